"""Packing of tokenised documents into sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder. The remainders' lengths form a histogram; a
linear program over cutting patterns of that histogram is solved by column generation, in which a knapsack
dynamic program prices columns. The rounded patterns are then dealt to the documents by their rank within each length.
Only the histogram, whose size does not depend on the data, comes to the driver.
"""

from __future__ import annotations

import os
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm.arrays import first_of_runs, giving_back
from quillgraph.runtime import materialise

SEQUENCE = 2048
#: Lengths are rounded up to a multiple of this in the linear program.
GRAIN = 8
END_ID = 1
#: The linear program stops when it is provably so close to its optimum.
GAP = 5e-4
MAX_COLUMNS = 20_000
#: Weight of the stable prices against the simplex prices when a column is priced.
PULL = 0.8
#: Classes of the signs of Latin-1 by their numbers, as the vocabulary's splitter sees them.
SPACE, LETTER, NUMBER, OTHER = range(4)
CLASSES = np.array([SPACE if c.isspace() else LETTER if c.isalpha() else NUMBER if c.isnumeric() else OTHER for c in map(chr, range(256))], np.uint8)
#: Stands for a word beyond Latin-1; texts that hold this sign are encoded whole.
BEYOND = "\x1c"
CLASSES[ord(BEYOND)] = NUMBER
#: Pieces whose ids a worker remembers.
REMEMBERED = 200_000
#: Pieces of one length are ranked in groups of about so many.
RANKED = 2000

PIECE = "doc_id long, doc_tokens long, start long, length long, ids binary"


def _sign(byte: int) -> str:
    """The printable sign that a byte-level vocabulary writes for a byte from 128 on."""
    if 0xA1 <= byte <= 0xFF and byte != 0xAD:
        return chr(byte)
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return chr(256 + hidden.index(byte))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _starts(signs: np.ndarray) -> np.ndarray:
    """Whether a piece or white space starts at each sign of a lower-cased text, given as Latin-1: runs of letters or other signs, and single numbers.

    ``'s 't 'm 'd 're 've 'll`` after anything but an other sign are pieces, and what is left of their word is one more. The text ends with three blanks.
    """
    kind = CLASSES[signs]
    starts = first_of_runs(kind) | (kind == NUMBER)
    at = np.flatnonzero((signs == ord("'")) & starts)
    at = at[at < len(signs) - 3]
    at = at[kind[at + 1] == LETTER]
    one, two = signs[at + 1], signs[at + 2]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    held = long | np.isin(one, np.frombuffer(b"stmd", np.uint8))
    at, rest = at[held], at[held] + 2 + long[held]
    starts[at + 1] = False
    starts[rest] |= kind[rest] == LETTER
    return starts


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's normaliser and splitter never look across white space, so the ids of a text are
    those of its words. Words of Latin-1 are lower-cased sign by sign and split where the classes of their signs change, for some texts at once; their pieces go to the
    vocabulary's merges. Other words take the tokenizer's whole way. A piece is encoded once for as long as it is remembered: the distinct pieces of some texts are
    looked up once, and the texts' ids are gathered from theirs in one step. Texts in which white space or special tokens could be understood differently are encoded whole.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.known: dict[bytes | str, bytes] = {}
        self.again: set[bytes | str] = set()
        # the vocabulary spells other than printable ASCII by a sign for each byte
        self.spelled = {k: "".join(map(_sign, chr(k).encode())) for k in range(256) if not 0x20 <= k < 0x7F}

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = (texts[at : at + 2048] for at in range(0, len(texts), 2048))
        return [array("I", e.ids).tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _ready(self, text: str, beyond: list[str]) -> str | None:
        """The text in lower case, its words beyond Latin-1 moved to ``beyond``; None if it is to be encoded whole."""
        if any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.special)):
            return None
        if _latin(text):
            return text.lower()
        words = text.split()
        plain = [_latin(w) for w in words]
        beyond += [w for w, p in zip(words, plain, strict=True) if not p]
        return " ".join([w.lower() if p else BEYOND for w, p in zip(words, plain, strict=True)])

    def _learn(self, pieces: list[bytes | str]) -> None:
        known = self.known
        unseen = [p for p in pieces if p not in known]
        self.again.update(set(pieces).difference(unseen))
        if len(known) + len(unseen) > REMEMBERED:
            # most pieces never come again: those that did since the last time stay, if they leave room
            stay = self.again if 2 * len(self.again) <= REMEMBERED else self.again.intersection(pieces)
            self.known = known = {p: known[p] for p in stay}
            self.again = set()
            unseen = [p for p in pieces if p not in known]
        tokenize = self.tokenizer.model.tokenize
        new = [p for p in unseen if isinstance(p, bytes)]
        for some in ([p for p in new if p.isascii()], [p for p in new if not p.isascii()]):
            spelled = b" ".join(some).decode("latin-1").translate(self.spelled).split(" ")
            known.update((p, array("I", [t.id for t in tokenize(s)]).tobytes()) for p, s in zip(some, spelled, strict=False))
        words = [p for p in unseen if isinstance(p, str)]
        known.update(zip(words, self._encode(words), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        beyond: list[str] = []
        ready = [self._ready(t or "", beyond) for t in texts]
        signs = np.frombuffer("\n".join([*(r or "" for r in ready), "\n\n"]).encode("latin-1"), np.uint8)
        held = CLASSES[signs] != SPACE
        starts = np.flatnonzero(_starts(signs) & held)
        places = np.append(np.cumsum(held)[starts] - 1, held.sum())
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(signs[held])]).dictionary_encode()
        which, pieces = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if beyond:
            number = {w: len(pieces) + k for k, w in enumerate(dict.fromkeys(beyond))}
            which = which.copy()
            which[which == pieces.index(BEYOND.encode())] = [number[w] for w in beyond]
            pieces += number
        # the sign itself is no piece
        self._learn([p for p in pieces if p != BEYOND.encode()])
        ids = [self.known.get(p, b"") for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = lengths[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        # where a piece's ids begin among the distinct ones, less where they begin in the texts
        shift = (np.cumsum(lengths) - lengths)[which] - ends[:-1]
        found = np.frombuffer(b"".join(ids), "<u4")[np.repeat(shift, n) + np.arange(ends[-1])].tobytes()
        first = np.cumsum([0, *(len(r or "") + 1 for r in ready)])
        bounds = (4 * ends[np.searchsorted(starts, first)]).tolist()
        return [(found[a:b] if r is not None else self._encode([t])[0]) + self.end for t, r, a, b in zip(texts, ready, bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[tuple, WordEncoder] = {}


def tokenise(docs: DataFrame, path: str, end_id: int | None = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``sequence`` ids of every document: doc_id, doc_tokens, start, length, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, end_id)
        encoder = _encoders.get(key) or _encoders.setdefault(key, WordEncoder(path, end_id))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    total = len(ids) // 4
                    rows += [(doc, total, k, min(sequence, total - k), ids[4 * k : 4 * (k + sequence)]) for k in range(0, total, sequence)]
                if rows:
                    types = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=["doc_id", "doc_tokens", "start", "length", "ids"])

    return docs.mapInArrow(giving_back(run), PIECE)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of most worth, and that worth."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(sizes, room, side="right")
        if n:
            gain = best[room - sizes[:n]] + worth[:n]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], took[room] = gain[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def solve_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Integer pattern counts that cover the demand exactly: [({size: copies}, times)].

    The linear program min sum(x), A x = d, x >= 0 is solved by the revised simplex method; each
    column enters by the knapsack above, until a dual bound proves the gap small. Counts are rounded down and what
    remains (at most one pattern's worth for each size) is packed best-fit, longest first.
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([demand[k] for k in sizes], float)
    fit = capacity // sizes
    columns = np.diag(fit.astype(float))
    inverse, amount = np.diag(1.0 / fit), need / fit
    # dual prices proportional to size are feasible and near the optimum: columns are priced between them
    # and the simplex prices, which keeps the path short; the best bound so far proves the gap
    centre, bound, pull = sizes / capacity, float(need @ sizes) / capacity, PULL
    for _ in range(MAX_COLUMNS):
        if amount.sum() <= bound * (1 + GAP):
            break
        worth = inverse.sum(0)
        mixed = pull * centre + (1 - pull) * worth
        value, column = best_pattern(sizes, np.maximum(mixed, 0), capacity)
        if (lower := float(need @ mixed) / max(1.0, value)) > bound:
            centre, bound = mixed / max(1.0, value), lower
        if float(worth @ column) <= 1 + 1e-9:
            if pull == 0:
                break
            pull = pull / 2 if pull > 0.05 else 0
            continue
        pull = PULL
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        amount = np.maximum(amount - step * direction, 0)
        amount[leave] = step
        columns[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
    times = np.floor(amount + 1e-7)
    left = need - columns @ times
    while (left < -0.5).any():
        worst = int(left.argmin())
        times[int(np.argmax((columns[worst] > 0) * times))] -= 1
        left = need - columns @ times
    found = [({int(s): int(n) for s, n in zip(sizes, columns[:, k], strict=True) if n}, int(times[k])) for k in range(len(times)) if times[k] > 0]
    rooms: dict[int, list[Counter]] = defaultdict(list)
    for size, n in zip(sizes[::-1].tolist(), np.rint(left[::-1]).astype(int).tolist(), strict=True):
        for _ in range(n):
            room = next((r for r in range(size, capacity + 1) if rooms[r]), None)
            pattern = rooms[room].pop() if room is not None else Counter()
            pattern[size] += 1
            rooms[(capacity if room is None else room) - size].append(pattern)
    same = Counter(tuple(sorted(p.items())) for held in rooms.values() for p in held)
    return found + [(dict(p), n) for p, n in sorted(same.items())]


@dataclass
class Packed:
    """``tokens``: the pieces with their ids. ``pieces``: where each of them lies."""

    tokens: DataFrame
    pieces: DataFrame
    sequence: int = SEQUENCE

    def sequences(self) -> DataFrame:
        """(sequence_id, ids) with the ids of each sequence in order, little-endian, without padding."""
        rows = self.pieces.select("piece_id", "sequence_id", "offset").join(self.tokens.select("piece_id", "ids"), "piece_id")
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
        return rows.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int | None = END_ID, sequence: int = SEQUENCE, grain: int = GRAIN) -> Packed:
    """Pack every document into sequences of at most ``sequence`` ids.

    A document's ids (null text: none) and then ``end_id`` are cut into full sequences and a remainder; every id
    lies in exactly one piece. A document without any id gives no piece. Rows with null or repeated ids are
    documents of their own: pieces are told apart by ``piece_id``. Other columns are left out, so their names
    cannot clash. No rows give no pieces.
    """
    if sequence % grain:
        raise ValueError("the grain divides the sequence length")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = materialise(tokenise(docs, tokenizer, end_id, sequence).withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    slim = tokens.select("piece_id", "doc_id", "doc_tokens", "start", "length").withColumn("size", F.ceil(F.col("length") / grain))
    counted = slim.groupBy("size").count().collect()  # at most sequence / grain rows
    total = sum(r["count"] for r in counted)
    plan, first, cursor = [], 0, Counter()
    for pattern, times in solve_patterns({int(r["size"]): r["count"] for r in counted}, sequence // grain):
        for place, (size, copies) in enumerate(sorted(pattern.items(), reverse=True)):
            plan.append((size, cursor[size], cursor[size] + times * copies, copies, first, place))
            cursor[size] += times * copies
        first += times
    plan = df.sparkSession.createDataFrame(plan, "size long, low long, high long, copies long, first long, place long")
    # rank within a size: a running number within small groups of it, after the groups before
    dealt = slim.withColumn("part", F.pmod(F.xxhash64("piece_id"), F.lit(max(1, total // RANKED))))
    before = dealt.groupBy("size", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("size", "part").orderBy("length", "doc_id", "piece_id")))
    ranked = ranked.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # the plan's rows are patterns of the histogram: bounded by the number of sizes, not by the data
    placed = ranked.join(F.broadcast(plan), (ranked["size"] == plan["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(plan["size"])
    nth = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("copies"))).withColumn("order", F.col("place") * (sequence // grain + 1) + nth % F.col("copies"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("order")) - F.col("length")
    pieces = placed.withColumn("offset", offset).select("piece_id", "doc_id", "doc_tokens", "start", "length", "sequence_id", "offset")
    return Packed(tokens, pieces, sequence)
