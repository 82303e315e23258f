"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. A distributed randomised SVD of the passages' TF-IDF
matrix gives a latent space; passages near a benchmark item there (by cosine) are candidates, and a longest common
subsequence and a check for the item's rarest words (its answer) decide. Only words of the benchmark can
contribute to a match, so the matrix has one column for each of them, and its size is bounded by the query set. The vocabulary, the
weights and the space are those of the whole benchmark, however its items are dealt into blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrays import first_of_runs, giving_back, sorted_distinct
from quillgraph.runtime import materialise

#: Words of a passage, and of the step from one passage to the next.
PASSAGE, STEP = 32, 16
#: Dimensions of the latent space.
DIMENSIONS = 96
#: Least cosine of a candidate, least share of an item's words in a common subsequence, least share of its answer words.
COSINE, COMMON, ANSWER = 0.3, 0.6, 0.375
#: Words of an item that count as its answer: the rarest.
ANSWER_WORDS = 8
#: Stop words: words in a larger share of all passages, unless they are among the rarest of an item. In a space of few dimensions
#: they would drown the others, and all passages of a language would be near each other.
COMMON_WORD = 0.005
KEPT_WORDS = 8
#: Words of the documents that a task holds at once (or one long document): their vectors should fit into a processor's cache.
PART_WORDS = 20_000
#: Benchmark items of one pass over the passages.
BLOCK = 5000
#: Largest list of contaminated texts that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
SEED = 20240229
WORD = re.compile(r"[^\W_]+")

HIT = "doc_id long, item_id long, first_word long, last_word long, cosine double, common double, answer double"


def split_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORD.findall((text or "").lower())


def _encode(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, words): each document as the ids of its words, -1 for words of no item; without any known word, none."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known.value.get
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = split_words(value.as_py())
                row = np.fromiter(map(ids, found, repeat(-1)), np.int32, len(found))
                rows.append(row.tobytes() if (row >= 0).any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "words"])

    return docs.mapInArrow(giving_back(run), "doc_id long, words binary").where("words is not null")


@dataclass
class _Part:
    """Some documents and the distinct useful words of their passages."""

    ids: list
    words: list[np.ndarray]
    doc: np.ndarray  # of each passage that has a useful word: its document's place in ids
    first: np.ndarray  # its first word
    passage: np.ndarray  # of each entry
    word: np.ndarray  # of each entry
    outside: np.ndarray  # words of each passage that no item holds
    passages: int  # all passages of these documents


def _part(ids: list, words: list[np.ndarray], known: np.ndarray) -> _Part:
    sizes = np.array([len(w) for w in words])
    last = np.maximum(0, -(-(sizes - PASSAGE) // STEP))
    base = np.cumsum(last + 1) - last - 1
    flat = np.concatenate(words)
    at = np.flatnonzero((flat >= 0) & known[flat])
    start = np.cumsum(sizes) - sizes
    doc = np.searchsorted(start, at, side="right") - 1
    number = (at - start[doc]) // STEP
    keys = []
    for back in range(PASSAGE // STEP):
        fits = (number >= back) & (number - back <= last[doc])
        keys.append((base[doc[fits]] + number[fits] - back) << 32 | flat[at[fits]].astype(np.int64))
    key = sorted_distinct(np.concatenate(keys))
    new = first_of_runs(key >> 32)
    number, dense = key[new] >> 32, np.cumsum(new) - 1
    owner = np.searchsorted(base, number, side="right") - 1
    first = (number - base[owner]) * STEP
    strange = np.concatenate([[0], np.cumsum(flat < 0)])
    low = start[owner] + first
    outside = strange[np.minimum(low + PASSAGE, start[owner] + sizes[owner])] - strange[low]
    return _Part(ids, words, owner, first, dense, key & 0xFFFFFFFF, outside, int((last + 1).sum()))


def _parts(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[_Part]:
    """Groups of documents with a bounded number of words (or one long document)."""
    for batch in batches:
        ids, words, held = [], [], 0
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc)
            words.append(np.frombuffer(value.as_py(), np.int32))
            held += len(words[-1])
            if held > PART_WORDS:
                yield _part(ids, words, known)
                ids, words, held = [], [], 0
        if ids:
            yield _part(ids, words, known)


def _near(part: _Part, weight: np.ndarray, scaled: np.ndarray, targets: np.ndarray, strange: float) -> np.ndarray:
    """Cosines of passages and items: in the latent space, with one more dimension for the words that no item holds.

    Each of those weighs ``strange``; without them a passage that shares a single word with the benchmark would be near its items.
    """
    image, _ = _weighted(part.passage, part.word, len(part.first), weight, scaled)
    image /= np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-12)
    mass = np.bincount(part.passage, weight[part.word] ** 2, len(part.first))
    image *= np.sqrt(mass / (mass + strange**2 * part.outside))[:, None].astype(np.float32)
    return image @ targets.T


def _weighted(passage: np.ndarray, word: np.ndarray, count: int, weight: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length-normalised TF-IDF rows times the basis (given times the weights), and the rows' lengths before."""
    norm = np.maximum(np.sqrt(np.bincount(passage, weight[word] ** 2, count)), 1e-12)
    image = np.add.reduceat(scaled[word], np.flatnonzero(first_of_runs(passage)), axis=0)
    return image / norm[:, None].astype(np.float32), norm


def _frequencies(encoded: DataFrame, size: int) -> np.ndarray:
    """Passages of the whole corpus that hold each word; the last entry counts all passages."""

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        known = np.ones(size, bool)
        for part in _parts(batches, known):
            total[:size] += np.bincount(part.word, minlength=size)
            total[size] += part.passages
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    out = np.zeros(size + 1)
    for row in encoded.mapInArrow(giving_back(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row for each word of the benchmark
        out[row["word"]] = row["n"]
    return out


def _gather(encoded: DataFrame, weight: np.ndarray, basis: np.ndarray, wide: bool) -> np.ndarray:
    """Sum over passages of a^T (a B) if ``wide``, else of (a B)^T (a B), for TF-IDF rows a and the basis B.

    Each task adds up its own passages, so what is shuffled is one small matrix for each task.
    """
    held = encoded.sparkSession.sparkContext.broadcast((weight, basis.astype(np.float32)))
    rows, columns = (len(weight) if wide else basis.shape[1]), basis.shape[1]

    def run(batches):
        weight, basis = held.value
        scaled = basis * weight[:, None].astype(np.float32)
        known, total = weight > 0, np.zeros((rows, columns))
        for part in _parts(batches, known):
            if not len(part.first):
                continue
            image, norm = _weighted(part.passage, part.word, len(part.first), weight, scaled)
            if wide:
                order = np.argsort(part.word, kind="stable")
                word = part.word[order]
                cut = np.flatnonzero(first_of_runs(word))
                image /= norm[:, None].astype(np.float32)
                total[word[cut]] += np.add.reduceat(image[part.passage[order]], cut, axis=0) * weight[word[cut], None]
            else:
                total += image.T @ image
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[k].astype(np.float32).tobytes() for k in at], pa.binary())], names=["row", "part"])

    def add(batches):
        # rows arrive sorted: add up one at a time
        now, total = None, None
        for batch in batches:
            keys, parts = [], []
            for row, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row != now:
                    if now is not None:
                        keys.append(now)
                        parts.append(total.tobytes())
                    now, total = row, np.zeros(columns)
                total = total + np.frombuffer(part, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], names=["row", "part"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["row", "part"])

    out = np.zeros((rows, columns))
    summed = encoded.mapInArrow(giving_back(run), "row long, part binary").repartition("row").sortWithinPartitions("row").mapInArrow(giving_back(add), "row long, part binary")
    for row in summed.collect():  # one row for each word or dimension
        out[row["row"]] = np.frombuffer(row["part"])
    return out


@dataclass
class Space:
    """Weights of the benchmark's words and their places in the latent space."""

    weight: np.ndarray
    basis: np.ndarray
    strange: float  # the weight of a word that no item holds: the mean of the others


def latent_space(encoded: DataFrame, size: int, items: list[list[int]], dimensions: int = DIMENSIONS) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages: a random range, one power step, then the small problem."""
    count = _frequencies(encoded, size)
    passages = max(count[size], 1)
    weight = np.log((passages + 1) / (count[:size] + 1)) + 1
    telling = count[:size] <= COMMON_WORD * passages
    for words in items:
        telling[sorted(set(words), key=lambda w: (count[w], w))[:KEPT_WORDS]] = True
    weight[~telling] = 0
    wide = min(dimensions, size)
    start = np.random.default_rng(SEED).standard_normal((size, wide))
    span, _ = np.linalg.qr(_gather(encoded, weight, start, wide=True) + 1e-9 * start)
    small = _gather(encoded, weight, span, wide=False)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return Space(weight, (span @ turn[:, ::-1]).astype(np.float32), float(weight[telling].mean()))


def common_subsequence(a: list | np.ndarray, b: list | np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if hit := places.get(y):
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _search(encoded: DataFrame, space: Space, items: list[tuple[int, list[int]]]) -> DataFrame:
    held = encoded.sparkSession.sparkContext.broadcast((space, items))

    def run(batches):
        space, items = held.value
        weight, known = space.weight, space.weight > 0
        scaled = space.basis * weight[:, None].astype(np.float32)
        vectors, answers = [], []
        for _, words in items:
            distinct = np.unique(words).astype(np.int64)
            vectors.append(scaled[distinct].sum(0))
            answers.append(set(sorted((int(w) for w in distinct), key=lambda w: (-weight[w], w))[:ANSWER_WORDS]))
        targets = np.array(vectors, np.float32).reshape(len(items), -1)
        targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
        for part in _parts(batches, known):
            out = []
            if not len(part.first):
                continue
            doc, first = part.doc, part.first
            near = _near(part, weight, scaled, targets, space.strange)
            best: dict[tuple, tuple] = {}
            for at, item in zip(*np.nonzero(near >= COSINE), strict=True):
                wanted, words = items[item][1], part.words[doc[at]]
                low = max(0, int(first[at]) - len(wanted))
                text = words[low : int(first[at]) + PASSAGE + len(wanted)].tolist()
                answer = len(answers[item] & set(text)) / max(1, len(answers[item]))
                share = common_subsequence(wanted, text) / len(wanted)
                if share >= COMMON and answer >= ANSWER:
                    found = (share, answer, float(near[at, item]), -low, low + len(text))
                    key = int(doc[at]), int(item)
                    best[key] = max(best.get(key, found), found)
            out = [(part.ids[d], items[k][0], -b[3], b[4], b[2], b[0], b[1]) for (d, k), b in sorted(best.items())]
            types = [pa.int64()] * 4 + [pa.float64()] * 3
            names = [c.split()[0] for c in HIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return encoded.mapInArrow(giving_back(run), HIT)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, cosine, common, answer): one row for each contaminated document and item.

    ``first_word`` and ``last_word`` bound the words of the document in which the item was found. The benchmark is the
    query set: it is taken in blocks of ``block`` items, each held against all passages of all documents; the block size
    changes no result. Documents that no row names are clean. Null and empty texts and items match nothing; a row of ``docs`` that
    repeats an id repeats its hits; rows without an id are searched like any other; items that repeat an id or a text are
    searched one by one; other columns are left out, so their names cannot clash. No rows on either side give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    items = [(row["item_id"], words) for row in rows.orderBy("item_id", "text").toLocalIterator() if (words := split_words(row["text"]))]
    if not items:
        return spark.createDataFrame([], HIT)
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    coded = [(number, [vocabulary[w] for w in words]) for number, words in items]
    encoded = materialise(_encode(texts, vocabulary), "passages")
    space = latent_space(encoded, len(vocabulary), [words for _, words in coded])
    found = None
    for at in range(0, len(coded), block):
        hits = _search(encoded, space, coded[at : at + block])
        found = hits if found is None else found.union(hits)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose texts no benchmark item was found, with all their columns.

    Rows are judged by their texts alone: equal texts go or stay together, whatever their ids, which may be null or repeated. Null
    texts stay. The names of the columns are free.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = held.withColumn("key", F.xxhash64(F.col("row").getField(text_col)))
    texts = held.select("key", F.col("row").getField(text_col).alias("text"))
    hits = materialise(find_contaminated(texts, benchmark, "key", "text").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    few = hits.count() <= BROADCAST_ROWS
    clean = held.join(F.broadcast(hits) if few else hits, "key", "left_anti")
    return clean.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
