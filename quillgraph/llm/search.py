"""Exact top-k search: a sharded inverted index, BM25, and block-max WAND.

Every task turns its documents into shards of bounded size, each with its own inverted index, in which blocks of postings carry what
bounds their scores. Term frequencies over all documents, their number and their mean length are global, so scores do not depend on
the shards. All terms of a query count. Queries visit each shard in blocks: short ones with block-max WAND, which skips documents that
cannot reach the k-th score so far; long ones, for which no bound is tight, by adding up all their postings.

Shards are visited in rounds, each with about three times as many as all before it. What a query has found after a round is a threshold for the
next one, so a round adds about 3 k documents to a query, whatever the number of shards. All of it merges to the exact top k.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialise, scratch_path

K1, B = 1.2, 0.75
#: Postings of a block with its own score bound.
BLOCK = 64
#: Shards of the first round, about; most rounds.
FIRST_SHARDS, LEVELS = 8, 30
#: A shard holds at most so many postings (or one document more).
SHARD_POSTINGS = 500_000
#: Queries of at most so many terms in a shard are answered by block-max WAND, longer ones by adding up all postings.
WAND_TERMS = 8
TOP = 10
#: Query terms that are held against the index at once.
QUERY_BLOCK = 1_000_000
#: Scores, and postings, that a shard works on at once.
CELLS, PIECE = 2_000_000, 500_000
#: A product of full matrices takes about this part of the time of adding up one posting.
DENSE = 256
#: Contributions are multiples of this, so sums of them are exact in any order and copies of a document tie.
QUANTUM = 2.0**-34
REMEMBERED = 200_000

INDEX = "level int, shard long, n long, ids binary, lengths binary, terms binary, counts binary, postings binary, bounds binary"
_POSTING = np.dtype([("doc", "<u4"), ("tf", "<u4")])
#: The largest frequency and the smallest length of a block: no posting of the block weighs more than they do together.
_BOUND = np.dtype([("tf", "<u4"), ("length", "<i8")])


def terms_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits of the whole text."""
    text = (text or "").lower()
    return re.findall("[a-z0-9]+", text) if text.isascii() else regex.findall(r"[\p{L}\p{N}]+", text)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return value


def _bag(text: str | None, hashes: dict) -> tuple[np.ndarray, np.ndarray, int]:
    found = terms_of(text)
    ids, tf = np.unique(np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)), return_counts=True)
    return ids, tf.astype("<u4"), len(found)


def _slices(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each slice, one slice after the other."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _level(shard: int) -> int:
    """Half of all shards have level 0, a quarter level 1 and so on."""
    mixed = xxhash.xxh64_intdigest(shard.to_bytes(8, "little")) | 1 << LEVELS - 1
    return (mixed & -mixed).bit_length() - 1


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard from (doc_id, text).

    ``ids`` and ``lengths`` are of its ``n`` documents, ``terms`` are sorted, each with its number of postings in ``counts``;
    ``postings`` holds local document numbers and frequencies, term after term, and ``bounds`` what bounds each block of them.
    ``level`` tells the round. Texts without words are indexed too; rows without an id are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, made = _Hashes(), TaskContext.get().partitionId(), 0
        ids, lengths, terms, freqs, held = [], [], [], [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            number = task << 20 | made
            local = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(t) for t in terms])
            term, freq = np.concatenate(terms), np.concatenate(freqs)
            terms.clear()
            freqs.clear()
            order = np.argsort(term, kind="stable")
            term, postings = term[order], np.empty(len(order), _POSTING)
            postings["doc"], postings["tf"] = local[order], freq[order]
            found, counts = np.unique(term, return_counts=True)
            blocks = -(-counts // BLOCK)
            first = np.repeat(np.cumsum(counts) - counts, blocks) + BLOCK * _slices(np.zeros(len(blocks), np.int64), blocks)
            bounds = np.empty(len(first), _BOUND)
            if len(first):
                bounds["tf"] = np.maximum.reduceat(postings["tf"], first)
                bounds["length"] = np.minimum.reduceat(np.array(lengths, np.int64)[postings["doc"]], first)
            parts = [np.array(ids, "<i8"), np.array(lengths, "<i8"), found.astype("<i8"), counts.astype("<i8"), postings, bounds]
            yield pa.RecordBatch.from_arrays([pa.array([_level(number)], pa.int32()), pa.array([number]), pa.array([len(ids)]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc is None:
                    continue
                term, tf, length = _bag(value.as_py(), hashes)
                ids.append(doc)
                lengths.append(length)
                terms.append(term)
                freqs.append(tf)
                held += len(term)
                if held >= SHARD_POSTINGS:
                    yield from shard()
                    ids, lengths, terms, freqs, held, made = [], [], [], [], 0, made + 1
        if ids:
            yield from shard()

    return docs.mapInArrow(run, INDEX)


def write_index(index: DataFrame) -> DataFrame:
    """The index in the shared folder, by level, so that a round reads its own shards only."""
    path = scratch_path(index.sparkSession, "search-index")
    index.write.partitionBy("level").parquet(path)
    return index.sparkSession.read.schema(INDEX).parquet(path)


def query_bags(queries: DataFrame) -> DataFrame:
    """(query_id, term, tf) of the distinct terms of whole query texts."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for query, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                term, tf, _ = _bag(value.as_py(), hashes)
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(term), pa.int64()), pa.array(term, pa.int64()), pa.array(tf.astype(np.int64))], names=["query_id", "term", "tf"])

    return queries.mapInArrow(run, "query_id long, term long, tf long")


def impact(tf, length, mean: float):
    """What a term's frequency in a document contributes, before its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _gains(weight, tf, length, mean: float):
    """Contributions of postings: whole multiples of the quantum, so sums don't depend on their order."""
    return np.maximum(np.round(weight * impact(tf, length, mean) / QUANTUM), 1) * QUANTUM


class Postings:
    """One term in one shard, as lists that all queries read: documents, contributions, and the bound and last document of each block."""

    def __init__(self, weight: float, postings: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, mean: float):
        self.docs = postings["doc"].tolist()
        self.gains = _gains(weight, postings["tf"].astype(float), lengths[postings["doc"]], mean).tolist()
        self.bounds = _gains(weight, bounds["tf"].astype(float), bounds["length"], mean).tolist()
        self.lasts = [*self.docs[BLOCK - 1 : len(self.docs) - 1 : BLOCK], self.docs[-1]]
        self.whole = max(self.bounds)


class Cursor:
    """How far a query has read a term's postings."""

    __slots__ = ("at", "doc", "of", "whole")

    def __init__(self, of: Postings):
        self.of, self.at, self.doc, self.whole = of, 0, of.docs[0], of.whole

    def seek(self, doc: int) -> bool:
        """Move to the first posting at or after a document; whole blocks are passed over by their last documents."""
        of = self.of
        block = bisect_left(of.lasts, doc, self.at // BLOCK)
        if block == len(of.lasts):
            self.at = len(of.docs)
            return False
        self.at = bisect_left(of.docs, doc, max(self.at, block * BLOCK), min((block + 1) * BLOCK, len(of.docs)))
        self.doc = of.docs[self.at]
        return True

    def block(self, doc: int) -> tuple[float, int]:
        """Bound and last document of the block that would hold a document, without reading it; (0, -1) if there is none."""
        at = bisect_left(self.of.lasts, doc, self.at // BLOCK)
        return (self.of.bounds[at], self.of.lasts[at]) if at < len(self.of.lasts) else (0.0, -1)


def block_max_wand(cursors: list[Cursor], k: int, ids: np.ndarray, floor: float = -1.0) -> list[tuple[float, int]]:
    """The k best (score, id) of one shard with a score of at least ``floor``.

    Documents are met in order; the pivot is the first one that the terms' bounds let reach the k-th score so far, and the blocks
    around it must let it too. Equal scores are won by smaller ids, so only what falls below the k-th score is skipped.
    """
    heap: list[tuple[float, int]] = []
    slack, live = 1e-9, list(cursors)
    while live:
        live.sort(key=lambda c: c.doc)
        least = max(floor, heap[0][0] if len(heap) == k else -1.0) - slack
        total, pivot = 0.0, -1
        for n, c in enumerate(live):
            total += c.whole
            if total >= least:
                pivot = n
                break
        if pivot < 0:
            break
        doc = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == doc:
            pivot += 1
        close, until = 0.0, live[pivot + 1].doc if pivot + 1 < len(live) else None
        for c in live[: pivot + 1]:
            bound, last = c.block(doc)
            close += bound
            if last >= 0:
                until = last + 1 if until is None else min(until, last + 1)
        if close >= least:
            move = doc
            if live[0].doc == doc:
                score = sum(c.of.gains[c.at] for c in live[: pivot + 1])
                entry = (score, -int(ids[doc]))
                if score >= floor and len(heap) < k:
                    heapq.heappush(heap, entry)
                elif score >= floor and entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                move = doc + 1
        else:
            move = max(doc + 1, until if until is not None else doc + 1)
        live = [c for n, c in enumerate(live) if n > pivot or c.doc >= move or c.seek(move)]
    return sorted(((s, -i) for s, i in heap), key=lambda x: (-x[0], x[1]))


@dataclass
class Block:
    """Queries and their terms: ``at`` of each entry is the query's place in ``queries``, ``column`` the term's in ``terms`` (sorted)."""

    queries: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    column: np.ndarray
    floors: np.ndarray  # the least score of each query that still counts


def block_of(rows: pa.Table, floors: dict[int, float]) -> Block:
    query, term, weight = (rows.column(c).to_numpy() for c in ("query_id", "term", "weight"))
    order = np.lexsort((term, query))
    queries, at = np.unique(query[order], return_inverse=True)
    terms, first, column = np.unique(term[order], return_index=True, return_inverse=True)
    return Block(queries, terms, weight[order][first], at.astype(np.int32), column.astype(np.int32), np.array([floors.get(q, 0.0) for q in queries.tolist()]))


def score_shard(block: Block, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, bounds: np.ndarray, mean: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, documents, scores) of the k best documents of one shard for each query of a block, if they reach its floor.

    Terms that many queries and many documents hold are added up as a product of full matrices, the others posting by posting.
    """
    if not len(terms) or not len(block.queries):
        return
    place = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    here = terms[place] == block.terms
    size = np.where(here, counts[place], 0)
    source = (np.cumsum(counts) - counts)[place]
    kept = here[block.column]
    at, column, n = block.at[kept].astype(np.int64), block.column[kept].astype(np.int64), len(ids)
    held = np.bincount(at, minlength=len(block.queries))
    short = held <= WAND_TERMS
    ends = np.cumsum(held)
    blocks = -(-counts // BLOCK)
    mark = (np.cumsum(blocks) - blocks)[place]
    read: dict[int, Postings] = {}
    for q in np.flatnonzero(short & (held > 0)).tolist():
        cursors = []
        for c in column[ends[q] - held[q] : ends[q]].tolist():
            if c not in read:
                read[c] = Postings(float(block.weights[c]), postings[source[c] : source[c] + size[c]], bounds[mark[c] : mark[c] + blocks[place[c]]], lengths, mean)
            cursors.append(Cursor(read[c]))
        best = block_max_wand(cursors, k, ids, float(block.floors[q]))
        if best:
            yield np.full(len(best), block.queries[q]), np.array([d for _, d in best], np.int64), np.array([x for x, _ in best])
    # the others: every posting of their terms
    size[np.setdiff1d(np.arange(len(size)), column[~short[at]])] = 0
    begin = np.cumsum(size) - size
    doc, gain, upto, low = np.empty(size.sum(), np.int32), np.empty(size.sum()), np.cumsum(size), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(upto, begin[low] + PIECE, "right")))
        found, own = postings[_slices(source[low:high], size[low:high])], slice(begin[low], upto[high - 1])
        doc[own] = found["doc"]
        gain[own] = _gains(np.repeat(block.weights[low:high], size[low:high]), found["tf"].astype(float), lengths[found["doc"]], mean)
        low = high
    many = np.bincount(column, minlength=len(block.terms)) * size * DENSE > len(block.queries) * n
    long = np.flatnonzero(~short)
    step = max(1, CELLS // n)
    for low in range(0, len(long), step):
        group = long[low : low + step]
        entries = _slices((ends - held)[group], held[group])
        row, col = np.repeat(np.arange(len(group)), held[group]), column[entries]
        scores = np.zeros((len(group), n))
        full = many[col]
        wide = np.unique(col[full])
        for start in range(0, len(wide), step):
            slab = wide[start : start + step]
            inside = full & (col >= slab[0]) & (col <= slab[-1])
            asked, table = np.zeros((len(group), len(slab))), np.zeros((len(slab), n))
            asked[row[inside], np.searchsorted(slab, col[inside])] = 1
            which = _slices(begin[slab], size[slab])
            table[np.repeat(np.arange(len(slab)), size[slab]), doc[which]] = gain[which]
            scores += asked @ table
        row, col = row[~full], col[~full]
        upto = np.cumsum(size[col])
        start = 0
        while start < len(col):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PIECE, "right")))
            r, c = row[start:stop], col[start:stop]
            which = _slices(begin[c], size[c])
            cell = np.repeat((r - r[0]) * n, size[c]) + doc[which]
            rows = r[-1] - r[0] + 1
            scores[r[0] : r[-1] + 1] += np.bincount(cell, gain[which], rows * n).reshape(rows, n)
            start = stop
        least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(group))
        least = np.maximum(least, block.floors[group])
        query, local = np.nonzero((scores >= least[:, None]) & (scores > 0))
        score = scores[query, local]
        order = np.lexsort((ids[local], -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = order[rank < k]
        yield block.queries[group[query[rank < k]]], ids[local[best]], score[best]


def _run_shards(index: DataFrame, block, mean: float, k: int) -> DataFrame:
    """(query_id, doc_id, score) of a broadcast block of queries on each shard."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                ids, lengths, terms, counts = (np.frombuffer(batch.column(c)[n].as_buffer(), "<i8") for c in range(4))
                postings, bounds = (np.frombuffer(batch.column(c)[n].as_buffer(), kind) for c, kind in ((4, _POSTING), (5, _BOUND)))
                for query, doc, score in score_shard(block.value, ids, lengths, terms, counts, postings, bounds, mean, k):
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "counts", "postings", "bounds").mapInArrow(run, "query_id long, doc_id long, score double")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (terms, counts)], names=["term", "n"])


def search(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id_col: str, query_text_col: str, k: int = TOP, query_terms: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the exact BM25 top ``k`` of every query over all documents.

    A query is the bag of all distinct terms of its whole text, each weighted by idf. With ``query_terms`` a caller asks for
    a shorter query: the terms with the largest idf times saturated frequency, ``tf (k1 + 1) / (tf + k1)`` (ties: the smaller term hash).
    Contributions are rounded to 2^-34. Ties in score are won by the smaller document
    id. Only documents that share a term with the query are returned, so a query may have fewer than ``k``.
    Queries with null or empty text, or without an id, return nothing; rows that repeat an id are documents
    (or, among queries, one query with the terms of all of them) of that id; other columns are left out, so their names
    cannot clash. No rows give no rows.
    """
    index = write_index(build_index(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    lengths = index.select("n", "lengths").mapInArrow(_sum_lengths, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("shards")).first()
    count, mean = lengths["n"] or 0, max((lengths["words"] or 0) / max(lengths["n"] or 1, 1), 1e-9)
    bags = query_bags(queries.where(F.col(query_id_col).isNotNull()).select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_text_col).alias("text")))
    bags = bags.groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))
    spread = index.select("terms", "counts").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = bags.join(spread, "term").withColumn("weight", weight)
    if query_terms is not None:
        telling = F.col("tf") * (K1 + 1) / (F.col("tf") + K1) * F.col("weight")
        best = Window.partitionBy("query_id").orderBy(telling.desc(), "term")
        weighted = weighted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= query_terms)
    chosen = materialise(weighted.select("query_id", "term", "weight"), "search-queries")
    blocks = max(1, -(-chosen.count() // QUERY_BLOCK))
    top = max(0, (lengths["shards"] // FIRST_SHARDS).bit_length() - 1)
    rounds = [index.where(F.col("level") >= top), *(index.where(F.col("level").between(level - 1, level)) for level in range(top - 1, -1, -2))]
    merged = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    answers = []
    for number in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()  # about QUERY_BLOCK rows
        best, floors = None, {}
        for shards in rounds:
            block = docs.sparkSession.sparkContext.broadcast(block_of(part, floors))
            found = _run_shards(shards, block, mean, k)
            found = (found if best is None else best.drop("rank").union(found)).withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
            best = materialise(found, "search-answers")
            block.destroy()
            floors = {row["query_id"]: row["score"] for row in best.where(F.col("rank") == k).toLocalIterator()}  # one row for each query of the block
        answers.append(best)
    found = answers[0]
    for more in answers[1:]:
        found = found.union(more)
    return found.select("query_id", "rank", "doc_id", "score")


def _sum_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, lengths in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = int(np.frombuffer(lengths.as_py(), "<i8").sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], names=["n", "words"])
