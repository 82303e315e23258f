"""Toxicity by two class-conditional Kneser-Ney bigram models.

One model is counted on toxic texts, one on ordinary texts. Both discount their counts and back off to the same
lower orders: bigrams to the class's unigrams, unigrams to counts that both classes share and that come from all texts of the corpus,
labelled or not, and words too rare to judge to one word that stands for all of them. A text is scored by the difference of its two
log-likelihoods for each word, over the whole text and over its most toxic expressions, put on a scale from 0 to 1 by a
logistic curve that is fitted on labelled texts which the counts have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrays import giving_back
from quillgraph.runtime import materialise

#: Labelled rows that are used at most (those with the smallest hashes), of each class.
MAX_ROWS = 20_000
#: A word or bigram in fewer labelled texts than this is rare: it is left to the shared backoff. The sample bounds the others.
RARE = 3
DISCOUNT = 0.75
#: Grams that a task counts before it hands them on.
HELD = 150_000
#: Distinct words that a text's most toxic expressions are taken from.
STRONGEST = 3
THRESHOLD = 0.7
START, OTHER = 0, 1


def _split(text: str | None) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


@dataclass
class Model:
    """Word ids, log-likelihood ratios of words, and those of bigrams under sorted keys."""

    ids: dict[str, int]
    word_ratio: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray  # discounted shares in ordinary, toxic and all texts
    backoff: np.ndarray  # after each word, of the same three
    unigram: np.ndarray  # of each class
    curve: np.ndarray  # bias, weights of the whole text, of the most toxic words, of the most toxic word

    def ratios(self, found: list[str]) -> np.ndarray:
        """log p(word | previous, toxic) - log p(word | previous, ordinary) for each word."""
        get = self.ids.get
        ids = np.fromiter((get(w, OTHER) for w in found), np.int64, len(found))
        before = np.concatenate([[START], ids[:-1]])
        key = before << 32 | ids
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        pair = np.where(hit, self.pairs[:, at], 0) if len(self.keys) else np.zeros((3, len(key)))
        p = [pair[c] + self.backoff[c][before] * (pair[2] + self.backoff[2][before] * self.unigram[c][ids]) for c in (0, 1)]
        return np.log(p[1]) - np.log(p[0])

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Mean ratio over the words of the whole text, over its few most toxic distinct words, and of the most toxic one.

        A word that a text repeats counts once among the most toxic ones. Shorter texts are padded with words that
        say nothing.
        """
        found = _split(text)
        if not found:
            return 0.0, 0.0, 0.0
        ratio = self.ratios(found)
        best: dict[str, float] = {}
        for k in np.argsort(-ratio, kind="stable"):
            best.setdefault(found[k], float(ratio[k]))
            if len(best) == STRONGEST or ratio[k] <= 0:
                break
        top = [max(v, 0.0) for v in best.values()]
        return float(ratio.mean()), sum(top) / STRONGEST, top[0]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counted(rows: DataFrame, grams, kind: pa.DataType, schema: str) -> DataFrame:
    """(gram, toxic, plain): texts of each class that hold a gram; ``grams(text)`` gives a text's distinct ones.

    A task adds up its own texts before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()

        def flush():
            keys = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())], names=["gram", "toxic", "plain"])
            held[0].clear()
            held[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[toxic].update(grams(text.as_py()))
                if len(held[0]) + len(held[1]) > HELD:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(giving_back(run), schema).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _corpus_counts(docs: DataFrame, ids: dict[str, int]) -> np.ndarray:
    """Texts of the whole corpus that hold each known word; under ``OTHER``, those that hold any other.

    A task adds up its own texts, so what is shuffled is bounded by the model's words.
    """
    known, size = docs.sparkSession.sparkContext.broadcast(ids), len(ids) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = known.value.get, np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = set(_split(text.as_py()))
                total[list({get(w, OTHER) for w in found})] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    out = np.zeros(size)
    for row in docs.mapInArrow(giving_back(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["word"]] = row["n"]
    return out


def train(data: DataFrame, corpus: DataFrame) -> Model | None:
    """Fit on (text, toxic, part): counts of the classes from rows with part 0, the logistic curve from rows with part 1.

    The shared backoff is counted over all texts of ``corpus`` (text). ``data`` is a bounded sample, so the model's size is bounded too,
    whatever the corpus. None if either class has no text to count.
    """
    counted = data.where("part = 0")
    sizes = {r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    singles = _counted(counted, lambda text: set(_split(text)), pa.string(), "gram string, toxic long, plain long")
    ones = singles.where(F.col("toxic") + F.col("plain") >= RARE).orderBy("gram").toPandas()
    ids = {w: k + 2 for k, w in enumerate(ones["gram"])}
    size = len(ids) + 2
    known = data.sparkSession.sparkContext.broadcast(ids)

    def pairs_of(text: str | None) -> set[int]:
        row = [START, *(known.value.get(w, OTHER) for w in _split(text))]
        return {a << 32 | b for a, b in zip(row, row[1:], strict=False) if a != OTHER and b != OTHER}

    def others_of(text: str | None) -> set[int]:
        return {OTHER} if any(w not in known.value for w in _split(text)) else set()

    pairs = _counted(counted, pairs_of, pa.int64(), "gram long, toxic long, plain long")
    pairs = pairs.where(F.col("toxic") + F.col("plain") >= RARE).orderBy("gram").toPandas()
    rest = _counted(counted, others_of, pa.int64(), "gram long, toxic long, plain long").collect()
    count = np.zeros((2, size))
    count[0, 2:], count[1, 2:] = ones["plain"], ones["toxic"]
    if rest:
        count[0, OTHER], count[1, OTHER] = rest[0]["plain"], rest[0]["toxic"]
    keys = pairs["gram"].to_numpy(np.int64)
    pair = np.stack([pairs["plain"].to_numpy(float), pairs["toxic"].to_numpy(float)])
    context = keys >> 32
    # shared backoff: how the whole corpus uses a word
    shared = _corpus_counts(corpus, ids) + 1.0
    shared[START] = 1e-9
    shared /= shared.sum()
    unigram = np.zeros((2, size))
    for c in (0, 1):
        total = max(count[c].sum(), 1)
        solid = np.maximum(count[c] - DISCOUNT, 0)
        unigram[c] = solid / total + (1 - solid.sum() / total) * shared
    # what a class has not seen after a word is shared out as in both classes together, and then as its own words are
    count, pair = np.vstack([count, count.sum(0)]), np.vstack([pair, pair.sum(0)])
    backoff, probability = np.ones((3, size)), np.zeros((3, len(keys)))
    for c in range(3):
        seen = np.maximum(count[c], 1.0)
        seen[START] = max(sum(sizes.values()) if c == 2 else sizes[c], 1)
        solid = np.maximum(pair[c] - DISCOUNT, 0)
        probability[c] = solid / np.maximum(seen[context], solid)
        used = np.bincount(context, probability[c], minlength=size)
        probability[c] /= np.maximum(used / 0.95, 1.0)[context]  # a text that holds a word can hold several of its pairs
        backoff[c] = np.maximum(1 - np.bincount(context, probability[c], minlength=size), 0.05)
    ratio = np.log(unigram[1]) - np.log(unigram[0])
    model = Model(ids, ratio, keys, probability, backoff, unigram, np.array([-8.0, 1.0, 1.0, 1.0]))
    held = data.where("part = 1").select(F.col("toxic").cast("long").alias("doc_id"), "text")
    points = _features(held, model).toPandas()  # at most the sample's rows
    if points["doc_id"].nunique() == 2:
        model.curve = _fit_curve(points[["whole", "few", "one"]].to_numpy(), points["doc_id"].to_numpy())
    return model


def _fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method; the weights are kept from turning negative."""
    data = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, fixed, n = np.zeros(data.shape[1]), np.zeros(data.shape[1], bool), data.shape[1]
    for _ in range(2 * rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        free = ~fixed
        gradient = data.T @ (p - y) + ridge * np.concatenate([[0], w[1:]])
        curvature = (data * (p * (1 - p))[:, None]).T @ data + (ridge + 1e-9) * np.eye(n)
        w[free] -= np.linalg.solve(curvature[np.ix_(free, free)], gradient[free])
        if (w[1:] < 0).any():
            fixed[1:] |= w[1:] < 0
            w[fixed] = 0
    return w


def _features(docs: DataFrame, model: Model) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([held.value.features(v.as_py()) for v in batch.column(1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in (0, 1, 2)), pa.array(held.value.score(found))], names=["doc_id", "whole", "few", "one", "score"])

    return docs.mapInArrow(giving_back(run), "doc_id long, whole double, few double, one double, score double")


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = MAX_ROWS) -> Model | None:
    """Train from the rows of ``labels`` (doc_id, toxic) that are not held out, at most ``rows`` of each class.

    The rows are chosen by a hash of the id before any text is read, so only the chosen texts move. Equal texts of a
    class count once. Labels without a text, and null labels, are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ordered = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    part = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 2, 1).otherwise(0)
    chosen = ordered[0].union(ordered[1]).withColumn("part", part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
    return train(materialise(sample.groupBy("text", "toxic").agg(F.max("part").alias("part")), "toxicity-sample"), texts.select("text"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; null texts stay."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([held.value.features(v.as_py()) for v in batch.column(place)]).reshape(-1, 3)
            known = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((held.value.score(found) < threshold) | ~known))

    return docs.mapInArrow(giving_back(run), docs.schema)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row, over its whole text.

    One pass without a shuffle. Null and empty texts have the score of a text that says nothing for either class; without a model
    every score is 0. Null and repeated ids are kept; other columns are left out, so their names cannot
    clash. No rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = _features(texts, model).select("doc_id", "score") if model else texts.select("doc_id", F.lit(0.0).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
