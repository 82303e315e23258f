"""Similar nodes: what meets, and what is carried to where it meets."""

import random

import numpy as np
import pyarrow as pa

from quillgraph.operators import graph, similar


def _sets(draw):
    """Sets of very different sizes that all have a token in common, near copies of some, equal ones, empty texts."""
    out = [["hot", *(f"t{n}_{k}" for k in range(n))] for n in (0, 0, 1, 2, 3, 5, 8, 13, 40, 80, 200, 700)]
    for base in list(out):
        for cut in (1, len(base) // 10, len(base) // 9, len(base) // 8, len(base) // 4):
            for _ in range(3):
                kept = base[: len(base) - cut]
                out.append(kept + [f"x{draw.random()}" for _ in range(draw.randrange(cut + 1))])
    return out


def test_pairs_are_those_of_brute_force_in_small_batches(spark):
    """String ids, tokens whose rows go on in the next batch, signatures of all lengths."""
    texts = _sets(random.Random(5))
    rows = [(f"n{k:04d}", " ".join(t)) for k, t in enumerate(texts)]
    least, want = {}, {}
    for k, t in rows:
        if t:
            least.setdefault(frozenset(t.split()), k)
    for s, a in least.items():
        for z, b in least.items():
            if a < b and (score := round(len(s & z) / len(s | z), 6)) >= 0.8:
                want[a, b] = score
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {(r.a, r.b): r.similarity for r in graph.similar_nodes(spark.createDataFrame(rows, "id string, t string"), "id", "t", 0.8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) > 100


def test_only_like_sizes_meet_and_signatures_are_as_long_as_their_sets(spark, monkeypatch):
    """4,000 sets with one token in common: 8 million pairs met before, each with 256 bytes on both sides."""
    sets = [[f"t{n}_{k}" for k in range(n)] for n in (1, 10, 100, 1000, 5000)]
    hashed = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "rep long, s array<string>").selectExpr("rep", "transform(s, t -> xxhash64(t)) hashes")
    shared = spark.sparkContext.broadcast(np.ones(similar.CLASSES, np.int32))
    found = similar._prefixes(hashed, shared, 0.8, "long").selectExpr("rep", "length(signature) b").distinct().collect()
    assert {r.rep: r.b for r in found} == {0: 8, 1: 8, 2: 16, 3: 128, 4: 256}
    n = np.sort(np.tile(2 ** np.arange(1, 9), 500)).astype(np.int32)
    zeros = [bytes(int(b) // 8) for b in similar._bits(n)]
    rows = pa.table({"token": np.zeros(len(n), np.int64), "before": np.arange(len(n)), "rep": np.arange(len(n)), "n": n, "place": np.ones(len(n), np.int32), "signature": pa.array(zeros, pa.binary())})
    monkeypatch.setattr(similar, "PAIRS", 10_000)
    pieces = list(similar._meeting(rows, 0.8))
    assert sum(len(a) for a, _ in pieces) == 8 * 500 * 499 // 2 and max(len(a) for a, _ in pieces) <= 10_000
    assert all((n[a] == n[b]).all() for a, b in pieces)


def test_pairs_meet_once_for_each_run_of_common_tokens():
    """Two copies with 50 common prefix tokens in two runs meet twice, not 50 times."""
    rows = []
    for rep in (0, 1):
        order = [*range(30), 100 + rep, *range(30, 50)]
        rows += [(t, order[k - 1] if k else None, rep, 260, k + 1, bytes(64)) for k, t in enumerate(order)]
    rows.sort(key=lambda r: (r[0], r[3]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["token", "before", "rep", "n", "place", "signature"])
    assert sum(len(a) for a, _ in similar._meeting(table, 0.8)) == 2
