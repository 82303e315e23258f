"""Short queries of one shard read a term's postings from lists that are made once."""

import random

import numpy as np

from quillgraph.llm import search


def test_short_queries_share_the_postings_of_a_term(spark, monkeypatch):
    """Two hundred queries of up to four terms: six terms are prepared, and the answers are those of brute force, above floors too."""
    draw = random.Random(11)
    words = [f"w{k}" for k in range(6)]
    docs = [(n, " ".join(draw.choices(words, [1, 2, 4, 8, 16, 32], k=draw.randrange(1, 40)) + ["é" * (n % 3)])) for n in range(400)]
    row = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).first()
    ids, lengths, terms, counts = (np.frombuffer(row[c], "<i8") for c in ("ids", "lengths", "terms", "counts"))
    postings, bounds = np.frombuffer(row["postings"], search._POSTING), np.frombuffer(row["bounds"], search._BOUND)
    hashes, mean = search._Hashes(), lengths.sum() / len(lengths)
    weight = {hashes[w]: 1.0 + k for k, w in enumerate(words)}
    queries = [sorted({hashes[w] for w in draw.sample(words, draw.randrange(1, 5))}) for _ in range(200)]
    rows = [(q, t, weight[t]) for q, found in enumerate(queries) for t in found]
    table = search.pa.table(dict(zip(("query_id", "term", "weight"), (list(x) for x in zip(*rows, strict=True)), strict=True)))
    bags = {n: search._bag(text, hashes) for n, text in docs}
    want = {}
    for q, found in enumerate(queries):
        scores = {n: sum(float(search._gains(weight[t], float(tf), length, mean)) for t, tf in zip(b.tolist(), tfs.tolist(), strict=True) if t in found) for n, (b, tfs, length) in bags.items()}
        want[q] = sorted(((-s, n) for n, s in scores.items() if s > 0))[:7]
    made = []

    class Counted(search.Postings):
        def __init__(self, *args):
            made.append(1)
            super().__init__(*args)

    monkeypatch.setattr(search, "Postings", Counted)
    for floors in ({}, {q: -w[-1][0] for q, w in want.items() if len(w) == 7}):
        made.clear()
        got = {}
        for query, doc, score in search.score_shard(search.block_of(table, floors), ids, lengths, terms, counts, postings, bounds, mean, 7):
            for q, n, s in zip(query.tolist(), doc.tolist(), score.tolist(), strict=True):
                got.setdefault(q, []).append((-s, n))
        assert got == want and len(made) == 6
