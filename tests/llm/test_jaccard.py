import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import jaccard
from quillgraph.llm.components import connected_components


def brute(rows, n, p):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    holds = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in holds[x] if j > i).items():
            if 100 * k >= p * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def corpus():
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], [r.choice(words) for _ in range(80)]
    for k in range(150):  # near copies of one text
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(80)] = r.choice(words)
        rows.append((k, " ".join(w)))
    line = "one common line that many small documents share"
    rows += [(200 + k, line + " " + " ".join(r.choice("abcde") for _ in range(r.randint(0, 4)))) for k in range(80)]
    rows += [(300 + k, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for k in range(60)]
    rows += [(400 + k, " ".join(base)) for k in range(30)]  # exact copies
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "Ab c"), (504, "aB  C"), (505, "ÀB c"), (506, "x " * 30_000)]
    return rows


@pytest.mark.parametrize(("n", "p", "block"), [(3, 90, 512), (5, 80, 512), (3, 70, 40)])
def test_components_match_brute_force(spark, monkeypatch, n, p, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, node string, component_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_documents(df, "doc_id", "text", n, p).collect()}
    assert got == brute(rows, n, p)


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    rows = jaccard.similar_documents(df, "doc_id", "text", 3, 90).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0, r.n_links) for r in rows) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert jaccard.similar_documents(df.where("false"), "doc_id", "text", 3, 90).count() == 0


def test_linked_sets_share_a_key():
    r = random.Random(1)
    for p in (70, 80, 90):
        for _ in range(300):
            a = {r.getrandbits(63) for _ in range(r.randint(2, 200))}
            b = set(a)
            for _ in range(r.randint(0, len(a) // 5 + 1)):
                b.discard(next(iter(b)) if r.random() < 0.5 else -1)
                if r.random() < 0.5:
                    b.add(r.getrandbits(63))
            if b and a != b and 100 * len(a & b) >= p * len(a | b):
                # what both hold occurs twice, and some of the rest elsewhere too
                times = {x: r.randint(2, 9) for x in a | b if x in a & b or r.random() < 0.5}
                x, y = (jaccard.prefix_of(*(np.array([f(t) for t in s if t in times]) for f in (int, times.get)), len(s), p) for s in (a, b))
                assert np.intersect1d(x, y).size


def test_shared_tokens_are_counted_over_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 50)
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abcdefghij") + r.choice("klmnopqrst") for _ in range(r.randint(1, 40)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {jaccard.node_of(s): s for s in (jaccard.shingles(t.encode(), 2, jaccard._Words()) for _, t in rows)}
    times = Counter(x for s in sets.values() for x in s.tolist())
    parts = jaccard._summed(jaccard._shared(jaccard._sent(df, 2, 7))).collect()
    assert {x.node: (x.n, x.shared) for x in parts} == {k: (len(s), sum(times[x] > 1 for x in s.tolist())) for k, s in sets.items()}


def test_unrelated_documents_form_no_family(spark):
    for size in (500, 2000):
        r = random.Random(size)
        words, line = [f"w{k}" for k in range(3000)], "one very common line of words that a third of all documents hold"
        rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(20, 200))) + (f" {line}" if k % 3 == 0 else "")) for k in range(size)]
        rows += [(size + k, rows[7][1] + f" x{k}") for k in range(5)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        nodes = jaccard._nodes(df, 5).selectExpr("doc_id", "node", "1L copies")
        sets = jaccard._sets(df, nodes, 5)
        families = connected_components(jaccard._stars(jaccard._prefixes(sets, 80))).groupBy("component").count().collect()
        assert max(x["count"] for x in families) <= 6
        assert jaccard._survivors(df, 5, 80, 10**6).count() == 6


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}
