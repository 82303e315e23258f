"""Search where questions and nodes come in many copies."""

from quillgraph.operators import graph, retrieve


def test_copies_are_scored_once(spark, monkeypatch):
    """Copies bring their own hits, but what is compared doesn't grow with them."""
    texts = [("large ring", "SMALL", 0.2), ("small ring", "PROMO", 0.9), ("hot bolt", "RING", 0.9), ("blue rod", "TIN", 1.0)]
    nodes = [(50 * (k % 7) + k, *texts[k % 4][:2], "thing", texts[k % 4][2]) for k in range(600)]
    asks = [(k, ("what is a small ring", "ring, small", "ring ring", "the", "red")[k % 5]) for k in range(100)]
    sizes = {}

    def counted(df, label, real=retrieve.materialise):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(retrieve, "materialise", counted)
    found = retrieve.semantic_search(spark.createDataFrame(asks, "query_id long, question string"), spark.createDataFrame(nodes, "node_id long, text string, context string, node_type string, confidence double"), 0.3, 7)
    terms = {0: ["small", "ring"], 1: ["small", "ring"], 2: ["ring", "ring"], 3: [], 4: ["red"]}
    want = []
    for q, _ in asks:
        words = terms[q % 5]
        scored = [(-min(sum(w in f"{t} {c}".lower() for w in words) / len(words) * (0.8 + 0.2 * p), 1.0), n) for n, t, c, _, p in nodes if words]
        want += [(q, rank, n, round(-r, 9)) for rank, (r, n) in enumerate(sorted(x for x in scored if -x[0] >= 0.3)[:7], 1)]
    assert sorted((r.query_id, r["rank"], r.node_id, round(r.relevance, 9)) for r in found.collect()) == want
    assert sizes["search-held"] <= 8 and sizes["search-nodes"] <= 4 * 7 and sizes["search-hits"] <= 3 * 7


def test_signatures_lose_no_similar_nodes(spark):
    """Pairs that are not similar are dropped by their signatures before the sets meet; long and short sets, at and below the threshold."""
    import random

    draw = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for size in (1, 4, 5, 9, 10, 60, 90, 300):
        for _ in range(6):
            words = draw.sample(vocabulary, size)
            texts.append(words)
            for cut in (1, size // 10, size // 5, size // 4):
                texts.append(words[: size - cut // 2] + [f"x{draw.random()}" for _ in range(cut - cut // 2)])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, t string")
    want, least = {}, {}
    for k, t in enumerate(texts):
        if t:
            least.setdefault(frozenset(t), k)
    for s, a in least.items():
        for z, b in least.items():
            if a < b and (score := round(len(s & z) / len(s | z), 6)) >= 0.8:
                want[a, b] = score
    got = {(r.a, r.b): r.similarity for r in graph.similar_nodes(df, "id", "t", 0.8).collect()}
    assert got == want and len(want) > 40
    spread = spark.createDataFrame([(r, f"w{k}") for r in (1, 2) for k in range(300 * r - 300, 300 * r)], "rep long, token string")
    one, two = graph._signatures(spread).orderBy("rep").collect()
    differ = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(one[1:], two[1:], strict=True))
    assert 300 < differ <= 600
