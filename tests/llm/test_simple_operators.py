"""Archives, URL filter, sharding, token counts."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import sharding, token_counts, urls, warc


def pages(spark):
    big, small = "x" * 1500, "y" * 10
    rows = [(1, "http://a", big, "c"), (2, "http://b", big, "c"), (3, None, small, "c"), (4, "u", small, "c"), (5, "u", None, "c"), (6, "u", "", "c"), (9, "u\nv", big, "c"), (7, "u", "é😀" * 900, "c"), (None, "u", big, "c")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_archives_return_every_record(spark, tmp_path):
    df = pages(spark).repartition(3)
    manifest = warc.archive(df, "page_id", "url", "html", str(tmp_path / "warc"))
    got = {r.record_id: r for r in warc.read_archives(manifest, with_payload=True).collect()}
    assert len(got) == 9
    for row in pages(spark).collect():
        data = (row.html or "").encode()
        r = got[row.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if row.html and row.html.startswith("x") and row.page_id != 9:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 9, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)


def test_archive_begins_with_its_dictionary(spark, tmp_path):
    rows = [(k, "u", f"<html><body>page {k} " + "common words of every page " * 20 + "</body></html>") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, url string, html string").coalesce(1)
    manifest = warc.archive(df, "id", "url", "html", str(tmp_path / "w")).collect()
    data = open(manifest[0].archive.removeprefix("file:"), "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert manifest[0].records == 300 and manifest[0].bytes == len(data)
    assert len(list(warc.iter_records(open(manifest[0].archive.removeprefix("file:"), "rb")))) == 300


def test_archives_of_nothing(spark, tmp_path):
    manifest = warc.archive(pages(spark).where("false"), "page_id", "url", "html", str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"), urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/")]


def test_url_rules(spark):
    cases = [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/"),
        ("https://example.org/en/12?x#y", "example.org", "/en/12", "example.org/en/1"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("https://x.com/fr/?q=/de/", "x.com", "/fr/", "com/fr/"),
        ("https://x.com#/de/", "x.com", "", None),
        ("ftp://x.org", "x.org", "", None),
        ("no url", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
        ("a://b/c://d.org/", "b", "/c://d.org/", None),
    ]
    df = spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df, "page_id", "url", RULES).collect()}
    for k, (_, host, path, rule) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        if rule:
            assert got[k].verdict == next(r.verdict for r in RULES if r.pattern == rule)
        assert got[k].verdict in ("allow", "block")


def test_url_classifier_on_held_out_urls(spark):
    rows = [(k, f"https://shop{k}.casino.net/win/{k % 17}" if k % 2 else f"https://lib{k}.school.net/read/{k % 17}", "block" if k % 2 else "allow") for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, truth string")
    parts = df.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), F.col("truth").alias("verdict"))
    model = urls.train(parts.where("page_id < 300"))
    got = urls.judge(df.where("page_id >= 300"), "page_id", "url", [], model).join(df, "page_id")
    assert got.where("verdict = truth").count() / got.count() > 0.95
    assert urls.train(parts.where("verdict = 'allow'")) is None


def test_shards_are_even_and_stay(spark):
    names = [f"s{k}" for k in range(10)]
    table = sharding.lookup_table(names, 1009)
    counts = [table.count(k) for k in range(10)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved / 1009 < 0.25
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, shard string")
    rows = sharding.place(df, "id", names, 1009).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.id == 1}) == 1
    assert all(r.shard == names[table[r.slot]] for r in rows)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def brute_tokens(word, scores, longest, byte):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - longest), end):
            if word[begin:end] in scores and best[begin][0] + scores[word[begin:end]] > best[end][0]:
                best[end] = best[begin][0] + scores[word[begin:end]], best[begin][1] + 1
        raw = len(word[end - 1].encode())
        if best[end - 1][0] + raw * byte > best[end][0]:
            best[end] = best[end - 1][0] + raw * byte, best[end - 1][1] + raw
    return best[-1][1]


def test_token_counts_match_brute_force(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.zipf_scores(path)
    trie = token_counts.PrefixTrie(scores)
    texts = ["the cat the cats", "日本語 text", "", None, "a" * 5000, "x\ny\tz", "Größe naïve 😀😀"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(0, "the cat the cats", 5), (None, "a", 5)], "id long, text string, n_tokens int")
    rows = token_counts.count_tokens(df, "id", "text", path).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            words = (texts[r.doc_id] or "").split()
            assert (r.n_words, r.n_tokens) == (len(words), sum(brute_tokens(token_counts.MARK + w, scores, trie.longest, trie.byte) for w in words))
    assert token_counts.count_tokens(df.where("false"), "id", "text", path).count() == 0


def test_archive_query_matches_sql(spark):
    import duckdb

    from quillgraph.llm import catalog

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(tuple(r) for r in catalog.op1_warc(spark, data).select(columns).collect())
    assert got == sorted(con.sql(f"select {', '.join(columns)} from ({catalog.ORACLES['op1_warc']})").fetchall())


def test_table_is_filled_in_turns_by_preference():
    from hashlib import blake2b

    names, size = [f"node{k}" for k in range(7)], 211
    order = []
    for name in names:
        digest = blake2b(name.encode(), digest_size=16).digest()
        first, step = int.from_bytes(digest[:8], "little") % size, int.from_bytes(digest[8:], "little") % (size - 1) + 1
        order.append([(first + k * step) % size for k in range(size)])
        assert sorted(order[-1]) == list(range(size))
    taken = {}
    for turn in range(size):  # a shard's turn: its most preferred slot that nobody has
        shard = turn % len(names)
        taken[next(x for x in order[shard] if x not in taken)] = shard
    assert sharding.lookup_table(names, size) == [taken[x] for x in range(size)]


def test_places_of_clashing_names_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z" * 50_000, 4)], "slot string, shard int")
    rows = sharding.place(df, "slot", ["x", "y"], 101).collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == {"key", "slot", "shard"}
    assert len({(r.slot, r.shard) for r in rows if r.key == "a"}) == 1 and all(r.shard in "xy" for r in rows)
    assert sharding.place(df.where("false"), "shard", ["x"], 101).count() == 0


def test_url_classifier_matches_an_independent_fit(spark):
    import random

    r = random.Random(2)
    rows = [(k, f"http://{r.choice(['shop', 'news', 'blog'])}{k % 9}.{r.choice(['net', 'io'])}/{r.choice(['cart', 'story', 'post'])}/{r.randint(0, 99)}") for k in range(120)]
    df = urls.match_rules(spark.createDataFrame(rows, "page_id long, url string"), "page_id", "url", [])
    df = df.drop("verdict").withColumn("verdict", F.when(F.col("host").startswith("shop"), "block").otherwise("allow"))
    model = urls.train(df)
    data = urls.with_features(df.select("host", "path", "verdict").distinct()).select("features", "verdict").collect()
    used = sorted({int(i) for x in data for i in x.features.indices})
    at = {i: k for k, i in enumerate(used)}
    x, y = np.zeros((len(data), len(used) + 1)), np.array([x.verdict == "block" for x in data], float)
    for k, row in enumerate(data):
        x[k, [at[int(i)] for i in row.features.indices]] = 1
    x[:, -1] = 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-3)
    ridge[-1] = 0
    for _ in range(30):  # Newton's method on mean log loss and ridge
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge + 1e-9)
        w -= np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * w)
    want = 1 / (1 + np.exp(-x @ w))
    got = np.array([v.probability[1] for v in model.transform(urls.with_features(df.select("host", "path", "verdict").distinct())).select("probability").collect()])
    assert np.abs(np.sort(got) - np.sort(want)).max() < 0.02


def test_urls_of_clashing_names_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None), (2, "http://h/" + "p" * 100_000)], "host long, rule string")
    rows = urls.judge(df, "host", "rule", [urls.Rule("allow", "org/")]).collect()
    assert len(rows) == 4 and [r.rule for r in rows if r.id == 1] == ["org/"] * 2 and all(r.verdict == "allow" for r in rows)
    assert urls.judge(df.where("false"), "host", "rule", [urls.Rule("allow", "org/")]).count() == 0
