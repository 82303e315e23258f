"""Private data, toxicity, decontamination, search, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, privacy, search, toxicity


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_spans(text):
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans_match_brute_force(spark):
    r = random.Random(8)
    signs, parts = "ab1234567890 .-+()@é😀_%\n0", ["4944339490429605", "4944 3394 9042 9605", "😀 +1 (366) 555-9807", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "000.01.1.255", "+44 20 7946 0958", "x@y.z"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 100))) for _ in range(1500)]
    texts += [r.choice(parts) + r.choice([" ", "", "x", "1", "-", "é"]) + r.choice(parts) for _ in range(400)] + [None, "", "1 " * 20_000, "a." * 20_000 + "@", "7" * 30_000]
    df = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)], "doc_id long, text string, base string")
    rows = privacy.sanitise(df).select("doc_id", privacy.listed(F.col("base")).alias("s"), "clean", "text").collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.s == brute_spans(texts[row.doc_id]), texts[row.doc_id][:80]
        assert (row.clean == row.text) == (row.s == "")


def test_disclosing_terms_are_hidden(spark):
    rows = [(k, f"the mayor of Springfield writes to boss@town.org on matter {k} of the day") for k in range(4)]
    rows += [(10 + k, f"the day of matter {k} on which nothing was said of it") for k in range(200)]
    rows += [(300, rows[0][1]), (301, None), (302, "lonely@once.org near Unseen")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.sanitise(df).collect()}
    hidden = {(s.kind, s.value) for s in got[0].added}
    assert {("removed", "springfield"), ("removed", "mayor"), ("removed", "writes")} <= hidden
    assert not {"the", "day", "matter"} & {v for _, v in hidden}
    assert got[300].clean == got[0].clean and "[EMAIL]" in got[0].clean and "Springfield" not in got[0].clean and "the day" in got[0].clean
    assert got[302].clean == "[EMAIL] near Unseen" and got[301].clean is None
    # the share is PMI over the entity's information
    docs = df.select("text", F.xxhash64("text").alias("hash"))
    shares = {(r.entity, r.term): r.share for r in privacy.disclosures(docs, privacy._contexts(docs)).collect()}
    n = len({t for _, t in rows if t})
    with_the = sum("the" in (t or "").split() for t in {t for _, t in rows})
    assert shares["email:boss@town.org", "the"] == pytest.approx(math.log2(n * 4 / (4 * with_the)) / math.log2(n / 4))
    assert privacy.sanitise(df.where("false")).count() == 0


def test_disclosing_terms_are_hidden_in_whole_texts(spark):
    filler = "the day of matter on which nothing was said of it " * 8
    rows = [(k, f"Dear Quimby{k % 2}, 😀 {filler} write to boss@town.org case {k} {filler} yours, Springfield. SPRINGFIELD!") for k in range(4)]
    rows += [(10 + k, f"{filler} number {k}") for k in range(200)] + [(300, f"{filler} a@b.org to springfield alone")]
    got = {r.doc_id: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        want = [m.span() for m in re.finditer("springfield|quimby[01]|dear|yours|write|case" if k < 4 else "springfield", text.lower())]
        assert [(s.start, s.end) for s in got[k].added] == want, k
    assert "Springfield" not in got[0].clean and "SPRINGFIELD" not in got[0].clean and "Quimby0" not in got[0].clean
    assert got[300].clean == f"{filler} [EMAIL] to  alone" and got[10].clean == got[10].text


def test_entities_of_single_texts_and_thresholds_match_brute_force(spark):
    r = random.Random(31)
    words = [f"term{int(r.expovariate(0.02))}" for _ in range(4000)]
    mails = [f"m{k}@host{k % 7}.org" for k in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(400)]
    texts = [t + (f" {r.choice(mails)} tail only{k}" if k % 4 == 0 else "") for k, t in enumerate(texts)]
    rows = [(k, t, "kept", 1) for k, t in enumerate(texts)] + [(1000 + k, texts[4], "kept", 1) for k in range(9)] + [(2000, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, hash int")
    distinct = set(texts)
    terms = {t: set(re.findall(r"[^\W\d_]\w{2,}", re.sub(r"\S+@\S+", " ", t))) for t in distinct}
    whole = {t: set(re.findall(r"[^\W\d_][^\W_]{2,}", t)) for t in distinct}
    entity = {t: set(re.findall(r"\S+@\S+", t)) for t in distinct}
    n, n_e, n_t = len(distinct), Counter(e for x in entity.values() for e in x), Counter(w for x in whole.values() for w in x)
    n_et = Counter((e, w) for t in distinct for e in entity[t] for w in terms[t])
    for support in (1, 2):
        best = {}
        for (e, w), both in n_et.items():
            if both >= support:
                best[w] = max(best.get(w, -9), math.log2(n * both / (n_e[e] * n_t[w])) / math.log2(n / n_e[e]))
        got = privacy.sanitise(df, support=support).collect()
        assert len(got) == len(rows)
        seen = set()
        for x in got:
            want = {(w, "removed" if best[w] >= 0.8 else "term") for w in terms.get(x.text, ()) if best.get(w, 0) >= 0.5} if x.text and entity[x.text] else set()
            assert {(s.value, s.kind) for s in x.added} == want, x.text
            seen |= {k for _, k in want}
        assert "term" in seen and ("removed" in seen or support == 2)
    clean = privacy.rewrite(df, support=1)
    assert clean.columns == df.columns
    got = {x.doc_id: x for x in clean.collect()}
    assert got[4].base == "kept" and got[4].hash == 1 and "@" not in got[4].text and got[1000].text == got[4].text and got[1].text == texts[1] and got[2000].text is None


def labelled(n=900):
    r = random.Random(9)
    words, bad = [f"w{k}" for k in range(300)], ["scum", "idiot", "moron"]
    rows = []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = k % 6 == 0
        for _ in range(r.randint(1, 3) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(-1, None, "s"), (-2, "", "s"), (-3, "scum " * 40_000, "s"), (None, "w1", "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5, None, 1), (7, 0, 1), (10**9, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.learn(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    flagged = {i for i in held if by[i].predicted}
    toxic = {i for i, _, y in rows if y} & set(held)
    assert len(flagged & toxic) >= 0.9 * len(toxic) and len(flagged - toxic) <= 0.05 * len(held)
    assert not by[-1].predicted and not by[-2].predicted and by[-3].predicted and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = -1").count() == 1 and kept.where("doc_id = -3").count() == 0
    assert toxicity.learn(df, labels.where("toxic = 0")) is None
    assert [r.score for r in toxicity.score(df.where("doc_id = 1"), None).collect()] == [0.0]
    assert toxicity.score(df.where("false"), model).count() == 0


def test_kneser_ney_matches_brute_force(spark):
    r = random.Random(23)
    make = lambda extra: " ".join(r.choice([f"w{int(r.expovariate(0.2))}"] * 4 + extra) for _ in range(r.randint(1, 12)))
    texts = [(make(["scum", "idiot"] if k % 3 == 0 else ["nice"]), int(k % 3 == 0), int(k % 5 == 0)) for k in range(120)]
    unlabelled = [make([]) for _ in range(60)]
    data = spark.createDataFrame(texts, "text string, toxic int, part int").repartition(3)
    model = toxicity.train(data, spark.createDataFrame([(t,) for t, _, _ in texts] + [(t,) for t in unlabelled] + [(None,)], "text string").repartition(4))
    counted = [(t.split(), y) for t, y, part in texts if part == 0]
    words, pairs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for row, y in counted:
        for w in set(row):
            words[w][y] += 1
    words = {w: n for w, n in words.items() if sum(n) >= toxicity.RARE}
    named = lambda row: [w if w in words else "?" for w in row]
    sizes = [sum(y == c for _, y in counted) for c in (0, 1)]
    rest = [sum("?" in named(row) for row, y in counted if y == c) for c in (0, 1)]
    for row, y in counted:
        for u, w in set(zip(["<s>", *named(row)], named(row), strict=False)):
            if "?" not in (u, w):
                pairs[u, w][y] += 1
    pairs = {k: n for k, n in pairs.items() if sum(n) >= toxicity.RARE}
    corpus = [named(t.split()) for t in [t for t, _, _ in texts] + unlabelled]
    spread = {w: sum(w in row for row in corpus) + 1 for w in [*words, "?"]}
    whole = sum(spread.values())

    def unigram(w, c):
        count = {**{k: n[c] for k, n in words.items()}, "?": rest[c]}
        total = sum(count.values())
        solid = {k: max(n - 0.75, 0) / total for k, n in count.items()}
        return solid[w] + (1 - sum(solid.values())) * spread[w] / whole

    def bigram(u, w, c, below):
        of = (lambda n: n[c]) if c < 2 else sum
        base = max(1, (sizes[c] if c < 2 else sum(sizes)) if u == "<s>" else of(rest if u == "?" and c == 2 else [rest[c]] * 2 if u == "?" else words[u]))
        p = {k[1]: max(of(n) - 0.75, 0) / max(base, max(of(n) - 0.75, 0)) for k, n in pairs.items() if k[0] == u}
        scale = max(sum(p.values()) / 0.95, 1)
        return p.get(w, 0) / scale + max(1 - sum(p.values()) / scale, 0.05) * below

    for text in [t for t, _, _ in texts[:40]] + ["unseen scum w1 w1 nice"]:
        row = named(text.split())
        want = []
        for u, w in zip(["<s>", *row], row, strict=False):
            p = [bigram(u, w, c, bigram(u, w, 2, unigram(w, c))) for c in (0, 1)]
            want.append(math.log(p[1] / p[0]))
        assert model.ratios(text.split()) == pytest.approx(want, abs=1e-6)


def test_benchmark_passages_are_found(spark):
    r = random.Random(10)
    words = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(12, 60)))) for k in range(40)]
    rows, truth = [], set()
    for k in range(400):
        text = [r.choice(words) for _ in range(r.randint(1, 300))]
        if k % 8 == 0:
            item = r.randrange(40)
            passage = items[item][1].split()
            if k % 16 == 0:  # a paraphrase: some words replaced
                passage = [w if r.random() > 0.2 else r.choice(words) for w in passage]
            at = r.randint(0, len(text))
            text[at:at] = passage
            truth.add((k, item))
        rows.append((k, " ".join(text).capitalize()))
    rows += [(1000, None), (1001, ""), (1002, items[3][1]), (1002, items[3][1]), (None, items[4][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (3, items[3][1])], "item_id long, text string")
    hits = decontaminate.find_contaminated(df, bench, block=25).collect()
    got = {(h.doc_id, h.item_id) for h in hits if h.doc_id is not None and h.doc_id < 1000}
    assert truth - got == set() and got - truth == set()
    assert sum(h.doc_id == 1002 for h in hits) == 4 and any(h.doc_id is None and h.item_id == 4 for h in hits)
    clean = decontaminate.remove_contaminated(df, bench)
    assert {x.doc_id for x in clean.where("doc_id < 1000").collect()} == {k for k in range(400)} - {d for d, _ in truth}
    assert decontaminate.find_contaminated(df.where("false"), bench).count() == 0
    assert decontaminate.find_contaminated(df, bench.where("false")).count() == 0


def test_recall_against_all_pairs(spark):
    r = random.Random(17)
    known, other = [f"item{k}" for k in range(1500)], [f"other{int(k)}" for k in range(4000)]
    common = [f"c{k}" for k in range(20)]
    word = lambda pool: r.choice(common) if r.random() < 0.3 else r.choice(pool)
    items = [(k, [word(known) for _ in range(r.randint(15, 60))]) for k in range(50)]
    docs = []
    for k in range(300):
        text = [word(other if r.random() < 0.9 else known) for _ in range(r.randint(40, 400))]
        if k % 2 == 0:
            passage, rate = list(r.choice(items)[1]), r.choice([0, 0.1, 0.2, 0.3, 0.4])
            passage = [w for w in passage if r.random() >= rate / 2]
            passage = [w if r.random() >= rate / 2 else r.choice(other) for w in passage]
            at = r.randint(0, len(text))
            text[at:at] = passage
        docs.append((k, text))
    spread, passages = Counter(), 0
    for _, text in docs:
        for at in range(0, max(1, len(text) - 16), 16):
            spread.update(set(text[at : at + 32]))
            passages += 1
    truth = set()
    for d, text in docs:
        for i, item in items:
            rare = set(sorted(set(item), key=lambda w: (spread[w], w))[:8])
            for at in range(0, len(text), 16):
                window = text[max(0, at - len(item)) : at + 32 + len(item)]
                if decontaminate.common_subsequence(item, window) >= 0.6 * len(item) and len(rare & set(window)) >= 0.375 * len(rare):
                    truth.add((d, i))
    df, bench = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    found = {(h.doc_id, h.item_id) for h in decontaminate.find_contaminated(df, bench).collect()}
    assert len(truth) > 100 and len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.05 * len(truth)
    assert found == {(h.doc_id, h.item_id) for h in decontaminate.find_contaminated(df, bench, block=7).collect()}
    rows = [(None, " ".join(docs[0][1])), (1, " ".join(docs[0][1])), (1, " ".join(docs[1][1])), (None, None)]
    kept = decontaminate.remove_contaminated(spark.createDataFrame(rows, "key long, text string"), bench.where("item_id >= 0"))
    assert kept.columns == ["key", "text"] and sorted(((x.key or 0), x.text is None) for x in kept.collect()) == [(0, True), (1, False)]


def test_common_subsequence():
    r = random.Random(11)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == t[-1, -1]


@pytest.mark.parametrize(("terms", "shard"), [(6, 10**6), (1000, 300)])
def test_search_matches_brute_force(spark, monkeypatch, terms, shard):
    monkeypatch.setattr(search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(search, "BLOCK", 4)
    r = random.Random(12)
    docs = {k: " ".join(f"t{int(r.expovariate(0.05))}" for _ in range(r.randint(0, 40))) for k in range(300)}
    docs[300] = docs[301] = docs[20]
    rows = [(k, t, 1.0) for k, t in docs.items()] + [(400, None, 1.0), (401, "", 1.0), (None, "t1 t2", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    found = search.search(df, df.where("doc_id % 20 = 0"), "doc_id", "text", "doc_id", "text", 7, terms).collect()
    bags = {k: Counter(search.terms_of(t)) for k, t in docs.items()} | {400: Counter(), 401: Counter()}
    size = {k: sum(b.values()) for k, b in bags.items()}
    mean, n = sum(size.values()) / len(size), len(size)
    df_of = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df_of.items()}
    got = defaultdict(list)
    for x in sorted(found, key=lambda x: x.rank):
        got[x.query_id].append((x.doc_id, round(x.score, 6)))
    for q in [k for k in bags if k % 20 == 0]:
        chosen = sorted(bags[q], key=lambda w: (-bags[q][w] * (search.K1 + 1) / (bags[q][w] + search.K1) * idf[w], xxhash.xxh64_intdigest(w) >> 1))[:terms]
        scores = {d: sum(idf[w] * search.impact(b[w], size[d], mean) for w in chosen if w in b) for d, b in bags.items() if any(w in b for w in chosen)}
        want = sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:7]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)
        assert got.get(q, []) == want or sorted(got[q]) == sorted(want)
    assert search.search(df.where("false"), df.where("false"), "doc_id", "text", "doc_id", "text").count() == 0


def test_search_uses_every_term_of_a_query(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 2000)
    r = random.Random(21)
    docs = {k: " ".join(f"t{int(r.expovariate(0.01))}" for _ in range(r.randint(0, 150))) for k in range(400)}
    docs[400] = docs[401] = docs[20]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {(x.query_id, x.rank): (x.doc_id, x.score) for x in search.search(df, df.where("doc_id % 20 = 0"), "doc_id", "text", "doc_id", "text").collect()}
    bags = {k: Counter(search.terms_of(t)) for k, t in docs.items()}
    size = {k: sum(b.values()) for k, b in bags.items()}
    mean, n = sum(size.values()) / len(size), len(size)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in Counter(w for b in bags.values() for w in b).items()}
    for q in [k for k in bags if k % 20 == 0]:
        scores = {d: sum(idf[w] * search.impact(b[w], size[d], mean) for w in bags[q] if w in b) for d, b in bags.items()}
        want = sorted(((d, s) for d, s in scores.items() if s), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        assert [got[q, k + 1][0] for k in range(len(want))] == [d for d, _ in want] and (q, len(want) + 1) not in got
        assert [got[q, k + 1][1] for k in range(len(want))] == pytest.approx([s for _, s in want], abs=1e-6)


def test_pipeline_stages_hand_on_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(13)
    rows = labelled(400)
    passage = " ".join(f"secret{r.randrange(500)}" for _ in range(30))
    texts = {i: t for i, t, _ in rows}
    texts[1000] = texts[1001] = texts[1002] = " ".join(r.choice(["u", "v", "x", "y"]) + str(k) for k in range(50))
    texts[1003] = texts[1] + " " + passage
    texts[1004] = "write to someone@mail.org now " + " ".join(f"q{k}" for k in range(20))
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(2000, None, "en", "s", 0), (2001, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({x.doc_id for x in held.select("doc_id").collect()})
        if name != "packing":
            assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "private_data":
            assert "someone@mail.org" not in held.where("doc_id = 1004").first().text
    toxic = {i for i, _, y in rows if y}
    assert len(seen[0] & toxic) < 0.15 * len(toxic) and len(seen[0] - toxic) >= 0.95 * (len(docs) - len(toxic))
    assert seen[1] & {1000, 1001, 1002} == {1000} and seen[1] - {1001, 1002} == seen[1]
    assert 1003 in seen[1] and 1003 not in seen[2] and seen[3] == seen[2] and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(seen[4])


def test_digest_of_spans(spark):
    texts = [None, "", "é a@b.org 😀 1.2.3.4", "+44 20 7946 0958 or x@y.z"]
    rows = privacy.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.sha2(privacy.listed(F.col("base")), 256).alias("digest")).collect()
    assert {x.doc_id: x.digest for x in rows} == {k: hashlib.sha256(brute_spans(t).encode()).hexdigest() for k, t in enumerate(texts)}
