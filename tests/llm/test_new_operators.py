"""SimHash, Merkle manifest and fill-in-middle against brute force."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import catalog, fim, merkle, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, output string"


def documents(spark, texts, sources=None):
    rows = [(k, t, "en" if k % 3 else None, (sources or ["a"])[k % len(sources or ["a"])], None if t is None else len(t), 7, "k", "o") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample_texts():
    draw = random.Random(5)
    words = [f"word{k}" for k in range(400)] + ["É", "é", "Straße", "日本語", "😀", "<", "P>"]
    texts = [None, "", " \t\n", "One", "one TWO", "one two three", "<P>", "a<S>b", "x" * 3, "\x0b\x0c", "no break here now"]
    for k in range(150):
        texts.append(" ".join(draw.choice(words) for _ in range(draw.randrange(1, 220))))
        if k % 3 == 0:
            # a near copy: few words differ at the end of a long text
            texts.append(texts[-1] + " " + draw.choice(words))
        if k % 10 == 0:
            texts += [texts[-1]] * 3
    texts.append(" ".join(draw.choice(words) for _ in range(70_000)))
    return texts


# ---- fill-in-middle


def fim_of(doc, text, seed="1"):
    text = text or ""
    drawn = hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()
    h = [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_brute_force(spark):
    texts = sample_texts()
    got = {r.doc_id: r for r in fim.restore(fim.fill_in_middle(documents(spark, texts), "doc_id", "text")).collect()}
    assert len(got) == len(texts)
    forms = set()
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_of(k, text)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored == (text or "") and r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_fill_in_middle_of_repeated_and_null_ids_and_of_nothing(spark):
    rows = [(None, "abcdef"), (None, "abcdef"), (4, "abc"), (4, "xyz")]
    got = fim.restore(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")).collect()
    assert sorted(r.restored for r in got) == ["abc", "abcdef", "abcdef", "xyz"]
    none = [r.output for r in got if r.doc_id is None]
    assert none[0] == none[1] == fim_of("", "abcdef")[4]
    assert len({(r.form, r.prefix_chars, r.middle_chars) for r in got if r.doc_id == 4}) == 1
    assert fim.restore(fim.fill_in_middle(documents(spark, []), "doc_id", "text")).count() == 0


def test_pieces_are_split_and_restored():
    text = "añb日cdé".encode() * 3
    whole = [fim.Piece(fim.TEXT, 0, 5), fim.Piece(fim.TEXT, 5, len(text) - 5)]
    for low in range(len(text) + 1):
        for high in range(low, len(text) + 1):
            parts = fim.cut(whole, [low, high])
            assert [b"".join(fim.slices(p, text)) for p in parts] == [text[:low], text[low:high], text[high:]]
            for form in fim.FORMS:
                output = b"".join(fim.slices(fim.arrange(parts, form), text))
                assert b"".join(fim.slices(fim.unarrange(output, form), output)) == text
    with pytest.raises(ValueError):
        fim.unarrange(b"<P>only", "psm")


def test_code_points_are_counted_over_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 5)
    for text in ("", "abc", "añb日c😀" * 7, "日" * 11):
        data = text.encode()
        assert fim.count_points(data) == len(text)
        for k in range(len(text) + 1):
            assert fim.offsets(data, [k, len(text)]) == [len(text[:k].encode()), len(data)]


# ---- Merkle manifest


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if lower and values[4] is not None:
        values[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in values[4])
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(digests):
    """(top, [(left, right) by level] for each)."""
    paths, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, p in enumerate(place):
            run = digests[p // 16 * 16 : p // 16 * 16 + 16]
            paths[k].append((run[: p % 16], run[p % 16 + 1 :]))
        digests = [sha(digests[k : k + 16]) for k in range(0, len(digests), 16)]
        place = [p // 16 for p in place]
    return digests[0], paths


def manifest_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own, subroots = {}, []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        top, paths = tree_of([leaf_of(r) for r in ordered])
        subroots.append(top)
        own[name] = ordered, top, paths
    root, uppers = tree_of(subroots)
    out = []
    for name, upper in zip(names, uppers, strict=True):
        ordered, top, paths = own[name]
        for row, path in zip(ordered, paths, strict=True):
            chosen = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
            folded = leaf_of(row, chosen)
            for left, right in path + upper:
                folded = sha([*left, folded, *right])
            proof = sha([d for left, right in path + upper for d in left + right])
            out.append((row["doc_id"], leaf_of(row), top, root, proof, folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(df):
    found = merkle.manifest(df, "doc_id", "source", catalog.LEAF_COLUMNS, merkle.tampered_leaf(catalog.LEAF_COLUMNS, "doc_id", "text"))
    return found, sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=str)


@pytest.mark.parametrize("band", [1, 3])
def test_manifest_matches_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    monkeypatch.setattr(merkle, "CHUNK", 16**band)
    draw = random.Random(3)
    sources = [None, "", "-", "é", "web"] + [f"s{k}" for k in range(20)]
    rows = [{"doc_id": k, "source": draw.choice(sources) if k % 3 else "hot", "lang": draw.choice([None, "", "en"]), "n_chars": draw.choice([None, 3]), "text": draw.choice([None, "", "ABC É", f"text {k}"])} for k in range(900)]
    rows += [dict(rows[5]), dict(rows[5]), dict(rows[6], text="other"), dict(rows[7], doc_id=None), {"doc_id": 5000, "source": "lone", "lang": None, "n_chars": None, "text": None}]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("digest", F.lit("x")).withColumn("grp", F.lit(1)).repartition(5)
    found, got = manifest_rows(df)
    assert got == manifest_of(rows)
    assert {r[6] for r in got} == {True, False}
    again = found.select(merkle.fold_column(F.col("leaf"), F.col("proof")).alias("root"), F.col("root").alias("was")).where("root <> was or root is null")
    assert again.count() == 0


def test_manifest_of_one_source_one_row_and_nothing(spark):
    rows = [{"doc_id": k, "source": "a", "lang": "x", "n_chars": 1, "text": "t"} for k in range(17)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest_rows(spark.createDataFrame(rows, schema))[1] == manifest_of(rows)
    assert manifest_rows(spark.createDataFrame(rows[:1], schema))[1] == manifest_of(rows[:1])
    assert manifest_rows(spark.createDataFrame([], schema))[1] == []


def test_sweeps_deliver_every_label_once():
    for size in (1, 2, 16, 17, 255, 257):
        digests = [sha([str(k)]) for k in range(size)]
        tree = merkle.sweep_up(digests, merkle.levels(size))
        assert len(tree[-1]) == 1
        proofs = list(merkle.sweep_down(tree, []))
        assert [merkle.fold(d, p) for d, p in zip(digests, proofs, strict=True)] == tree[-1] * size


# ---- SimHash


def fingerprint_of(text):
    words = [w for w in _lower(text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components_of(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


@pytest.mark.parametrize("block", [simhash.BLOCK_WORDS, 50])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    if block == 50:  # blocks of words in this process; workers use their own module
        monkeypatch.setattr(simhash, "BLOCK_WORDS", block)
        for text in sample_texts()[:80]:
            assert simhash.fingerprint((text or "").encode()) == fingerprint_of(text)
        return
    texts = sample_texts()
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts), "doc_id", "text").collect()}
    fps = {k: fingerprint_of(t) for k, t in enumerate(texts)}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {k: r.component_id for k, r in got.items()} == components_of(fps)


def close_fingerprints(count, seed):
    """Families of fingerprints that differ in few bits, beside unrelated ones."""
    draw = np.random.default_rng(seed)
    out = []
    for centre in draw.integers(0, 1 << 63, count // 20, dtype=np.uint64):
        for _ in range(20):
            x = int(centre)
            for bit in draw.integers(0, 64, draw.integers(0, 7)):
                x ^= 1 << int(bit)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("open_", [4096, 24, 4])
def test_links_lose_none_when_keys_are_too_large(spark, monkeypatch, open_):
    monkeypatch.setattr(simhash, "OPEN", open_)
    fps = close_fingerprints(400, open_) + [1 << k for k in range(64)] + [3 << k for k in range(63)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    assert {x: y for x, y in _joined(fps, found).items()} == components_of({x: x for x in fps})


def _joined(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_every_pair_within_three_bits_keeps_a_chain():
    draw = random.Random(2)
    for _ in range(3000):
        x = sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 4)))
        turned = np.array([x if not s else (x << 16 * s | x >> 64 - 16 * s) & (1 << 64) - 1 for s in range(4)], np.uint64)
        assert len(simhash.within(turned))


def test_near_duplicates_of_null_ids_repeats_and_nothing(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (2, "a b c d"), (9, None), (8, ""), (3, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (2, 2), (3, 2), (3, 3), (8, 3), (9, 3)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
