import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_patterns_cover_the_demand_exactly():
    r = random.Random(5)
    for capacity, n in ((64, 3000), (64, 7), (256, 20)):
        demand = Counter(min(capacity, int(r.expovariate(4 / capacity)) + 1) for _ in range(n))
        found = packing.solve_patterns(demand, capacity)
        total = Counter()
        for pattern, times in found:
            assert sum(k * v for k, v in pattern.items()) <= capacity
            for k, v in pattern.items():
                total[k] += v * times
        assert total == demand
        least = sum(k * v for k, v in demand.items()) / capacity
        assert sum(t for _, t in found) <= least * 1.02 + 2
    assert packing.solve_patterns({}, 64) == []


def test_knapsack_matches_brute_force():
    r = random.Random(6)
    for _ in range(20):
        sizes = np.array(sorted(r.sample(range(1, 20), 4)))
        worth = np.array([r.random() for _ in sizes])
        value, pattern = packing.best_pattern(sizes, worth, 30)
        best = np.zeros(31)
        for room in range(1, 31):
            best[room] = max([best[room - 1], *(best[room - s] + w for s, w in zip(sizes, worth, strict=True) if s <= room)])
        assert value == pytest.approx(best[30]) and pattern @ worth == pytest.approx(value) and pattern @ sizes <= 30


TEXTS = ["It's the CAT's 3rd naïve Größe", "<|endoftext|> a <|startoftext|>b", "a\x1cb c\x1f d", "日本語 のテスト é e\u0301", "\u00a0x\u2003y\u3000z", "", None, "don't 'll 've", "İstanbul ΣΑΣ", "word " * 5000, " ".join(a + b + c for a in "aàÿßæµªz" for b in "éñöxÁ" for c in ["", ".", "..", ",", "!?", "õê"])]


def test_word_encoder_matches_the_tokenizer():
    own, whole = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text, data in zip(TEXTS, own.encode(TEXTS), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_every_id_lies_in_one_piece(spark):
    r = random.Random(7)
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(r.choice(["alpha", "beta", "x1"]) for _ in range(r.randint(0, 700)))) for k in range(200)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int").repartition(4)
    packed = packing.pack(df, "doc_id", "text", PATH)
    rows = packed.pieces.join(packed.tokens.select("piece_id", F.crc32("ids").alias("crc")), "piece_id").collect()
    whole = Tokenizer.from_file(PATH)
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in rows:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.crc == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        pieces[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert pieces.keys() == ids.keys()
    for held, size in ((pieces[i], len(ids[i])) for i in ids):
        assert sum(n for _, n in held) == size and all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:], strict=False))
    for held in sequences.values():
        ends = [0] + [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= total / 2048 * 1.05 + 2
    out = {s.sequence_id: len(s.ids) // 4 for s in packed.sequences().collect()}
    assert out == {k: sum(n for _, n in v) for k, v in sequences.items()}


def test_packing_nothing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(df.where("false"), "doc_id", "text", PATH).pieces.count() == 0
    rows = packing.pack(df, "doc_id", "text", PATH).pieces.collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_words_with_combining_signs_have_the_tokenizers_ids():
    r = random.Random(16)
    signs = ["a", "B", "é", "́", "̇", "İ", "i", "ı", "K", "Å", "क़", "़", "ﬁ", "ß", "Σ", "σ", "é", "É", "日", "ª", "µ", "1", "'", "s", ".", ",", ";", ":", "!", "?", "-", " ", "\n", " "]
    texts = ["İ.", "X İ;", "BELEDİYESİ.", "क़.", "á,", "İİ! İ"] + ["".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    whole = Tokenizer.from_file(PATH)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.WordEncoder(PATH, None).encode(texts)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_words_that_come_again_are_learnt_once(monkeypatch):
    """Words of one text alone don't push out the others, and ids stay those of the vocabulary."""
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(path)
    learnt = []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: learnt.extend(texts) or encode(texts))
    often = [f"often{k}x." for k in range(50)]
    for turn in range(12):
        once = [f"once{turn}y{k}" for k in range(100)]
        text = " ".join(often + once)
        got = np.frombuffer(encoder.encode([text])[0], "<u4")[:-1].tolist()
        assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 500
    assert sum(w.startswith("often") for w in learnt) <= 2 * 50


def test_pieces_of_latin_words_are_merged_once(monkeypatch):
    """Marks, numbers and contractions don't make a word new, and only words beyond Latin-1 take the tokenizer's whole way."""
    r = random.Random(20)
    signs = [*"abstrevlmdÀß'''\"09,.&* \n", "\x85", "\x07", "\xad", "½", "re", "'s", "'ve", "'ll", "日", "é", "’s"]
    texts = ["it's 'store ''s 're\"'d l'", "naïve naïve!! (naïve) naïve&&& naïve's 7naïve", None, "'", "a’s 日 it's b", *("".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000))]
    encoder = packing.WordEncoder(PATH, None)
    whole = []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words: whole.extend(words) or encode(words))
    assert encoder.encode([]) == []
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert whole and all(max(w) > "\xff" for w in whole)
