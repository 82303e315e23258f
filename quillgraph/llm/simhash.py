"""Near duplicates by SimHash fingerprints and the pigeonring principle.

A fingerprint of 64 bits is a ring of ``SEGMENTS`` equal segments. If two fingerprints differ in at most ``DIFFERENCES`` bits, some
segment begins a chain along the ring all of whose beginnings stay within budget: the first l segments have at most
``l * DIFFERENCES / SEGMENTS`` differences, that is 0, 1, 2 and 3. Candidates therefore share the first segment of a chain, and one of the halves
of the next, which may hold one difference at most: eight keys of 24 bits for each distinct fingerprint. Candidates whose chain
exceeds a budget are dropped before the full distance is looked at.

Keys that more than ``OPEN`` fingerprints share are not opened: their chains are followed one segment further, where at most two differences
leave one of three parts whole, then at most three one of four. What is still too large is compared in pairs of blocks. No
link is lost on any of these ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.components import connected_components
from quillgraph.runtime import materialise

SEGMENTS, DIFFERENCES, WIDTH = 4, 3, 16
#: Fingerprints of a key that are compared in one task; beyond them chains are followed further. Block of a key at the end of its chain.
OPEN = 4096
#: The share of all rows (one in so many) from which a fingerprint counts as heavy: there are never more of them than this.
HEAVY = 2000
#: Words of a text that are hashed together.
BLOCK_WORDS = 65_536
SEED = 42

#: Parts of the segment at each place of a chain, as (first bit from the segment's top, bits): one more part than it may have differences.
PARTS = {1: ((0, 8), (8, 8)), 2: ((0, 5), (5, 5), (10, 6)), 3: ((0, 4), (4, 4), (8, 4), (12, 4))}


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """The SimHash of the ``n``-word shingles of a whole text, repeats included; 0 without words.

    A-Z are lower-cased, words are split at ASCII white space and joined by single spaces. A text with fewer words is one shingle. A
    bit is set if it is set in over half of the shingles' hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    ones, count = np.zeros(64, np.int64), max(1, len(words) - n + 1)
    for at in range(0, count, BLOCK_WORDS):
        block = words[at : at + BLOCK_WORDS + n - 1]
        joined = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        ends = ends[n - 1 :] if len(block) >= n else ends[-1:]
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: len(ends)].tolist(), ends.tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), n) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _turned(fp: Column, start: int) -> Column:
    """The ring from segment ``start`` on: the chain's first segment has the highest bits."""
    left = WIDTH * start
    return fp if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def _bits(ring: Column, first: int, count: int) -> Column:
    """``count`` bits of the ring from the ``first`` one from the top."""
    return F.shiftrightunsigned(F.shiftleft(ring, first) if first else ring, 64 - count)


def _place(ring: Column, place: int) -> Column:
    """One key for each part of the segment at ``place`` of the chain: the part's number and its bits."""
    return F.array(*(F.lit(k << 8).bitwiseOR(_bits(ring, WIDTH * place + first, count)) for k, (first, count) in enumerate(PARTS[place])))


def _keys(fps: DataFrame) -> DataFrame:
    """(key, start, ring): the keys of the chains of two segments of each fingerprint; ``ring`` is turned to its start."""
    rings = F.array(*(F.struct(F.lit(s).alias("start"), _turned(F.col("fp"), s).alias("ring")) for s in range(SEGMENTS)))
    turned = fps.select(F.explode(rings).alias("r")).select("r.start", "r.ring")
    head = F.shiftleft(F.col("start").cast("long"), 40).bitwiseOR(F.shiftleft(_bits(F.col("ring"), 0, WIDTH), 16))
    return turned.select(F.explode(F.transform(_place(F.col("ring"), 1), head.bitwiseOR)).alias("key"), "start", "ring")


def _further(keys: DataFrame, place: int) -> DataFrame:
    """The keys followed to the segment at ``place`` of their chains."""
    parts = F.explode(_place(F.col("ring"), place)).alias("part")
    return keys.select("key", "start", "ring", parts).select(F.xxhash64("key", F.lit(place), "part").alias("key"), "start", "ring")


def within(x: np.ndarray) -> np.ndarray:
    """Which differences (``x``: rings that were combined by exclusive or) keep every budget of the chain from its start."""
    keep = np.flatnonzero(x >> np.uint64(48) == 0)
    for segments in (2, 3, 4):
        keep = keep[np.bitwise_count(x[keep] >> np.uint64(64 - WIDTH * segments)) <= segments * DIFFERENCES // SEGMENTS]
    return keep


def grow(rings: np.ndarray) -> np.ndarray:
    """For each ring the first index of those that it reaches by links within the key.

    Who is reached is not compared again, so dense groups of copies cost little more than their size.
    """
    root, open_ = np.arange(len(rings)), np.arange(len(rings))
    while len(open_):
        first, open_ = open_[0], open_[1:]
        frontier = open_[:0]
        turn = np.array([first])
        while len(open_):
            step = max(1, (1 << 18) // len(open_))
            near = np.unique(np.concatenate([within((rings[turn[k : k + step], None] ^ rings[open_]).ravel()) % len(open_) for k in range(0, len(turn), step)]))
            if not len(near):
                break
            frontier = open_[near]
            root[frontier] = first
            open_ = np.delete(open_, near)
            turn = frontier
    return root


def across(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in left, index in right): for each ring of ``right`` the first of ``left`` that it links with, and for each of ``left`` the first of ``right``."""
    pairs = [], []
    step = max(1, (1 << 18) // len(right))
    for k in range(0, len(left), step):
        hit = within((left[k : k + step, None] ^ right).ravel())
        a, b = hit // len(right) + k, hit % len(right)
        for own in (np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]):
            pairs[0].append(a[own])
            pairs[1].append(b[own])
    return np.concatenate(pairs[0]), np.concatenate(pairs[1])


def _unturned(rings: np.ndarray, start: int) -> np.ndarray:
    right = np.uint64(WIDTH * start)
    return (rings if not start else rings >> right | rings << np.uint64(64) - right).view(np.int64)


def _opened(dealt: DataFrame) -> DataFrame:
    """(a, b) links from rows (key, block, start, ring) in order of (key, block): within a key, or between the two blocks of a key."""

    def links(start, block, rings):
        if block[0] == block[-1]:
            rings = np.unique(rings)
            a, b = grow(rings), np.arange(len(rings))
            a, b = rings[a[a != b]], rings[b[a != b]]
        else:
            left, right = rings[block == block[0]], rings[block != block[0]]
            i, j = across(left, right)
            a, b = left[i], right[j]
        return _unturned(a, start), _unturned(b, start)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            key = rows[0]
            if not len(key):
                continue
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            # the last key may go on in the next batch
            yield from made(rows, cuts[:-1])
            held = [r[cuts[-2] :] for r in rows]
        if held is not None and len(held[0]):
            yield from made(held, np.array([0, len(held[0])]))

    def made(rows, cuts):
        out = [], []
        for k in np.flatnonzero(np.diff(cuts) > 1):
            i, j = cuts[k], cuts[k + 1]
            a, b = links(int(rows[2][i]), rows[1][i:j], rows[3][i:j].view(np.uint64))
            if len(a):
                out[0].append(a)
                out[1].append(b)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _dealt(keys: DataFrame) -> DataFrame:
    return keys.select("key", "block", "start", "ring").repartition("key").sortWithinPartitions("key", "block")


def _blocks(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """Keys that stay too large, as pairs of blocks of about ``OPEN`` / 2 fingerprints; each pair is a key of its own."""
    sizes = sizes.select("key", F.ceil(F.col("n") / (OPEN // 2)).alias("blocks"))
    rows = keys.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("ring"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "block", "start", "ring")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) over the distinct fingerprints ``fps`` (fp): enough links to connect whatever links connect.

    Keys are counted with map-side combination; the few that are too large are set apart by their counts.
    """
    keys, found = _keys(fps), None
    for place in (2, 3, 4):
        sizes = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > OPEN), "simhash-sizes")
        large = sizes.count()
        rest = keys
        if large:
            # each holds over OPEN rows, but their number may grow: a broadcast only for a few
            names = F.broadcast(sizes.select("key")) if large <= 100_000 else sizes.select("key")
            rest, keys = keys.join(names, "key", "left_anti"), keys.join(names, "key", "left_semi")
        opened = materialise(_opened(_dealt(rest.withColumn("block", F.lit(0).cast("long")))), "simhash-links")
        found = opened if found is None else found.unionByName(opened)
        if not large:
            return found.distinct()
        if place == 4:
            return found.unionByName(materialise(_opened(_dealt(_blocks(keys, sizes))), "simhash-links")).distinct()
        keys = materialise(_further(keys, place), "simhash-keys")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link if at most ``DIFFERENCES`` bits differ; ``component_id`` is the smallest id reachable by links, itself included. Null
    texts and texts without words have the fingerprint 0 and link like any others. Equal fingerprints are one
    node, so copies are never paired. Rows without an id have a fingerprint, link with nothing and have a null component; rows
    that repeat an id are in the components of all their texts, and the rows stay apart. Other columns are left out, so their names cannot clash. No
    rows give no rows.
    """
    found = materialise(fingerprints(df, id_col, text_col, n), "simhash-fingerprints")
    known = materialise(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-distinct")
    parts = connected_components(links(known.select("fp")))
    placed = known.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialise(placed.join(lowest, "component").select("fp", "copies", "component_id"), "simhash-classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # a fingerprint of many rows is joined by a broadcast: no more than HEAVY of them can be that frequent
    heavy = F.broadcast(classes.where(F.col("copies") * HEAVY > total).select("fp", F.col("component_id").alias("heavy_id")))
    with_heavy = found.join(heavy, "fp", "left")
    light = with_heavy.where("heavy_id is null").join(classes.select("fp", "component_id"), "fp", "left")
    done = with_heavy.where("heavy_id is not null").withColumnRenamed("heavy_id", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return light.select("doc_id", text.alias("fingerprint"), component).unionByName(done.select("doc_id", text.alias("fingerprint"), component))
