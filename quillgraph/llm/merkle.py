"""Merkle manifest of a dataset, with a proof for every row, by time-forward processing.

Nodes are labelled so that children come before parents. A node sends its digest to the label of its parent; a
priority queue ordered by label hands each parent its children's digests, left to right, when the sweep reaches it. The reversed
sweep goes from the root down: a node sends its children what the proof of each has from there to the root.

The queue is external: the tree is swept in bands of ``BAND`` levels, and the messages between bands are rows of a written table that
Spark's shuffle brings in order of labels. Within a band each subtree is swept by one task with a queue of bounded
size (``FAN ** BAND`` messages). A tree of n leaves takes ``log(n) / log(4096)`` rounds; a group that holds a third of all rows is thousands of
subtrees like any other.
"""

from __future__ import annotations

import hashlib
import heapq
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

#: Children of a node; levels that are swept together.
FAN, BAND = 16, 3
CHUNK = FAN**BAND
#: Largest table of runs that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_NODES = "grp string, pos long, size long, digest string"
_MESSAGES = "grp string, chunk long, up array<string>, subroot string"
_PROOFS = "name string, leaf string, claimed string, proof array<string>, proof_sha256 string, folded string, subroot string"


def node_digest(children: list[str]) -> str:
    """The digest of a node: of its children's digests as hexadecimal text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels(size: int) -> int:
    """How often ``size`` nodes are joined in runs until one remains."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


class Queue:
    """A priority queue of messages: the lowest label comes first, with its messages in the order in which they were sent."""

    def __init__(self) -> None:
        self.heap, self.sent = [], 0

    def __bool__(self) -> bool:
        return bool(self.heap)

    def send(self, label: tuple[int, int], message) -> None:
        heapq.heappush(self.heap, (label, self.sent, message))
        self.sent += 1

    def deliver(self) -> tuple[tuple[int, int], list]:
        label, _, message = heapq.heappop(self.heap)
        messages = [message]
        while self.heap and self.heap[0][0] == label:
            messages.append(heapq.heappop(self.heap)[2])
        return label, messages


def sweep_up(digests: list[str], height: int) -> list[list[str]]:
    """The digests of a subtree's nodes, by level: ``digests`` at level 0, its top (one node) at level ``height``."""
    tree, queue = [digests, *([] for _ in range(height))], Queue()
    if height:
        for k, digest in enumerate(digests):
            queue.send((1, k // FAN), digest)
    while queue:
        (level, k), children = queue.deliver()
        digest = node_digest(children)
        tree[level].append(digest)
        if level < height:
            queue.send((level + 1, k // FAN), digest)
    return tree


def sweep_down(tree: list[list[str]], suffix: list[str]) -> Iterator[list[str]]:
    """The proof of each node at level 0: alternately the digests left and right of it, level by level, to the root."""
    queue, top = Queue(), len(tree) - 1
    queue.send((-top, 0), suffix)
    while queue:
        (level, k), (suffix,) = queue.deliver()
        level = -level
        if not level:
            yield suffix
            continue
        run = tree[level - 1][k * FAN : (k + 1) * FAN]
        for slot in range(len(run)):
            queue.send((1 - level, k * FAN + slot), ["".join(run[:slot]), "".join(run[slot + 1 :]), *suffix])


def fold(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to; a level without siblings still hashes."""
    for left, right in zip(proof[::2], proof[1::2], strict=True):
        leaf = node_digest([left, leaf, right])
    return leaf


def fold_column(leaf: Column, proof: Column) -> Column:
    """``fold`` as a column, for those who hold a row and its proof."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(proof) / 2).cast("int") - 1), lambda k: F.struct(F.get(proof, 2 * k).alias("left"), F.get(proof, 2 * k + 1).alias("right")))
    return F.when(F.size(proof) == 0, leaf).otherwise(F.aggregate(pairs, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256)))


def encoded(*columns: Column) -> Column:
    """The text that a leaf hashes: ``-`` for a null, else the bytes' number, a colon and the value; numbers in decimal."""
    return F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; all other characters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _subtrees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """The rows of one (grp, chunk) after another, from batches in that order."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place of each in its group by ``order``, and ``size``, the group's rows.

    Rows are sorted over ranges of (grp, order), so a large group has many ranges; only the counts of ranges are summed up.
    """
    dealt = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    dealt = materialise(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    runs = dealt.groupBy("part", "grp").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("grp")  # a group has no more rows here than there are partitions
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select("part", "grp", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "merkle-runs")
    few = runs.count() <= BROADCAST_ROWS
    return dealt.join(F.broadcast(runs) if few else runs, ["part", "grp"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "pos")


def _rise(nodes: DataFrame) -> DataFrame:
    """The nodes ``BAND`` levels up, or the top of a group that ends before."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])

    def run(batches):
        out = []
        for rows in _subtrees(batches, 5):
            grp, chunk, _, size, _ = rows[0]
            height = min(BAND, levels(size))
            (top,) = sweep_up([r[4] for r in rows], height)[-1]
            for _ in range(height):
                size = -(-size // FAN)
            out.append((grp, chunk, size, top))
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    columns = nodes.select("grp", F.floor(F.col("pos") / CHUNK).alias("chunk"), "pos", "size", "digest")
    return _dealt(columns).mapInArrow(run, _NODES)


def _fall(nodes: DataFrame, messages: DataFrame, last: bool) -> DataFrame:
    """What the nodes of a band receive from above: the messages of the next band, or at the ``last`` one the proofs of the leaves.

    A message is a row before the first node of its subtree.
    """
    text, texts = pa.string(), pa.list_(pa.string())
    schema = pa.schema([("name", text), ("leaf", text), ("claimed", text), ("proof", texts), ("proof_sha256", text), ("folded", text), ("subroot", text)] if last else [("grp", text), ("chunk", pa.int64()), ("up", texts), ("subroot", text)])

    def run(batches):
        out, held = [], 0
        for (_, _, _, _, _, _, _, up, subroot), *rows in _subtrees(batches, 9):
            tree = sweep_up([r[4] for r in rows], min(BAND, levels(rows[0][3])))
            for (grp, _, pos, _, digest, name, claimed, _, _), proof in zip(rows, sweep_down(tree, up), strict=True):
                if last:
                    out.append((name, digest, claimed, proof, node_digest(proof), fold(claimed or digest, proof), subroot))
                else:
                    out.append((grp, pos, proof, subroot))
                held += 200 + sum(map(len, proof))
                if held > 8 << 20:
                    yield _batch(out, schema)
                    out, held = [], 0
        if out:
            yield _batch(out, schema)

    none = F.lit(None).cast("string")
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    below = nodes.select("grp", chunk, "pos", "size", "digest", *((F.col("name"), F.col("claimed")) if last else (none.alias("name"), none.alias("claimed"))), F.lit(None).cast("array<string>").alias("up"), none.alias("subroot"))
    above = messages.select("grp", "chunk", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"), none.alias("digest"), none.alias("name"), none.alias("claimed"), "up", "subroot")
    return _dealt(below.unionByName(above)).mapInArrow(run, _PROOFS if last else _MESSAGES)


def _climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each band of a forest, and (grp, digest, band): the top of each group and the band that it is in."""
    biggest = leaves.agg(F.max("size")).first()[0] or 0
    bands, tops = [leaves], leaves.where("size = 1").select("grp", "digest", F.lit(0).alias("band"))
    for band in range(-(-levels(biggest) // BAND)):
        grown = materialise(_rise(bands[band].where("size > 1")), "merkle-nodes")
        tops = tops.unionByName(grown.where("size = 1").select("grp", "digest", F.lit(band).alias("band")))
        bands.append(grown.where("size > 1"))
    return bands[: max(1, len(bands) - 1)], tops


def _prove(bands: list[DataFrame], starts: DataFrame) -> DataFrame:
    """The proofs of all leaves; ``starts`` (grp, band, up, subroot) has what each group's top receives."""
    messages = None
    for band in reversed(range(len(bands))):
        here = starts.where(F.col("band") == band).select("grp", F.lit(0).cast("long").alias("chunk"), "up", "subroot")
        messages = here if messages is None else here.unionByName(messages)
        # a group that ended in a lower band has no nodes here, and no message yet
        messages = _fall(bands[band], messages, last=band == 0)
        if band:
            messages = materialise(messages, "merkle-messages")
    return messages


def manifest(df: DataFrame, id_col: str, group_col: str, columns: list[str], claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every row of ``df``.

    A leaf is the SHA-256 of the ``encoded`` values of ``columns``. The leaves of a group, in order of ids (nulls first, ties by
    digest), are joined in runs of ``FAN`` until one remains, the group's subroot; the subroots, in order of their groups (null first, then by bytes), are
    joined to the root likewise. ``proof`` has alternately the digests left and right of a node in its run, from the leaf to the
    root; ``proof_sha256`` is the hash of all of them. ``folded_root`` is the root that the proof and the
    ``claimed`` leaf (an expression over ``df``; null: the leaf itself) lead to, and ``verified`` whether that is the root.

    Repeated rows are leaves of their own. Nulls in any column are told apart from empty texts. Other columns are left
    out, so their names cannot clash. No rows give no rows and no root.
    """
    ids, group = F.col(id_col).cast("long"), F.col(group_col).cast("string")
    named = [F.col(c) for c in columns]
    none = F.lit(None).cast("string")
    leaves = df.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"),
        ids.alias("doc_id"),
        ids.cast("string").alias("name"),
        F.sha2(encoded(*named), 256).alias("digest"),
        (none if claimed is None else claimed).alias("claimed"),
    )
    bands, tops = _climb(_numbered(leaves, ["doc_id", "digest"]))
    tops = materialise(tops, "merkle-subroots")
    above = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", none.alias("claimed"))
    upper, summit = _climb(_numbered(above, ["name"]))
    top = summit.select("digest").first()
    root = F.lit(top[0] if top else None).cast("string")
    ends = _prove(upper, summit.select("grp", "band", F.array().cast("array<string>").alias("up"), none.alias("subroot")))
    starts = ends.select(F.col("name").alias("grp"), F.col("proof").alias("up"), F.col("leaf").alias("subroot")).join(tops.select("grp", "band"), "grp")
    proofs = _prove(bands, materialise(starts, "merkle-starts"))
    return proofs.select(F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def tampered_leaf(columns: list[str], id_col: str, text_col: str, one_in: int = 5) -> Column:
    """The leaf of a row whose text was lower-cased in A-Z, for one in so many ids by checksum; null for all others and null texts."""
    changed = [lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in columns]
    chosen = (F.crc32(F.col(id_col).cast("long").cast("string")) % one_in == 0) & F.col(text_col).isNotNull()
    return F.when(chosen, F.sha2(encoded(*changed), 256))
