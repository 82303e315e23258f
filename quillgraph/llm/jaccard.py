"""Exact self-join of documents by the Jaccard similarity of their word shingles.

The join works on a token-group matrix. Similar documents are partitioned into groups, each group keeps
the union of its members' tokens (a row of the matrix), the overlap of a query with that union bounds its
overlap with any member, and only groups whose bound reaches the threshold are opened.

At scale the matrix is never formed for unrelated documents. A set links with another only if enough of its tokens
occur in other sets at all: tokens are counted over the whole corpus, by ranges of their hashes, and sets with too few shared ones are
done. The tokens of the others are put in order from rare to frequent; two linked sets share one of the first
``n - ceil(t n) + 1``, so sets that share such a token form a family, found with linear work (a star for each token).
A family is the unit of work; a large one is dealt out as pairs of blocks of bounded size. Inside a unit the matrix prunes and groups are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrays import giving_back, sorted_distinct
from quillgraph.llm.components import connected_components
from quillgraph.runtime import materialise

#: Members of a group of the matrix.
GROUP = 16
#: A block of a family holds about so many tokens and documents at most.
BLOCK_TOKENS = 500_000
BLOCK_DOCS = 512
#: Largest list of representatives that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Tokens that a task compares before it sends them on, and tokens of a range in which they are counted.
CHUNK_TOKENS, RANGE_TOKENS = 500_000, 2_000_000
CHUNK_DOCS = 60_000
#: Words that a task remembers before it starts anew.
REMEMBERED = 400_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, n: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of the whole text.

    A-Z are lower-cased; words are split at ASCII white space. A text with fewer words is one shingle; without words
    there is none.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    last = len(ids) - n + 1
    h = np.full(last, n, np.uint64)
    for k in range(n):
        h = _mix(h * _M1 + ids[k : k + last])
    return sorted_distinct(h)


def node_of(tokens: np.ndarray) -> int:
    """One id for equal sets."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[bytes | None]:
    return (v.as_py() for v in batch.column(column).cast(pa.binary()))


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node); node is null for a document without words."""

    def run(batches):
        words = _Words()
        for batch in batches:
            sets = [shingles(t, n, words) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "node"])

    return docs.mapInArrow(giving_back(run), "doc_id long, n_shingles long, node long")


_SENT = "range long, chunk long, tokens binary, owners binary"
_SHARED = "chunk long, nodes binary, owners binary, shared binary"
#: The owner of a token that several sets of a chunk hold: they have counted it already.
_COUNTED = 65_535


def _sent(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """The tokens of each chunk of documents, by ranges of their hashes; a task takes equal sets once.

    A token that several sets of the chunk hold is sent once, whatever their number, so a frequent token makes no more rows than
    there are chunks. The row with the range -1 - chunk has the chunk's nodes and, as 64-bit pairs in ``owners``, their
    numbers of tokens and of tokens shared within the chunk.
    """

    def chunk_rows(chunk: int, nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        times = np.diff(np.append(np.flatnonzero(new), len(flat)))
        local = np.bincount(owner, np.repeat(times, times) > 1, len(sets)).astype(np.int64)
        token, owner = _mix(flat[new] * _M1), np.where(times > 1, _COUNTED, owner[new]).astype("<u2")
        place = (((token >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, token, owner = place[order], token[order].astype("<u4"), owner[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), len(place))
        rows = [(int(place[i]), chunk, token[i:j].tobytes(), owner[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        rows.append((-1 - chunk, chunk, np.array(nodes, "<i8").tobytes(), np.stack([sizes, local], 1).astype("<i8").tobytes()))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=["range", "chunk", "tokens", "owners"])

    def run(batches):
        words, seen, task, made = _Words(), set(), TaskContext.get().partitionId(), 0
        nodes, sets, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), _texts(batch), strict=True):
                if doc.as_py() is None:
                    continue
                tokens = shingles(text, n, words)
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                sets.append(tokens)
                held += len(tokens)
                if held >= CHUNK_TOKENS or len(nodes) >= CHUNK_DOCS:
                    yield chunk_rows(task << 32 | made, nodes, sets)
                    nodes, sets, held, made = [], [], 0, made + 1
        if nodes:
            yield chunk_rows(task << 32 | made, nodes, sets)

    return docs.mapInArrow(giving_back(run), _SENT)


def _shared(sent: DataFrame) -> DataFrame:
    """(chunk, nodes, owners, shared): for each chunk and range, how many tokens of a set (owner) other sets hold too.

    A range is a bounded share of all tokens. Its tokens are compared by 32 further bits of their hashes: tokens
    that fall together only seem shared, which can't lose a link. The rows with nodes are handed on.
    """
    names = [c.split()[0] for c in _SHARED.split(", ")]

    def counted(rows: list) -> pa.RecordBatch:
        token = np.concatenate([t for _, t, _ in rows])
        chunk = np.repeat(np.arange(len(rows)), [len(t) for _, t, _ in rows])
        key = chunk << 16 | np.concatenate([o for _, _, o in rows]).astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, key = token[order], key[order]
        same = token[1:] == token[:-1]
        hit = (np.append(same, False) | np.insert(same, 0, False)) & (key & 0xFFFF != _COUNTED)
        key, times = np.unique(key[hit], return_counts=True)
        cut = np.searchsorted(key >> 16, np.arange(len(rows) + 1))
        out = [(rows[k][0], None, (key[i:j] & 0xFFFF).astype("<u2").tobytes(), times[i:j].astype("<u4").tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=names)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for place, chunk, tokens, owners in zip(*(batch.column(k) for k in range(4)), strict=True):
                place, chunk = place.as_py(), chunk.as_py()
                if place < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([v], pa.binary()) for v in (tokens.as_py(), None, owners.as_py()))], names=names)
                    continue
                if place != now:
                    if len(rows) > 1:
                        yield counted(rows)
                    now, rows = place, []
                rows.append((chunk, np.frombuffer(tokens.as_py(), "<u4"), np.frombuffer(owners.as_py(), "<u2")))
        if len(rows) > 1:
            yield counted(rows)

    return sent.repartition("range").sortWithinPartitions("range").mapInArrow(giving_back(run), _SHARED)


def _summed(parts: DataFrame) -> DataFrame:
    """(node, n, shared) of each set of each chunk: its tokens, and those that other sets hold too."""

    def run(batches):
        now, nodes, total = None, None, np.zeros(CHUNK_DOCS, np.int64)

        def done():
            own = total[: len(nodes)] + nodes[:, 2]
            total[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), pa.array(own)], names=["node", "n", "shared"])

        for batch in batches:
            for chunk, names, owners, shared in zip(*(batch.column(k) for k in range(4)), strict=True):
                if (chunk := chunk.as_py()) != now:
                    if now is not None:
                        yield done()
                    now = chunk
                if names.is_valid:
                    nodes = np.column_stack([np.frombuffer(names.as_py(), "<i8"), np.frombuffer(shared.as_py(), "<i8").reshape(-1, 2)])
                else:
                    total[np.frombuffer(owners.as_py(), "<u2")] += np.frombuffer(shared.as_py(), "<u4")
        if now is not None:
            yield done()

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(giving_back(run), "node long, n long, shared long")


def _survivors(docs: DataFrame, n: int, per_cent: int, tokens: int) -> DataFrame:
    """(node): the sets that hold enough tokens of other sets to link with one; ``tokens`` are there in all."""
    whole = _summed(_shared(_sent(docs, n, max(1, -(-tokens // RANGE_TOKENS)))))
    return whole.where(100 * F.col("shared") >= per_cent * F.col("n")).select("node").distinct()


def _sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(node, copies, tokens) of the nodes of ``members`` (doc_id, node, copies), from the texts of their documents."""

    def run(batches):
        words = _Words()
        for batch in batches:
            node = batch.column(2).to_pylist()
            sets = [shingles(t, n, words) for t in _texts(batch)]
            keep = [k for k, s in enumerate(sets) if len(s) and node_of(s) == node[k]]
            rest = batch.select([2, 3]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([sets[k].tobytes() for k in keep], pa.binary())], names=["node", "copies", "tokens"])

    small = members.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(members) if small else members, "doc_id").select("doc_id", "text", "node", "copies")
    return texts.mapInArrow(giving_back(run), "node long, copies long, tokens binary")


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node, n) rows of token sets."""
    for batch in batches:
        for node, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = np.frombuffer(tokens.as_py(), np.int64)
            for at in range(0, len(held), 100_000):
                some = held[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), node)), pa.array(np.full(len(some), len(held)))], names=["token", "node", "n"])


def prefix_of(tokens: np.ndarray, times: np.ndarray, size: int, per_cent: int) -> np.ndarray:
    """The tokens by which a set of ``size`` tokens meets every set that it links with.

    ``tokens`` are those that ``times`` > 1 sets hold. In the order from rare to frequent (ties by token), two linked
    sets share one of the first ``size - ceil(per_cent size / 100) + 1``; the tokens of one set alone come before the others.
    """
    room = size - -(-per_cent * size // 100) + 1 - (size - len(tokens))
    return tokens[np.lexsort((tokens, times))[: max(room, 0)]]


def _prefixes(sets: DataFrame, per_cent: int) -> DataFrame:
    """(key, node): the prefix tokens of each set, counted over the given sets."""
    spelt = sets.select("node", "tokens").mapInArrow(giving_back(_spelt), "token long, node long, n long")
    times = spelt.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    known = spelt.join(times, "token")

    def prefix(node, n, tokens, times):
        tokens, times = np.concatenate(tokens), np.concatenate(times)
        tokens, first = np.unique(tokens, return_index=True)  # a repeated row repeats its tokens
        own = prefix_of(tokens, times[first], n, per_cent)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), node))], names=["key", "node"])

    def run(batches):
        now, size, tokens, times = None, 0, [], []
        for batch in batches:
            token, node, n, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(node):
                continue
            cut = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if node[i] != now:
                    if tokens:
                        yield prefix(now, size, tokens, times)
                    now, size, tokens, times = node[i], int(n[i]), [], []
                tokens.append(token[i:j])
                times.append(count[i:j])
        if tokens:
            yield prefix(now, size, tokens, times)

    dealt = known.select("token", "node", "n", "times").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(giving_back(run), "key long, node long")


def _stars(keys: DataFrame) -> DataFrame:
    """(a, b): each node of a key with the smallest node of that key; linear in the rows, minima are combined before the shuffle."""
    hubs = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    return keys.join(hubs, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _open_groups(query: list, data: list, per_cent: int, same: bool):
    """Links between two lists of (node, copies, tokens): yields (index in query, indices in data).

    ``data`` is partitioned into groups of similar sets; the rows of the token-group matrix are
    their token unions. Tokens of a single set can't be shared and only count towards its size.
    """
    everything = query if same else query + data
    flat = np.concatenate([x[2] for x in everything])
    _, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    cuts = np.cumsum([0, *(len(x[2]) for x in everything)])
    local = [own[shared[own]] for own in (ids[cuts[k] : cuts[k + 1]] for k in range(len(everything)))]
    q_sets, d_sets = local[: len(query)], local if same else local[len(query) :]
    d_size = np.array([len(x[2]) for x in data])
    order = sorted(range(len(data)), key=lambda k: (int(d_sets[k][0]) if len(d_sets[k]) else -1, len(d_sets[k]), data[k][0]))
    groups = [np.array(order[k : k + GROUP]) for k in range(0, len(order), GROUP)]
    union = [np.unique(np.concatenate([d_sets[k] for k in g])) for g in groups]
    union_cut = np.cumsum([0, *map(len, union)])
    union_flat = np.concatenate(union)
    members = [np.concatenate([d_sets[k] for k in g]) for g in groups]
    member_cut = [np.cumsum([0, *(len(d_sets[k]) for k in g)]) for g in groups]
    largest = np.array([d_size[g].max() for g in groups])
    mark = np.zeros(len(times), bool)
    for q, tokens in enumerate(q_sets):
        size = len(query[q][2])
        if 100 * len(tokens) < per_cent * size:
            continue
        mark[tokens] = True
        sums = np.concatenate([[0], np.cumsum(mark[union_flat])])
        bound = sums[union_cut[1:]] - sums[union_cut[:-1]]
        near = []
        for g in np.flatnonzero((100 * bound >= per_cent * size) & (100 * largest >= per_cent * size)):
            hits = np.concatenate([[0], np.cumsum(mark[members[g]])])
            common = hits[member_cut[g][1:]] - hits[member_cut[g][:-1]]
            near.append(groups[g][(100 + per_cent) * common >= per_cent * (size + d_size[groups[g]])])
        mark[tokens] = False
        near = np.concatenate(near) if near else np.empty(0, np.int64)
        if same:
            near = near[near != q]
        if len(near):
            yield q, near


def _unit_links(rows: list, per_cent: int) -> list[tuple[int, int, int]]:
    """(node, smallest node reached within the unit, documents linked with) of a unit's linked nodes."""
    sides = {}
    for side, node, copies, tokens in rows:
        sides.setdefault(side, {}).setdefault(node, (node, copies, tokens))
    names = sorted(sides)
    left = [sides[names[0]][k] for k in sorted(sides[names[0]])]
    same = len(names) == 1
    right = left if same else [sides[names[1]][k] for k in sorted(sides[names[1]])]
    root, count = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q, near in _open_groups(left, right, per_cent, same):
        a, copies, _ = left[q]
        for r in near.tolist():
            b, other, _ = right[r]
            count[a] = count.get(a, 0) + other
            if not same:
                count[b] = count.get(b, 0) + copies
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(x, find(x), n) for x, n in count.items()]


def _links(dealt: DataFrame, per_cent: int) -> DataFrame:
    """(node, root, linked) from rows (unit, side, node, copies, tokens) sorted by unit."""

    def flush(rows, out):
        if len({r[1] for r in rows}) > 1:
            out += _unit_links(rows, per_cent)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["node", "root", "linked"])

    def run(batches):
        unit, rows, out, wanted = None, [], [], 1
        for batch in batches:
            for u, pair, side, node, copies, tokens in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if u != unit:
                    if len({r[0] for r in rows}) == wanted:
                        flush(rows, out)
                    unit, rows, wanted = u, [], 1 + pair
                rows.append((side, node, copies, np.frombuffer(tokens, np.uint64)))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if len({r[0] for r in rows}) == wanted:
            flush(rows, out)
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(giving_back(run), "node long, root long, linked long")


def _deal(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Each node's token set, once for each unit that needs it, in order of units."""
    placed = members.select("node", "family", "blocks", "block")
    small = placed.count() <= BROADCAST_ROWS
    sets = sets.join(F.broadcast(placed) if small else placed, "node")
    one = sets.where("blocks = 1").select(F.xxhash64("family").alias("unit"), F.lit(0).alias("pair"), F.lit(0).cast("long").alias("side"), "node", "copies", "tokens")
    many = sets.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    many = many.select(F.xxhash64("family", low, high).alias("unit"), (low != high).cast("int").alias("pair"), F.col("block").alias("side"), "node", "copies", "tokens")
    return one.union(many).repartition("unit").sortWithinPartitions("unit", "side", "node")


def similar_documents(df: DataFrame, id_col: str, text_col: str, n: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row.

    Two documents link when ``100 * |A and B| >= per_cent * |A or B|`` for their sets of ``n``-word
    shingles; ``component_id`` is the smallest id reachable by links, itself included; ``n_links`` counts
    the documents that a document links with. The result is exact: no pair that reaches the threshold is lost.

    Equal sets are one node, so copies cost nothing after the first pass and are never paired. Null and
    empty texts have no shingles and no links, and are components of their own. Rows without an id link with
    nothing and have a null component. Rows that repeat an id count as documents of that id. Other
    columns are left out, so their names cannot clash. No rows give no rows.
    """
    if not 50 <= per_cent <= 100:
        raise ValueError("per_cent lies between 50 and 100")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nodes = materialise(_nodes(docs, n), "jaccard-nodes")
    known = nodes.where("doc_id is not null and node is not null")
    per_node = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    tokens = per_node.agg(F.sum("n")).first()[0] or 0
    some = per_node.join(_survivors(docs, n, per_cent, tokens), "node").select("doc_id", "node", "copies", "n")
    some = materialise(some, "jaccard-survivors")
    sets = materialise(_sets(docs, some.select("doc_id", "node", "copies"), n), "jaccard-sets")
    families = connected_components(_stars(materialise(_prefixes(sets, per_cent), "jaccard-prefixes")))
    members = families.join(some, "node").withColumnRenamed("component", "family")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks"))
    members = materialise(members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).select("node", "family", "blocks", "block"), "jaccard-members")
    links = materialise(_links(_deal(sets, members), per_cent), "jaccard-links")
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"), F.min("root").alias("root"))
    if not members.where("blocks > 1").isEmpty():
        # what one unit joined, another may join further
        merged = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "merged")
        linked = linked.join(merged, "node", "left").select("node", "linked", F.coalesce("merged", "root").alias("root"))
    placed = per_node.join(linked, "node", "left").select("node", "doc_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = placed.join(lowest, "root").select("node", "component_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    found = nodes.join(classes, "node", "left")
    known_id = F.col("doc_id").isNotNull()
    return found.select("doc_id", "n_shingles", F.when(known_id, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known_id, F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"))
