"""Knowledge graph: nodes and edges as tables keyed by content hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.similar import similar_nodes  # noqa: F401
from quillgraph.runtime import materialise


def mention_nodes(mentions: DataFrame) -> DataFrame:
    """Mentions with the id of their node; endpoints of relations need no lookup, the id is a hash."""
    return mentions.withColumn("node_id", T.node_id(F.col("entity_type"), F.col("text")))


def build_nodes(mentions: DataFrame) -> DataFrame:
    """One node for each id: greatest confidence, first text, number of mentions and of distinct documents.

    Documents stay in the bridge table of ``node_documents``, so a hub node carries no unbounded array.
    """
    rows = mention_nodes(mentions)
    return rows.groupBy("node_id").agg(
        F.min_by("text", F.struct("doc_id", "start_pos")).alias("text"),
        F.first("entity_type").alias("node_type"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("n_mentions"),
        F.count_distinct("doc_id").alias("n_documents"),
    )


def node_documents(mentions: DataFrame) -> DataFrame:
    """The bridge of nodes and the documents that mention them."""
    return mention_nodes(mentions).select("node_id", "doc_id").distinct()


def relation_edges(pairs: DataFrame, edge_type: str = "co_occurs_with") -> DataFrame:
    """Co-occurring mentions as relations between nodes; a node is not related to itself."""
    a, b = T.node_id(F.col("a_entity_type"), F.col("a_text")), T.node_id(F.col("b_entity_type"), F.col("b_text"))
    rows = pairs.select("doc_id", a.alias("src"), b.alias("dst"), F.lit(edge_type).alias("edge_type"), "confidence")
    return rows.where("src <> dst")


def build_edges(relations: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type): greatest confidence, number of relations and of distinct documents."""
    rows = relations.withColumn("edge_id", T.edge_id(F.col("src"), F.col("dst"), F.col("edge_type")))
    return rows.groupBy("edge_id", "src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_relations"), F.count_distinct("doc_id").alias("n_documents"))


def resolve_by_evidence(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints of relations without ids: the first two nodes of the document any of whose words occurs in the evidence.

    ``relations`` has relation_id, doc_id, evidence; ``nodes`` has doc_id, node_id, text. Relations without two are dropped.
    """
    hit = relations.join(nodes, "doc_id").where(F.exists(T.tokens(F.lower("text")), lambda w: F.contains(F.lower("evidence"), w)))
    ranked = hit.withColumn("n", F.row_number().over(Window.partitionBy("relation_id").orderBy("node_id")))
    ends = ranked.where("n <= 2").groupBy("relation_id", "doc_id", "evidence").agg(F.min("node_id").alias("src"), F.max("node_id").alias("dst"))
    return ends.where("src <> dst")


def merge_maps(rows: DataFrame, key: str, map_col: str, order: str) -> DataFrame:
    """Properties of several rows of a key in one map; the last value of a property wins."""
    parts = rows.select(key, order, F.explode(map_col).alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", order).alias("v"))
    return parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(map_col))


def upsert(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Existing and new nodes or edges as one table, with ``created`` for keys that were not there before."""
    both = existing.select(key, "confidence", F.lit(0).alias("new")).unionByName(batch.select(key, "confidence", F.lit(1).alias("new")))
    return both.groupBy(key).agg(F.max("confidence").alias("confidence"), (F.min("new") == 1).alias("created"), F.sum("new").alias("updates"))


def merge_graphs(*parts: DataFrame, key: str = "node_id", documents: Sequence[DataFrame] | None = None) -> DataFrame:
    """Union of several graphs' nodes or edges: greatest confidence, number of graphs and of distinct documents.

    ``documents`` are the graphs' bridge tables (key, doc_id), from which documents that graphs share are counted once; without them
    the graphs' own counts are added up, which is right only if they share none. ``graphsets.merge`` unites evidence and properties, too.
    A key repeated within a graph counts as a further graph. No rows give no rows.
    """
    rows = reduce(DataFrame.unionByName, parts)
    merged = rows.groupBy(key).agg(F.max("confidence").alias("confidence"), F.count("*").alias("graphs"), *(() if documents else (F.sum("n_documents").alias("n_documents"),)))
    if not documents:
        return merged
    united = reduce(DataFrame.unionByName, (d.select(key, "doc_id") for d in documents)).distinct()
    return merged.join(united.groupBy(key).agg(F.count("doc_id").alias("n_documents")), key, "left").fillna(0, ["n_documents"])


def graph_statistics(items: DataFrame, type_col: str) -> DataFrame:
    """Totals and mean confidence, overall (null) and by type."""
    return items.groupingSets([[], [type_col]], type_col).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def list_graphs(items: DataFrame) -> DataFrame:
    """The names of all graphs in order, each once; rows without a graph are one, listed first."""
    return items.select("graph_id").distinct().orderBy("graph_id")


def drop_graph(items: DataFrame, graph_id: str) -> DataFrame:
    """The rows of all other graphs; rows without a graph stay. ``sources.files.drop_stored_graph`` deletes one in storage."""
    return items.where(~F.col("graph_id").eqNullSafe(graph_id))


def remove_documents(bridge: DataFrame, edges: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that still have a document, edges between them) after documents are deleted."""
    left = bridge.join(doc_ids, "doc_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("n_documents"))
    ids = left.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return left, kept


#: 64-bit words of a set's signature.
SIGNATURE = 32


def _signatures(spread: DataFrame) -> DataFrame:
    """(rep, s0, s1, ...): for each bit the parity of the number of the set's tokens that are hashed to it. Where two signatures differ, the sets do, too. ``similar`` has them in bytes, as long as the sets need."""
    bits = spread.select("rep", F.xxhash64("token").alias("h")).select("rep", F.expr("cast(h & 63 as int)").alias("bit"), F.expr(f"(h >> 6) & {SIGNATURE - 1}").alias("word"))
    one = F.expr("shiftleft(1L, bit)")
    return bits.groupBy("rep").agg(*(F.coalesce(F.bit_xor(F.when(F.col("word") == k, one)), F.lit(0)).alias(f"s{k}") for k in range(SIGNATURE)))


def _both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of all edges in both directions, written once in one of them; repeated edges stay, as arrivals are made distinct at each hop."""
    one = materialise(edges.select("src", "dst").where("src <> dst"), "edges")
    return one.union(one.select("dst", "src"))


def _inside(reached: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The edges with one end nearer than ``max_depth`` and both reached, with the depths d1 of src and d2 of dst.

    They are met from the nearer ends, which are few; what is at ``max_depth`` meets only edges that have been found.
    """
    columns = ["query_id", "dst", "src", *(c for c in edges.columns if c not in ("src", "dst")), "d1", "d2"]
    ends = {c: reached.select("query_id", F.col("node_id").alias(c), F.col("depth").alias(d)) for c, d in (("src", "d1"), ("dst", "d2"))}
    from_src = edges.join(ends["src"].where(F.col("d1") < max_depth), "src").join(ends["dst"], ["query_id", "dst"])
    from_dst = edges.join(ends["dst"].where(F.col("d2") < max_depth), "dst").join(ends["src"].where(F.col("d1") >= max_depth), ["query_id", "src"])
    return from_src.select(columns).union(from_dst.select(columns))


def traverse(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(query_id, node_id, depth): undirected breadth-first search, smallest depth of each node within ``max_depth``.

    Each hop joins the frontier with the edges and keeps what was not reached; hops are checkpointed, so lost executors
    cost one hop. Hubs are join rows, which adaptive execution can split.
    """
    both = _both_ways(edges)
    reached = frontier = materialise(starts.select("query_id", "node_id").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        nearby = frontier.join(both, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id")).distinct()
        frontier = materialise(nearby.join(reached, ["query_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def traversed_edges(reached: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Edges with one end nearer than ``max_depth`` and both ends reached, oriented from the nearer end."""
    return _inside(reached, edges, max_depth)


def traverse_paths(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(query_id, node_id, depth, path): the least depth of each node and the smallest of its shortest paths, from start to node.

    A path grows with its hop: of all arrivals at a node the smallest path wins by an aggregation with map-side combination, and since all are equally long, smallest paths
    have smallest beginnings. Paths hold at most ``max_depth`` + 1 nodes. Starts without edges are reached at depth 0; null ids and loops are left out.
    """
    both = _both_ways(edges)
    begin = starts.select("query_id", "node_id").where("node_id is not null").distinct()
    reached = frontier = materialise(begin.select("query_id", "node_id", F.lit(0).alias("depth"), F.array("node_id").alias("path")), "paths")
    for depth in range(1, max_depth + 1):
        # all arrivals at a node end with it, so the smallest path is that of the smallest beginning
        arrivals = frontier.join(both, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"), "path")
        best = arrivals.groupBy("query_id", "node_id").agg(F.min("path").alias("path")).join(reached.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        frontier = materialise(best.select("query_id", "node_id", F.lit(depth).alias("depth"), F.array_append("path", F.col("node_id")).alias("path")), "paths")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def edge_paths(reached: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(query_id, edge_id, from_node, to_node, depth): one row for each traversed edge, from the end that is reached first (ties: the smaller id).

    An edge is traversed if one end is nearer than ``max_depth`` and both are reached; ``depth`` is that of the first end.
    """
    rows = _inside(reached, edges.select("edge_id", "src", "dst"), max_depth)
    forward = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") <= F.col("dst")))
    return rows.select("query_id", "edge_id", F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("from_node"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("to_node"), F.least("d1", "d2").alias("depth"))


def _masks(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, block, mask): for each node and block of ``BLOCK`` queries, the bits of the queries that have it. ``queries`` is (query_id, block, bit)."""
    bits = pairs.join(queries, "query_id").select("node_id", "block", F.expr("shiftleft(1L, bit)").alias("one"))
    return bits.groupBy("node_id", "block").agg(F.bit_or("one").alias("mask"))


#: Queries that are counted together as bits of one number; blocks are numbered within parts of about so many queries.
BLOCK, NUMBERED = 64, 4096


def count_edges(reached: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(query_id, n_edges): the number of ``edge_paths`` of each query that has any near node, without a row for each query and edge.

    ``reached`` comes from ``traverse`` over the same edges, so both ends of an edge are reached if one is nearer than ``max_depth``: the edges are those that begin or
    end at near nodes, by their degrees, less those that do both. The latter are found for ``BLOCK`` queries at once: what meets the edges is a mask for each node and block.
    """
    near = materialise(reached.where(F.col("depth") < max_depth).select("query_id", "node_id"), "near")
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    ends = near.join(degrees, "node_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"))
    queries = near.select("query_id").distinct()
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, queries.count() // NUMBERED)))
    number = F.row_number().over(Window.partitionBy("part").orderBy("query_id")) - 1
    queries = queries.withColumn("part", part).withColumn("number", number)
    queries = materialise(queries.select("query_id", F.struct("part", F.expr(f"number div {BLOCK}").alias("at")).alias("block"), (F.col("number") % BLOCK).alias("bit")), "near-queries")
    masks = materialise(_masks(queries, near), "near-masks")
    both = edges.select("src", "dst").join(masks.toDF("src", "block", "one"), "src").join(masks.toDF("dst", "block", "other"), ["dst", "block"])
    both = both.select("block", F.col("one").bitwiseAND(F.col("other")).alias("mask")).where("mask <> 0")
    counted = both.groupBy("block").agg(F.array(*(F.sum(F.getbit("mask", F.lit(k)).cast("long")) for k in range(BLOCK))).alias("counts"))
    counted = counted.select("block", F.posexplode("counts").alias("bit", "inner"))
    inner = queries.join(counted, ["block", "bit"]).select("query_id", "inner")
    return ends.join(inner, "query_id", "left").select("query_id", (F.col("ends") - F.coalesce("inner", F.lit(0))).alias("n_edges")).where("n_edges > 0")


def nearest_edges(reached: DataFrame, edges: DataFrame, max_depth: int, k: int) -> DataFrame:
    """The best ``k`` of the ``edge_paths`` of each query, with ``n`` and the other columns of ``edges`` (edge_id, src, dst, confidence and more): nearest first, then the surest, then the smaller id.

    ``reached`` comes from ``traverse`` over the same edges. Depth by depth, only queries that have fewer than ``k`` edges so far go on, so at most ``k`` nodes of each meet
    their edges beyond the starts, and no more than 2 ``k`` of these are shuffled for each query and task.
    """
    surest = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "edge_id")
    found = None
    for depth in range(max_depth):
        level = reached.where(F.col("depth") == depth).select("query_id", "node_id")
        if found is not None:
            level = level.join(found.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
        level = materialise(level, "nearest-level")
        if found is not None and level.isEmpty():
            break
        rows = edges.join(level.toDF("query_id", "src"), "src").unionByName(edges.join(level.toDF("query_id", "dst"), "dst"))
        if found is not None:
            # these queries have all their edges of smaller depths
            rows = rows.join(found.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti")
        # an edge between two nodes of the level comes twice
        rows = rows.withColumn("n", F.row_number().over(surest)).where(F.col("n") <= 2 * k).drop("n").distinct()
        rows = rows.withColumn("n", F.row_number().over(surest)).where(F.col("n") <= k).drop("n")
        rows = materialise(rows.withColumn("depth", F.lit(depth)), "nearest-edges")
        found = rows if found is None else found.unionByName(rows)
    best = Window.partitionBy("query_id").orderBy("depth", F.col("confidence").desc(), "edge_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    for end, d in (("src", "d1"), ("dst", "d2")):
        found = found.join(reached.select("query_id", F.col("node_id").alias(end), F.col("depth").alias(d)), ["query_id", end])
    forward = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") <= F.col("dst")))
    found = found.withColumns({"from_node": F.when(forward, F.col("src")).otherwise(F.col("dst")), "to_node": F.when(forward, F.col("dst")).otherwise(F.col("src"))})
    return found.drop("src", "dst", "d1", "d2")


def edges_around(starts: DataFrame, edges: DataFrame, max_depth: int, k: int) -> DataFrame:
    """What ``nearest_edges`` finds for the nodes that ``traverse`` reaches from (query_id, node_id), where no other use is made of these nodes.

    The traversal and the choice go depth by depth together: a query goes on for as long as it has fewer than ``k`` edges, so all of them are known, and its next
    nodes are their other ends. What is written for each query is at most ``k`` edges and nodes of a depth, however many the graph has around it. ``edges`` has each
    edge_id once; a start that is in no edge has no rows, and null starts are left out.
    """
    surest = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "edge_id")
    level = materialise(starts.select("query_id", "node_id").where("node_id is not null").distinct(), "around-level")
    others = [c for c in edges.columns if c not in ("edge_id", "src", "dst")]
    met, found = level, None
    for depth in range(max_depth):
        forward = edges.join(level.toDF("query_id", "src"), "src").select("query_id", "edge_id", *others, F.col("src").alias("from_node"), F.col("dst").alias("to_node"))
        backward = edges.join(level.toDF("query_id", "dst"), "dst").select("query_id", "edge_id", *others, F.col("dst").alias("from_node"), F.col("src").alias("to_node"))
        rows = forward.unionByName(backward)
        if found is not None:
            # these queries have all their edges of smaller depths
            rows = rows.join(found.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti")
        # an edge between two nodes of the level comes twice, and from the smaller of them
        rows = rows.withColumn("n", F.row_number().over(surest)).where(F.col("n") <= 2 * k)
        rows = rows.groupBy("query_id", "edge_id", *others).agg(F.min("from_node").alias("from_node"), F.max("to_node").alias("to_node"))
        rows = rows.withColumn("n", F.row_number().over(surest)).where(F.col("n") <= k).drop("n")
        rows = materialise(rows.withColumn("depth", F.lit(depth)), "around-edges")
        found = rows if found is None else found.unionByName(rows)
        if depth + 1 < max_depth:
            done = found.groupBy("query_id").count().where(F.col("count") >= k)
            level = rows.join(done, "query_id", "left_anti").select("query_id", F.col("to_node").alias("node_id")).distinct().join(met, ["query_id", "node_id"], "left_anti")
            level = materialise(level, "around-level")
            if level.isEmpty():
                break
            met = met.unionByName(level)
    best = Window.partitionBy("query_id").orderBy("depth", F.col("confidence").desc(), "edge_id")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


def traversal_summary(starts: DataFrame, reached: DataFrame) -> DataFrame:
    """(query_id, nodes, depth_reached) for every query of ``starts``; 0 and 0 where nothing was reached."""
    found = reached.groupBy("query_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth_reached"))
    return starts.select("query_id").distinct().join(found, "query_id", "left").fillna(0)
