"""What traversal moves, and edges found from their nearer end."""

from quillgraph.operators import graph
from quillgraph.plans import registry


def test_edges_are_written_once_and_met_from_the_nearer_end(spark, monkeypatch):
    """A hub at the last depth brings no edges of its own; loops, repeated and opposite edges count as before."""
    star = [("hub", f"x{k}") for k in range(50)]
    edges = spark.createDataFrame([("a", "hub"), ("a", "hub"), ("b", "a"), ("a", "b"), ("b", "hub"), ("a", "a"), ("c", "b"), *star], "src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (2, "x7")], "query_id long, node_id string")
    sizes = []

    def counted(df, label, real=graph.materialise):
        out = real(df, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    reached = graph.traverse(starts, edges, 1)
    assert dict(sizes[:1]) == {"edges": 56}
    assert sorted(tuple(r) for r in reached.collect()) == [(1, "a", 0), (1, "b", 1), (1, "hub", 1), (2, "hub", 1), (2, "x7", 0)]
    found = graph.traversed_edges(reached, edges, 1).select("query_id", "src", "dst", "d1", "d2")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", "a", 0, 0), (1, "a", "b", 0, 1), (1, "a", "hub", 0, 1), (1, "a", "hub", 0, 1), (1, "b", "a", 1, 0), (2, "hub", "x7", 1, 0)]
    paths = {(r.query_id, r.node_id): r.path for r in graph.traverse_paths(starts, edges, 2).collect()}
    assert paths[1, "x3"] == ["a", "hub", "x3"] and paths[1, "c"] == ["a", "b", "c"] and paths[2, "b"] == ["x7", "hub", "b"] and len(paths) == 54 + 53


def test_the_query_tells_the_paths_of_both_hops(spark):
    """The edges of suppliers that are two hops away count too, not only those of the starts."""
    rows = registry.QUERIES["edge_paths"](spark, "/root/testdata/sf0.001").collect()
    assert {r.depth for r in rows} == {0, 1} and all(r.from_node[0] == "sp"[r.depth] for r in rows)
    assert len({(r.query_id, r.edge_id) for r in rows}) == len(rows)
