"""Queries of the knowledge graph and of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import extract, graph, retrieve
from quillgraph.plans.corpus_queries import MENTIONS, mentions_of
from quillgraph.plans.registry import query, table

WINDOW = 10
_ID = "md5(entity_type || ':' || text)[1:16]"
_PAIRS = (
    f"{MENTIONS}, m as (select *, {_ID} node_id from mentions), rel as (select a.doc_id, a.node_id src, b.node_id dst, greatest(0.3, 0.7 - (b.start_pos - a.start_pos) / 10 * 0.4) "
    f"confidence from m a join m b on a.doc_id = b.doc_id and b.start_pos > a.start_pos and b.start_pos - a.start_pos <= {WINDOW} where a.node_id <> b.node_id)"
)
_NODES = "nodes as (select node_id, min(text) text, min(entity_type) node_type, max(confidence) confidence, count(*) n_mentions, count(distinct doc_id) n_documents from m group by 1)"
_EDGES = "edges as (select md5(src || ':' || dst || ':co_occurs_with')[1:16] edge_id, src, dst, max(confidence) confidence, count(*) n_relations, count(distinct doc_id) n_documents from rel group by all)"


def relations_of(spark, sf_dir):
    return graph.relation_edges(extract.cooccurrence(mentions_of(spark, sf_dir), WINDOW))


@query(f"with {MENTIONS}, m as (select *, {_ID} node_id from mentions) select distinct entity_type, text, node_id, md5(node_id || ':' || node_id || ':x')[1:16] edge_id from m")
def node_ids(spark, sf_dir):
    rows = graph.mention_nodes(mentions_of(spark, sf_dir)).select("entity_type", "text", "node_id").distinct()
    return rows.withColumn("edge_id", T.edge_id(F.col("node_id"), F.col("node_id"), F.lit("x")))


@query(f"with {_PAIRS}, {_NODES} select * from nodes")
def build_nodes(spark, sf_dir):
    return graph.build_nodes(mentions_of(spark, sf_dir))


@query(f"with {_PAIRS}, {_EDGES} select edge_id, src, dst, round(confidence, 6) confidence, n_relations, n_documents from edges")
def build_edges(spark, sf_dir):
    return graph.build_edges(relations_of(spark, sf_dir)).drop("edge_type").withColumn("confidence", F.round("confidence", 6))


@query(
    "with r as (select o_orderkey relation_id, o_custkey doc_id, lower(o_orderpriority || ' ' || o_orderstatus) evidence from orders), n as (select c_custkey doc_id, unnest([c_custkey "
    "* 10, c_custkey * 10 + 1, c_custkey * 10 + 2]) node_id, unnest(['urgent', 'high medium', 'o f p']) text from customer), hit as (select distinct r.relation_id, r.doc_id, node_id "
    "from r join n using (doc_id) where len(list_filter(string_split(text, ' '), lambda w: contains(evidence, w))) > 0), k as (select *, row_number() over (partition by relation_id "
    "order by node_id) i from hit) select relation_id, min(node_id) src, max(node_id) dst from k where i <= 2 group by 1 having count(*) = 2"
)
def resolve_by_evidence(spark, sf_dir):
    relations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("doc_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("evidence"))
    c = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(c.alias("doc_id"), F.inline(F.array(*(F.struct((c * 10 + k).alias("node_id"), F.lit(t).alias("text")) for k, t in enumerate(["urgent", "high medium", "o f p"])))))
    return graph.resolve_by_evidence(relations, nodes).select("relation_id", "src", "dst")


def _half(spark, sf_dir, odd):
    m = mentions_of(spark, sf_dir).where(F.col("doc_id") % 2 == odd)
    return graph.build_nodes(m.where("doc_id % 4 <= 1 or text <> 'with'") if odd == 0 else m)


@query(
    f"with {_PAIRS}, a as (select distinct node_id from m where doc_id % 2 = 0 and text <> 'with'), b as (select distinct node_id from m where doc_id % 2 = 1) select b.node_id, "
    f"0.8::double confidence, a.node_id is null created, 1::bigint updates from b left join a using (node_id) union all select a.node_id, 0.8, false, 0 from a anti join b using "
    f"(node_id)"
)
def upsert_graph(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    old = graph.build_nodes(m.where("doc_id % 2 = 0 and text <> 'with'"))
    return graph.upsert(old, graph.build_nodes(m.where("doc_id % 2 = 1")), "node_id")


@query(
    "with g as (select l_partkey % 100 node_id, l_suppkey % 2 graph_id, max(l_discount)::double confidence from lineitem group by all) "
    "select node_id, max(confidence) confidence, count(*) graphs, n_documents from g join (select l_partkey % 100 node_id, count(distinct l_orderkey) n_documents from lineitem group by 1) using (node_id) group by node_id, n_documents"
)
def merge_graphs(spark, sf_dir):
    """Parts of orders as nodes, orders as documents: the graphs of odd and even suppliers share most of them."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("node_id"), (F.col("l_suppkey") % 2).alias("g"), F.col("l_discount").cast("double").alias("c"), F.col("l_orderkey").alias("doc_id"))
    parts = [rows.where(F.col("g") == k) for k in (0, 1)]
    return graph.merge_graphs(*(p.groupBy("node_id").agg(F.max("c").alias("confidence")) for p in parts), documents=[p.select("node_id", "doc_id") for p in parts])


@query(f"with {_PAIRS}, {_NODES} select node_type, count(*) n, round(avg(confidence), 6) mean_confidence from nodes group by grouping sets ((), (node_type))")
def graph_statistics(spark, sf_dir):
    return graph.graph_statistics(graph.build_nodes(mentions_of(spark, sf_dir)), "node_type")


@query("select distinct n_name graph_id from nation where n_name <> 'CHINA'")
def list_and_drop_graphs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "graph_id")
    return graph.list_graphs(graph.drop_graph(rows, "CHINA"))


@query(
    "select p_partkey, round(case when len(u) = 0 then 1.0 else len(i) / len(u) end, 6) similarity from (select p_partkey, list_intersect(a, b) i, list_distinct(a || b) u from "
    "(select p_partkey, list_distinct(string_split(lower(p_type), ' ')) a, list_distinct(string_split(lower(p_name || ' brass tin'), ' ')) b from part))"
)
def text_jaccard(spark, sf_dir):
    score = T.text_jaccard(F.col("p_type"), F.concat("p_name", F.lit(" brass tin")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("similarity"))


_SETS = (
    "t as (select min(item_id) rep, s from (select item_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) s from benchmark "
    "union all select 100000 + doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) from documents) where len(s) > 0 group "
    "by s)"
)


@query(
    f"with {_SETS} select a.rep a, b.rep b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) similarity from t a join t b on a.rep < b.rep and len(a.s) "
    f">= 0.79 * len(b.s) and len(b.s) >= 0.79 * len(a.s) where round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) >= 0.8"
)
def similar_nodes(spark, sf_dir):
    """All documents and benchmark items as nodes."""
    nodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 100000, "text"))
    return graph.similar_nodes(nodes, "id", "text", 0.8)


@query(f"with {_PAIRS}, {_NODES} select node_id, count(distinct doc_id) n_documents from m where doc_id % 3 <> 0 group by 1")
def remove_documents(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    gone = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")
    return graph.remove_documents(graph.node_documents(m), graph.build_edges(relations_of(spark, sf_dir)), gone)[0]


_SUPPLY = (
    "e as (select distinct 'p' || l_partkey src, 's' || l_suppkey dst from lineitem), b as (select src, dst from e union select dst, src from e), s as (select 's' || s_suppkey "
    "node_id, s_suppkey query_id from supplier where s_suppkey % 10 = 0), h1 as (select distinct query_id, b.dst node_id from s join b on b.src = s.node_id), h2 as (select distinct "
    "query_id, b.dst node_id from h1 join b on b.src = h1.node_id)"
)


def _supply(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    edges = rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    starts = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return edges, starts


@query(f"with {_SUPPLY} select query_id, node_id, min(d) depth from (select query_id, node_id, 0 d from s union all select query_id, node_id, 1 from h1 union all select query_id, node_id, 2 from h2) group by all")
def traverse(spark, sf_dir):
    edges, starts = _supply(spark, sf_dir)
    return graph.traverse(starts, edges, 2)


@query(
    f"with {_SUPPLY}, r as (select query_id, node_id, min(d) d from (select query_id, node_id, 0 d from s union all select query_id, node_id, 1 from h1) group by all) select x.query_id, "
    f"e.src, e.dst from e join r x on x.node_id = e.src join r y on y.node_id = e.dst and y.query_id = x.query_id where least(x.d, y.d) < 1"
)
def traversed_edges(spark, sf_dir):
    edges, starts = _supply(spark, sf_dir)
    return graph.traversed_edges(graph.traverse(starts, edges, 1), edges, 1).select("query_id", "src", "dst")


_PATHS = (
    f"{_SUPPLY}, p0 as (select query_id, node_id, [node_id] path from s), p1 as (select query_id, dst node_id, min(list_append(path, dst)) path from p0 join b on src = node_id "
    f"group by all), p2 as (select query_id, dst node_id, min(list_append(path, dst)) path from p1 join b on src = node_id where not exists (select 1 from p0 where p0.query_id "
    f"= p1.query_id and p0.node_id = dst) and not exists (select 1 from p1 q where q.query_id = p1.query_id and q.node_id = dst) group by all), reached as (select *, 0 depth from "
    f"p0 union all select *, 1 from p1 union all select *, 2 from p2)"
)


@query(f"with {_PATHS} select query_id, node_id, depth, array_to_string(path, '>') path from reached")
def traversed_paths(spark, sf_dir):
    edges, starts = _supply(spark, sf_dir)
    return graph.traverse_paths(starts, edges, 2).withColumn("path", F.array_join("path", ">"))


@query(
    f"with {_PATHS} select x.query_id, e.src || '-' || e.dst edge_id, case when x.depth < y.depth or (x.depth = y.depth and src <= dst) then src else dst end from_node, "
    "case when x.depth < y.depth or (x.depth = y.depth and src <= dst) then dst else src end to_node, least(x.depth, y.depth) depth from e join reached x on x.node_id = src join reached y on y.node_id = dst and y.query_id = x.query_id where least(x.depth, y.depth) < 2"
)
def edge_paths(spark, sf_dir):
    """All edges within the two hops that are traversed."""
    edges, starts = _supply(spark, sf_dir)
    named = edges.withColumn("edge_id", F.concat_ws("-", "src", "dst"))
    return graph.edge_paths(graph.traverse(starts, edges, 2), named, 2)


@query(f"with {_PATHS} select query_id, count(*) nodes, max(depth) depth_reached from reached group by 1 union all select -1, 0, 0")
def traversal_summary(spark, sf_dir):
    """One more query starts at a node that is not there."""
    edges, starts = _supply(spark, sf_dir)
    lost = starts.limit(0).unionByName(spark.createDataFrame([(-1, None)], "query_id long, node_id string"))
    return graph.traversal_summary(starts.unionByName(lost), graph.traverse_paths(starts.unionByName(lost), edges, 2))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: w not in ({_STOP}) and length(w) > 2)"
@query(f"select item_id, array_to_string({_TERMS}, ' ') terms from benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def _questions(spark, sf_dir):
    """Every hundredth part's name as a question to all parts."""
    return table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("question"))


def _part_nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("text"), F.col("p_type").alias("context"), F.lit("thing").alias("node_type"), (F.col("p_size") / 50.0).alias("confidence"))


_ASKED = f"q as (select p_partkey query_id, {_TERMS.replace('text', 'p_name')} terms from part where p_partkey % 100 = 0)"
_SEARCH = (
    f"{_ASKED}, n as (select p_partkey node_id, lower(p_name || ' ' || p_type) body, p_size / 50.0 c from part), sc as (select query_id, node_id, least(len(list_filter(terms, lambda "
    f"t: contains(body, t))) / len(terms) * (0.8 + 0.2 * c), 1.0) relevance from q, n where len(terms) > 0), hits as (select query_id, row_number() over (partition by query_id "
    f"order by relevance desc, node_id) as rank, node_id, relevance from sc where relevance >= 0.3 qualify rank <= 10)"
)


@query("select p_partkey, round(least(((contains(b, 'small'))::int + contains(b, 'ring')::int + contains(b, 'tin')::int) / 3 * (0.8 + 0.2 * p_size / 50.0), 1.0), 6) relevance from (select *, lower(p_name || ' ' || p_type) b from part)")
def node_relevance(spark, sf_dir):
    terms = F.array(F.lit("small"), F.lit("ring"), F.lit("tin"))
    rows = _part_nodes(spark, sf_dir)
    score = T.node_relevance(terms, F.col("text"), F.col("context"), F.col("node_type"), F.col("confidence"))
    return rows.select(F.col("node_id").alias("p_partkey"), F.round(score, 6).alias("relevance"))


@query(f"with {_SEARCH} select query_id, rank::int as rank, node_id, round(relevance, 6) relevance from hits")
def semantic_search(spark, sf_dir):
    hits = retrieve.semantic_search(_questions(spark, sf_dir), _part_nodes(spark, sf_dir), 0.3, 10)
    return hits.withColumn("relevance", F.round("relevance", 6))


@query(f"with {_SEARCH} select query_id, round(least(avg(relevance) filter (rank <= 5) + least(count(*) * 0.05, 0.2) + least(count(*) * 0.02, 0.1), 1.0), 6) confidence from hits group by 1")
def answer_confidence(spark, sf_dir):
    hits = retrieve.semantic_search(_questions(spark, sf_dir), _part_nodes(spark, sf_dir), 0.3, 10)
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_edges"))
    return retrieve.answer_confidence(hits, n, n.withColumnRenamed("n_edges", "n_sources"))


_REL = "case p_partkey % 3 when 0 then 'causes' when 1 then 'regulates' else 'treats' end"
_SURE = "(p_size % 2 = 1)"


@query(
    "select p_partkey, kind, case kind when 'definition' then p_name || ' is ' || p_type || case when p_size > 25 then '. It is related to second (pathway)' else '' end || case "
    "when p_size % 2 = 1 then '. Key relationships include: ' || p_brand else '' end || '.' "
    f"when 'mechanism' then 'The mechanism involves second. more' || case when {_REL} in ('causes', 'regulates') then '. ' || p_brand else '' end || '.' "
    f"when 'causal' then case when {_REL} = 'causes' then p_brand || '. ' else '' end || 'This relates to ' || p_name || ': ' || p_type || '.' "
    "else p_name || ': ' || p_type || '. second: more. Related information: ' || p_brand || '.' end answer from part, (values ('definition'), ('mechanism'), ('causal'), ('general')) k(kind)"
)
def template_answer(spark, sf_dir):
    """All four templates, with relations, over all parts."""
    kinds = F.explode(F.array(*(F.lit(x) for x in ("definition", "mechanism", "causal", "general"))))
    rows = table(spark, sf_dir, "part").withColumn("kind", kinds)
    entity = lambda text, kind, context, relevance: F.struct(text.alias("text"), F.lit(kind).alias("type"), context.alias("context"), relevance.alias("relevance"))
    entities = F.array(entity(F.col("p_name"), "thing", F.col("p_type"), F.lit(1.0)), entity(F.lit("second"), "pathway", F.lit("more"), F.when(F.col("p_size") > 25, 0.9).otherwise(0.1)))
    relation = F.when(F.col("p_partkey") % 3 == 0, "causes").when(F.col("p_partkey") % 3 == 1, "regulates").otherwise("treats")
    relations = F.array(F.struct(relation.alias("type"), F.when(F.col("p_size") % 2 == 1, 0.9).otherwise(0.2).alias("confidence"), F.col("p_brand").alias("evidence")))
    return rows.select("p_partkey", "kind", retrieve.template_answer(F.col("kind"), entities, relations).alias("answer"))


_TRIPLES = (
    "t as (select p_name || '|' || p_type source, p_brand || '|' || p_type target, (['treat', 'cause', 'inhibit', 'other'])[1 + p_partkey % 4] relation_type, list(l_orderkey order "
    "by l_orderkey) pmids, p_partkey % 2 = 0 sd, p_partkey % 3 = 0 td from part join lineitem on l_partkey = p_partkey group by all)"
)
_NAMED = (
    "s as (select distinct n_regionkey query_id, unnest(['ECONOMY', 'ECON', 'SMALL', 'BRAND#' || n_nationkey]) subject from nation), w as (select * from s a where not exists (select "
    "1 from s b where a.query_id = b.query_id and length(b.subject) > length(a.subject) and contains(b.subject, a.subject)))"
)
_ENDS = " union all ".join(
    f"select query_id, '{d}' direction, row_number() over (partition by query_id order by len(pmids) desc, source, relation_type, target, pmids) as rank, source, relation_type, "
    f"target, pmids from (select distinct query_id, source, relation_type, target, pmids from t join w on list_contains(string_split(upper({e}), '|'), w.subject) where {f} and "
    f"relation_type <> 'other') qualify rank <= {n}"
    for d, e, f, n in (("forward", "source", "sd", 20), ("reverse", "target", "td", 100))
)


@query(f"with {_TRIPLES}, {_NAMED} select query_id, direction, rank::int as rank, source, relation_type, target, array_to_string(pmids, ',') pmids from ({_ENDS})")
def literature_relations(spark, sf_dir):
    part, p = table(spark, sf_dir, "part"), F.col("p_partkey")
    kinds = F.array(*(F.lit(x) for x in ("treat", "cause", "inhibit", "other")))
    rows = part.join(table(spark, sf_dir, "lineitem"), p == F.col("l_partkey"))
    ends = [F.concat_ws("|", "p_name", "p_type").alias("source"), F.concat_ws("|", "p_brand", "p_type").alias("target"), F.element_at(kinds, (p % 4 + 1).cast("int")).alias("relation_type")]
    triples = rows.groupBy(*ends, (p % 2 == 0).alias("source_is_disease"), (p % 3 == 0).alias("target_is_disease")).agg(F.array_sort(F.collect_list("l_orderkey")).alias("pmids"))
    names = F.array(F.lit("ECONOMY"), F.lit("ECON"), F.lit("SMALL"), F.concat(F.lit("BRAND#"), F.col("n_nationkey").cast("string")))
    subjects = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("query_id"), F.explode(names).alias("subject"))
    found = retrieve.literature_relations(subjects, triples)
    return found.withColumn("pmids", F.array_join(F.transform("pmids", lambda x: x.cast("string")), ","))


@query("select s_name subject, 'nation' predicate, s_nationkey::varchar as object, s_suppkey || ' 7' citations from supplier union all select s_name, 'balance', floor(s_acctbal)::bigint::varchar, '' from supplier")
def knowledge_sequence(spark, sf_dir):
    row = lambda p, o, c: F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object"), c.cast("string").alias("citation"))
    balance = F.floor("s_acctbal").cast("long")
    relations = F.array(row("nation", F.col("s_nationkey"), F.concat_ws("|", F.col("s_suppkey").cast("string"), F.lit("7"))), row("balance", balance, F.when(F.col("s_suppkey") % 2 == 0, "")))
    found = retrieve.knowledge_sequence(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("subject"), relations.alias("relations")))
    return found.withColumn("citations", F.array_join("citations", " "))


@query(f"with e as (select p_partkey query_id, unnest({_TERMS.replace('text', 'p_name')} || [p_name[1:1]]) entity from part) select distinct * from (select * from e union all select query_id, entity || 's' from e where length(entity) > 1) where entity <> ''")
def question_entities(spark, sf_dir):
    questions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("question"))
    return retrieve.question_entities(questions, lambda q: F.array(F.substring(q, 1, 1)), lambda e: F.array(F.when(F.length(e) > 1, F.concat(e, F.lit("s")))))


@query(
    "select conv_id, turn, case when contains(t, 'what is') or contains(t, 'define') or contains(t, 'definition') then 'definition' when contains(t, 'how does') or contains(t, "
    "'how do') or contains(t, 'mechanism') then 'mechanism' when contains(t, 'why') or contains(t, 'reason') or contains(t, 'cause') then 'causal' else 'general' end kind from "
    "(select conv_id, turn, lower(text) t from conversations)"
)
def question_type(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.question_type(F.col("text")).alias("kind"))


@query(
    "with s as (select upper(n_name) subject, n_regionkey from nation), r as (select subject, 'customer' predicate, c_name as object from s join nation on upper(n_name) = subject "
    "join customer on c_nationkey = n_nationkey union all select subject, 'supplier', s_name from s join nation on upper(n_name) = subject join supplier on s_nationkey = n_nationkey) "
    "select * from r qualify row_number() over (partition by subject, predicate order by object) <= 20"
)
def relations_for(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    by_nation = lambda t, key, name: table(spark, sf_dir, t).join(nation, F.col(key) == F.col("n_nationkey")).select("n_name", F.col(name).alias("object"))
    sources = {"customer": (by_nation("customer", "c_nationkey", "c_name"), "n_name", "object"), "supplier": (by_nation("supplier", "s_nationkey", "s_name"), "n_name", "object")}
    return retrieve.relations_for(nation.select(F.lower("n_name").alias("subject")), sources)


@query(
    "with s as (select n_regionkey query_id, n_name subject from nation union all select n_regionkey, n_name[1:4] from nation) select * from s a where not exists (select 1 from "
    "s b where b.query_id = a.query_id and length(b.subject) > length(a.subject) and contains(b.subject, a.subject))"
)
def longest_subjects(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("subject"))
    return retrieve.longest_subjects(n.union(n.select("query_id", F.substring("subject", 1, 4))))


@query("select s_name subject, 'supplier' predicate, 'Key: ' || s_suppkey || chr(10) || 'Nation: ' || s_nationkey as object from supplier")
def textualize(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("nothing", F.lit(None).cast("string"))
    return retrieve.textualize(rows, "s_name", "supplier", {"s_suppkey": "Key", "nothing": "Fax", "s_nationkey": "Nation"})


@query(
    "select s_name subject, 'organisation' predicate, 'Name: ' || s_name || chr(10) || 'Address: ' || s_suppkey || case when s_nationkey % 2 = 0 then chr(10) || 'Country: ' || "
    "s_nationkey else '' end as object, case when s_suppkey % 3 = 0 then '' else 'PMID:' || s_suppkey || ' ORPHA:7' end citations from supplier "
    "union all select s_name, 'relation', 'Relation: supplies' || chr(10) || 'Target: ' || s_nationkey, '' from supplier "
    "union all select s_name, 'prevalence', 'Mean value: ' || s_suppkey, 'PMID:' || s_nationkey from supplier where s_suppkey % 5 > 0 "
    "union all select s_name, 'phenotype', 'Phenotype: p' || s_suppkey % 7, '' from supplier union all select s_name, 'literature', 'Target: t' || chr(10) || 'Articles: 1|2', '1 2' from supplier"
)
def textualized_kinds(spark, sf_dir):
    """Suppliers as records of five kinds, with missing columns, empty records and citations."""
    s, key, nation = table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")
    subject, text = F.col("s_name").alias("subject"), lambda c: c.cast("string")
    records = {
        "organisation": s.select(subject, F.col("s_name").alias("name"), text(key).alias("address"), F.when(nation % 2 == 0, text(nation)).alias("country"), F.when(key % 3 > 0, F.concat(F.lit("[PMID:"), text(key), F.lit(", Orphanet:7]"))).alias("citations")),
        "relation": s.select(subject, F.lit("supplies").alias("relation"), text(nation).alias("target")),
        "prevalence": s.select(subject, F.when(key % 5 > 0, key).alias("mean_value"), F.concat(F.lit("PMID:"), text(nation)).alias("citations")),
        "phenotype": s.select(subject, F.concat(F.lit("p"), text(key % 7)).alias("hpo_term")),
        "literature": s.select(subject, F.lit("t").alias("target"), F.lit("1|2").alias("pmids"), F.lit("1|2").alias("citations")),
    }
    return retrieve.textualize_kinds(records).withColumn("citations", F.array_join("citations", " "))


@query("select c_custkey, 'PMID:' || c_custkey || ' ORPHA:' || c_nationkey citations from customer")
def parse_citations(spark, sf_dir):
    text = F.concat(F.lit("[PMID:"), F.col("c_custkey").cast("string"), F.lit(", Orphanet:"), F.col("c_nationkey").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(retrieve.parse_citations(text), " ").alias("citations"))


@query("select c_custkey, case when regexp_replace(c_name, '[^A-Za-z0-9]', ' ', 'g') = c_name then c_name else c_name || '|' || regexp_replace(c_name, '[^A-Za-z0-9]', ' ', 'g') end names from customer")
def clean_entity_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(retrieve.clean_entity_names(F.array("c_name")), "|").alias("names"))


@query(
    "with a as (select c_custkey row_id, c_nationkey query_id, unnest(['a' || c_custkey % 5, 'b' || c_custkey % 3]) as alias, c_acctbal::double d from customer), e as (select "
    "n_nationkey query_id, 'b' || n_nationkey % 3 as alias, 0 tier from nation) select a.row_id, a.query_id, arg_min(a.alias, (coalesce(e.tier, 1), d, a.alias)) as alias from "
    "a left join e on e.query_id = a.query_id and e.alias = a.alias group by 1, 2"
)
def best_alias(spark, sf_dir):
    k = F.col("c_custkey")
    aliases = table(spark, sf_dir, "customer").select(k.alias("row_id"), F.col("c_nationkey").alias("query_id"), F.concat(F.lit("a"), (k % 5).cast("string"), F.lit("|b"), (k % 3).cast("string")).alias("aliases"), F.col("c_acctbal").cast("double").alias("distance"))
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("b"), (F.col("n_nationkey") % 3).cast("string")).alias("entity"))
    return retrieve.best_alias(aliases, entities)


@query(
    "with d as (select q.vec_id query_id, v.vec_id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::double - z[2]::double) ** 2))), 6) "
    "distance from embeddings q, embeddings v where q.vec_id % 100 = 0) select query_id, rank::int as rank, vec_id from (select *, row_number() over (partition by query_id order "
    "by distance, vec_id) as rank from d) where rank <= 30"
)
def knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.knn(queries, v, 30).select("query_id", "rank", "vec_id")


@query(
    "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))) / sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))), 6) norm, round(embedding[1]::double "
    "/ sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))), 6) first_value from embeddings"
)
def l2_normalize(spark, sf_dir):
    unit = T.l2_normalize(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first_value"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn, turn) source_no from conversations where role = 'assistant'")
def number_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("rank", F.col("turn"))
    return retrieve.number_sources(rows).select("conv_id", "turn", F.col("source_no").cast("long").alias("source_no"))


@query("select conv_id, md5(string_agg(text, chr(10) || chr(10) order by turn, text)) digest from conversations where text is not null group by 1")
def context_block(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("rank", F.col("turn"))
    return retrieve.context_block(rows, ("conv_id",)).select("conv_id", F.md5("context").alias("digest"))


@query(
    "select conv_id, turn, md5(h) digest from (select conv_id, turn, role, coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10)) over (partition by conv_id order by "
    "turn rows between unbounded preceding and 1 preceding), '') h from conversations) where role = 'user'"
)
def conversation_history(spark, sf_dir):
    return retrieve.conversation_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("history").alias("digest"))
