"""The flagship: corpus to graph to answered benchmark questions, with the SQL of the whole way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import answers, extract, graphsets, retrieve
from quillgraph.plans.graph_queries import _STOP, _part_nodes, _questions
from quillgraph.plans.registry import query, table
from quillgraph.runtime import materialise

WINDOW, THRESHOLD, LONGEST, LEAST = 6, 0.04, 380, 6
_KINDS = ("metabolite", "pathway", "disease", "process")
_EDGE_TYPES = ("regulates", "causes", "relates_to")
_ASKS = ("What is ", "How does this work: ", "Why ", "Tell me of ")


def _terms(spark, sf_dir):
    """The longer words of the benchmark, typed by their length."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.query_terms(F.col("text"))).alias("token")).where(F.length("token") >= LEAST).distinct()
    kinds = F.array(*(F.lit(k) for k in _KINDS))
    return words.withColumn("entity_type", F.get(kinds, F.length("token") % 4))


def knowledge_of(spark, sf_dir) -> tuple[graphsets.Graph, object]:
    """The graph of these words in all documents: words at most ``WINDOW`` tokens apart are related, with the words and their distance as evidence."""
    mentions = extract.token_mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), _terms(spark, sf_dir))
    mentions = materialise(mentions.withColumn("confidence", 0.5 + F.length("text") % 5 / 10), "mentions")
    pairs = extract.cooccurrence(mentions, WINDOW)
    a, b = T.node_id(F.col("a_entity_type"), F.col("a_text")), T.node_id(F.col("b_entity_type"), F.col("b_text"))
    distance = F.col("b_start_pos") - F.col("a_start_pos")
    kind = F.get(F.array(*(F.lit(t) for t in _EDGE_TYPES)), (F.length("a_text") + F.length("b_text")) % 3)
    relations = pairs.select("doc_id", a.alias("src"), b.alias("dst"), kind.alias("edge_type"), "confidence", F.concat_ws(" ", "a_text", distance.cast("string"), "b_text").alias("evidence")).where("src <> dst")
    return graphsets.stored(graphsets.build(mentions, materialise(relations, "relations")))


def questions_of(spark, sf_dir):
    """Each benchmark item as a question; some are empty, null or too long."""
    n = F.col("item_id")
    ask = F.get(F.array(*(F.lit(x) for x in _ASKS)), (n % 4).cast("int"))
    text = F.when(n % 17 == 3, F.lit(" ")).when(n % 17 == 4, F.lit(None)).when(n % 17 == 5, F.lit("zz qq")).otherwise(F.concat(ask, "text"))
    return table(spark, sf_dir, "benchmark").select(n.alias("query_id"), text.alias("question"))


_PICK = lambda values, index: "([" + ", ".join(f"'{v}'" for v in values) + f"])[1 + {index}]"
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: w not in ({_STOP}) and length(w) > 2)"
_GRAPH = f"""
terms as materialized (select distinct token, {_PICK(_KINDS, 'length(token) % 4')} entity_type from (select unnest({_WORDS}) token from benchmark) where length(token) >= {LEAST}),
tokens as (select doc_id, unnest(t) token, unnest(range(len(t)))::bigint start_pos from (select doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') t from documents)),
m as materialized (select doc_id, token as text, entity_type, 0.5 + length(token) % 5 / 10 confidence, start_pos, md5(entity_type || ':' || token)[1:16] item_id from tokens join terms using (token)),
near as materialized (select *, start_pos // {WINDOW} k from m union all select *, start_pos // {WINDOW} + 1 from m),
rel as materialized (
  select a.doc_id, a.item_id src, b.item_id dst, {_PICK(_EDGE_TYPES, '(length(a.text) + length(b.text)) % 3')} edge_type, greatest(0.3, 0.7 - (b.start_pos - a.start_pos) / {WINDOW} * 0.4) confidence,
    a.text || ' ' || (b.start_pos - a.start_pos) || ' ' || b.text evidence
  from near a join m b on a.doc_id = b.doc_id and b.start_pos // {WINDOW} = a.k
  where a.item_id <> b.item_id and b.start_pos > a.start_pos and b.start_pos - a.start_pos <= {WINDOW}
),
nodes as materialized (select item_id, any_value(text) text, any_value(entity_type) node_type, max(confidence) confidence from m group by 1),
edges as materialized (select md5(src || ':' || dst || ':' || edge_type)[1:16] edge_id, src, dst, edge_type, max(confidence) confidence from rel group by src, dst, edge_type),
docs as materialized (select item_id, doc_id from m union select md5(src || ':' || dst || ':' || edge_type)[1:16], doc_id from rel)
"""
_BOOST = "case node_type when 'metabolite' then 1.2 when 'disease' then 1.1 when 'pathway' then 1.15 else 1.0 end"
_ANSWER = f"""
with {_GRAPH},
q as (select item_id query_id, case when item_id % 17 = 3 then ' ' when item_id % 17 = 4 then null when item_id % 17 = 5 then 'zz qq' else {_PICK(_ASKS, 'item_id % 4')} || text end question from benchmark),
state as (select *, case when trim(coalesce(question, '')) = '' then 'empty' when length(question) > {LONGEST} then 'too_long' end status from q),
asked as (select query_id, {_WORDS.replace('text', 'question')} terms from state where status is null),
scored as (select query_id, item_id, least(len(list_filter(terms, lambda t: contains(text || ' ', t))) / len(terms) * {_BOOST} * (0.8 + 0.2 * confidence), 1.0) relevance from asked, nodes where len(terms) > 0),
hits as materialized (select *, row_number() over (partition by query_id order by relevance desc, item_id) as rank from scored where relevance >= {THRESHOLD} qualify rank <= 10),
both_ as materialized (select src, dst from edges union select dst, src from edges),
h0 as materialized (select query_id, item_id node_id from hits where rank <= 5),
h1 as materialized (select distinct query_id, dst node_id from h0 join both_ on src = node_id),
h2 as materialized (select distinct query_id, dst node_id from h1 join both_ on src = node_id),
reached as materialized (select query_id, node_id, min(d) d from (select *, 0 d from h0 union all select *, 1 from h1 union all select *, 2 from h2) group by all),
around as materialized (
  select x.query_id, e.edge_id, e.edge_type, e.confidence, least(x.d, y.d) depth, case when x.d < y.d or (x.d = y.d and src <= dst) then src else dst end src, case when x.d < y.d or (x.d = y.d and src <= dst) then dst else src end dst
  from edges e join reached x on x.node_id = src join reached y on y.node_id = dst and y.query_id = x.query_id where least(x.d, y.d) < 2
),
chosen as materialized (select *, row_number() over (partition by query_id order by depth, confidence desc, edge_id) n from around qualify n <= 10),
told as (select md5(src || ':' || dst || ':' || edge_type)[1:16] edge_id, min(evidence) evidence from rel group by 1),
ends as (select query_id, count(distinct e) n_ends from (select query_id, unnest([src, dst]) e from chosen) group by 1),
used as (
  select query_id, doc_id, max(kind = 'hit') hit, max(kind = 'entity') entity, max(kind = 'relation') relation
  from (select query_id, item_id, 'hit' kind from hits union all select query_id, item_id, 'entity' from hits where rank <= 5 union all select query_id, edge_id, 'relation' from chosen) join docs using (item_id) group by all
),
d as (select query_id, count_if(hit) n_hit, count_if(entity or relation) n_documents, count_if(entity and relation) n_shared from used group by 1),
e as (
  select query_id, avg(relevance) relevance, count(*) n_entities, list(text order by rank) texts, list(node_type order by rank) kinds, list(h.relevance order by rank) scores
  from hits h join nodes using (item_id) where rank <= 5 group by 1
),
r as (select query_id, avg(confidence) sure, count(*) n_relations, list(edge_type order by n) types, list(confidence order by n) sures, list(evidence order by n) told from chosen join told using (edge_id) group by 1),
c as (select query_id, count(*) n_edges from around group by 1),
k as (select query_id, max(d) depth_reached from reached group by 1),
a as (
  select *, case when e.n_entities > 0 then 'answered' else 'no_hit' end found, coalesce(types, []) rt, coalesce(sures, []) rs, coalesce(told, []) re,
    least(relevance + least(0.05 * coalesce(n_edges, 0), 0.2) + least(0.02 * coalesce(n_hit, 0), 0.1), 1.0) base
  from state left join e using (query_id) left join r using (query_id) left join c using (query_id) left join d using (query_id) left join k using (query_id) left join ends using (query_id)
),
p as (
  select *,
    list_filter(range(2, least(n_entities, 3) + 1), lambda i: scores[i] > 0.6) strong, list_filter(range(1, least(len(rt), 3) + 1), lambda i: rs[i] > 0.6) sure_,
    list_filter(range(1, n_entities + 1), lambda i: kinds[i] in ('pathway', 'process')) processes,
    list_filter(range(1, len(rt) + 1), lambda i: rt[i] in ('regulates', 'causes')) moving, list_filter(range(1, len(rt) + 1), lambda i: rt[i] = 'causes') causing
  from a
),
t as (
  select *,
    [texts[1] || ' is a ' || kinds[1], case when len(strong) > 0 then 'It is related to ' || array_to_string(list_transform(strong, lambda i: texts[i] || ' (' || kinds[i] || ')'), ', ') end, case when len(sure_) > 0 then 'Key relationships include: ' || array_to_string(list_transform(sure_, lambda i: re[i][1:100]), '. ') end] definition,
    list_concat([case when len(processes) > 0 then 'The mechanism involves ' || texts[processes[1]] end], list_transform(moving[1:2], lambda i: re[i][1:150])) mechanism,
    list_transform(causing[1:2], lambda i: re[i][1:150]) causal,
    list_concat(list_transform(range(1, least(n_entities, 3) + 1), lambda i: texts[i] || ' is a ' || kinds[i]), [case when len(re) > 0 then 'Related information: ' || array_to_string(list_transform(re[1:2], lambda x: x[1:100]), '. ') end]) general,
    case when contains(lower(question), 'what is') or contains(lower(question), 'define') or contains(lower(question), 'definition') then 'definition' when contains(lower(question), 'how does') or contains(lower(question), 'how do') or contains(lower(question), 'mechanism') then 'mechanism'
      when contains(lower(question), 'why') or contains(lower(question), 'reason') or contains(lower(question), 'cause') then 'causal' else 'general' end kind
  from p
),
w as (
  select *, list_filter(case kind when 'definition' then definition when 'mechanism' then mechanism when 'causal' then causal else general end, lambda x: x is not null and x <> '') parts,
    case kind when 'definition' then 'I couldn''t find a clear definition for your query.' when 'mechanism' then 'I found some relevant information but couldn''t determine the specific mechanism.' when 'causal' then 'I found relevant information but couldn''t identify clear causal relationships.' else 'I found some relevant information but couldn''t formulate a comprehensive answer.' end nothing
  from t
)
select query_id, coalesce(status, found) status,
  case coalesce(status, found) when 'empty' then 'Please provide a valid question.' when 'too_long' then 'Query too long. Maximum length is {LONGEST} characters.' when 'no_hit' then 'I couldn''t find relevant information to answer your question.' else case when len(parts) = 0 then nothing else array_to_string(parts, '. ') || '.' end end answer,
  round(case when status is null and found = 'answered' then base else 0.0 end, 6) base_confidence,
  round(case when status is null and found = 'answered' then least(base + 0.3 * (0.25 * relevance + 0.25 * coalesce(sure, 0) + 0.2 * least(coalesce(n_documents, 0) * 0.1, 0.3) + 0.15 * case when n_entities > 1 and n_relations > 0 then least(n_ends / n_entities, 0.2) else 0 end + 0.15 * case when n_relations > 0 then n_shared / n_documents else 0 end), 1.0) else 0.0 end, 6) confidence,
  coalesce(n_entities, 0)::bigint n_entities, coalesce(n_relations, 0)::bigint n_relations, coalesce(n_documents, 0)::bigint n_documents, coalesce(n_edges, 0)::bigint n_edges, coalesce(depth_reached, 0)::bigint depth_reached
from w
"""


@query(_ANSWER[: _ANSWER.index("both_ as materialized")].rstrip().rstrip(",") + " select query_id, rank::int as rank, item_id node_id, round(relevance, 6) relevance from hits")
def question_hits(spark, sf_dir):
    """The best nodes of the graph of all documents for each benchmark question that can be asked."""
    asked = questions_of(spark, sf_dir).where((F.trim("question") != "") & (F.length("question") <= LONGEST))
    nodes = knowledge_of(spark, sf_dir).nodes.withColumnRenamed("item_id", "node_id").withColumn("context", F.lit(""))
    return retrieve.semantic_search(asked, nodes, THRESHOLD).withColumn("relevance", F.round("relevance", 6))


@query(_ANSWER)
def answered_questions(spark, sf_dir):
    """All benchmark questions against the graph of all documents."""
    return answers.answer(questions_of(spark, sf_dir), knowledge_of(spark, sf_dir), max_length=LONGEST, threshold=THRESHOLD)


#: The least relevance and the longest question of the answers from parts and suppliers.
PART_THRESHOLD, PART_LONGEST = 0.3, 1000
_PART_ASKS = ("What is ", "How does ", "Why ", "")
_KEYED = lambda kind, key: f"'{kind}' || lpad({key}::varchar, 12, '0')"
_SUPPLY_GRAPH = f"""
rel as materialized (
  select l_orderkey doc_id, {_KEYED('p', 'l_partkey')} src, {_KEYED('s', 'l_suppkey')} dst, {_PICK(_EDGE_TYPES, '(l_partkey + l_suppkey) % 3')} edge_type, l_quantity / 50 confidence, 'order ' || l_orderkey || ' line ' || l_linenumber evidence from lineitem
),
nodes as materialized (select {_KEYED('p', 'p_partkey')} item_id, p_name as text, p_type context, 'thing' node_type, p_size / 50.0 confidence from part),
edges as materialized (select md5(src || ':' || dst || ':' || edge_type)[1:16] edge_id, src, dst, edge_type, max(confidence) confidence from rel group by src, dst, edge_type),
docs as materialized (select src item_id, doc_id from rel union select md5(src || ':' || dst || ':' || edge_type)[1:16], doc_id from rel)
"""


def _replaced(sql, *changes):
    for old, new in changes:
        assert old in sql
        sql = sql.replace(old, new)
    return sql


#: The way from questions to answers is that of ``_ANSWER``; parts have a context, which is searched and told.
_PART_ANSWER = _replaced(
    _ANSWER[_ANSWER.index("state as") :],
    (f"> {LONGEST} then", f"> {PART_LONGEST} then"),
    (f"length is {LONGEST} characters", f"length is {PART_LONGEST} characters"),
    (f"relevance >= {THRESHOLD} ", f"relevance >= {PART_THRESHOLD} "),
    ("contains(text || ' ', t)", "contains(lower(text || ' ' || context), t)"),
    ("list(node_type order by rank) kinds", "list(node_type order by rank) kinds, list(context order by rank) contexts"),
    ("texts[1] || ' is a ' || kinds[1]", "texts[1] || ' is ' || contexts[1]"),
    ("texts[i] || ' is a ' || kinds[i]", "texts[i] || ': ' || contexts[i]"),
    ("list_transform(causing[1:2], lambda i: re[i][1:150]) causal", "list_concat(list_transform(causing[1:2], lambda i: re[i][1:150]), ['This relates to ' || texts[1] || ': ' || contexts[1]]) causal"),
)
_PART_FOUND = _PART_ANSWER[: _PART_ANSWER.index("told as")]


def _supply_graph(spark, sf_dir) -> tuple[graphsets.Graph, object]:
    """Parts and their suppliers, related by lines of orders: the lines are evidence, the orders documents of parts and relations (with repeats, which ``gather`` unites after few are left). The second table is the contexts of parts."""
    key = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 12, "0"))
    kind = F.get(F.array(*(F.lit(t) for t in _EDGE_TYPES)), ((F.col("l_partkey") + F.col("l_suppkey")) % 3).cast("int"))
    ends = [key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst"), kind.alias("edge_type")]
    lines, edge = table(spark, sf_dir, "lineitem"), T.edge_id(F.col("src"), F.col("dst"), F.col("edge_type")).alias("item_id")
    edges = lines.groupBy("l_partkey", "l_suppkey").agg((F.max("l_quantity") / 50).alias("confidence")).select(*ends, "confidence").select(edge, "src", "dst", "edge_type", "confidence")
    rows = lines.select(*ends, "l_orderkey", F.concat_ws(" ", F.lit("order"), "l_orderkey", F.lit("line"), "l_linenumber").alias("evidence"))
    documents = rows.select(F.explode(F.array("src", edge)).alias("item_id"), F.col("l_orderkey").alias("doc_id"))
    parts = _part_nodes(spark, sf_dir).withColumn("item_id", key("p", "node_id"))
    nodes = parts.select("item_id", "text", "node_type", "confidence")
    return graphsets.Graph(nodes, materialise(edges, "supply-edges"), documents, rows.select(edge, "evidence").distinct(), None), parts.select("item_id", "context")


@query(
    f"select * exclude (n_edges, depth_reached) from (with {_SUPPLY_GRAPH}, q as (select p_partkey query_id, case p_partkey // 100 % 17 when 3 then ' ' when 4 then null when 5 then 'zz qq' when 6 then repeat(p_name, 250) "
    f"else {_PICK(_PART_ASKS, 'p_partkey // 100 % 4')} || p_name || ' beside other metal' end question from part where p_partkey % 100 = 0), {_PART_ANSWER})"
)
def answer_queries(spark, sf_dir):
    """Questions of all kinds by every hundredth part, against all parts and their suppliers: search, two hops, relations with evidence, orders, answer and confidences. Some questions are empty, null, unknown or too long."""
    n = F.expr("query_id div 100")
    ask = F.get(F.array(*(F.lit(x) for x in _PART_ASKS)), (n % 4).cast("int"))
    text = F.when(n % 17 == 3, " ").when(n % 17 == 4, F.lit(None)).when(n % 17 == 5, "zz qq").when(n % 17 == 6, F.repeat("question", 250)).otherwise(F.concat(ask, "question", F.lit(" beside other metal")))
    knowledge, contexts = _supply_graph(spark, sf_dir)
    return answers.answer(_questions(spark, sf_dir).select("query_id", text.alias("question")), knowledge, contexts, PART_LONGEST, PART_THRESHOLD, counted=False)


@query(
    f"with {_SUPPLY_GRAPH}, q as (select p_partkey query_id, p_name question from part where p_partkey % 100 = 0), {_PART_FOUND} "
    "pieces as (select edge_id, list_sort(list_distinct(list(evidence)))[1:2] told from (select md5(src || ':' || dst || ':' || edge_type)[1:16] edge_id, evidence from rel) group by 1), "
    "used as (select query_id, item_id from hits where rank <= 5 union all select query_id, edge_id from chosen) "
    "select query_id, 'entity' part, rank::bigint n, item_id item, text || ': ' || context as text, round(relevance, 6) score from hits join nodes using (item_id) where rank <= 5 union all "
    "select query_id, 'relation', n, edge_id, src || ' ' || edge_type || ' ' || dst || ' | ' || array_to_string(told, ' | '), round(confidence, 6) from chosen join pieces using (edge_id) union all "
    "select distinct query_id, 'document', null, doc_id::varchar, null, null from used join docs using (item_id)"
)
def assemble_evidence(spark, sf_dir):
    """The evidence for every hundredth part's name: parts, relations to suppliers with lines of orders, and the orders of both."""
    knowledge, contexts = _supply_graph(spark, sf_dir)
    nodes = materialise(knowledge.nodes.join(contexts, "item_id").withColumnRenamed("item_id", "node_id"), "supply-nodes")
    found = answers.gather(_questions(spark, sf_dir), knowledge, nodes, PART_THRESHOLD, counted=False)
    return answers.assembled(found, nodes).withColumn("score", F.round("score", 6))
