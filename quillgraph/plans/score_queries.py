"""Queries of evidence scoring, citations, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import confidence, evaluate
from quillgraph.plans.registry import query, table
from quillgraph.sources import files

#: Line items as evidence: an order is a question, a supplier's file is a document, a part an entity.
_EVIDENCE = (
    "ev as (select l_orderkey % 500 query_id, 'study_' || l_suppkey || '_20' || lpad((l_suppkey % 25)::varchar, 2, '0') || case when l_suppkey % 2 = 0 then '.pdf' else '.txt' "
    "end doc, l_partkey entity_id, l_discount::double * 5 + 0.4 score, l_linenumber from lineitem), ent as (select * from ev where l_linenumber % 2 = 1), rel as (select * from "
    "ev where l_linenumber % 2 = 0 and l_linenumber < 6), docs as (select distinct query_id, doc from ev)"
)


def _evidence(spark, sf_dir):
    s = F.col("l_suppkey")
    doc = F.concat(F.lit("study_"), s.cast("string"), F.lit("_20"), F.lpad((s % 25).cast("string"), 2, "0"), F.when(s % 2 == 0, ".pdf").otherwise(".txt"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("query_id"), doc.alias("doc"), F.col("l_partkey").alias("entity_id"), (F.col("l_discount").cast("double") * 5 + 0.4).alias("score"), "l_linenumber")
    return rows.select("query_id", "doc").distinct(), rows.where("l_linenumber % 2 = 1"), rows.where("l_linenumber % 2 = 0 and l_linenumber < 6")


_CONF = (
    "conf as (select d.query_id, d.doc, round(case when coalesce(ne, 0) + coalesce(nr, 0) = 0 then 0.3 else least(case when e is not null and r is not null then (e + r) / 2 else "
    "coalesce(e, r) end + least(0.05 * (coalesce(ne, 0) + coalesce(nr, 0) - 1), 0.2), 1.0) end, 6) confidence, (coalesce(ne, 0) + coalesce(nr, 0))::bigint n_references from docs "
    "d left join (select query_id, doc, avg(score) e, count(*) ne from ent group by all) using (query_id, doc) left join (select query_id, doc, avg(score) r, count(*) nr from "
    "rel group by all) using (query_id, doc))"
)
_META = (
    "least(0.5 + case when contains(stem, 'clinical') or contains(stem, 'metabolomics') or contains(stem, 'biomarker') or contains(stem, 'research') then 0.1 else 0 end + case "
    "when regexp_matches(stem, '(19|20)[0-9]{2}') then 0.1 else 0 end + case when regexp_matches(stem, '[a-z]+_[a-z]+') then 0.1 else 0 end + case when contains(stem, 'journal') "
    "or contains(stem, 'nature') or contains(stem, 'science') or contains(stem, 'cell') or contains(stem, 'plos') then 0.2 else 0 end, 1.0)"
)


@query(f"with {_EVIDENCE}, {_CONF} select * from conf")
def document_confidence(spark, sf_dir):
    return confidence.document_confidence(*_evidence(spark, sf_dir))


@query(
    f"with {_EVIDENCE} select query_id, doc, round(0.3 * {_META} + 0.4 * least(coalesce(n, 0) / 10, 1.0) + 0.3 * coalesce(m, 0.5), 6) reliability from (select *, regexp_replace(doc, "
    f"'\\.[a-z]+$', '') stem from docs) left join (select query_id, doc, count(*) n, avg(score) m from (select query_id, doc, score from ent union all select query_id, doc, score "
    f"from rel) group by all) using (query_id, doc)"
)
def source_reliability(spark, sf_dir):
    return confidence.source_reliability(*_evidence(spark, sf_dir))


@query(
    "with e as (select distinct l_orderkey % 500 query_id, l_partkey id from lineitem), t as (select distinct l_orderkey % 500 query_id, unnest([l_partkey, l_suppkey]) id from "
    "lineitem where l_linenumber = 1) select e.query_id, round(avg(case when t.id is null then 0.0 else 1.0 end), 6) connectivity from e left join t on t.query_id = e.query_id "
    "and t.id = e.id group by 1"
)
def graph_connectivity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("query_id"), F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return confidence.graph_connectivity(rows, rows.where("l_linenumber = 1").select("query_id", F.col("entity_id").alias("src"), "dst"))


@query("select query_id, round(avg(case when n > 1 then 1.0 else 0.0 end), 6) consistency from (select l_orderkey % 50 query_id, l_partkey, count(distinct l_suppkey) n from lineitem group by all) group by 1")
def evidence_consistency(spark, sf_dir):
    return confidence.evidence_consistency(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("doc")))


@query(
    f"with {_EVIDENCE} select doc, round(avg(case when ends_with(doc, '.pdf') then 0.2 else 0 end + 0.7 + case when query_id % 2 = 0 then 0.1 else 0 end), 6) quality, round(avg(case "
    f"when 2024 - y <= 2 then 1.0 when 2024 - y <= 5 then 0.8 when 2024 - y <= 10 then 0.6 else 0.4 end), 6) recency from (select *, regexp_extract(doc, '((?:19|20)[0-9]{{2}})', "
    f"1)::int y from docs) where length(regexp_extract(doc, '((?:19|20)[0-9]{{2}})', 1)) = 4 group by doc"
)
def citation_quality(spark, sf_dir):
    docs = _evidence(spark, sf_dir)[0].where(T.year_of(F.col("doc")).isNotNull())
    return docs.groupBy("doc").agg(F.round(F.avg(T.citation_quality(F.col("doc"), F.col("query_id") % 2 == 0)), 6).alias("quality"), F.round(F.avg(T.temporal_relevance(F.col("doc"), 2024)), 6).alias("recency"))


@query(
    "select l_orderkey, l_linenumber, round(least(b + 0.3 * least(0.2 * d + 0.2 * t + 0.25 * 0.5 + 0.15 * d + 0.1 * t + 0.05 * 0.7 + 0.05 * 0.8, 1.0) * (1 - b), 1.0), 6) full_score, "
    "round(least(b + 0.3 * (0.25 * d + 0.25 * t + 0.2 * least(l_linenumber * 0.1, 0.3) + 0.15 * least(l_linenumber * 0.05, 0.2) + 0.15 * d), 1.0), 6) short_score, case when b "
    ">= 0.8 then 'High' when b >= 0.6 then 'Medium' when b >= 0.4 then 'Low' else 'Very Low' end as level from (select *, l_quantity::double / 50 b, l_discount::double * 10 d, "
    "l_tax::double * 10 t from lineitem)"
)
def response_confidence(spark, sf_dir):
    b, d, t = F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10
    full = confidence.response_confidence(b, {"entity": d, "relation": t, "reliability": F.lit(0.5), "connectivity": d, "consistency": t, "citation": F.lit(0.7), "temporal": F.lit(0.8)})
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(full, 6).alias("full_score"), F.round(confidence.enhanced_confidence(b, d, t, n, n, d), 6).alias("short_score"), T.confidence_level(b).alias("level"))


_STEM = "(select *, regexp_replace(doc, '\\.[a-z]+$', '') stem from docs)"


@query(
    f"with {_EVIDENCE}, r as (select l_orderkey % 500 query_id, l_suppkey relation_id, l_partkey src, l_partkey + 1 dst, 'study_' || l_suppkey || '_20' || lpad((l_suppkey % 25)::varchar, "
    f"2, '0') || case when l_suppkey % 2 = 0 then '.pdf' else '.txt' end doc, l_discount::double * 5 + 0.4 score from lineitem where l_linenumber % 2 = 0 and l_linenumber < 6), "
    "b as (select query_id, query_id % 10 / 10 base from (select distinct query_id from docs)), "
    f"rl as (select query_id, doc, round(0.3 * {_META} + 0.4 * least(coalesce(n, 0) / 10, 1.0) + 0.3 * coalesce(m, 0.5), 6) x from {_STEM} left join (select query_id, doc, count(*) "
    f"n, avg(score) m from (select query_id, doc, score from ent union all select query_id, doc, score from r) group by all) using (query_id, doc)), "
    "rel_ as (select query_id, avg(x) reliability, count_if(x >= 0.8)::bigint good_sources, count(*) sources from rl group by 1), "
    "ci as (select query_id, avg(0.5 + case when ends_with(doc, '.pdf') then 0.2 else 0 end + 0.2 + case when hit then 0.1 else 0 end) citation, avg(case when 2024 - y <= 2 then "
    "1.0 when 2024 - y <= 5 then 0.8 when 2024 - y <= 10 then 0.6 else 0.4 end) temporal from (select docs.*, (2000 + regexp_extract(doc, 'study_([0-9]+)', 1)::int % 25) y, coalesce(hit, "
    "false) hit from docs left join (select distinct query_id, doc, true hit from ent) using (query_id, doc)) group by 1), "
    "e1 as (select query_id, avg(score) entity from ent group by 1), r1 as (select query_id, avg(score) relation from r group by 1), "
    "ends as (select query_id, src id from r union select query_id, dst from r), co as (select x.query_id, round(avg(case when ends.id is null then 0.0 else 1.0 end), 6) connectivity "
    "from (select distinct query_id, entity_id from ent) x left join ends on ends.query_id = x.query_id and ends.id = x.entity_id group by 1), "
    "cs as (select query_id, round(avg(case when n > 1 then 1.0 else 0.0 end), 6) consistency from (select query_id, k, count(distinct doc) n from (select query_id, 'e' || entity_id "
    "k, doc from ent union all select query_id, 'r' || relation_id, doc from r) group by all) group by 1), "
    "f as (select query_id, base, coalesce(entity, 0) entity, coalesce(relation, 0) relation, coalesce(reliability, 0) reliability, coalesce(connectivity, 0) connectivity, coalesce(consistency, "
    "0) consistency, coalesce(citation, 0) citation, coalesce(temporal, 0) temporal, good_sources, sources from b left join e1 using (query_id) left join r1 using (query_id) left "
    "join rel_ using (query_id) left join co using (query_id) left join cs using (query_id) left join ci using (query_id)) "
    "select query_id, base, round(entity, 6) entity, round(relation, 6) relation, round(reliability, 6) reliability, round(connectivity, 6) connectivity, round(consistency, 6) consistency, round(citation, 6) citation, round(temporal, 6) temporal, "
    "round(least(base + 0.3 * least(0.2 * entity + 0.2 * relation + 0.25 * reliability + 0.15 * connectivity + 0.1 * consistency + 0.05 * citation + 0.05 * temporal, 1.0) * (1 - base), 1.0), 6) confidence, good_sources, sources from f"
)
def scored_responses(spark, sf_dir):
    """All seven factors from the evidence of each question, and the confidence that they make."""
    docs, entities, _ = _evidence(spark, sf_dir)
    s = F.col("l_suppkey")
    doc = F.concat(F.lit("study_"), s.cast("string"), F.lit("_20"), F.lpad((s % 25).cast("string"), 2, "0"), F.when(s % 2 == 0, ".pdf").otherwise(".txt"))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0 and l_linenumber < 6")
    relations = rows.select((F.col("l_orderkey") % 500).alias("query_id"), s.alias("relation_id"), F.col("l_partkey").alias("src"), (F.col("l_partkey") + 1).alias("dst"), doc.alias("doc"), (F.col("l_discount").cast("double") * 5 + 0.4).alias("score"))
    bases = docs.select("query_id").distinct().withColumn("base", F.col("query_id") % 10 / 10)
    return confidence.scored_responses(bases, docs, entities, relations, 2024)


_TEXTS = (
    "txt as (select o_orderkey id, 'See [' || (o_orderkey % 7 + 1) || '] and [' || (o_custkey % 5 + 1) || '], also [' || (o_orderkey % 3 + 1) || '].' t from orders), num as (select "
    "id, unnest(list_transform(regexp_extract_all(t, '\\[([0-9]+)\\]', 1), lambda x: x::int)) as number, generate_subscripts(regexp_extract_all(t, '\\[([0-9]+)\\]', 1), 1) - 1 "
    "pos from txt), men as (select id, number, min(pos)::bigint first_pos from num group by all)"
)


def _marked(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("See ["), (o % 7 + 1).cast("string"), F.lit("] and ["), (c % 5 + 1).cast("string"), F.lit("], also ["), (o % 3 + 1).cast("string"), F.lit("]."))
    return table(spark, sf_dir, "orders").select(o.alias("id"), text.alias("t"))


@query(f"with {_TEXTS} select * from men")
def citation_mentions(spark, sf_dir):
    return confidence.citation_mentions(_marked(spark, sf_dir), "id", "t")


@query(
    f"with {_TEXTS}, g as (select id, number, number - row_number() over (partition by id order by number) g from (select distinct id, number from num)), r as (select id, min(number) "
    f"a, max(number) b from g group by id, g) select id, '[' || string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) || ']' ranges from r group by "
    f"id"
)
def collapse_ranges(spark, sf_dir):
    return confidence.collapse_ranges(confidence.citation_mentions(_marked(spark, sf_dir), "id", "t"), "id")


_SOURCES = "src as (select o_orderkey id, unnest(generate_series(1, 7))::int as number from orders), cit as (select id, number, 'PMID:' || ((id + number) % 4) citation from src)"


def _sources(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("number"))
    return rows.withColumn("citation", F.concat(F.lit("PMID:"), ((F.col("id") + F.col("number")) % 4).cast("string")))


@query(f"with {_SOURCES} select id, number, citation, min(number) over (partition by id, citation) to_number from cit")
def consolidate_sources(spark, sf_dir):
    return confidence.consolidate_sources(_sources(spark, sf_dir))


@query(
    f"with {_TEXTS}, {_SOURCES}, c as (select id, citation, min(number) n, min(first_pos) pos from cit left join men using (id, number) group by all) select id, citation, row_number() "
    f"over (partition by id order by pos nulls last, n, citation) entry from c"
)
def bibliography(spark, sf_dir):
    return confidence.bibliography(_sources(spark, sf_dir), confidence.citation_mentions(_marked(spark, sf_dir), "id", "t"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'https://www.orpha.net/en/disease/detail/' || c_custkey when 1 then 'https://omim.org/entry/' || c_custkey else 'PMID:' || c_custkey end link from customer")
def citation_link(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "ORPHA:").when(k % 3 == 1, "OMIM:").otherwise("PMID:")
    return table(spark, sf_dir, "customer").select("c_custkey", confidence.citation_link(F.concat(kind, k.cast("string"))).alias("link"))


def _records(spark, sf_dir):
    """Customers as records of articles; every seventh is broken, every ninth has no authors, every eleventh is not there."""
    k = F.col("c_custkey")
    n = k.cast("string")
    author = lambda last, first: F.concat(F.lit("<Author><LastName>"), last, F.lit("</LastName>"), first, F.lit("</Author>"))
    authors = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("<AuthorList>"), author(F.concat(F.lit("Lee"), n), F.lit("<ForeName>Ann</ForeName>")), author(F.lit("Dee &amp; Co"), F.lit("")), F.lit("</AuthorList>")))
    whole = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><Article><Journal><JournalIssue><PubDate><Year>20"), F.lpad((k % 25).cast("string"), 2, "0"), F.lit("</Year></PubDate></JournalIssue><Title>J"), (k % 3).cast("string"), F.lit("</Title></Journal><ArticleTitle>On "), n, F.lit("</ArticleTitle>"), authors,
        F.lit('</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">'), n, F.lit('</ArticleId><ArticleId IdType="doi">10.1/'), n, F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"),
    )
    rows = table(spark, sf_dir, "customer").where(k % 11 > 0)
    return files.bibliography_records(rows.select(k.alias("id"), F.when(k % 7 == 0, F.lit("<PubmedArticle><broken")).otherwise(whole).alias("xml")), "id", "xml")


_RECORDS = "rec as (select c_custkey k, c_custkey::varchar pmid, c_custkey % 7 > 0 good, case when c_custkey % 9 = 0 then 'Anonymous' else 'Lee' || c_custkey || ', Ann and Dee & Co' end authors, 2000 + c_custkey % 25 y from customer where c_custkey % 11 > 0)"


@query(
    f"with {_RECORDS} select pmid, case when good then authors end authors, case when good then 'On ' || pmid end title, case when good then 'J' || k % 3 end journal, case when "
    f"good then y end::int as year, case when good then '10.1/' || pmid end doi from rec"
)
def bibliography_records(spark, sf_dir):
    return _records(spark, sf_dir).drop("month", "url")


@query(
    f"with {_RECORDS} select o_orderkey id, c.citation, case when k % 5 = 4 then 'https://omim.org/entry/' || k when good then authors || ' (' || y || '). On ' || pmid || '. J' "
    f"|| k % 3 || '. https://doi.org/10.1/' || pmid || ' https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' else c.citation end link "
    "from (select o_orderkey, o_custkey, case when o_custkey % 5 = 4 then 'OMIM: ' else 'PMID:' end || o_custkey citation from orders) c left join rec on case when o_custkey % 5 = 4 then o_custkey = k else o_custkey = k end".replace("when k % 5 = 4 then 'https://omim.org/entry/' || k", "when o_custkey % 5 = 4 then 'https://omim.org/entry/' || o_custkey")
)
def linked_citations(spark, sf_dir):
    """Orders cite customers' records; missing and broken ones stay as they are."""
    c = F.col("o_custkey")
    cited = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.when(c % 5 == 4, "OMIM: ").otherwise("PMID:"), c.cast("string")).alias("citation"))
    return confidence.linked_citations(cited, _records(spark, sf_dir))


@query(
    "select conv_id, turn, case when kind in (0, 1, 4) then true when kind = 2 then false end metadata_ok, case kind when 0 then 'm' || turn when 1 then turn::varchar when 4 then "
    "null end model, case kind when 0 then conv_id when 1 then 12 end::int tokens, case kind when 0 then 'x,y' when 1 then null end tags, case kind when 0 then 0.5 when 1 then "
    "2 end::double as temperature "
    "from (select conv_id, turn, turn % 5 kind from conversations)"
)
def chat_metadata(spark, sf_dir):
    """Metadata of mixed types: text, numbers and arrays under the same names, broken text, nulls, arrays at the top."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    text = (
        F.when(turn % 5 == 0, F.concat(F.lit('{"model": "m'), turn.cast("string"), F.lit('", "tokens": '), conv, F.lit(', "settings": {"temperature": 0.5}, "tags": ["x", "y"]}')))
        .when(turn % 5 == 1, F.concat(F.lit('{"model": '), turn.cast("string"), F.lit(', "tokens": "12", "settings": {"temperature": 2}, "tags": "none"}')))
        .when(turn % 5 == 2, "{broken").when(turn % 5 == 4, "[1, 2]")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("metadata"))
    fields = {"model": ("$.model", "string"), "tokens": ("$.tokens", "int"), "tags": ("$.tags", "array<string>"), "temperature": ("$.settings.temperature", "double")}
    return files.chat_metadata(rows, fields).drop("metadata").withColumn("tags", F.array_join("tags", ","))


@query("select o_orderkey, 'Source ' || (o_orderkey % 5) || ', Source ' || (o_orderkey % 5 + 1) || ' and [3], [4], [5]' text from orders")
def expand_citations(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    text = F.concat(F.lit("Sources "), k.cast("string"), F.lit("-"), (k + 1).cast("string"), F.lit(" and [3, 4-5]\n\nSource: x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", confidence.expand_citations(text).alias("text"))


@query("select o_orderkey id, unnest([1, 2])::int as number, unnest(['https://x.org/' || o_orderkey, 'Book']) as source, unnest([round(o_orderkey % 10 / 10, 1), 0.8])::double confidence, unnest([true, false]) is_url from orders")
def parse_web_citations(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("An answer [1].\n[1]: https://x.org/"), k.cast("string"), F.lit(" (Confidence: "), F.round(k % 10 / 10, 1).cast("string"), F.lit(")\n[2]: Book"))
    return confidence.parse_web_citations(table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("t")), "id", "t")


_PLACES = "loc as (select query_id, doc, string_agg(distinct p::varchar, ',' order by p::varchar) pages from (select query_id, doc, unnest([100 + l_linenumber, 100 + entity_id % 7]) p from (select * from ent union all select * from rel)) group by all)"


def _places(spark, sf_dir):
    _, e, r = _evidence(spark, sf_dir)
    rows = e.unionByName(r).select("query_id", "doc", (100 + F.col("l_linenumber")).cast("string").alias("page"), F.lit(None).cast("string").alias("section"), F.concat(F.lit("see Page "), (100 + F.col("entity_id") % 7).cast("string")).alias("evidence"))
    return confidence.citation_locations(rows)


@query(f"with {_EVIDENCE}, {_PLACES} select query_id, doc, pages from loc")
def citation_locations(spark, sf_dir):
    return _places(spark, sf_dir).select("query_id", "doc", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(
    f"with {_EVIDENCE}, {_CONF}, {_PLACES} select c.query_id, c.doc, 2000 + split_part(c.doc, '_', 2)::int % 25 as year, 'Study ' || split_part(c.doc, '_', 2) title, confidence, "
    f"coalesce(pages, '') pages, row_number() over (partition by c.query_id order by confidence desc, c.doc)::int place from conf c left join loc using (query_id, doc)"
)
def extract_citations(spark, sf_dir):
    rows = confidence.extract_citations(*_evidence(spark, sf_dir), _places(spark, sf_dir))
    return rows.select("query_id", "doc", "year", "title", "confidence", F.coalesce(F.array_join(F.col("pages").cast("array<string>"), ","), F.lit("")).alias("pages"), "place")


_CITED = "'Source ' || turn || ' says ([' || conv_id || ']) (1, 2-3), [[' || turn || ']] SOURCE 4. (5).' || chr(10) || coalesce(text, '')"


@query(
    rf"select conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CITED}, 'Source (\d+)', '[\1]', 'gi'), '\(([\d, -]+)\)[., "
    rf"]', '[\1].', 'g'), '\(\[', '[', 'g'), '\]\)', ']', 'g'), '\[\[+', '[', 'g'), '\]\]+', ']', 'g')) digest from conversations"
)
def normalize_citations(spark, sf_dir):
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    text = F.concat(F.lit("Source "), turn, F.lit(" says (["), conv, F.lit("]) (1, 2-3), [["), turn, F.lit("]] SOURCE 4. (5).\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(confidence.normalize_citations(text)).alias("digest"))


@query(
    f"with {_EVIDENCE}, {_CONF} select query_id, count(*) n, count_if(confidence >= 0.8)::bigint high, count_if(confidence >= 0.6 and confidence < 0.8)::bigint medium, count_if(confidence "
    f"< 0.6)::bigint low, round(avg(confidence), 6) mean, max(confidence) best, min(confidence) worst, 0::bigint with_pages, 0::bigint with_authors, 0::bigint with_doi from conf "
    f"group by 1"
)
def citation_statistics(spark, sf_dir):
    return confidence.citation_statistics(confidence.document_confidence(*_evidence(spark, sf_dir)))


@query(
    f"with {_EVIDENCE}, {_CONF} select query_id, string_agg(substr(s, 3) || ': ' || doc || '. ' || doc, chr(10) order by s, -confidence, doc) bibliography from (select *, case "
    f"when confidence >= 0.8 then '1 Primary' when confidence >= 0.6 then '2 Supporting' else '3 Additional' end s from conf) group by 1"
)
def render_bibliography(spark, sf_dir):
    rows = confidence.document_confidence(*_evidence(spark, sf_dir)).withColumn("title", F.col("doc")).withColumn("year", F.lit(None).cast("int"))
    return confidence.render_bibliography(rows)


_DETAILS = (
    "det as (select *, 2000 + split_part(doc, '_', 2)::int % 25 as year, 'Study ' || repeat(split_part(doc, '_', 2) || ' ', 1 + n_references % 9 * 5) title, list_transform(range(n_references "
    "% 5), lambda i: 'Author ' || i) authors, case when n_references % 3 > 0 then list_transform(range(n_references % 3), lambda i: (10 + i)::int) end pages, case when n_references "
    "% 2 = 0 then 'Journal ' || n_references end journal, case when n_references % 4 = 1 then '10.1/' || n_references end doi from conf)"
)


def _details(spark, sf_dir):
    n = F.col("n_references")
    number = F.split_part("doc", F.lit("_"), F.lit(2))
    numbered = lambda count, item: F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1), item))
    rows = confidence.document_confidence(*_evidence(spark, sf_dir))
    return rows.withColumns({
        "year": (2000 + number.cast("int") % 25), "title": F.concat(F.lit("Study "), F.repeat(F.concat(number, F.lit(" ")), (1 + n % 9 * 5).cast("int"))),
        "authors": numbered(n % 5, lambda i: F.concat(F.lit("Author "), i.cast("string"))), "pages": numbered(n % 3, lambda i: (10 + i).cast("int")),
        "journal": F.when(n % 2 == 0, F.concat(F.lit("Journal "), n.cast("string"))), "doi": F.when(n % 4 == 1, F.concat(F.lit("10.1/"), n.cast("string"))),
    })


@query(
    f"with {_EVIDENCE}, {_CONF}, {_DETAILS} select query_id, case when confidence >= 0.8 then 1 when confidence >= 0.6 then 2 else 3 end as section, row_number() over (partition by query_id order by confidence desc, doc)::int place, "
    "concat_ws('. ', case when len(authors) > 3 then array_to_string(authors[1:3], ', ') || ', et al.' when len(authors) > 0 then array_to_string(authors, ', ') end, '(' || year "
    "|| ')', '*' || case when length(title) > 100 then title[1:100] || '...' else title end || '*', '*' || journal || '*', 'DOI: ' || doi, "
    "case when len(pages) = 1 then 'p. ' || pages[1] when len(pages) > 1 then 'pp. ' || pages[1] || '-' || pages[-1] end, '(' || doc || ')', '[Confidence: ' || case when confidence "
    ">= 0.8 then 'High' when confidence >= 0.6 then 'Medium' when confidence >= 0.4 then 'Low' else 'Very Low' end || ']') line from det"
)
def full_bibliography(spark, sf_dir):
    """Full lines: authors, year, title, journal, DOI, pages, file, level."""
    return confidence.full_bibliography(_details(spark, sf_dir))


@query(f"with {_EVIDENCE}, {_CONF}, {_DETAILS} select query_id, count(*) n, count_if(len(pages) > 0)::bigint with_pages, count_if(len(authors) > 0)::bigint with_authors, count_if(doi is not null)::bigint with_doi from det group by 1")
def citation_details(spark, sf_dir):
    return confidence.citation_statistics(_details(spark, sf_dir)).select("query_id", "n", "with_pages", "with_authors", "with_doi")


_SPOKEN = (
    "'Fact one (confidence score: 0.' || o_orderkey % 10 || ') [1] [2] and two, Confidence score: 0.5 based on [' || o_orderkey % 5 || '] (confidence score: 1.2.3) [3] ' || case "
    "when o_orderkey % 3 = 0 then '(confidence score: 0.9) [1]' else '[Source: book ' || o_orderkey || '] x (0.25) [Source: two] (7) (0.75)' end"
)


def _spoken(spark, sf_dir):
    o = F.col("o_orderkey")
    tail = F.when(o % 3 == 0, F.lit("(confidence score: 0.9) [1]")).otherwise(F.concat(F.lit("[Source: book "), o.cast("string"), F.lit("] x (0.25) [Source: two] (7) (0.75)")))
    text = F.concat(F.lit("Fact one (confidence score: 0."), (o % 10).cast("string"), F.lit(") [1] [2] and two, Confidence score: 0.5 based on ["), (o % 5).cast("string"), F.lit("] (confidence score: 1.2.3) [3] "), tail)
    return table(spark, sf_dir, "orders").select(o.alias("id"), text.alias("t"))


@query(
    "with s as (select o_orderkey id, 1 as number, 1 p, (o_orderkey % 10) / 10 x from orders union all select o_orderkey, 2, 1, (o_orderkey % 10) / 10 from orders union all select "
    "o_orderkey, (o_orderkey % 5)::int, 2, 0.5 from orders union all select o_orderkey, 1, 3, 0.9 from orders where o_orderkey % 3 = 0), "
    "f as (select id, number, arg_min(x, p)::double confidence from s group by all), r as (select o_orderkey id, unnest([1, 2, 3, 4])::int as number from orders) "
    "select id, number, 'ref ' || number as source, round(confidence, 6) confidence, case when confidence is null then 'Further Reading' else 'References' end as section from r left join f using (id, number)"
)
def scored_references(spark, sf_dir):
    """References with the scores that the text states for them."""
    rows = _spoken(spark, sf_dir)
    references = rows.select("id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number"))
    references = references.withColumn("source", F.concat(F.lit("ref "), F.col("number").cast("string")))
    found = confidence.scored_references(references, confidence.inline_scores(rows, "id", "t"), "id")
    return found.withColumn("confidence", F.round("confidence", 6))


@query(
    f"select o_orderkey id, case when o_orderkey % 3 = 0 then t else replace(replace(t, '[Source: book ' || o_orderkey || ']', '[1]'), '[Source: two]', '[2]') end as text, case "
    f"when o_orderkey % 3 = 0 then '' else 'book ' || o_orderkey || '|two' end sources, case when o_orderkey % 3 = 0 then 0.7 else 0.5 end::double confidence from (select *, {_SPOKEN} "
    f"t from orders)"
)
def numbered_source_marks(spark, sf_dir):
    found = _spoken(spark, sf_dir).select("id", confidence.number_source_marks(F.col("t")).alias("m"))
    return found.select("id", "m.text", F.array_join("m.sources", "|").alias("sources"), "m.confidence")


@query("select o_orderkey, 'One' || ' [1]. Two ' || o_orderkey || ' [2]' content from orders")
def insert_markers(spark, sf_dir):
    text = F.concat(F.lit("One. Two "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", confidence.insert_markers(text, F.lit(" [1]"), F.lit(" [2]")).alias("content"))


_QUALITY = (
    "least(0.25 * case when n < 50 then n / 50 * 0.5 when n > 2000 then 0.8 else greatest(0.5, 1.0 - abs(n - 400) / 400) end + 0.35 * c + 0.25 * case when k = 0 then 0.0 when "
    "k <= 3 then k / 3.0 * 0.8 else 0.8 end + 0.05 * 0.1 + 0.10 * case when len(string_split(text, '.')) <= 1 then 0.0 when len(w) / greatest(len(s), 1) between 10 and 25 then "
    "0.2 else 0.1 end, 1.0)"
)
_QROWS = (
    r"rows_ as (select doc_id, text, length(trim(text)) n, (doc_id % 10) / 10 c, doc_id % 5 k, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: "
    r"x <> '') s, list_filter(regexp_split_to_array(array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''), ' '), '\s+'), lambda "
    r"x: x <> '') w from documents where not contains(text, chr(9)))"
)


def _quality(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\t")))
    return rows.select(d.alias("query_id"), ((d % 10) / 10).alias("confidence"), T.response_quality(F.col("text"), (d % 10) / 10, d % 5, F.lit("kb")).alias("quality"))


@query(f"with {_QROWS} select doc_id query_id, c confidence, round({_QUALITY}, 6) quality from rows_")
def response_quality(spark, sf_dir):
    return _quality(spark, sf_dir).withColumn("quality", F.round("quality", 6))


@query("select doc_id, md5(trim(regexp_replace(trim(text), '\\s+', ' ', 'g')) || ' [1] [2]') digest from documents where not contains(text, '[') and not contains(text, ']')")
def clean_response(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("[")) & ~F.contains("text", F.lit("]")))
    return rows.select("doc_id", F.md5(T.clean_response(F.concat(F.trim("text"), F.lit("   [1][2] (Confidence score: 0.9)")))).alias("digest"))


_SIDES = "a as (select o_orderkey query_id, (o_orderkey % 11) / 11 qa, (o_custkey % 7) / 7 ca from orders where o_orderkey % 5 > 0), b as (select o_orderkey query_id, (o_orderkey % 13) / 13 qb, (o_custkey % 9) / 9 cb from orders where o_orderkey % 7 > 0)"


def _sides(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    kb = orders.where(o % 5 > 0).select(o.alias("query_id"), ((o % 11) / 11).alias("quality"), ((c % 7) / 7).alias("confidence"))
    web = orders.where(o % 7 > 0).select(o.alias("query_id"), ((o % 13) / 13).alias("quality"), ((c % 9) / 9).alias("confidence"))
    return kb, web


@query(
    f"with {_SIDES}, s as (select *, case when qb is null then 'kb_only' when qa is null then 'web_only' when qa - qb > 0.3 then 'kb_primary' when qb - qa > 0.3 then 'web_primary' "
    f"when qa > 0.7 and qb > 0.7 then 'parallel' else 'quality' end strategy from a full join b using (query_id)) select query_id, strategy, round(case strategy when 'kb_only' "
    f"then ca when 'web_only' then cb when 'kb_primary' then 0.7 * ca + 0.3 * cb when 'web_primary' then 0.7 * cb + 0.3 * ca when 'parallel' then (ca + cb) / 2 else case when qa "
    f">= qb then ca else cb end end, 6) confidence, round(greatest(coalesce(qa, qb), coalesce(qb, qa)), 6) quality from s"
)
def combine_responses(spark, sf_dir):
    return confidence.combine_responses(*_sides(spark, sf_dir))


_FUSED = (
    f"with {_SIDES}, ab as (select o_orderkey query_id, qa, ca, qb, cb, 'kb ' || repeat(o_orderkey || ' ', 40) ka, 'web ' || o_custkey kb from orders left join a on a.query_id = o_orderkey left join b on b.query_id = o_orderkey), "
    "s as (select *, case when qa is null and qb is null then 'none' when qb is null then 'kb_only' when qa is null then 'web_only' when qa - qb > 0.3 then 'kb_primary' when qb "
    "- qa > 0.3 then 'web_primary' when qa > 0.7 and qb > 0.7 then 'parallel' else 'quality' end strategy from ab), "
    "w as (select *, strategy = 'web_primary' or (strategy = 'quality' and qb > qa) web_first from s), n as (select chr(10) n) "
    "select query_id, strategy, md5(case strategy when 'none' then 'No response is available from any source.' when 'kb_only' then ka when 'web_only' then kb "
    "when 'kb_primary' then ka || case when qb > 0.5 then n || n || '**Additional Context:**' || n || kb else '' end when 'web_primary' then kb || case when qa > 0.5 then n || n || '**Knowledge Base Context:**' || n || ka else '' end "
    "when 'parallel' then '**Knowledge Base Response:**' || n || ka || n || n || '**Current Information:**' || n || kb "
    "else case when web_first then kb else ka end || case when case when web_first then qa else qb end > 0.4 then n || n || '**Additional Context:**' || n || (case when web_first then ka else kb end)[1:200] || '...' else '' end end) digest, "
    "concat_ws(n, case when web_first then null when qa is not null then 'a' || query_id end, case when qb is not null and query_id % 2 = 0 then 'b' end, case when web_first and qa is not null then 'a' || query_id end) bibliography, "
    "round(case strategy when 'none' then 0 when 'kb_only' then ca when 'web_only' then cb when 'kb_primary' then 0.7 * ca + 0.3 * cb when 'web_primary' then 0.7 * cb + 0.3 * "
    "ca when 'parallel' then (ca + cb) / 2 else case when qa >= qb then ca else cb end end, 6) confidence, "
    "round(case strategy when 'none' then 0 when 'kb_only' then qa when 'web_only' then qb when 'kb_primary' then 0.7 * qa + 0.3 * qb when 'web_primary' then 0.7 * qb + 0.3 * qa when 'parallel' then (qa + qb) / 2 else greatest(qa, qb) end, 6) quality, "
    "(case when qa is null then 0 else 1.5 end + case when qb is null then 0 else 0.25 end)::double as seconds, (case when qa is null then 0 else query_id % 4 end + case when qb is null then 0 else 2 end)::bigint n_citations, "
    "case when qa is null and qb is null then '' when qb is null then 'kb' when qa is null then 'web' when web_first then 'web,kb' else 'kb,web' end sources from w, n"
)


@query(_FUSED)
def fused_responses(spark, sf_dir):
    """All orders as questions: some with both answers, some with one, some with none."""
    kb, web = _sides(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_custkey")
    q = F.col("query_id")
    kb = kb.select("query_id", "quality", "confidence", F.concat(F.lit("kb "), F.repeat(F.concat(q.cast("string"), F.lit(" ")), 40)).alias("content"), F.concat(F.lit("a"), q.cast("string")).alias("bibliography"), F.lit(1.5).alias("seconds"), (q % 4).alias("n_citations"))
    web = web.join(orders, "query_id").select("query_id", "quality", "confidence", F.concat(F.lit("web "), F.col("o_custkey").cast("string")).alias("content"), F.when(q % 2 == 0, "b").alias("bibliography"), F.lit(0.25).alias("seconds"), F.lit(2).cast("long").alias("n_citations"))
    rows = confidence.fuse_responses(orders, kb, web)
    return rows.withColumn("digest", F.md5("content")).drop("content").withColumn("confidence", F.round("confidence", 6))


@query(
    f"with {_SIDES}, u as (select query_id, 'kb' as source, qa quality, ca confidence from a union all select query_id, 'web', qb, cb from b) select query_id, source from u qualify "
    f"row_number() over (partition by query_id order by 0.6 * quality + 0.4 * confidence desc, source) = 1"
)
def select_best(spark, sf_dir):
    kb, web = _sides(spark, sf_dir)
    return confidence.select_best(kb.withColumn("source", F.lit("kb")).unionByName(web.withColumn("source", F.lit("web")))).select("query_id", "source")


@query(
    "with r as (select *, 's' || l_linenumber s from lineitem), x as (select l_orderkey, s, max(l_partkey::varchar) m from r group by all), y as (select l_orderkey, string_agg(s || '_part=' || m, ',' order by s) metadata from x group by 1) "
    "select l_orderkey query_id, string_agg('## ' || s || chr(10) || 'text ' || l_partkey, chr(10) || chr(10) order by s, 'text ' || l_partkey) as content, round(sum(l_tax::double), "
    "6) as seconds, any_value(metadata) metadata from r join y using (l_orderkey) group by 1"
)
def merge_n_responses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("source"), F.concat(F.lit("text "), F.col("l_partkey").cast("string")).alias("content"), F.lit(0.5).alias("confidence"), F.col("l_tax").cast("double").alias("seconds"), F.create_map(F.lit("part"), F.col("l_partkey").cast("string")).alias("metadata"))
    merged = confidence.merge_n_responses(rows).drop("confidence")
    return merged.withColumn("metadata", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query(
    "select item_id, case when item_id % 3 = 0 then 'hybrid' when contains(lower(text), 'new') or contains(lower(text), 'now') or contains(lower(text), 'recent') or contains(lower(text), "
    "'latest') or contains(lower(text), 'current') or contains(lower(text), 'today') or contains(lower(text), 'trending') then 'real_time' else 'knowledge_base' end query_type, "
    "case when item_id % 3 = 0 then 0.75 else 0.3 end::double confidence, item_id % 3 = 0 valid, case when item_id % 3 = 0 then 'parallel' when contains(lower(text), 'new') or "
    "contains(lower(text), 'now') or contains(lower(text), 'recent') or contains(lower(text), 'latest') or contains(lower(text), 'current') or contains(lower(text), 'today') or "
    "contains(lower(text), 'trending') then 'web_first' else 'kb_first' end strategy from benchmark"
)
def classify_and_route(spark, sf_dir):
    good = F.lit('Sure: {"query_type": "HYBRID", "confidence_score": 0.75, "reasoning": "both"} done')
    bad = F.lit('{"query_type": "HYBRID", "confidence_score": 7}')
    rows = table(spark, sf_dir, "benchmark").withColumn("j", F.when(F.col("item_id") % 3 == 0, good).otherwise(bad))
    found = confidence.parse_classification(rows, "item_id", "j", "text")
    return found.withColumn("strategy", confidence.routing_strategy(F.col("query_type"), F.col("confidence")))


@query("select event_type strategy, count(*) n, round(count(*) / (select count(*) from events), 6) share, round(avg(case when user_id % 4 > 0 then 1.0 else 0.0 end), 6) success_rate, round(avg(value), 6) mean_seconds from events group by 1")
def routing_metrics(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), (F.col("user_id") % 4 > 0).alias("ok"), F.col("value").alias("seconds"))
    return confidence.routing_metrics(log, "strategy")


_ANSWERS = (
    "sc as (select conv_id, turn, case when conv_id % 2 = 0 then 'definition' else 'application' end category, case when turn % 2 = 0 then 'basic' else 'advanced' end difficulty, "
    "(contains(lower(text), 'the')::int + contains(lower(text), 'with')::int + contains(lower(text), 'zz')::int) / 3 k, ((contains(lower(text), 'was') or contains(lower(text), "
    "'are'))::int + contains(lower(text), 'quux')::int) / 2 c, (turn % 10) / 10 conf, length(text) n from conversations), ans as (select *, round(k, 6) keyword_share, round(c, "
    "6) concept_share, round(least(0.4 * k + 0.4 * c + 0.2 * least(conf, 1.0), 1.0), 6) accuracy from sc)"
)


def _answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, "definition").otherwise("application").alias("category"), F.when(F.col("turn") % 2 == 0, "basic").otherwise("advanced").alias("difficulty"), F.col("text").alias("answer"), ((F.col("turn") % 10) / 10).alias("confidence"), F.array(F.lit("the"), F.lit("with"), F.lit("zz")).alias("keywords"), F.array(F.lit("was are"), F.lit("quux")).alias("concepts"), F.lit(0.1).alias("minimum"))
    return evaluate.score_answers(rows)


@query(f"with {_ANSWERS} select conv_id, turn, keyword_share, concept_share, accuracy, accuracy >= 0.6 and conf >= 0.1 and n > 50 passed from ans")
def score_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", "keyword_share", "concept_share", "accuracy", "passed")


@query(
    f"with {_ANSWERS} select case when grouping(category) = 0 then 'category' when grouping(difficulty) = 0 then 'difficulty' else 'all' end as level, category, difficulty, count(*) "
    f"n, round(avg((accuracy >= 0.6 and conf >= 0.1 and n > 50)::int), 6) pass_rate, "
    "round(avg(accuracy), 6) mean, round(median(accuracy), 6) median, round(stddev_samp(accuracy), 6) deviation, min(accuracy) least, max(accuracy) most, round(avg(conf) filter "
    "(conf > 0), 6) mean_confidence, round(avg(turn + 0.5), 6) mean_seconds from ans group by grouping sets ((), (category), (difficulty))"
)
def suite_summary(spark, sf_dir):
    return evaluate.suite_summary(_answers(spark, sf_dir).withColumn("seconds", F.col("turn") + 0.5))


@query(
    f"with {_ANSWERS}, s as (select avg((accuracy >= 0.6 and conf >= 0.1 and n > 50)::int) pass_rate, avg(accuracy) mean from ans) select 'pass_rate' criterion, round(pass_rate, "
    f"6) as value, pass_rate >= 0.5 ok from s union all select 'mean', round(mean, 6), mean <= 0.9 from s"
)
def success_criteria(spark, sf_dir):
    s = _answers(spark, sf_dir).agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("accuracy").alias("mean"))
    return evaluate.success_criteria(s, {"pass_rate": (">=", 0.5), "mean": ("<=", 0.9)}).withColumn("value", F.round("value", 6))
