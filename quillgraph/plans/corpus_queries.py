"""Queries of document preparation, language, extraction and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import changes, corpus, extract
from quillgraph.plans.registry import query, table
from quillgraph.sources import files

#: Stop words by which the language table is scored.
PROFILES = {
    "en": ["the", "and", "of", "to", "in", "that", "with", "for", "is", "was"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "que", "dans", "pour"],
    "de": ["der", "die", "das", "und", "ist", "für", "auf", "sich", "nicht", "mit"],
    "es": ["el", "los", "se", "que", "por", "como", "una", "las", "no", "para"],
}
#: Words that stand for entities in the invented corpus.
TOKEN_TYPES = {"metabolite": ["with", "from"], "disease": ["this", "that"], "pathway": ["was", "are"]}
_CLEAN = r"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\x00-\x7F]+', '', 'g'))"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 20)"
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"
_SCORES = "scores as (select doc_id, lang as guess, n / sum(n) over (partition by doc_id) as score from (select d.doc_id, p.lang, count(*) n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) word from documents) d join (" + " union all ".join(f"select '{w}' word, '{k}' lang" for k, ws in PROFILES.items() for w in ws) + ") p using (word) group by all))"
#: Mentions by place among the tokens, as a common table expression.
MENTIONS = "mentions as (select doc_id, tok as text, case when tok in ('with', 'from') then 'metabolite' when tok in ('this', 'that') then 'disease' else 'pathway' end entity_type, 0.8::double confidence, pos::bigint start_pos from (select doc_id, unnest(t) tok, generate_subscripts(t, 1) - 1 pos from (select doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') t from documents)) where tok in ('with', 'from', 'this', 'that', 'was', 'are'))"


def mentions_of(spark, sf_dir):
    return extract.token_entities(table(spark, sf_dir, "documents"), TOKEN_TYPES)


@query(f"select doc_id, length(c)::bigint n_clean, md5(c) digest from (select doc_id, {_CLEAN} c from documents)")
def clean_text(spark, sf_dir):
    c = T.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n_clean"), F.md5(c).alias("digest"))


@query("select doc_id, list_filter(list_transform(string_split(text, chr(10))[1:10], lambda s: trim(s)), lambda s: length(s) between 11 and 199)[1] title from documents")
def document_titles(spark, sf_dir):
    return corpus.extract_sections(table(spark, sf_dir, "documents")).select("doc_id", "title")


@query(
    "with d as (select doc_id, 'A title of document ' || doc_id || chr(10) || case when doc_id % 3 = 0 then 'Authors: Ann Lee; Bo, Cy Dee and ' || source || chr(10) else '' end "
    "|| 'Abstract: ' || coalesce(text, '') || chr(10) || case when doc_id % 2 = 0 then 'Keywords' else 'Introduction' end t from documents where not regexp_matches(coalesce(text, "
    "''), '(?i)abstract|keywords|introduction|background|1\\.|affiliation|by|author')) "
    "select doc_id, 'A title of document ' || doc_id title, md5(trim(trim(regexp_extract(t, '(?is)abstract\\s*:?\\s*(.*?)\\n\\s*(?:keywords|introduction)', 1))[1:1000])) digest, "
    "case when doc_id % 3 = 0 then array_to_string(list_filter(['Ann Lee', 'Cy Dee', regexp_extract(t, ' and ([^\\n]*)', 1)], lambda a: length(a) > 2), '|') else '' end authors "
    "from d"
)
def document_sections(spark, sf_dir):
    """Title, abstract and authors of documents that are laid out as articles."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").where(~text.rlike(r"(?i)abstract|keywords|introduction|background|1\.|affiliation|by|author"))
    d = F.col("doc_id")
    authors = F.when(d % 3 == 0, F.concat(F.lit("Authors: Ann Lee; Bo, Cy Dee and "), "source", F.lit("\n"))).otherwise("")
    whole = F.concat(F.lit("A title of document "), d.cast("string"), F.lit("\n"), authors, F.lit("Abstract: "), text, F.lit("\n"), F.when(d % 2 == 0, "Keywords").otherwise("Introduction"))
    rows = corpus.extract_sections(docs.select("doc_id", whole.alias("text")))
    return rows.select("doc_id", "title", F.md5(F.trim("abstract")).alias("digest"), F.array_join("authors", "|").alias("authors"))


@query("select doc_id, 0 unit_no, md5(text) digest from documents where contains(lower(text), 'with') or contains(lower(text), 'tion')")
def keyword_pages(spark, sf_dir):
    rows = corpus.keyword_units(table(spark, sf_dir, "documents"), ["with", "TION"], unit="page", limit=3)
    return rows.select("doc_id", "unit_no", F.md5("unit").alias("digest"))


@query(rf"select doc_id, len(list_filter(regexp_split_to_array({_CLEAN}, '\s+'), lambda t: t <> ''))::bigint n_words from documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(T.clean_text(F.col("text"))).alias("n_words"))


@query("select doc_id, coalesce(case when trim(string_split(text, chr(10))[2]) <> '' then string_split(text, chr(10))[2] end, case when trim(source) <> '' then source end) picked from documents")
def coalesce_extractions(spark, sf_dir):
    second = F.try_element_at(F.split("text", "\n"), F.lit(2))
    return table(spark, sf_dir, "documents").select("doc_id", T.coalesce_extractions(second, F.col("source")).alias("picked"))


@query("select doc_id, s::bigint chunk_start, length(text[s + 1:s + 1000])::bigint n, md5(text[s + 1:s + 1000]) digest from (select doc_id, text, unnest(generate_series(0, length(text) - 1, 800)) s from documents where length(text) > 0)")
def chunk_text(spark, sf_dir):
    rows = corpus.chunk_text(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("chunk_start").cast("long").alias("chunk_start"), F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query(f"select doc_id, count(*) n, md5(min(s)) first_digest from (select doc_id, unnest({_SENTENCES}) s from documents) where contains(lower(s), 'with') or contains(lower(s), 'from') group by doc_id")
def keyword_sentences(spark, sf_dir):
    rows = corpus.keyword_units(table(spark, sf_dir, "documents"), ["with", "from"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.min("unit")).alias("first_digest"))


@query(r"select page_id, nullif(regexp_extract(url, '((?:19|20)[0-9]{2})', 1), '')::int as \"year\", length(regexp_extract(url, '([^/]*)$', 1))::bigint n_stem from pages".replace('\\"', '"'))
def filename_metadata(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.year_of(url).alias("year"), F.length(F.regexp_extract(url, "([^/]*)$", 1)).cast("long").alias("n_stem"))


@query(f"with {MENTIONS} select doc_id, start_pos, text from (select *, row_number() over (partition by doc_id order by confidence desc, start_pos) n from mentions where confidence >= 0.7) where n <= 50")
def capped_entities(spark, sf_dir):
    return corpus.cap_entities(corpus.filter_min_confidence(mentions_of(spark, sf_dir), 0.7)).select("doc_id", "start_pos", "text")


@query("select doc_id, n_chars, (select count(*) from documents where contains(lower(text), 'the')) total from documents where contains(lower(text), 'the') order by n_chars desc, doc_id limit 20 offset 10")
def list_documents(spark, sf_dir):
    return corpus.list_documents(table(spark, sf_dir, "documents"), "the", "n_chars", True, 20, 10).select("doc_id", "n_chars", "total")


@query("select source, count(*) documents, round(avg(n_chars), 6) mean_chars, max(n_chars) max_chars from documents group by grouping sets ((), (source))")
def document_statistics(spark, sf_dir):
    return corpus.document_statistics(table(spark, sf_dir, "documents"))


@query(f"with {_SCORES} select doc_id, guess, round(score, 6) score from scores")
def language_scores(spark, sf_dir):
    rows = corpus.language_scores(table(spark, sf_dir, "documents"), PROFILES)
    return rows.select("doc_id", F.col("lang").alias("guess"), F.round("score", 6).alias("score"))


@query(
    f"with {_SCORES} select lang, count(*) n, round(avg(case when guess = lang then 1.0 else 0.0 end), 6) accuracy from (select doc_id, case when max(score) > 0.5 then arg_max(guess, "
    f"score) else 'en' end guess from scores group by doc_id) join documents using (doc_id) group by rollup (lang)"
)
def language_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    picked = corpus.pick_language(corpus.language_scores(docs, PROFILES)).select("doc_id", F.col("lang").alias("guess"))
    return corpus.label_accuracy(picked.join(docs, "doc_id"), "guess", "lang").withColumn("accuracy", F.round("accuracy", 6))


@query("select doc_id, 'See __CITATION_0__ and __CITATION_1__ for ' || source masked, '[' || (doc_id % 9) || ']|[1, ' || (doc_id % 7) || ']' markers, 'See [' || (doc_id % 9) || '] and [1, ' || (doc_id % 7) || '] for ' || source back from documents")
def mask_citations(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.lit("See ["), (d % 9).cast("string"), F.lit("] and [1, "), (d % 7).cast("string"), F.lit("] for "), F.col("source"))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.mask_citations(text).alias("m"))
    return rows.select("doc_id", "m.masked", F.array_join("m.markers", "|").alias("markers"), T.unmask_citations(F.col("m.masked"), F.col("m.markers")).alias("back"))


@query(rf"select doc_id, round((least(a, b) / greatest(a, b) + 1.0 + 0.9) / 3, 6) confidence from (select doc_id, len({_TOKENS}) a, len(list_filter(regexp_split_to_array(lower(source || ' ' || text), '\s+'), lambda t: t <> '')) b from documents)")
def translation_confidence(spark, sf_dir):
    text = F.lower("text")
    score = T.translation_confidence(text, F.concat_ws(" ", "source", text), F.lit(0.9))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("confidence"))


@query("select doc_id, lang <> 'en' needed from documents")
def translation_needed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.translation_needed(F.col("lang"), F.lit("en_US")).alias("needed"))


@query(f"with {MENTIONS} select doc_id, text, count(*) n from mentions group by all")
def vocab_entities(spark, sf_dir):
    found = extract.vocab_entities(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z0-9]", " ").alias("text")), TOKEN_TYPES)
    return found.groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query(f"with {MENTIONS} select doc_id, text, entity_type, count(*) n from mentions group by all")
def mentions_by_sql(spark, sf_dir):
    """The table function in SQL, over whole texts."""
    extract.register_mentions(spark, TOKEN_TYPES)
    table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z0-9]", " ").alias("body")).createOrReplaceTempView("mention_texts")
    return spark.sql("select d.doc_id, m.text, m.entity_type, count(*) n from mention_texts d, lateral extract_mentions(d.body) m group by all")


@query("select doc_id, ((length(text) - length(replace(text, 'tion', ''))) / 4)::bigint n from documents where contains(text, 'tion')")
def substring_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[A-Z]", "_").alias("text"))
    return extract.substring_entities(docs, ["tion"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {MENTIONS} select * from mentions")
def token_entities(spark, sf_dir):
    return mentions_of(spark, sf_dir).drop("end_pos")


@query(r"select doc_id, count(*) n, min(m) first_text from (select doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+')) m from documents) group by doc_id")
def regex_entities(spark, sf_dir):
    rows = extract.regex_entities(table(spark, sf_dir, "documents"), {"number": [r"[0-9]+\.[0-9]+"]})
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query(f"with {MENTIONS} select doc_id, count(*) n from mentions group by doc_id")
def resolve_overlaps(spark, sf_dir):
    """Mentions doubled by less confident, longer ones: the more confident half stays."""
    m = mentions_of(spark, sf_dir)
    wide = m.withColumn("confidence", F.lit(0.5)).withColumn("entity_type", F.lit("wide"))
    return extract.resolve_overlaps(m.unionByName(wide)).groupBy("doc_id").agg(F.count("*").alias("n"))


#: The default vocabulary and the words of the invented corpus.
RAW_TERMS = {kind: [*extract.VOCABULARY.get(kind, []), *TOKEN_TYPES.get(kind, [])] for kind in extract.VOCABULARY}
_ALNUM = "'[\\p{L}\\p{N}]'"
#: All whole-word occurrences in raw texts, with their places: a text is cut at each term, and the pieces' lengths tell where it was.
RAW = (
    "terms(term, kind) as (values " + ", ".join(f"('{t.lower()}', '{kind}')" for kind, ts in RAW_TERMS.items() for t in ts) + "), "
    "cutup as (select doc_id, text, term, kind, string_split(lower(text), term) p from documents, terms where contains(lower(text), term)), "
    "spots as (select doc_id, text, term, kind, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(term)))::bigint start_pos from cutup), "
    f"raw as materialized (select doc_id, text[start_pos + 1:start_pos + length(term)] text, kind entity_type, start_pos, start_pos + length(term) end_pos from spots where not "
    f"regexp_matches(coalesce(text[start_pos:start_pos], ''), {_ALNUM}) and not regexp_matches(coalesce(text[start_pos + length(term) + 1:start_pos + length(term) + 1], ''), {_ALNUM}))"
)


def raw_mentions(spark, sf_dir):
    return extract.vocab_entities(table(spark, sf_dir, "documents"), RAW_TERMS)


@query(f"with {RAW} select * from raw")
def raw_vocabulary(spark, sf_dir):
    """Every whole-word term of the default vocabulary, with its place, in raw texts."""
    return raw_mentions(spark, sf_dir).drop("confidence")


@query(
    "with cutup as (select doc_id, head, tail, string_split(lower(text), head) p from documents, (values ('tio', 'n'), ('an', 'a'), ('e', 'e')) v(head, tail) where contains(lower(text), head)), "
    "spot as (select doc_id, head || tail term, unnest(list_filter(range(1, len(p)), lambda k: starts_with(p[k + 1] || case when k + 1 < len(p) then head else '' end, tail))) k, list_transform(p, lambda x: length(x)) sizes, length(head) h from cutup), "
    "ends as (select doc_id, term, sizes, h, count(*) n, min(k) low, max(k) high from spot group by all) "
    "select doc_id, term as text, n, list_sum(sizes[1:low])::bigint + (low - 1) * h first_start, list_sum(sizes[1:high])::bigint + (high - 1) * h last_start from ends"
)
def raw_substrings(spark, sf_dir):
    """Terms inside words, overlapping occurrences included, whatever their case."""
    found = extract.substring_entities(table(spark, sf_dir, "documents"), ["tion", "ANA", "ee"])
    return found.groupBy("doc_id", F.lower("text").alias("text")).agg(F.count("*").alias("n"), F.min("start_pos").alias("first_start"), F.max("start_pos").alias("last_start"))


#: In SQL words end at letters other than A-Z: these are taken as one of them.
_PATTERN_ROWS = ", ".join("('" + p.replace("'", "''") + f"', '{kind}')" for kind, ps in {**extract.PATTERNS, "number": [r"\b[0-9]+(?:\.[0-9]+)?\b"]}.items() for p in ps)


@query(
    f"with p(pattern, kind) as (values {_PATTERN_ROWS}) select doc_id, kind entity_type, m as text, count(*) n from (select doc_id, kind, unnest(regexp_extract_all(t, '(?i)' || "
    f"pattern)) m from (select doc_id, regexp_replace(text, '[\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}\\x{{400}}-\\x{{4FF}}\\x{{3040}}-\\x{{9FFF}}]', 'q', 'g') "
    f"t from documents), p) group by all"
)
def raw_patterns(spark, sf_dir):
    """The default patterns and one for numbers in raw texts."""
    found = extract.regex_entities(table(spark, sf_dir, "documents"), {**extract.PATTERNS, "number": [r"\b[0-9]+(?:\.[0-9]+)?\b"]})
    return found.groupBy("doc_id", "entity_type", "text").agg(F.count("*").alias("n"))


_WIDE = (
    f"{RAW}, wide as (select doc_id, text[greatest(start_pos - 7, 1):end_pos + 3 * (start_pos % 3)] text, 'wide' entity_type, greatest(start_pos - 8, 0) start_pos, least(end_pos "
    f"+ 3 * (start_pos % 3), length(text)) end_pos, 0.5 + (start_pos % 5) / 10 confidence from (select raw.* replace (documents.text as text) from raw join documents using (doc_id)))"
)


@query(
    f"with recursive {_WIDE}, every as (select distinct doc_id, text, entity_type, start_pos, end_pos, confidence from (select doc_id, text, entity_type, start_pos, end_pos, 0.8 "
    f"confidence from raw union all select doc_id, text, entity_type, start_pos, end_pos, confidence from wide)), "
    "o as materialized (select *, row_number() over (partition by doc_id order by start_pos, entity_type, end_pos desc, text, confidence) n from every), "
    "sweep as (select doc_id, n, n k, end_pos, confidence, null::bigint done from o where n = 1 union all "
    "select o.doc_id, o.n, case when s.end_pos <= o.start_pos or o.confidence > s.confidence then o.n else s.k end, case when s.end_pos <= o.start_pos or o.confidence > s.confidence "
    "then o.end_pos else s.end_pos end, case when s.end_pos <= o.start_pos or o.confidence > s.confidence then o.confidence else s.confidence end, case when s.end_pos <= o.start_pos "
    "then s.k end from sweep s join o on o.doc_id = s.doc_id and o.n = s.n + 1), "
    "kept as (select doc_id, done n from sweep where done is not null union all select doc_id, arg_max(k, n) from sweep group by doc_id) select doc_id, text, entity_type, start_pos, end_pos, round(confidence, 6) confidence from kept join o using (doc_id, n)"
)
def swept_mentions(spark, sf_dir):
    """The spans that remain of the raw mentions and of wider ones around them, some more and some less confident."""
    docs = table(spark, sf_dir, "documents")
    m = raw_mentions(spark, sf_dir).distinct()
    start, end = F.col("start_pos"), F.col("end_pos")
    low, more = F.greatest(start - 8, F.lit(0)), 3 * (start % 3)
    joined = m.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    wide = joined.select("doc_id", F.substring("body", (low + 1).cast("int"), (end + more - low).cast("int")).alias("text"), F.lit("wide").alias("entity_type"), (0.5 + (start % 5) / 10).alias("confidence"), low.alias("start_pos"), F.least(end + more, F.length("body")).alias("end_pos"))
    return extract.resolve_overlaps(m.unionByName(wide)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"with {RAW} select a.doc_id, a.start_pos a_start_pos, b.start_pos b_start_pos, a.text a_text, b.text b_text, md5(d.text[greatest(a.start_pos - 20, 0) + 1:b.start_pos + length(b.text) "
    f"+ 20]) digest from raw a join raw b on a.doc_id = b.doc_id and b.start_pos > a.start_pos and b.start_pos - a.start_pos <= 150 join documents d on d.doc_id = a.doc_id"
)
def cooccurrence_evidence(spark, sf_dir):
    """The text around each pair of mentions at most 150 characters apart."""
    pairs = extract.cooccurrence(raw_mentions(spark, sf_dir), 150)
    rows = extract.cooccurrence_evidence(pairs, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "a_start_pos", "b_start_pos", "a_text", "b_text", F.md5("evidence").alias("digest"))


_CAPTURED = r"(?i)\b(?:with|from)\b[^\p{L}\p{N}_]+[\p{L}\p{N}_]+[^\p{L}\p{N}_]+(?:this|that|was|are)\b"


@query(
    f"with {RAW}, c as (select doc_id, unnest(regexp_extract_all(text, '{_CAPTURED}')) e from documents), "
    "w as (select doc_id, e, regexp_extract(e, '^([A-Za-z]+)', 1) l, regexp_extract(e, '([A-Za-z]+)$', 1) r from c), "
    "f as (select doc_id, lower(text) low, min(start_pos) start_pos from raw group by all) "
    "select w.doc_id, l as \"left\", r as \"right\", 'near' relation_type, x.start_pos source_pos, y.start_pos target_pos from w join f x on x.doc_id = w.doc_id and x.low = lower(l) "
    "join f y on y.doc_id = w.doc_id and y.low = lower(r) where x.start_pos <> y.start_pos"
)
def pattern_relations(spark, sf_dir):
    """Relations 'x the y' between captured words that are mentions."""
    docs = table(spark, sf_dir, "documents")
    captures = extract.pattern_relations(docs, [(r"\b(with|from)\b\W+\w+\W+\b(this|that|was|are)\b", "near", 0.8)])
    linked = extract.link_mentions(captures, extract.vocab_entities(docs, TOKEN_TYPES))
    return linked.select("doc_id", "left", "right", "relation_type", F.col("source.start_pos").alias("source_pos"), F.col("target.start_pos").alias("target_pos"))


@query(
    f"with {MENTIONS}, placed as materialized (select doc_id, text, start_pos, start_pos // 10 bucket from mentions), "
    "near as materialized (select doc_id, text, start_pos, bucket from placed union all select doc_id, text, start_pos, bucket + 1 from placed) "
    "select a.doc_id, a.text a_text, a.start_pos a_start_pos, b.text b_text, b.start_pos b_start_pos, round(greatest(0.3, 0.7 - (b.start_pos - a.start_pos) / 10 * 0.4), 6) confidence "
    "from near a join placed b on a.doc_id = b.doc_id and b.bucket = a.bucket where b.start_pos > a.start_pos and b.start_pos - a.start_pos <= 10"
)
def cooccurrence(spark, sf_dir):
    rows = extract.cooccurrence(mentions_of(spark, sf_dir), 10)
    return rows.select("doc_id", "a_text", "a_start_pos", "b_text", "b_start_pos", F.round("confidence", 6).alias("confidence"))


@query(
    f"with {MENTIONS}, p as (select a.doc_id from mentions a join mentions b on a.doc_id = b.doc_id and b.start_pos > a.start_pos and b.start_pos - a.start_pos <= 10) select doc_id, "
    f"length(text)::bigint n_chars, coalesce(m.n, 0)::bigint n_mentions, coalesce(p.n, 0)::bigint n_relations from documents left join (select doc_id, count(*) n from mentions "
    f"group by 1) m using (doc_id) left join (select doc_id, count(*) n from p group by 1) p using (doc_id)"
)
def extraction_stats(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    return extract.extraction_stats(table(spark, sf_dir, "documents"), m, extract.cooccurrence(m, 10))


_UNESCAPED = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')"
_PIECES = "array_to_string(list_filter(list_transform(regexp_split_to_array({}, '<!--[^>]*-->|<[^>]*>'), lambda x: regexp_replace({}, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')".replace("{}, '^", _UNESCAPED.format("x") + ", '^")


@query(
    "with p as (select page_id doc_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) t, regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)</body>.*$', '') b from pages), "
    f"x as (select doc_id, {_PIECES.format('t')} t, {_PIECES.format('b')} b from p) select doc_id, concat_ws(chr(10), nullif(t, ''), nullif(b, '')) as text from x"
)
def article_text(spark, sf_dir):
    return files.article_text(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "with o as (select doc_id::varchar path, sha256(text) h from documents where doc_id % 10 <> 3), n as (select doc_id::varchar path, sha256(case when doc_id % 10 = 5 then text "
    "|| '!' else text end) h from documents where doc_id % 10 <> 7) select path, case when o.h is null then 'new' when n.h is null then 'deleted' else 'modified' end change from "
    "o full join n using (path) where o.h is distinct from n.h"
)
def diff_manifest(spark, sf_dir):
    """Yesterday's corpus lacks ids that end in 3; today's lacks those in 7, and those in 5 changed."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    old = changes.manifest(docs.where(d != 3).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))
    new = changes.manifest(docs.where(d != 7).select(F.col("doc_id").cast("string").alias("path"), F.when(d == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")))
    return changes.diff_manifest(old, new)


@query("select doc_id::varchar path, case when doc_id % 10 in (3, 5) then 'v2' else 'v1' end as version from documents where doc_id % 10 <> 7")
def apply_manifest(spark, sf_dir):
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    old = changes.manifest(docs.where(d != 3).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))).withColumn("version", F.lit("v1"))
    new = changes.manifest(docs.where(d != 7).select(F.col("doc_id").cast("string").alias("path"), F.when(d == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")))
    return changes.apply_manifest(old, new, changes.diff_manifest(old, new), "v2").select("path", "version")


_VERSIONS = "v as (select date_trunc('day', ts) created_at, strftime(ts, '%Y-%m-%d') version_id, count(*) file_count, sum(user_id)::bigint size_bytes from events group by all)"


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("created_at"), F.date_format("ts", "yyyy-MM-dd").alias("version_id")).agg(F.count("*").alias("file_count"), F.sum("user_id").alias("size_bytes"))


@query(f"with {_VERSIONS} select version_id, file_count - lag(file_count) over w files, size_bytes - lag(size_bytes) over w as bytes, (epoch(created_at) - epoch(lag(created_at) over w))::bigint as seconds from v window w as (order by created_at, version_id)")
def version_diff(spark, sf_dir):
    return changes.version_diff(_versions(spark, sf_dir))


@query(f"with {_VERSIONS} select version_id from v order by created_at desc, version_id offset 10")
def retained_versions(spark, sf_dir):
    return changes.retain(_versions(spark, sf_dir), 10).select("version_id")


@query(
    "select user_id operation_id, last_status status, round(100.0 * n_ok / n, 6) progress  , seconds as seconds, round(n_ok / n, 6) success_rate from (select user_id, arg_max(event_type, "
    "(ts, event_type)) last_status, count_if(event_type <> 'error') n_ok, count(*) n, (max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000)) as seconds from events group "
    "by 1)"
)
def operation_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    totals = e.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("completed"))
    rows = e.join(totals, "user_id").select(F.col("user_id").alias("operation_id"), "ts", F.col("event_type").alias("status"), (100.0 * F.col("completed") / F.col("total")).alias("progress"), "total", "completed", (F.col("total") - F.col("completed")).alias("failed"))
    return changes.operation_progress(rows)


@query("select event_type operation_type, count(*) n, round(avg(case when user_id % 3 > 0 then 1.0 else 0.0 end), 6) success_rate, round(avg(case when user_id % 3 > 0 then value end), 6) mean_seconds from events group by 1")
def operation_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation_type"), F.when(F.col("user_id") % 3 > 0, "completed").otherwise("failed").alias("status"), F.col("value").alias("seconds"))
    return changes.operation_report(rows)
