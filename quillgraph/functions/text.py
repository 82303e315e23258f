"""Column functions on text: cleaning, counting, scoring helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "... [TRUNCATED]"
#: Words that carry no meaning in a question.
STOP_WORDS = ["what", "is", "are", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "about", "how", "why", "when", "where", "which", "who", "whom", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "can", "could", "should", "would", "will", "shall", "may", "might", "must", "do", "does", "did", "have", "has", "had", "be", "been", "being", "am", "was", "were"]
#: Words of a question about current events.
TEMPORAL_WORDS = ["recent", "latest", "current", "new", "today", "now", "2024", "2023", "this year", "last year", "trending"]
#: Words in the name of a scientific source, of a journal, and of an academic citation.
SCIENCE_WORDS = ["clinical", "metabolomics", "biomarker", "research"]
JOURNAL_WORDS = ["journal", "nature", "science", "cell", "plos"]
ACADEMIC_WORDS = ["journal", "research", "study", "clinical", "metabolomics"]
#: Factor of a node's relevance by its type.
TYPE_BOOST = {"metabolite": 1.2, "disease": 1.1, "pathway": 1.15, "biomarker": 1.25, "clinical_condition": 1.1, "measurement": 1.05}


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether ``text`` contains any of ``words``."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def clean_text(text: Column, ascii_only: bool = True, max_chars: int = 1_000_000) -> Column:
    """White space to single spaces, non-ASCII dropped (optional), trimmed, cut with a marker; null gives ''."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    if ascii_only:
        out = F.regexp_replace(out, r"[^\x00-\x7F]+", "")
    out = F.trim(out)
    return F.when(F.length(out) > max_chars, F.concat(F.substring(out, 1, max_chars), F.lit(TRUNCATED))).otherwise(out)


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+)"), 1)


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def coalesce_extractions(*candidates: Column) -> Column:
    """The first of several extraction results that is not blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))


def sentences(text: Column, min_len: int = 20) -> Column:
    """Sentences longer than ``min_len`` characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > min_len)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")


#: The last year of a stem that stands alone; a longer number is no year.
_LAST_YEAR = r"^(?:.*[^0-9])?((?:19|20)[0-9]{2})(?![0-9])"


def filename_title(path: Column) -> Column:
    """Title from a file's stem: the year of publication removed, separators to spaces, capitalised, cut at 100 characters."""
    bare = F.regexp_replace(_stem(path), r"^((?:.*[^0-9])?)(?:19|20)[0-9]{2}(?![0-9])", "$1")
    return F.substring(F.initcap(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[_\-]+", " "), r" +", " "))), 1, 100)


def year_of(path: Column) -> Column:
    """The first year from 1900 to 2099 in a path, else null."""
    found = F.regexp_extract(path, r"((?:19|20)[0-9]{2})", 1)
    return F.when(found != "", found.cast("int"))


def publication_year(path: Column) -> Column:
    """The last year from 1900 to 2099 that stands alone in a file's stem, where numbers come before years; else that of ``year_of``."""
    found = F.regexp_extract(_stem(path), _LAST_YEAR, 1)
    return F.when(found != "", found.cast("int")).otherwise(year_of(path))


def text_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of lower-case token sets; two empty sets are equal, one empty set has nothing in common."""
    x, y = (F.array_distinct(tokens(F.lower(c))) for c in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(both, F.lit(1)))


def query_terms(text: Column) -> Column:
    """Words longer than two characters that are not stop words; repeated words stay."""
    return F.filter(words(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))


def node_weight(node_type: Column, confidence: Column) -> Column:
    """What a node's type and confidence make of its share of terms."""
    boost = F.lit(1.0)
    for name, factor in TYPE_BOOST.items():
        boost = F.when(F.lower(node_type) == name, factor).otherwise(boost)
    return boost * (0.8 + confidence * 0.2)


def node_body(text: Column, context: Column) -> Column:
    """The text in which terms are looked for."""
    return F.lower(F.concat_ws(" ", text, context))


def node_relevance(terms: Column, text: Column, context: Column, node_type: Column, confidence: Column) -> Column:
    """Share of terms that occur in the node's text, boosted by type and confidence, at most 1; without terms 0."""
    body = node_body(text, context)
    hits = F.size(F.filter(terms, lambda t: F.contains(body, t)))
    share = F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0)
    return F.least(share * node_weight(node_type, confidence), F.lit(1.0))


def question_type(text: Column) -> Column:
    """definition, mechanism, causal or general, by the phrases a question contains, in that order."""
    q = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(any_of(q, ["what is", "define", "definition"]), "definition")
        .when(any_of(q, ["how does", "how do", "mechanism"]), "mechanism")
        .when(any_of(q, ["why", "reason", "cause"]), "causal")
        .otherwise("general")
    )


def classify_query(text: Column) -> Column:
    """real_time where a temporal word occurs, else knowledge_base."""
    return F.when(any_of(F.lower(F.coalesce(text, F.lit(""))), TEMPORAL_WORDS), "real_time").otherwise("knowledge_base")


def mask_citations(text: Column) -> Column:
    """(masked, markers): each ``[n]``, ``[n, m]`` or ``[n-m]`` becomes ``__CITATION_i__``."""
    pattern = r"\[[0-9]+(?:(?:, *|-)[0-9]+)*\]"
    markers = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, k: F.concat(F.lit("__CITATION_"), k.cast("string"), F.lit("__"), p))
    return F.struct(F.concat(parts[0], F.array_join(tail, "")).alias("masked"), markers.alias("markers"))


def unmask_citations(masked: Column, markers: Column) -> Column:
    """Put the markers back."""
    numbered = F.transform(markers, lambda m, k: F.struct(k.alias("k"), m.alias("m")))
    return F.aggregate(numbered, masked, lambda a, x: F.replace(a, F.concat(F.lit("__CITATION_"), x["k"].cast("string"), F.lit("__")), x["m"]))


def translation_confidence(original: Column, translated: Column, base: Column) -> Column:
    """Mean of the word-length ratio, the share of citation markers kept and the base confidence, at most 1."""
    a, b = F.size(tokens(original)), F.size(tokens(translated))
    length = F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b, F.lit(1))).otherwise(0.0)
    m, n = (F.regexp_count(c, F.lit(r"\[[0-9]+\]")) for c in (original, translated))
    kept = F.when(m == 0, 1.0).otherwise(F.least(n / F.greatest(m, F.lit(1)), F.lit(1.0)))
    return F.least((length + kept + base) / 3, F.lit(1.0))


def translation_needed(source: Column, target: Column) -> Column:
    """Whether the normalised language codes differ; false where either is empty."""

    def norm(c: Column) -> Column:
        low = F.lower(F.replace(c, F.lit("_"), F.lit("-")))
        return F.when(low.isin("zh-cn", "zh-tw"), "zh").when(low.isin("en-us", "en-gb"), "en").otherwise(low)

    empty = F.coalesce(source, F.lit("")).isin("") | F.coalesce(target, F.lit("")).isin("")
    return F.when(empty, False).otherwise(norm(source) != norm(target))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").when(score >= 0.4, "Low").otherwise("Very Low")


def clean_response(text: Column) -> Column:
    """Collapse white space, drop confidence annotations, one space before and between markers."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    out = F.regexp_replace(out, r"(?i)\(\s*confidence\s*score:\s*[0-9.]+\s*\)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+\[", " ["), r"\]\s*\[", "] [")
    return F.trim(out)


def response_quality(content: Column, confidence: Column, n_citations: Column, source: Column, low: int = 50, high: int = 2000) -> Column:
    """0.25 length + 0.35 confidence + 0.25 citations + 0.05 source + 0.10 coherence, at most 1."""
    n = F.length(F.trim(content))
    length = F.when(n < low, n / low * 0.5).when(n > high, 0.8).otherwise(F.greatest(F.lit(0.5), 1.0 - F.abs(n - 400) / 400))
    cited = F.when(n_citations == 0, 0.0).when(n_citations <= 3, n_citations / 3.0 * 0.8).otherwise(0.8)
    bonus = F.when(source == "kb", 0.1).when(source == "web", 0.05).otherwise(0.0)
    parts = F.filter(F.transform(F.split(content, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    mean = F.aggregate(parts, F.lit(0), lambda a, s: a + F.size(tokens(s))) / F.greatest(F.size(parts), F.lit(1))
    coherent = F.when(F.size(F.split(content, r"\.")) <= 1, 0.0).when(mean.between(10, 25), 0.2).otherwise(0.1)
    return F.least(length * 0.25 + confidence * 0.35 + cited * 0.25 + bonus * 0.05 + coherent * 0.10, F.lit(1.0))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def node_id(node_type: Column, text: Column) -> Column:
    """First 16 hex digits of the md5 of ``type:lower(trim(text))``."""
    return F.substring(F.md5(F.concat_ws(":", node_type, F.lower(F.trim(text)))), 1, 16)


def edge_id(source: Column, target: Column, edge_type: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", source, target, edge_type)), 1, 16)


def metadata_quality(path: Column) -> Column:
    """0.5, more for a domain word, a year, an ``a_b`` name and a journal word in the file's stem, at most 1."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", ""))
    score = (
        F.lit(0.5)
        + F.when(any_of(stem, SCIENCE_WORDS), 0.1).otherwise(0.0)
        + F.when(stem.rlike("(19|20)[0-9]{2}"), 0.1).otherwise(0.0)
        + F.when(stem.rlike("[a-z]+_[a-z]+"), 0.1).otherwise(0.0)
        + F.when(any_of(stem, JOURNAL_WORDS), 0.2).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def citation_quality(path: Column, located: Column) -> Column:
    """0.5, more for a PDF, an academic name and a known location, at most 1."""
    low = F.lower(path)
    score = F.lit(0.5) + F.when(low.endswith(".pdf"), 0.2).otherwise(0.0)
    score = score + F.when(any_of(low, ACADEMIC_WORDS), 0.2).otherwise(0.0)
    return F.least(score + F.when(located, 0.1).otherwise(0.0), F.lit(1.0))


def temporal_relevance(path: Column, as_of_year: int, year: Column | None = None) -> Column:
    """Recency by the ``year`` (without one, the first in the path)."""
    age = F.lit(as_of_year) - (year_of(path) if year is None else year)
    return F.when(age.isNull(), 0.6).when(age <= 2, 1.0).when(age <= 5, 0.8).when(age <= 10, 0.6).otherwise(0.4)


def percentile_nearest(values: Column, q: float) -> Column:
    """``sorted[min(int(q n), n - 1)]`` of an array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), F.least(F.floor(q * n) + 1, n).cast("int"))
