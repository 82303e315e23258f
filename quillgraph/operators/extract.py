"""Entity mentions and relations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MENTION = "doc_id long, text string, entity_type string, confidence double, start_pos long, end_pos long"
CAPTURE = "doc_id long, left string, right string, relation_type string, confidence double, evidence string"

#: Default vocabulary by entity type.
VOCABULARY = {
    "metabolite": ["glucose", "lactate", "pyruvate", "acetate", "citrate", "succinate", "alanine", "glycine", "serine", "threonine", "valine", "leucine", "isoleucine", "phenylalanine", "tyrosine", "tryptophan", "histidine", "lysine", "arginine", "creatinine", "urea", "cholesterol", "triglyceride", "fatty acid", "amino acid", "nucleotide", "ATP", "ADP", "AMP", "NADH", "NAD+", "CoA", "acetyl-CoA"],
    "disease": ["diabetes", "obesity", "hypertension", "cancer", "cardiovascular disease", "metabolic syndrome", "insulin resistance", "type 2 diabetes", "coronary heart disease", "stroke", "atherosclerosis", "inflammation"],
    "pathway": ["glycolysis", "gluconeogenesis", "citric acid cycle", "TCA cycle", "fatty acid oxidation", "fatty acid synthesis", "amino acid metabolism", "purine metabolism", "pyrimidine metabolism", "pentose phosphate pathway"],
    "biomarker": ["biomarker", "marker", "indicator", "predictor", "signature", "metabolic signature", "metabolic profile", "metabolic fingerprint"],
    "technique": ["NMR", "mass spectrometry", "LC-MS", "GC-MS", "HPLC", "UPLC", "spectroscopy", "chromatography", "metabolomics", "proteomics", "genomics", "nuclear magnetic resonance"],
    "sample_type": ["plasma", "serum", "urine", "tissue", "saliva", "breath", "blood", "cerebrospinal fluid", "CSF", "feces", "stool"],
    "clinical_condition": ["diagnosis", "prognosis", "treatment", "therapy", "intervention", "clinical trial", "patient", "control", "case", "cohort"],
}
#: Measurement patterns by entity type.
PATTERNS = {
    "measurement": [r"\b\d+\.?\d*\s*(mg/dL|mmol/L|μM|mM|nM|pM|g/L|mg/L|μg/L)\b", r"\b\d+\.?\d*\s*(fold|times|%|percent)\b", r"\bp\s*[<>=]\s*0\.\d+\b", r"\bR²?\s*[=]\s*0\.\d+\b"],
    "statistical": [r"\bp-value\b|\bp\s*[<>=]\s*\d+\.?\d*\b", r"\bconfidence interval\b|\bCI\b", r"\bstandard deviation\b|\bSD\b|\bstd\b", r"\bmean\b|\baverage\b|\bmedian\b", r"\bcorrelation\b|\bassociation\b|\bregression\b"],
    "sample_preparation": [r"\bsample preparation\b|\bsample processing\b", r"\bextraction\b|\bpurification\b|\bcentrifugation\b", r"\bfiltration\b|\bdilution\b|\bdeproteinization\b", r"\bstorage\b|\bfreeze\b|\bthaw\b|\bstability\b"],
}
#: Relation patterns on single words, with their type and confidence.
RELATION_PATTERNS = [
    (r"(\w+)\s+(?:is|are)\s+(?:associated|linked|correlated)\s+with\s+(\w+)", "associated_with", 0.8),
    (r"(\w+)\s+(?:pathway|metabolism)\s+(?:produces|generates|yields)\s+(\w+)", "produces", 0.9),
    (r"(\w+)\s+(?:is|serves as)\s+(?:a|an)?\s*biomarker\s+(?:for|of)\s+(\w+)", "biomarker_for", 0.85),
    (r"(\w+)\s+(?:regulates|controls|modulates)\s+(\w+)", "regulates", 0.75),
    (r"(\w+)\s+(?:causes|leads to|results in)\s+(\w+)", "causes", 0.8),
]


def _scan(docs: DataFrame, make: Callable[[], Callable[[str], Iterable[tuple]]], schema: str, id_col: str, text_col: str) -> DataFrame:
    """Rows that a finder yields for each document, in Arrow batches; ``make`` builds the finder once in every task."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, *hit) for hit in find(text or "")]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def _low(text: str) -> str:
    """Lower case of the same length: a character whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _finder(vocabulary: Mapping[str, Sequence[str]], whole_word: bool) -> Callable[[str], Iterator[tuple[str, str, int, int]]]:
    """(text, kind, start, end) of all occurrences of all terms in one pass over a text, by an automaton of the terms.

    The time of a pass depends on the text and on what is found, not on the number of terms.
    """
    kinds: dict[str, list[str]] = {}
    for kind, terms in vocabulary.items():
        for term in terms:
            if term and kind not in kinds.setdefault(_low(term), []):
                kinds[_low(term)].append(kind)
    if not kinds:
        return lambda text: iter(())
    terms = ahocorasick.Automaton()
    for term, of in kinds.items():
        terms.add_word(term, (len(term), of))
    terms.make_automaton()

    def find(text: str) -> Iterator[tuple[str, str, int, int]]:
        low = _low(text)
        for last, (length, of) in terms.iter(low):
            start, end = last + 1 - length, last + 1
            if not whole_word or not (start and low[start - 1].isalnum() or end < len(low) and low[end].isalnum()):
                for kind in of:
                    yield text[start:end], kind, start, end

    return find


def vocab_entities(docs: DataFrame, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY, whole_word: bool = True, confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every case-insensitive occurrence of every term; with ``whole_word``, not next to a letter or digit.

    Occurrences of different terms may overlap; without ``whole_word`` those of one term may too. A term of two kinds is
    found for both. Null and empty texts hold none.
    """
    words = {kind: list(terms) for kind, terms in vocabulary.items()}

    def make():
        spots = _finder(words, whole_word)
        return lambda text: ((found, kind, confidence, start, end) for found, kind, start, end in spots(text))

    return _scan(docs, make, MENTION, id_col, text_col)


def register_mentions(spark: SparkSession, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY, whole_word: bool = True, name: str = "extract_mentions") -> None:
    """Make ``vocab_entities`` a table function of SQL: ``select ... from docs, lateral extract_mentions(docs.text)``.

    Its rows are (text, entity_type, start_pos, end_pos); batches pass through Arrow.
    """

    class Mentions:
        def __init__(self):
            self.find = _finder(vocabulary, whole_word)

        def eval(self, text: str):
            yield from self.find(text or "")

    spark.udtf.register(name, F.udtf(Mentions, returnType="text string, entity_type string, start_pos long, end_pos long", useArrow=True))


def substring_entities(docs: DataFrame, terms: Sequence[str], confidence: float = 0.6, kind: str = "domain_term", **columns: str) -> DataFrame:
    """Every occurrence of the terms, also inside words."""
    return vocab_entities(docs, {kind: terms}, False, confidence, **columns)


def regex_entities(docs: DataFrame, patterns: Mapping[str, Sequence[str]] = PATTERNS, confidence: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All matches of the patterns, case-insensitive, with their places."""
    compiled = [(kind, re.compile(p, re.IGNORECASE)) for kind, ps in patterns.items() for p in ps]

    def find(text: str):
        for kind, pattern in compiled:
            for m in pattern.finditer(text):
                yield m[0], kind, confidence, m.start(), m.end()

    return _scan(docs, lambda: find, MENTION, id_col, text_col)


#: Largest table of terms that is broadcast; beyond it the join shuffles.
BROADCAST_TERMS = 200_000


def token_mentions(docs: DataFrame, terms: DataFrame, confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lower-case tokens that are in ``terms`` (token, entity_type), a table of any size; places count tokens. Built from joins only.

    A token of several types is found for each; null and empty texts hold none.
    """
    few = terms.count() <= BROADCAST_TERMS
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.lower(text_col), r"[^a-z0-9]+")).alias("pos", "token"))
    found = split.join(F.broadcast(terms) if few else terms, "token")
    return found.select("doc_id", F.col("token").alias("text"), "entity_type", F.lit(confidence).alias("confidence"), F.col("pos").cast("long").alias("start_pos"), (F.col("pos") + 1).cast("long").alias("end_pos"))


def token_entities(docs: DataFrame, token_types: Mapping[str, Sequence[str]], confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``token_mentions`` of lists by type."""
    rows = [(t.lower(), kind) for kind, ts in token_types.items() for t in ts]
    return token_mentions(docs, docs.sparkSession.createDataFrame(rows, "token string, entity_type string"), confidence, id_col, text_col)


def resolve_overlaps(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left to right, an overlapping mention replaces the kept one only if it is strictly more confident.

    A sweep over the mentions of each document in order of place (ties by type, the longer first, text, confidence) that holds only the one kept last,
    so the work is linear and a document of any size is streamed. Mentions without a place, an end or a confidence are left out; repeated ones count once. No rows give no rows.
    """
    columns = [key, "text", "entity_type", "confidence", "start_pos", "end_pos"]
    rows = mentions.select(*columns).where("start_pos is not null and end_pos is not null and confidence is not null")
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = names = types = None
        for batch in batches:
            names, types, out = batch.schema.names, batch.schema.types, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept is None or row[0] != kept[0] or kept[5] <= row[4]:
                    if kept is not None:
                        out.append(kept)
                    kept = row
                elif row[3] > kept[3]:
                    kept = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(kept, types, strict=True)], names=names)

    dealt = rows.repartition(key).sortWithinPartitions(key, "start_pos", "entity_type", F.col("end_pos").desc(), "text", "confidence")
    return dealt.mapInArrow(run, schema)


def pattern_relations(docs: DataFrame, patterns: Sequence[tuple[str, str, float]] = RELATION_PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, left, right, relation_type, confidence, evidence) for each match of a two-group pattern."""
    compiled = [(re.compile(p, re.IGNORECASE), kind, c) for p, kind, c in patterns]

    def find(text: str):
        for pattern, kind, confidence in compiled:
            for m in pattern.finditer(text):
                yield m[1], m[2], kind, confidence, m[0]

    return _scan(docs, lambda: find, CAPTURE, id_col, text_col)


def link_mentions(captures: DataFrame, mentions: DataFrame, mode: str = "exact") -> DataFrame:
    """Captures whose both sides are mentions of their document: adds source and target (start_pos, text, entity_type).

    ``exact``: equal lower-case text, the first such mention. ``best``: else a mention that contains the capture,
    else one that the capture contains, the first within a tier. Source and target differ. Texts are compared once for each document: of
    equal mentions only the first counts, so a frequent term is one row of its document.
    """
    rows = captures.withColumn("_id", F.xxhash64("doc_id", F.lower("left"), F.lower("right"), "relation_type", "evidence"))
    places = mentions.groupBy("doc_id", F.lower("text").alias("_low")).agg(F.min(F.struct("start_pos", "text", "entity_type")).alias("_m"))

    def side(col: str, name: str) -> DataFrame:
        wanted = rows.select("_id", "doc_id", F.lower(col).alias("_want")).distinct()
        if mode == "exact":
            joined = wanted.join(places.withColumnRenamed("_low", "_want"), ["doc_id", "_want"]).withColumn("_tier", F.lit(0))
        else:
            tier = F.when(F.col("_low") == F.col("_want"), 0).when(F.contains("_low", F.col("_want")), 1).when(F.contains("_want", F.col("_low")), 2)
            joined = wanted.join(places, "doc_id").withColumn("_tier", tier).where("_tier is not null")
        return joined.groupBy("_id").agg(F.min(F.struct("_tier", "_m")).alias("_b")).select("_id", F.col("_b._m").alias(name))

    both = rows.join(side("left", "source"), "_id").join(side("right", "target"), "_id")
    return both.where(F.col("source") != F.col("target")).drop("_id")


def cooccurrence(mentions: DataFrame, window: int = 150, decay: bool = True) -> DataFrame:
    """Pairs of mentions of a document at most ``window`` apart, by a bucketed range join.

    Confidence falls from 0.7 with distance, to 0.3 at least (constant 0.5 without ``decay``).
    """
    rows = mentions.select("doc_id", "start_pos", "text", "entity_type", F.floor(F.col("start_pos") / window).alias("b"))
    a = rows.select("doc_id", *(F.col(c).alias(f"a_{c}") for c in ("start_pos", "text", "entity_type")), F.explode(F.array("b", F.col("b") + 1)).alias("b"))
    b = rows.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in ("start_pos", "text", "entity_type")), "b")
    near = a.join(b, ["doc_id", "b"]).where((F.col("a_start_pos") < F.col("b_start_pos")) & (F.col("b_start_pos") - F.col("a_start_pos") <= window))
    distance = F.col("b_start_pos") - F.col("a_start_pos")
    score = F.greatest(F.lit(0.3), 0.7 - distance / window * 0.4) if decay else F.lit(0.5)
    return near.select("doc_id", "a_text", "a_entity_type", "a_start_pos", "b_text", "b_entity_type", "b_start_pos", score.alias("confidence"))


def cooccurrence_evidence(pairs: DataFrame, docs: DataFrame, before: int = 20, after: int = 20, window: int = 150, chunk: int = 4096, longest: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pairs`` of ``cooccurrence`` with ``evidence``: the text from ``before`` characters ahead of the first mention to ``after`` behind the second.

    Pairs meet pieces of their document's text, not whole texts: the piece that holds the first mention, with a margin for ``window`` and a
    second mention of up to ``longest`` characters. Pairs of documents that are not there, or have no text, have none.
    """
    margin = before + window + longest + after
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text_col) - 1, F.lit(0)) / chunk).cast("int"))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.explode(numbers).alias("_chunk"))
    low = F.greatest(F.col("_chunk") * chunk - before, F.lit(0))
    pieces = cut.select("doc_id", "_chunk", low.alias("_low"), F.substring("_text", low + 1, F.lit(chunk + before + margin)).alias("_piece"))
    first = F.greatest(F.col("a_start_pos") - before, F.lit(0))
    last = F.col("b_start_pos") + F.length("b_text") + after
    rows = pairs.withColumn("_chunk", F.floor(F.col("a_start_pos") / chunk).cast("int")).join(pieces, ["doc_id", "_chunk"], "left")
    evidence = F.substring("_piece", (first - F.col("_low") + 1).cast("int"), (last - first).cast("int"))
    return rows.withColumn("evidence", evidence).drop("_chunk", "_low", "_piece")


def extraction_stats(docs: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Per document: text length, mentions, relations."""
    m = mentions.groupBy("doc_id").agg(F.count("*").alias("n_mentions"))
    r = relations.groupBy("doc_id").agg(F.count("*").alias("n_relations"))
    out = docs.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(m, "doc_id", "left").join(r, "doc_id", "left")
    return out.fillna(0, ["n_mentions", "n_relations"])
