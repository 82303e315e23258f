"""Personal data: patterns, and information-theoretic sanitisation of the words that give them away.

Patterns find the protected entities. How much a term of the same text tells about an entity is estimated from the corpus: the pointwise
mutual information of term and entity over distinct texts, as a share of the information that the entity itself carries.
Above one threshold a term is generalised to a placeholder, above a higher one it is removed, wherever a text that holds an entity has it.
An entity of a single text is given away by the words that are rare in the corpus. Everything is built from
column expressions, joins and aggregations; whole texts are never shuffled unless they have more copies than a broadcast holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds.
GENERALISED, REMOVED = "term", "removed"
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE_AT, REMOVE_AT = 0.5, 0.8
#: Distinct texts in which term and entity must occur together before the estimate counts. With 1 the entities of a single
#: text count too, and every word of that text that is rare enough in the corpus gives them away.
SUPPORT = 2
#: Settings that protect the entities of single texts without blanking most of these: of N texts a term is generalised that at
#: most N ** 0.2 of them hold, and removed if at most N ** 0.05 do.
SINGLE_TEXTS = {"support": 1, "generalise_at": 0.8, "remove_at": 0.95}
#: Largest list of terms, or of texts with copies, that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Parts of a text's marks: a lookup reads one part from its start.
MARK_PARTS = 64
#: Matches whose places are added up at once.
PLACED = 512

# The patterns. Beginnings are fixed by what precedes, so that long runs are read once; \G lets a match
# begin where the one before it ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"[\p{L}][\p{L}\p{N}]{2,}"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(F.split(digits, ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _placed(matches: Column) -> Column:
    """Spans of (gap, size, kind, value) of all matches in order; those without a kind only move the others.

    Matches are added up in groups, so that the work grows with their number.
    """
    none, groups = F.array().cast(SPAN), F.array().cast(f"array<{SPAN}>")

    def add(a: Column, m: Column) -> Column:
        start, end = a["at"] + m["gap"], a["at"] + m["gap"] + m["size"]
        span = F.struct(m["kind"].alias("kind"), start.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(m["kind"].isNotNull(), F.array_append(a["spans"], span).cast(SPAN)).otherwise(a["spans"]).alias("spans"))

    def join(a: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct(s["kind"].alias("kind"), (a["at"] + s["start"]).alias("start"), (a["at"] + s["end"]).alias("end"), s["value"].alias("value")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.array_append(a["parts"], moved.cast(SPAN)).cast(f"array<{SPAN}>").alias("parts"))

    local = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / PLACED).cast("int")),
        lambda k: F.aggregate(F.slice(matches, k * PLACED + 1, F.lit(PLACED)), F.struct(F.lit(0).alias("at"), none.alias("spans")), add),
    )
    whole = F.aggregate(local, F.struct(F.lit(0).alias("at"), groups.alias("parts")), join, lambda a: F.flatten(a["parts"]))
    return F.when(F.size(matches) > 0, whole).otherwise(none)


def _matches(text: Column, pattern: str, kind, value) -> Column:
    """(gap, size, kind, value) of each match: what lies between them is split off, and lengths are code points."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), kind(m).alias("kind"), value(m).alias("value")))


def _located(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches."""
    return _placed(_matches(text, pattern, lambda m: F.lit(kind), lambda m: m))


def base_spans(text: Column) -> Column:
    """Emails, IP addresses, cards and phones of a whole text, by kind and start; null text has none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    digit = text.rlike("[0-9]")
    parts = {
        "email": F.when(F.contains(text, F.lit("@")), _located(text, _EMAIL, "email")),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_located(text, _IP, "ip"), lambda s: s["value"].rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"))),
        "card": F.when(digit, F.filter(_located(text, _CARD, "card"), lambda s: _luhn(s["value"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_located(text, _PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(8, 15))),
    }
    return F.concat(*(F.coalesce(parts[k], none) for k in KINDS))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(_digits(span["value"])))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that other places stay as they are."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], a["at"]), F.lit(0)))).alias("out"),
    )
    done = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done)


def _terms(text: Column) -> Column:
    """The distinct terms of a whole text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), lambda t: F.lower(t)))


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(MARK_PARTS)).cast("int")


def _kind(marks: Column, term: Column) -> Column:
    return F.try_element_at(F.get(marks, _part(term)), term)


def _marked(text: Column, marks: Column) -> Column:
    """Spans of all occurrences in a whole text of the terms that ``marks`` gives a kind."""
    return _placed(_matches(text, _TERM, lambda m: _kind(marks, F.lower(m)), lambda m: F.lower(m)))


def _key(text: Column) -> Column:
    """What tells texts apart: 128 bits of their content; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def _held(docs: DataFrame) -> DataFrame:
    """(hash, entities, terms) of each distinct text that holds an entity; its terms lie outside its entities."""
    some = docs.where(F.col("text").rlike("[@0-9]")).withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0).dropDuplicates(["hash"])
    return some.select("hash", F.array_distinct(F.transform("base", _entity)).alias("entities"), _terms(_blanked(F.col("text"), F.col("base"))).alias("terms"))


def _contexts(docs: DataFrame) -> DataFrame:
    """(hash, entity, term) for each entity and each term of the same whole text outside its entities; null is the term of a text without any."""
    return _held(docs).select("hash", F.explode("entities").alias("entity"), "terms").select("hash", "entity", F.explode_outer("terms").alias("term"))


def _spread(docs: DataFrame) -> tuple[DataFrame, int]:
    """(term, n_t) over distinct texts, and the number of these.

    A text of c copies counts 1 / c for each of them, so only the keys of texts are shuffled, not texts or their terms:
    terms are added up before the shuffle.
    """
    texts = docs.where("text is not null").select("hash", "text")
    copies = materialise(texts.groupBy("hash").agg(F.count("*").alias("copies")), "privacy-texts")
    several = copies.where("copies > 1")
    few = several.count() <= BROADCAST_ROWS
    weighed = texts.join(F.broadcast(several) if few else several, "hash", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    words = weighed.select("share", F.explode(_terms(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.round(F.sum("share")).alias("n_t")), copies.count()


def _share(total: int) -> Column:
    """What a term discloses of an entity, of n_e, n_t and n_et."""
    information = F.log2(F.lit(float(total)) / F.col("n_e"))
    mutual = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    return F.when(information > 0, mutual / information).otherwise(0.0)


def _together(pairs: DataFrame, support: int) -> DataFrame:
    """(entity, term, n_et) of (hash, entity, term) with at least ``support`` texts."""
    return pairs.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)


def disclosures(docs: DataFrame, contexts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, share): the share of an entity's information that a term of the same texts discloses.

    ``share = PMI(entity; term) / IC(entity)`` with ``PMI = log2(N n_et / (n_e n_t))`` and ``IC = log2(N / n_e)``, where N
    counts distinct texts, n_e those that hold the entity, n_t those that hold the term anywhere and n_et those that
    hold both. Copies of a text count once. Pairs seen together in fewer than ``support`` texts are no evidence.
    """
    holds = contexts.select("entity", "hash").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    spread, total = _spread(docs)
    return _together(contexts, support).join(holds, "entity").join(spread, "term").select("entity", "term", _share(total).alias("share"))


def _told(docs: DataFrame, held: DataFrame, support: int) -> DataFrame:
    """(term, share): the largest share of any entity's information that a term discloses.

    All entities of a single text have n_e = n_et = 1 with each of its terms: their pairs need not be formed.
    """
    entities = held.select("hash", F.explode("entities").alias("entity"))
    holds = materialise(entities.groupBy("entity").agg(F.count("*").alias("n_e"), F.max("hash").alias("hash")), "privacy-entities")
    repeated = entities.join(holds.where("n_e > 1").select("entity", "n_e"), "entity")
    terms = held.select("hash", F.explode("terms").alias("term"))
    pairs = _together(repeated.select("hash", "entity").join(terms, "hash"), support).join(holds.select("entity", "n_e"), "entity").select("term", "n_e", "n_et")
    if support <= 1:
        alone = terms.join(holds.where("n_e = 1").select("hash").distinct(), "hash", "left_semi").select("term").distinct()
        one = F.lit(1).cast("long")
        pairs = pairs.unionByName(alone.select("term", one.alias("n_e"), one.alias("n_et")))
    spread, total = _spread(docs)
    return pairs.distinct().join(spread, "term").groupBy("term").agg(F.max(_share(total)).alias("share"))


def _marks_of(docs: DataFrame, generalise_at: float, remove_at: float, support: int) -> DataFrame:
    """(hash, marks): the disclosing terms of each distinct text that has an entity, with their kinds; whatever entity they disclose.

    ``marks`` is an array of maps from term to kind, by a hash of the term.
    """
    held = materialise(_held(docs), "privacy-held")
    told = _told(docs, held, support).where(F.col("share") >= generalise_at)
    told = materialise(told.select("term", F.when(F.col("share") >= remove_at, REMOVED).otherwise(GENERALISED).alias("kind")), "privacy-terms")
    few = told.count() <= BROADCAST_ROWS
    # a text has no more of these than terms
    terms = held.select("hash", F.explode("terms").alias("term"))
    found = terms.join(F.broadcast(told) if few else told, "term").groupBy("hash", _part(F.col("term")).alias("part"))
    parts = found.agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("kinds"))
    parts = parts.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("part", "kinds"))).alias("parts"))
    return parts.select("hash", F.transform(F.sequence(F.lit(0), F.lit(MARK_PARTS - 1)), lambda n: F.try_element_at(F.col("parts"), n)).alias("marks"))


def _shown(kind: Column) -> Column:
    return F.when(kind == REMOVED, "").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def _hidden(text: Column, marks: Column) -> Column:
    """The text with each marked term replaced; what lies between the terms and the terms are joined again, in one pass."""
    between, found = F.split(text, _TERM, -1), F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    pieces = F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(_shown(_kind(marks, F.lower(m))), m, F.lit(""))))
    return F.when(marks.isNull(), text).otherwise(F.array_join(pieces, ""))


def _rewrite(text: Column, base: Column, marks: Column) -> Column:
    """The text with its pattern spans and, between them, its marked terms replaced; overlapping spans are replaced once, by the first of them."""
    order = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    longer = lambda a, s: F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["kind"].alias("kind"))
    step = lambda a, s: F.when((F.size(a) > 0) & (s["start"] < last(a)["end"]), F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), longer(a, s))).otherwise(F.array_append(a, s))
    spans = F.aggregate(order, F.array().cast("array<struct<start:int,end:int,kind:string>>"), step)

    def piece(k: Column) -> Column:
        low = F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
        high = F.coalesce(F.get(spans, k)["start"], F.length(text))
        return F.concat(_hidden(F.substring(text, low + 1, high - low), marks), F.coalesce(_shown(F.get(spans, k)["kind"]), F.lit("")))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), "")


def _judged(df: DataFrame, text_col: str, generalise_at: float, remove_at: float, support: int) -> DataFrame:
    """(row, base, added, clean); ``row`` has the columns of ``df``."""
    text = F.col("row").getField(text_col)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    marks = _marks_of(rows.select(text.alias("text"), _key(text).alias("hash")), generalise_at, remove_at, support)
    none = F.array().cast(SPAN)
    spotted = rows.withColumn("base", base_spans(text))
    # texts without an entity stay as they are: they are not shuffled
    some = spotted.where(F.size("base") > 0).withColumn("hash", _key(text)).join(marks, "hash", "left")
    added = F.when(F.col("marks").isNotNull(), _marked(_blanked(text, F.col("base")), F.col("marks"))).otherwise(none)
    some = some.select("row", "base", added.alias("added"), _rewrite(text, F.col("base"), F.col("marks")).alias("clean"))
    return spotted.where(F.size("base") == 0).select("row", "base", none.alias("added"), text.alias("clean")).unionByName(some)


def sanitise(df: DataFrame, text_col: str = "text", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, support: int = SUPPORT) -> DataFrame:
    """All rows and columns of ``df`` with ``base`` (pattern spans), ``added`` (term spans) and ``clean`` (the new text).

    Every occurrence of a disclosing term in a text that holds an entity is a span; texts without entities stay as they are.
    Spans are (kind, start, end, value) in code points, the end exclusive. ``clean`` is null where the text is null.
    Rows with equal texts are treated alike. Columns of ``df`` that are already called base, added or clean give way
    to these; all other names are free. No rows give no rows.
    """
    kept = [c for c in df.columns if c.lower() not in ("base", "added", "clean")]
    found = _judged(df, text_col, generalise_at, remove_at, support)
    return found.select(*(F.col("row").getField(c).alias(c) for c in kept), "base", "added", "clean")


def rewrite(df: DataFrame, text_col: str = "text", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, support: int = SUPPORT) -> DataFrame:
    """``df`` with its texts rewritten as in ``sanitise``; all other columns, whatever their names, stay as they are."""
    found = _judged(df, text_col, generalise_at, remove_at, support)
    return found.select(*((F.col("clean") if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns))


def count_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
