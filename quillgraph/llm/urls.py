"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

#: Most rows that a classifier is fitted on: the distinct labelled URLs with the smallest hashes.
TRAINING_ROWS = 20_000
FEATURES = 1 << 16
GRAMS = (3, 4)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host suffix, a slash and the beginning of a path, such as ``example.org/es/``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _pick(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def _id_name(id_col: str) -> str:
    return "id" if id_col.lower() in ("host", "path", "rule", "verdict", "features", "rawprediction", "probability", "prediction", "p_block") else id_col


def match_rules(df: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    """id, host, path, the longest fitting rule and its verdict (null where no rule fits).

    The id keeps its name, unless that is the name of another column of the result: then it is called ``id``.
    """
    name = _id_name(id_col)
    parts = df.select(F.col(f"`{id_col}`").alias(name), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.select(name, "host", "path", _pick(rules, host, path, lambda r: r.pattern).alias("rule"), _pick(rules, host, path, lambda r: r.verdict).alias("verdict"))


def _grams(text: Column, kind: str, n: int) -> Column:
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    places = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.lit(f"{kind}{n}:"), F.substring(marked, i, F.lit(n))))


def with_features(df: DataFrame) -> DataFrame:
    """``host`` and ``path`` as a hashed bag of character n-grams, in ``features``."""
    grams = F.concat(*(_grams(F.col(c), k, n) for c, k in (("host", "h"), ("path", "p")) for n in GRAMS))
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df.withColumn("_grams", grams)).drop("_grams")


def train(labelled: DataFrame, rows: int = TRAINING_ROWS) -> LogisticRegressionModel | None:
    """Fit on (host, path, verdict), at most ``rows`` distinct ones; None unless both verdicts occur.

    The bound makes this a small job whatever the size of the corpus: the sample is taken by hash, so
    it does not depend on the order or the partitioning of the rows.
    """
    urls = labelled.where(F.col("verdict").isin("allow", "block")).select("host", "path", "verdict").distinct()
    sample = materialise(urls.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(rows), "url-labels")
    if sample.select("verdict").distinct().count() < 2:
        return None
    data = with_features(sample).withColumn("label", (F.col("verdict") == "block").cast("double"))
    return LogisticRegression(maxIter=40, regParam=1e-3, standardization=False, threshold=0.5).fit(data)


def judge(df: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule], model: LogisticRegressionModel | None = None, rows: int = TRAINING_ROWS) -> DataFrame:
    """id, host, path, rule, verdict and p_block for every row.

    The verdict is that of the longest fitting rule, else ``block`` where the classifier gives at least
    one half. Without a model, the URLs that rules decide are the labelled table to train from; if they
    hold one verdict only (or none), the rest is allowed. Null and malformed URLs have an empty host and
    path and are judged like any other; repeated rows are judged alike; other columns are left out.
    """
    matched = match_rules(df, id_col, url_col, rules)
    if model is None:
        model = train(matched.where("rule is not null"), rows)
    if model is None:
        return matched.withColumn("p_block", F.lit(0.0)).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    scored = model.transform(with_features(matched))
    p = vector_to_array(F.col("probability"))[1]
    return scored.select(_id_name(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))
