"""Incremental refresh of a graph from a directory: a merge on read with exactly-once batches.

A store holds what each version changed: manifest rows, and the mentions and relations of the documents that the version
processed. A document's newest manifest row tells which version speaks for it, or that it is gone. A version counts once its commit, one row that is written last,
is there: what a lost run wrote before its commit is written over by the next one, and a batch whose source is
committed already is left out. Versions have one writer at a time, as the batches of a stream do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators import extract, graphsets
from quillgraph.runtime import materialise

MANIFEST = "path string, file_hash string, last_modified timestamp, change string"
COMMIT = "source string, version long, added long, updated long, deleted long, failed long, known long"
RELATION = "doc_id string, src string, dst string, edge_type string, confidence double, evidence string"
#: What a version processes: documents (doc_id, text) to mentions and relations, both with doc_id.
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, part long").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, part long")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(source, version, added, updated, deleted, failed, known) of each committed version; none where there is no store."""
    return _read(spark, f"{root}/commits", COMMIT).drop("part")


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest committed row of each path, with its version; deleted paths keep a row. With ``version``, the state as of it."""
    done = commits(spark, root).select(F.col("version").alias("part"))
    if version is not None:
        done = done.where(F.col("part") <= version)
    rows = _read(spark, f"{root}/manifest", MANIFEST).join(done.distinct(), "part", "left_semi")
    newest = rows.groupBy("path").agg(F.max_by(F.struct("file_hash", "last_modified", "change"), "part").alias("m"), F.max("part").alias("version"))
    return newest.select("path", "m.*", "version")


def contributions(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations) of all documents that are there, each from the version that speaks for it."""
    live = manifest(spark, root, version).where("change in ('new', 'modified')").select(F.col("path").alias("doc_id"), F.col("version").alias("part"))
    mentions = _read(spark, f"{root}/mentions", extract.MENTION.replace("doc_id long", "doc_id string"))
    relations = _read(spark, f"{root}/relations", RELATION)
    return tuple(rows.join(live, ["doc_id", "part"], "left_semi").drop("part") for rows in (mentions, relations))


def graph(spark: SparkSession, root: str, version: int | None = None) -> graphsets.Graph:
    """The graph of the store, now or as of a version."""
    return graphsets.build(*contributions(spark, root, version))


def list_files(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """(path, modificationTime, length, content) of a directory's files; contents are read only where they are used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(directory)


def _commit(spark: SparkSession, root: str, source: str, rows: DataFrame, docs: DataFrame | None, extract_from: Extract | None) -> dict | None:
    """Write a version of manifest rows and of what the documents give, then its commit."""
    held = commits(spark, root).agg(F.coalesce(F.max("version"), F.lit(-1)).alias("last"), F.count_if(F.col("source") == source).alias("seen")).first()
    if held["seen"]:
        return None
    version = held["last"] + 1
    rows.select("path", "file_hash", "last_modified", "change").write.mode("overwrite").parquet(f"{root}/manifest/part={version}")
    if docs is not None:
        mentions, relations = extract_from(docs)
        columns = [c.split()[0] for c in extract.MENTION.split(", ")]
        mentions.select(*columns).write.mode("overwrite").parquet(f"{root}/mentions/part={version}")
        relations.select(*(c.split()[0] for c in RELATION.split(", "))).write.mode("overwrite").parquet(f"{root}/relations/part={version}")
    written = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/part={version}")
    of = lambda change: F.count_if(F.col("change") == change)
    counts = written.agg(of("new").alias("added"), of("modified").alias("updated"), of("deleted").alias("deleted"), of("failed").alias("failed"), of("known").alias("known"))
    commit = counts.select(F.lit(source).alias("source"), F.lit(version).cast("long").alias("version"), "*").coalesce(1)
    commit.write.mode("overwrite").parquet(f"{root}/commits/part={version}")
    return spark.read.schema(COMMIT).parquet(f"{root}/commits/part={version}").first().asDict()


def begin(spark: SparkSession, root: str, directory: str, glob: str = "*.txt") -> dict | None:
    """The first version: files that are there already are known, but not processed until they change. Done once."""
    files = list_files(spark, directory, glob)
    rows = files.select("path", F.lit(None).cast("string").alias("file_hash"), F.col("modificationTime").alias("last_modified"), F.lit("known").alias("change"))
    return _commit(spark, root, "begin", rows, None, None)


def _changed(files: DataFrame, was: DataFrame) -> DataFrame:
    """(path, file_hash, last_modified, change, text) of the files that the manifest doesn't know in this form.

    A file whose content is no UTF-8 text is failed: it has a row, but no text. Of rows that repeat a path the newest counts. A file that was
    deleted and is there again is new.
    """
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.col("modificationTime").desc(), "length"))
    now = files.withColumn("n", newest).where("n = 1").select("path", F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("last_modified"), F.col("content").cast("string").alias("body"))
    old = was.select("path", F.col("file_hash").alias("was_hash"), F.col("last_modified").alias("was_time"), F.col("change").alias("was"))
    same = (F.col("last_modified") == F.col("was_time")) & (F.col("was_hash").isNull() | (F.col("was_hash") == F.col("file_hash"))) & (F.col("was") != "deleted")
    good = F.is_valid_utf8("body")
    change = F.when(~good, "failed").when(F.col("was").isNull() | (F.col("was") == "deleted"), "new").otherwise("modified")
    rows = now.join(old, "path", "left").where(~F.coalesce(same, F.lit(False)))
    return rows.select("path", "file_hash", "last_modified", change.alias("change"), F.when(good, F.col("body")).alias("text"))


def merge_files(spark: SparkSession, root: str, source: str, files: DataFrame, gone: DataFrame | None, extract_from: Extract) -> dict | None:
    """The commit of a version that takes over ``files`` as far as they changed, and the manifest rows of those that are ``gone``.

    None if nothing changed or ``source`` is committed already.
    """
    if not commits(spark, root).where(F.col("source") == source).isEmpty():
        return None
    changed = materialise(_changed(files, manifest(spark, root)), "refresh-changed")
    rows = changed.drop("text")
    if gone is not None:
        rows = rows.unionByName(gone)
    if rows.isEmpty():
        return None
    docs = changed.where("change <> 'failed'").select(F.col("path").alias("doc_id"), "text")
    return _commit(spark, root, source, rows, docs, extract_from)


def batch_handler(root: str, extract_from: Extract, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the files of each micro-batch as a version. A batch that is handed over again after its commit changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_files(batch.sparkSession, root, f"{name}:{batch_id}", batch, None, extract_from)

    return handle


def reconcile(spark: SparkSession, root: str, directory: str, extract_from: Extract, run: str, glob: str = "*.txt") -> dict | None:
    """A version of what a listing shows: files that are new, changed since, or gone. A stream of files sees the new ones alone.

    The listing reads no contents. Of the files with another time only those are read that are as new as the oldest of them: the source skips the others
    by their time. ``run`` names the run: repeated with the same name it changes nothing.
    """
    listed = materialise(list_files(spark, directory, glob).select("path", "modificationTime"), "refresh-listing")
    was = materialise(manifest(spark, root), "refresh-manifest")
    live = was.where("change <> 'deleted'")
    gone = live.join(listed, "path", "left_anti").select("path", "file_hash", "last_modified", F.lit("deleted").alias("change"))
    other = listed.join(live.select("path", F.col("last_modified").alias("modificationTime")), ["path", "modificationTime"], "left_anti")
    since = other.agg(F.min("modificationTime")).first()[0]
    files = list_files(spark, directory, glob)
    # all files stand for none here if nothing has another time
    files = files.where(F.col("modificationTime") >= F.lit(since)).join(other.select("path"), "path", "left_semi") if since else files.where("false")
    return merge_files(spark, root, f"reconcile:{run}", files, gone, extract_from)
