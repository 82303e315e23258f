"""Manifests, versions and operation progress."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.sources import files


def manifest(files: DataFrame, path_col: str = "path", content_col: str = "content", mtime_col: str | None = None) -> DataFrame:
    """path, SHA-256 of the content, modification time."""
    mtime = F.col(mtime_col) if mtime_col else F.lit(None).cast("timestamp")
    return files.select(F.col(path_col).alias("path"), F.sha2(F.col(content_col), 256).alias("file_hash"), mtime.alias("last_modified"))


def diff_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) with change one of new, modified, deleted; unchanged files are absent."""
    a = old.select("path", F.struct("file_hash", "last_modified").alias("was"))
    b = new.select("path", F.struct("file_hash", "last_modified").alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def apply_manifest(old: DataFrame, new: DataFrame, diff: DataFrame, version: str) -> DataFrame:
    """The manifest after the changes: deleted paths go, changed ones carry the new version."""
    kept = old.join(diff.select("path"), "path", "left_anti")
    changed = new.join(diff.where("change <> 'deleted'").select("path"), "path", "left_semi").withColumn("version", F.lit(version))
    return kept.unionByName(changed, allowMissingColumns=True)


def snapshot(df: DataFrame, root: str, version: str) -> dict:
    """Write one version and return its ``version_id``, ``file_count`` and ``size_bytes``; a version that is there is replaced."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return version_files(df.sparkSession, root, version)


def version_files(spark: SparkSession, root: str, version: str) -> dict:
    """Data files of a version and their size, as Spark's readers see them; files without rows don't count."""
    files = spark.read.parquet(f"{root}/version={version}").select("_metadata.file_path", "_metadata.file_size").distinct()
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size")).first()
    return {"version_id": version, "file_count": found["n"], "size_bytes": found["size"]}


def restore(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The rows of one version; a version that is not there stops the job."""
    return spark.read.parquet(f"{root}/version={version}")


def rollback(current: DataFrame, root: str, version: str, safety: str | None = None) -> tuple[DataFrame, dict]:
    """An earlier version, after the current rows have been kept as a version of their own.

    Returns the rows of ``version`` and what ``snapshot`` says of the safety copy, called ``safety`` or else by a new name. If
    ``version`` is not there, nothing is written.
    """
    earlier = restore(current.sparkSession, root, version)
    name = safety or f"before-{version}-{uuid.uuid4().hex[:8]}"
    if name == version:
        raise ValueError("the safety copy would replace the version that is wanted")
    return earlier, snapshot(current, root, name)


def drop_versions(spark: SparkSession, root: str, versions: DataFrame, most: int = 50) -> int:
    """Delete the files of the versions past the newest ``most``; returns how many went. What is kept is neither read nor written."""
    old = [r["version_id"] for r in retain(versions, most).select("version_id").toLocalIterator()]  # names of versions that are to go
    return sum(files.drop_stored(spark, root, "version", name) for name in old)


def list_versions(versions: DataFrame, limit: int = 20) -> DataFrame:
    """The newest versions first, ties by name; a version without a time comes last."""
    return versions.orderBy(F.col("created_at").desc_nulls_last(), "version_id").limit(limit)


def retain(versions: DataFrame, most: int = 50) -> DataFrame:
    """Versions past the newest ``most``, which are to be dropped; a version table has one row for each version."""
    w = Window.orderBy(F.col("created_at").desc(), "version_id")
    return versions.withColumn("n", F.row_number().over(w)).where(F.col("n") > most).drop("n")


def version_diff(versions: DataFrame) -> DataFrame:
    """Each version against every earlier one's neighbour: change of count, of size and of time."""
    w = Window.orderBy("created_at", "version_id")
    seconds = F.unix_timestamp("created_at") - F.unix_timestamp(F.lag("created_at").over(w))
    return versions.select("version_id", (F.col("file_count") - F.lag("file_count").over(w)).alias("files"), (F.col("size_bytes") - F.lag("size_bytes").over(w)).alias("bytes"), seconds.alias("seconds"))


def operation_progress(events: DataFrame) -> DataFrame:
    """Latest progress of each operation, clamped to 0-100; (completed + failed) / total where no figure is given."""
    last = events.groupBy("operation_id").agg(F.max_by(F.struct("status", "progress", "total", "completed", "failed"), F.struct("ts", "status")).alias("x"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    done = F.col("x.completed") + F.col("x.failed")
    share = F.coalesce("x.progress", F.when(F.col("x.total") > 0, 100.0 * done / F.col("x.total")), F.lit(0.0))
    return last.select("operation_id", "x.status", F.round(F.greatest(F.lit(0.0), F.least(share, F.lit(100.0))), 6).alias("progress"), "seconds", F.round(F.when(done > 0, F.col("x.completed") / done).otherwise(0.0), 6).alias("success_rate"))


def operation_report(operations: DataFrame) -> DataFrame:
    """By type: operations, success rate, mean seconds of completed ones."""
    ok = F.col("status") == "completed"
    return operations.groupBy("operation_type").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(ok, F.col("seconds"))), 6).alias("mean_seconds"))
