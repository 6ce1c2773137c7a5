"""Writers. No path that is read is ever overwritten; a new version is written and then named."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import keep_first


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet", write: bool = True, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write in a fixed column order; with ``write=False`` (a dry run) only the checked plan is returned."""
    out = df.select(*columns) if columns else df
    if fmt == "csv":
        flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes]
        out = out.select(*flat)
    if write:
        w = out.write.mode("errorifexists").format(fmt)
        w = w.option("header", True) if fmt == "csv" else w
        (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return out


def write_batches(df: DataFrame, path: str, batch: str = "batch", fmt: str = "csv", write: bool = True) -> DataFrame:
    """One folder per batch. Rows of a batch are brought together first, so a batch is one file."""
    return write_table(df.repartition(batch), path, fmt=fmt, write=write, partition_by=[batch])


def write_versioned(df: DataFrame, root: str, write: bool = True) -> str | None:
    """Write ``root/v-<id>`` and append it to the version log; readers take the log's last entry.

    The earlier versions stay, so a reader of the old table is never disturbed. A version's log entry is a file of its own that is only
    ever created: of two writers that take the same number, the later one fails and its table is not named.
    """
    if not write:
        return None
    spark = df.sparkSession
    log = versions(spark, root)
    number = (log.agg(F.max("version")).collect()[0][0] or 0) + 1
    path = f"{root}/v-{number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    _name_version(spark, root, number, path)
    return path


def _name_version(spark: SparkSession, root: str, number: int, path: str) -> None:
    entry = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/v-{number:06d}.json")
    fs = entry.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(entry, False)
    except Py4JJavaError as e:
        raise RuntimeError(f"version {number} of {root} was taken by another writer") from e
    try:
        out.writeBytes(json.dumps({"version": number, "path": path}) + "\n")
    finally:
        out.close()


def versions(spark: SparkSession, root: str) -> DataFrame:
    schema = "version long, path string"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).json(f"{root}/_versions") if fs.exists(p) else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The table the version log names last."""
    last = versions(spark, root).orderBy(F.desc("version"), F.desc("path")).limit(1).collect()
    if not last:
        raise ValueError(f"no version under {root}")
    return spark.read.parquet(last[0]["path"])


def cache_waveforms(signals: DataFrame, path: str, n_channels: int, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, problems): parsed signals written once, the first path per recording, complete ones only."""
    per = signals.groupBy("record_id", "path").agg(F.count_distinct("lead").alias("n"))
    whole = per.filter(F.col("n") == n_channels)
    first = keep_first(whole.select("record_id", "path"), ["record_id"], ["path"])
    kept = signals.join(first, ["record_id", "path"], "left_semi")
    problems = per.filter(F.col("n") != n_channels).withColumn("error", F.format_string("%d channels", F.col("n"))).drop("n")
    if write:
        kept.repartition("record_id").sortWithinPartitions("record_id", "lead").write.mode("errorifexists").parquet(path)
    return kept, problems


def length_histogram(signals: DataFrame, trace: str = "trace") -> DataFrame:
    return signals.groupBy(F.size(trace).alias("n_samples")).agg(F.count(F.lit(1)).alias("n"))
