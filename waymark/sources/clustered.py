"""A table laid out by key, so that a look-up of a few keys opens only the files that hold them.

Rows are cut into ranges of the key at sampled points and sorted inside them. Files then cover key ranges that do not overlap, except that a
key with very many rows fills several files of its own. Each file carries row-group minima and maxima and a Bloom filter on the key, and a small
index table beside the data states the range of each file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEW_KEYS = 10_000


def write_clustered(df: DataFrame, path: str, key: str = "record_id", n_files: int | None = None, bloom_keys: int = 1_000_000) -> None:
    """Write ``path/data`` clustered by ``key`` and ``path/index``: one row (file, lo, hi, n) per file.

    ``n_files`` defaults to the session's shuffle partitions. Rows without a key are kept, in files of their own or first in a file. The cut
    also orders by a hash of the whole row, so one key may be spread over many tasks and files.
    """
    rest = F.xxhash64(*df.columns)
    cut = df.repartitionByRange(n_files, key, rest) if n_files else df.repartitionByRange(key, rest)
    cut.sortWithinPartitions(key).write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{key}", str(bloom_keys)).parquet(f"{path}/data")
    files = df.sparkSession.read.parquet(f"{path}/data").select(F.col(key).alias("k"), F.col("_metadata.file_path").alias("file"))
    files.groupBy("file").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/index")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def files_with(spark: SparkSession, path: str, wanted: DataFrame, key: str = "record_id") -> list[str]:
    """The files whose range holds a wanted key.

    Wanted keys and files are merged in one order: going down, every file carries the smallest wanted key at or above its own smallest one, and is
    kept if its range reaches that far. Both lists are short: one row per file and at most ``FEW_KEYS`` keys.
    """
    index = spark.read.parquet(f"{path}/index").filter("lo is not null").select("file", F.col("lo").alias("at"), "hi", F.lit(None).cast(dict(wanted.dtypes)[key]).alias("ask"), F.lit(0).alias("side"))
    asks = wanted.select(F.lit(None).cast("string").alias("file"), F.col(key).alias("at"), F.lit(None).alias("hi"), F.col(key).alias("ask"), F.lit(1).alias("side"))
    down = W.partitionBy(F.lit(0)).orderBy(F.desc("at"), F.desc("side")).rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = index.unionByName(asks).withColumn("next", F.last("ask", ignorenulls=True).over(down)).filter("side = 0 and next <= hi")
    return sorted(r["file"] for r in hit.select("file").collect())


def lookup(spark: SparkSession, path: str, wanted: DataFrame | Sequence, key: str = "record_id", few: int = FEW_KEYS) -> DataFrame:
    """All rows of the wanted keys, read from the files that may hold them.

    ``wanted`` is a list of keys or a table with the key column; NULL keys match nothing. Up to ``few`` distinct keys, files are pruned by the
    index, and row groups by their minima, maxima and Bloom filters through the pushed-down key list. More keys than that would touch most files,
    so they are a semi join over the whole table.
    """
    table = read_clustered(spark, path)
    kind = dict(table.dtypes)[key]
    if isinstance(wanted, DataFrame):
        asked = wanted.select(F.col(key).cast(kind).alias(key))
    else:
        asked = spark.createDataFrame([(k,) for k in wanted], f"`{key}` {kind}")
    asked = asked.filter(F.col(key).isNotNull()).distinct()
    keys = [r[0] for r in asked.limit(few + 1).collect()]
    if len(keys) > few:
        return table.join(asked, key, "left_semi")
    files = files_with(spark, path, spark.createDataFrame([(k,) for k in keys], f"`{key}` {kind}"), key) if keys else []
    if not files:
        return table.limit(0)
    return spark.read.schema(table.schema).parquet(*files).filter(F.col(key).isin(keys))
