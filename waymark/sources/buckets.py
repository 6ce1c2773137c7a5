"""A table of keyed rows that takes changes in small batches without being rewritten.

Rows live in a fixed number of buckets by a hash of their key, and every bucket is a set of files of its own. A version of the table names the
files of all its buckets in one log entry, which is only ever created. A batch of changes rewrites the buckets it touches; the new version takes
all others over as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import upsert

SLICES = 4


def bucket_of(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _path(spark: SparkSession, where: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict | None:
    """The last version: its number, keys, bucket count, files by bucket, and the last batch of each feed."""
    p, fs = _path(spark, f"{root}/_versions")
    if not fs.exists(p):
        return None
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if str(s.getPath().getName()).endswith(".json"))
    if not names:
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/_versions/{names[-1]}", wholetext=True).collect()))


def _publish(spark: SparkSession, root: str, entry: dict) -> None:
    p, fs = _path(spark, f"{root}/_versions/v-{entry['version']:09d}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        raise RuntimeError(f"version {entry['version']} of {root} was taken by another writer") from e
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()


def _read(spark: SparkSession, entry: dict, buckets: Sequence[str] | None = None) -> DataFrame | None:
    paths = [p for b, p in sorted(entry["buckets"].items()) if buckets is None or b in buckets]
    return spark.read.schema(entry["schema"]).parquet(*paths) if paths else None


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The table as its last version names it."""
    entry = current(spark, root)
    if entry is None:
        raise ValueError(f"no version under {root}")
    rows = _read(spark, entry)
    return rows if rows is not None else spark.createDataFrame([], entry["schema"])


def _write(df: DataFrame, root: str, keys: Sequence[str], n: int) -> dict[str, str]:
    """Write rows by bucket; the folders of the buckets that have rows."""
    where = f"{root}/rows-{uuid.uuid4().hex}"
    spread = df.withColumn("_bucket", bucket_of(keys, n)).repartition("_bucket", F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(SLICES)))
    spread.write.mode("errorifexists").partitionBy("_bucket").parquet(where)
    p, fs = _path(df.sparkSession, where)
    names = [str(s.getPath().getName()) for s in fs.listStatus(p)]
    return {d.split("=")[1]: f"{where}/{d}" for d in names if d.startswith("_bucket=")}


def fold_changes(
    changes: DataFrame, root: str, keys: Sequence[str], by: Sequence[str], n_buckets: int = 64, feed: str | None = None, batch: int | None = None,
) -> dict:
    """Fold changed rows into the table, the newest version of a key (by ``by``) winning; no key is lost. Returns the version.

    Only buckets that hold a changed key are read and written. A batch number at or below the last one of its ``feed`` has been folded and
    changes nothing; an empty batch neither. The bucket count is fixed by the first version, and so are the columns: later ones must be able to
    take the table's types, absent ones are NULL. Of two writers that take the same version number, the later one fails.
    """
    spark = changes.sparkSession
    entry = current(spark, root)
    if entry is None:
        entry = {"version": 0, "keys": list(keys), "n": n_buckets, "schema": ", ".join(f"`{c}` {t}" for c, t in changes.dtypes), "buckets": {}, "feeds": {}}
    if list(keys) != entry["keys"]:
        raise ValueError(f"the table is keyed by {entry['keys']}")
    if feed is not None and batch is not None and batch <= entry["feeds"].get(feed, -1):
        return entry
    n = entry["n"]
    touched = [str(r[0]) for r in changes.select(bucket_of(keys, n)).distinct().collect()]
    if not touched:
        return entry
    old = _read(spark, entry, touched)
    merged = upsert(old, changes.select(*[c for c in changes.columns if c in old.columns]), keys, by) if old is not None else upsert(changes, changes.limit(0), keys, by)
    new = {**entry, "version": entry["version"] + 1, "buckets": {**entry["buckets"], **_write(merged, root, keys, n)}}
    if feed is not None and batch is not None:
        new["feeds"] = {**entry["feeds"], feed: batch}
    _publish(spark, root, new)
    return new
