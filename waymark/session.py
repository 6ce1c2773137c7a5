"""Session settings for tests and benches; a cluster brings its own session."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "waymark", cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else os.cpu_count()))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests, benches): it then gets a temporary folder of its own, removed at exit. Any other
    session without the setting is refused, since its executors share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="waymark-stage-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table once as Parquet in the shared folder and go on from the files.

    For tables that several later steps read: their plan is then a file scan with column pruning, filters and a known size, and a lost
    executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Read bytes to a bucket: some hundred thousand landmark rows, which a task sorts in memory.
BUCKET_BYTES = 4 << 20


def bucket_count(df: DataFrame) -> int:
    """Buckets for ``df`` by the size of the files that it reads: one for each ``BUCKET_BYTES``, one for each core at least.

    The session's shuffle partitions are the most, and what a table without files gets.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, size = df.inputFiles(), 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        if size >= most * BUCKET_BYTES:
            break
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        size += p.getFileSystem(conf).getFileStatus(p).getLen()
    return min(most, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))) if files else most


def materialise_by(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``materialise`` as a table in buckets of ``keys``: joins, windows and aggregates on these keys, or on more, then move none of its rows.

    Each bucket is one file, sorted by ``order``. The table has a name only until its DataFrame is made; its files stay like those of ``materialise``.
    """
    spark = df.sparkSession
    name, n = f"laid_{uuid.uuid4().hex}", bucket_count(df)
    made = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
    (made.sortBy(*order) if order else made).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    laid = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return laid
