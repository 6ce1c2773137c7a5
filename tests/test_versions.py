"""Version numbers belong to one writer each."""

import pytest

from waymark.operators import corpus
from waymark.sources import writers


def test_the_later_of_two_writers_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    writers.write_versioned(spark.range(3), root)
    writers._name_version(spark, root, 2, f"{root}/other")
    with pytest.raises(RuntimeError, match="taken"):
        writers._name_version(spark, root, 2, f"{root}/mine")
    assert [r.version for r in writers.versions(spark, root).orderBy("version").collect()] == [1, 2]


def test_versions_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (3, 5):
        writers.write_versioned(spark.range(n), root)
    assert writers.read_current(spark, root).count() == 5


def test_shards_are_crc32_of_the_key(spark):
    import zlib

    df = spark.createDataFrame([(f"r{i}",) for i in range(50)], "record_id string")
    got = {r.record_id: r.s for r in df.select("record_id", corpus.shard_of(df["record_id"], 7).alias("s")).collect()}
    assert got == {k: zlib.crc32(k.encode()) % 7 for k in got}
