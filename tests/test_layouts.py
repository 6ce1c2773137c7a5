"""Tables laid out by key, tables in buckets, merged documents, and the monitor that keeps state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from waymark import streaming
from waymark.sources import buckets, clustered, readers


def scanned_files(df):
    """Files the executed scan has read."""
    fresh = df.select("*")
    fresh.collect()
    leaves = fresh._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def beats_by_record(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "t")
    rng = random.Random(1)
    rows = [(rng.randrange(2000) if rng.random() < 0.6 else 777, i, float(i)) for i in range(6000)] + [(None, -1, 0.0)]
    df = spark.createDataFrame(rows, "record_id long, beat_id long, v double")
    clustered.write_clustered(df, path, n_files=16)
    return path, rows


@pytest.mark.parametrize("ids", [[3], [1999, 5], [777], [10**9], [], [None, 4]])
def test_a_lookup_opens_only_the_files_that_hold_the_keys(spark, beats_by_record, ids):
    path, rows = beats_by_record
    got = clustered.lookup(spark, path, ids)
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for r in rows if r[0] is not None and r[0] in ids)
    holding = clustered.read_clustered(spark, path).filter(F.col("record_id").isin([i for i in ids if i is not None] or [-5])).select(F.input_file_name()).distinct().count()
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == 16 and index.agg(F.sum("n")).first()[0] == len(rows)
    if holding:
        # a key's range may reach into a neighbour file only if the key itself does
        assert scanned_files(got) == holding


def test_a_hot_key_is_spread_over_files(spark, beats_by_record):
    path, rows = beats_by_record
    assert spark.read.parquet(f"{path}/index").filter("lo = 777 and hi = 777").count() >= 4


def test_many_keys_are_a_semi_join(spark, beats_by_record):
    path, rows = beats_by_record
    wanted = spark.range(0, 300).withColumnRenamed("id", "record_id")
    got = clustered.lookup(spark, path, wanted, few=100)
    assert got.count() == sum(r[0] is not None and r[0] < 300 for r in rows) == clustered.lookup(spark, path, wanted).count()


def feed_rows(spark, rows):
    return spark.createDataFrame(rows, "record_id string, lead string, edited_at long, v int")


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    root, keys = str(tmp_path / "t"), ["record_id", "lead"]
    first = buckets.fold_changes(feed_rows(spark, [(f"r{i}", "I", 1, i) for i in range(200)]), root, keys, ["edited_at"], n_buckets=16)
    assert len(first["buckets"]) == 16
    second = buckets.fold_changes(feed_rows(spark, [("r3", "I", 2, -3), ("r3", "I", 1, -9), ("new", "I", 1, -4)]), root, keys, ["edited_at"])
    touched = {str(r[0]) for r in feed_rows(spark, [("r3", "I", 0, 0), ("new", "I", 0, 0)]).select(buckets.bucket_of(keys, 16)).collect()}
    assert {b for b in first["buckets"] if first["buckets"][b] != second["buckets"][b]} == touched
    got = {r["record_id"]: r["v"] for r in buckets.read_buckets(spark, root).collect()}
    assert got == {**{f"r{i}": i for i in range(200)}, "r3": -3, "new": -4}


def test_replayed_and_empty_batches_change_nothing(spark, tmp_path):
    root, keys = str(tmp_path / "t"), ["record_id", "lead"]
    batch = feed_rows(spark, [("a", "I", 5, 1)])
    one = buckets.fold_changes(batch, root, keys, ["edited_at"], 4, feed="f", batch=0)
    assert buckets.fold_changes(batch, root, keys, ["edited_at"], feed="f", batch=0) == one
    assert buckets.fold_changes(batch.limit(0), root, keys, ["edited_at"], feed="f", batch=1) == one
    older = buckets.fold_changes(feed_rows(spark, [("a", "I", 4, 7)]), root, keys, ["edited_at"], feed="f", batch=2)
    assert older["version"] == 2 and buckets.read_buckets(spark, root).first()["v"] == 1


def test_the_later_of_two_writers_of_a_bucketed_table_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    entry = buckets.fold_changes(feed_rows(spark, [("a", "I", 5, 1)]), root, ["record_id", "lead"], ["edited_at"], 4)
    with pytest.raises(RuntimeError, match="taken"):
        buckets._publish(spark, root, entry)
    with pytest.raises(ValueError, match="keyed"):
        buckets.fold_changes(feed_rows(spark, []), root, ["lead"], ["edited_at"])


def merged(spark, docs, depth):
    d = spark.createDataFrame([("k", i, t) for i, t in enumerate(docs)], "k string, n int, value string").repartition(3)
    m, bad = readers.merge_documents(d, ["k"], ["n"], depth=depth)
    return {tuple(r["path"]): json.loads(r["value"]) for r in m.collect()}, sorted(r["n"] for r in bad.collect())


def test_documents_are_merged_key_by_key(spark):
    docs = ['{"a": {"x": 1, "y": [1, {"z": 2}]}, "s": "q\\"\\u00e9"}', '{"b": null, "a": {"x": 5}}', "no json", "[1]", None, '{"c": {}}', "{}"]
    whole = {}
    for t in docs[:2] + docs[5:]:
        whole.update(json.loads(t))
    assert merged(spark, docs, 1) == ({(k,): v for k, v in whole.items()}, [2, 3, 4])
    assert merged(spark, docs, 8)[0] == {("a", "x"): 5, ("a", "y"): [1, {"z": 2}], ("s",): 'q"é', ("b",): None, ("c",): {}}


def test_a_later_leaf_replaces_members_and_the_reverse(spark):
    assert merged(spark, ['{"a": {"x": 1, "y": 2}, "b": 1}', '{"a": 3, "b": {"p": {"q": 4}}}'], 8)[0] == {("a",): 3, ("b", "p", "q"): 4}
    assert merged(spark, ['{"a": 3}', '{"a": {"x": 1}}', '{"a": {"y": 2}}'], 8)[0] == {("a", "x"): 1, ("a", "y"): 2}


SHAPE = "u string, id long, pos long"


def test_gaps_across_batches_are_reported_and_late_rows_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    base = 1_700_000_000
    # one list per micro-batch: (unit, id, second)
    feed = [
        [("a", 1, 0), ("b", 2, 590), ("a", 3, 600)],
        [("a", 4, 640), ("b", 5, 640), ("c", 6, 700), ("c", 7, 690)],  # a gap over two batches; one out of order
        [("z", 8, 5000)],
        [("a", 9, 641), ("z", 10, 5030), ("z", 11, 5020)],  # the first one is later than the watermark
        [("z", 12, 20000)],
        [("z", 13, 40000)],
    ]
    stream = spark.readStream.schema(SHAPE).parquet(src).withColumn("ts", F.timestamp_seconds(F.col("pos")))
    found = streaming.short_gap_monitor(stream, ["u"], "ts", "pos", "id", 60, "5 minutes")
    q = found.writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for part in feed:
            spark.createDataFrame([(u, i, base + s) for u, i, s in part], SHAPE).write.mode("append").parquet(src)
            q.processAllAvailable()
        got = sorted((r.u, r.previous, r.id, r.gap) for r in spark.table("gaps").collect())
    finally:
        q.stop()
    kept = [(u, i, base + s) for part in feed for u, i, s in part if i != 9]
    want = streaming.short_gaps(spark.createDataFrame(kept, SHAPE), ["u"], "pos", "id", 60)
    assert got == sorted((r.u, r.previous, r.id, r.gap) for r in want.collect()) == [
        ("a", 3, 4, 40), ("b", 2, 5, 50), ("c", 7, 6, 10), ("z", 8, 11, 20), ("z", 11, 10, 10)]


def test_documents_are_parsed_once_whatever_the_depth(spark):
    d = spark.createDataFrame([(1, 1, '{"a":{"b":{"c":1,"d":{}},"e":[1]},"f":null}'), (1, 2, "no object"), (1, 3, "{}")], "k long, n long, value string")
    leaves, bad = readers.document_leaves(d, ["k", "n"], depth=3)
    assert leaves._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    assert sorted(("/".join(r.path), r.value) for r in leaves.collect()) == [("a/b/c", "1"), ("a/b/d", "{}"), ("a/e", "[1]"), ("f", "null")]
    assert sorted(("/".join(r.path), r.value) for r in readers.document_leaves(d, ["k", "n"], depth=2)[0].collect()) == [("a/b", '{"c":1,"d":{}}'), ("a/e", "[1]"), ("f", "null")]
    assert [r.n for r in bad.collect()] == [2]
