"""Tables laid out by key and piece of the order: nothing of them is shuffled again."""

from pyspark.sql import functions as F

from waymark import session
from waymark.operators import review
from waymark.operators.ordered import keep_first, lay_out, with_neighbours
from waymark.operators.quantiles import ordered_median
from waymark.schema import LANDMARKS_11

LM = LANDMARKS_11.order
BASE = dict(zip(LM, (100, 120, 140, 160, 168, 175, 185, 210, 260, 300, 350)))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_neighbours_along_a_laid_out_table(spark):
    rows = [("a", i, i * i) for i in range(0, 40, 3)] + [("b", i, -i) for i in (7, 1, 25)] + [("a", None, 5), ("b", None, 6), (None, 3, 7), (None, 30, 8)]
    d = spark.createDataFrame(rows, "k string, o long, v long")
    laid = lay_out(d, ["k"], "o", grain=8)
    assert rows_of(laid.drop("_piece")) == rows_of(d)
    look = dict(lag={"p": "v"}, lead={"n": "v"}, running={"s": "v"}, carry={"c": "v"}, ordinal="i")
    assert rows_of(with_neighbours(laid, ["k"], "o", **look).drop("_piece")) == rows_of(with_neighbours(d, ["k"], "o", grain=8, **look))
    assert "Exchange" not in executed(laid.groupBy("k", "_piece").count())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("laid_")]


def test_a_hot_key_is_spread_by_its_pieces(spark):
    d = spark.range(400).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    files = lay_out(d, ["k"], "o", grain=4).groupBy(F.input_file_name()).count()
    assert files.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_buckets_follow_the_size_of_the_files(spark, tmp_path, monkeypatch):
    d = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    most, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    assert session.bucket_count(d) == most
    d.write.parquet(f"{tmp_path}/a b")
    read = spark.read.parquet(f"{tmp_path}/a b")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert session.bucket_count(read) == cores
        monkeypatch.setattr(session, "BUCKET_BYTES", 200_000)
        assert cores < 8 <= session.bucket_count(read.groupBy("k").count()) <= 10
        monkeypatch.setattr(session, "BUCKET_BYTES", 10)
        assert session.bucket_count(read) == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", most)


def test_median_of_values_that_were_counted_in_parts(spark):
    d = spark.createDataFrame([("a", 1, 2), ("a", 4, 1), ("a", 1, 1), ("a", 9, 3), ("b", 3, 1), ("b", 5, 1), ("c", None, 4)], "k string, v long, n long")
    each = d.filter("v is not null").select("k", "v", F.explode(F.sequence(F.lit(1), "n")))
    for grain in (None, 4):
        for upper in (True, False):
            assert rows_of(ordered_median(d, ["k"], "v", "m", upper, grain, count="n")) == rows_of(ordered_median(each, ["k"], "v", "m", upper, grain))


def test_whole_rows_are_laid_out_once_for_a_merge(spark, monkeypatch):
    written = []
    keep = review.materialise
    monkeypatch.setattr(review, "materialise", lambda df: written.append(df.columns) or keep(df))
    rows = [(r, "II", i, 500.0, 5000, *[v + 400 * i for v in BASE.values()], -1.0) for r in ("r", "s") for i in range(4)] + [(None, "II", 1, 500.0, 5000, *BASE.values(), -1.0)]
    m = spark.createDataFrame(rows, "record_id string, lead string, beat_id long, fs_hz double, n_samples long, " + ", ".join(f"{c} long" for c in LM) + ", q_peak_ms double")
    c = keep_first(m.filter("record_id = 'r' and beat_id > 0"), ["record_id", "lead"], ["beat_id"]).withColumn("q_peak", F.col("q_peak") + 2)
    laid = review.lay_out(m, ["record_id", "lead"], "beat_id")
    out = review.merge_corrections(laid, c, n_outside="n")
    assert "_piece" not in out.columns and rows_of(out) == rows_of(review.merge_corrections(m, c, n_outside="n"))
    assert [r["q_peak_ms"] for r in out.filter("record_id = 'r'").orderBy("beat_id").collect()] == [340.0, 1140.0, 1940.0, 2740.0]
    assert out.filter("record_id is null or record_id = 's'").filter("label_quality is null and q_peak_ms = -1 and n = 0").count() == 5
    assert len(written) == 2 and not any("_rr0" in w or "p_onset" in w for w in written)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = executed(review.merge_corrections(laid, c)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [lines[i + 1] for i, t in enumerate(lines) if "Exchange hashpartitioning" in t]
    assert moved and not any(" p_onset#" in t or "[p_onset#" in t for t in moved)


def test_of_rows_that_repeat_a_key_the_lowest_anchor_is_the_reviewed_one(spark):
    shift = [(1, 0), (1, 400), (2, 900), (2, 1300), (1, 400)]
    shape = "record_id string, lead string, beat_id long, fs_hz double, n_samples long, " + ", ".join(f"{c} long" for c in LM)
    for threshold in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            for order in (shift, shift[::-1]):
                m = spark.createDataFrame([("r", "II", i, 500.0, 5000, *[v + s for v in BASE.values()]) for i, s in order], shape).coalesce(1)
                c = m.filter("beat_id = 1").orderBy("qrs_onset").limit(1).withColumn("r_peak", F.col("r_peak") + 3)
                got = review.merge_corrections(m, c).collect()
                assert sorted((r["beat_id"], r["r_peak"], r["label_quality"]) for r in got) == sorted(
                    (i, BASE["r_peak"] + 3 + s, "corrected" if i == 1 else "propagated") for i, s in shift)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
