"""Steps that many queries share: what they read, carry and write, besides their results."""

import datetime

from pyspark.sql import functions as F

from waymark.operators import consensus as C
from waymark.operators import debias as D
from waymark.operators import review
from waymark.plans import fixtures
from waymark.schema import LANDMARKS_11

LM = LANDMARKS_11.order
BASE = dict(zip(LM, (100, 120, 140, 160, 168, 175, 185, 210, 260, 300, 350)))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_a_line_with_an_absent_price_come_last_as_in_sql(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    li = [(1, 1, 5, 7, p, day, q, 0.0, 0.0, "N", "F") for p, q in ((None, 1.0), (9.0, 2.0))]
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp, l_quantity double, "
                              "l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(3, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = fixtures.units(spark, str(tmp_path)).collect()
    assert [r["qrs_offset"] for r in rows] == [400 + 5 + 15 + 2 * 2]


def test_lines_are_laid_out_once(spark):
    text = plan(fixtures.beats(spark, "/root/testdata/sf0.001"))
    assert "min(struct" not in text and "RepartitionByExpression [l_orderkey" in text


def test_repairs_are_plain_columns(spark):
    d = spark.createDataFrame([(None, 9.0, 8.0, 7.0, None, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0)], ", ".join(f"{c} double" for c in LM))
    forward, ranked = C.repair_forward(d, LM), C.repair_ranked(d, ["qrs_onset"])
    assert "lambda" not in plan(forward) and "lambda" not in plan(ranked)
    assert [forward.first()[c] for c in LM] == [None, 9, 9, 9, None, 9, 9, 9, 9, 9, 9]


def test_residuals_are_counted_before_training_parts_are_laid_out(spark):
    res = spark.createDataFrame([(i, 1, "a", "x", float(i % 3), True) for i in range(40)], "record_id long, lead int, disease_class string, fiducial string, residual_ms double, usable boolean")
    spread = D.fold_spread(res)
    text = plan(spread)
    below = text[text.index("Generate"):]
    assert 0 < below.find("Aggregate") < below.find("Window")
    r = spread.first()
    assert (r["lowest_ms"], r["highest_ms"], r["spread_ms"]) == (1.0, 1.0, 0.0)


def test_whole_rows_are_written_once_when_corrections_are_merged(spark, monkeypatch):
    written = []
    keep = review.materialise
    monkeypatch.setattr(review, "materialise", lambda df: written.append(df.columns) or keep(df))
    rows = [("r", "II", i, 500.0, 5000, *[v + 400 * i for v in BASE.values()]) for i in range(3)]
    m = spark.createDataFrame(rows, "record_id string, lead string, beat_id long, fs_hz double, n_samples long, " + ", ".join(f"{c} long" for c in LM))
    c = m.filter("beat_id = 1").withColumn("q_peak", F.col("q_peak") + 2)
    out = review.merge_corrections(m, c).orderBy("beat_id").collect()
    assert [r["q_peak"] for r in out] == [170, 570, 970]
    assert [r["label_quality"] for r in out] == ["propagated", "corrected", "propagated"]
    assert len(written) == 1
