import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import arrays as A
from waymark.functions import hashing as H
from waymark.functions import scalar as S
from waymark.operators.ordered import keep_first, keep_last, text_rank, with_frame, with_neighbours
from waymark.operators.quantiles import grouped_quantiles, ordered_median, refined_quantiles, running_counts


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is not None, x) for x in t))


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", i * 3 + rnd.randrange(3), rnd.choice([None, rnd.randrange(50)])) for i in range(400)]
    return spark.createDataFrame(data, "k string, o long, v long").cache()


@pytest.mark.parametrize("grain", [7, 64, 1 << 20])
def test_neighbours_equal_a_plain_window(series, grain):
    kw = dict(lag={"p": "v"}, lead={"n": "v"}, carry={"c": "v"}, ordinal="i", running={"s": "v"}, total="t")
    a = with_neighbours(series, ["k"], "o", grain=grain, **kw)
    b = with_neighbours(series, ["k"], "o", grain=None, **kw)
    cols = ["k", "o", "v", "p", "n", "c", "i", "s", "t"]
    assert rows(a, *cols) == rows(b, *cols)


def test_bounded_frame_equals_a_plain_window(series):
    d = with_neighbours(series, ["k"], "o", ordinal="i")
    a = with_frame(d, ["k"], "i", 2, 3, {"x": lambda w: F.sum("v").over(w.rowsBetween(-2, 3))}, grain=5)
    b = d.withColumn("x", F.sum("v").over(W.partitionBy("k").orderBy("i").rowsBetween(-2, 3)))
    assert rows(a, "k", "i", "x") == rows(b, "k", "i", "x")


def test_first_and_last_rows_stay_whole(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, 7)], "k string, o int, v int")
    assert rows(keep_first(d, ["k"], ["o"]), "k", "o", "v") == [("a", 1, None), ("b", 1, 7)]
    assert rows(keep_last(d, ["k"], ["o"]), "k", "o", "v") == [("a", 2, 5), ("b", 1, 7)]


def test_quantiles_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k in "ab" for v in rng.normal(size=501)] + [("c", 2.0)] * 5 + [("d", None)]
    d = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.98, 1.0]
    want = {(k, i): np.quantile([v for kk, v in data if kk == k and v is not None], p) for k in "abc" for i, p in enumerate(probs)}
    got = {(r["k"], r["level_no"]): r["v"] for r in refined_quantiles(d, ["k"], "v", probs).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    g = {r["k"]: r["m"] for r in grouped_quantiles(d, ["k"], "v", [0.5], ["m"]).collect()}
    assert abs(g["a"] - want[("a", 3)]) < 1e-12


@pytest.mark.parametrize("outliers", [[], [1e12], [-1e300, 1e300]])
def test_many_ranks_of_crowded_values_with_outliers(spark, outliers):
    rng = np.random.default_rng(7)
    v = np.concatenate([1 + rng.random(3000) * 1e-9, rng.normal(size=2000), np.zeros(500), outliers])
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    probs = [i / 4000 for i in range(4001)]
    got = [r["v"] for r in refined_quantiles(d, [], "v", probs).orderBy("level_no").collect()]
    assert np.allclose(got, np.quantile(v, probs), rtol=1e-12, atol=1e-15)


def test_an_outlier_does_not_crowd_a_piece(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.random(20000), [1e12]])
    counts = spark.createDataFrame([(float(x), 1) for x in v], "v double, _c long")
    run = running_counts(counts, [], "v")
    sizes = [r["count"] for r in run.groupBy("_piece").count().collect()]
    assert sum(sizes) == len(v) and max(sizes) < 3 * len(v) / len(sizes)
    at = {r["v"]: r["_from"] for r in run.collect()}
    assert [at[x] for x in sorted(at)] == list(range(len(v)))


def test_ordered_median_and_its_upper_form(spark):
    d = spark.createDataFrame([("a", v) for v in (1, 2, 2, 9)] + [("b", 5)], "k string, v long")
    assert rows(ordered_median(d, ["k"], "v", "m"), "k", "m") == [("a", 2.0), ("b", 5.0)]
    e = spark.createDataFrame([("a", v) for v in (1, 3, 8, 9)], "k string, v long")
    assert ordered_median(e, ["k"], "v", "m", upper=True).first()["m"] == 8


def test_text_rank_grows_with_the_text(spark):
    words = ["", "a", "abc", "abcdefghijk", "abd", "b", "zz"]
    d = spark.createDataFrame([(w,) for w in words], "w string").withColumn("r", text_rank(F.col("w")))
    got = [r["r"] for r in d.orderBy("w").collect()]
    assert got == sorted(got)


def test_rounding_modes_and_number_parsing(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in d.select(S.half_even(F.col("x"))).collect()] == [0, 2, 2]
    assert [r[0] for r in d.select(S.half_away(F.col("x"))).collect()] == [1, 2, 3]
    t = spark.createDataFrame([("12",), ("12.0",), (" None ",), ("",), ("NaN",), ("x",), ("0",)], "t string")
    assert [r[0] for r in t.select(S.parse_int(F.col("t"))).collect()] == [12, 12, None, None, None, None, 0]
    i = spark.createDataFrame([(4,), (5,)], "i long")
    assert [r[0] for r in i.select(S.halve_rate(F.col("i"))).collect()] == [2, 3]


def test_range_rule_modes_and_strictness(spark):
    d = spark.createDataFrame([(40.0,), (200.0,), (39.9,), (None,)], "x double")
    assert [r[0] for r in d.select(S.out_of_range(F.col("x"), 40.0, 200.0)).collect()] == [False, False, True, False]
    assert [r[0] for r in d.select(S.out_of_range(F.col("x"), 40.0, 200.0, "flag")).collect()] == [False, False, True, True]


def test_array_rules_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=33)
    d = spark.createDataFrame([([float(v) for v in x],)], "a array<double>")
    a = F.col("a")
    r = d.select(A.median(a), A.quantile(a, 0.3), A.gradient(a), A.box_mean(a, 5), A.arg_best(a, lambda v: F.abs(v))).first()
    assert abs(r[0] - np.median(x)) < 1e-12 and abs(r[1] - np.quantile(x, 0.3)) < 1e-12
    assert np.allclose(r[2], np.gradient(x))
    assert np.allclose(r[3], np.convolve(np.pad(x, 2, mode="edge"), np.ones(5) / 5, "valid"))
    assert r[4] == int(np.argmax(np.abs(x)))


def test_draws_are_stable_and_spread(spark):
    d = spark.range(20000).withColumn("u", H.uniform(1, F.col("id")))
    s = d.agg(F.avg("u"), F.stddev("u"), F.count_distinct("u")).first()
    assert abs(s[0] - 0.5) < 0.01 and abs(s[1] - 0.2887) < 0.01 and s[2] > 19900
    staged = H.with_draw(spark.range(50).withColumn("b", F.col("id") * 3), "x", 9, [F.col("id"), F.col("b")])
    assert staged.filter(F.col("x") != H.draw(9, F.col("id"), F.col("b"))).count() == 0
    w = H.continue_draw(H.with_state(spark.range(50000), "x", 4, [F.col("id")]), "x", F.lit(0)).select(H.poisson_one(F.col("x")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05
