"""The bootstrap by value counts: distribution, matrix kernels and the cross-validated fit against its SQL form."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import hashing as H
from waymark.operators import infer
from waymark.plans import correction

SF = "/root/testdata/sf0.001"


def test_weights_of_counts_are_poisson():
    keys = np.arange(40, dtype=np.int64)
    for count in (1, 3, 64, 100):
        w = H.poisson_weights(5, [keys], np.full(40, count), np.arange(3000, dtype=np.int64))
        assert abs(w.mean() - count) < 5 * np.sqrt(count / w.size) + 1e-9
        assert abs(w.var() / count - 1) < 0.05


def test_counts_beyond_the_twins_table_keep_their_weight(spark):
    counts = np.array([8191, 8192, 12288, 1 << 15], np.int64)
    w = H.poisson_weights(5, [np.arange(4, dtype=np.int64)], counts, np.arange(2000, dtype=np.int64))
    assert np.all(np.abs(w.mean(1) - counts) < 5 * np.sqrt(counts / 2000)) and np.all(np.abs(w.var(1) / counts - 1) < 0.2)
    df = spark.range(20000).select(F.when(F.col("id") < 16384, 0.0).otherwise(1.0).alias("v"), "id")
    r = infer.bootstrap_ci(df, [], "v", ["id"], "mean", n=500, seed=1).first()
    assert r.ci_lo < r.point < r.ci_hi and r.ci_hi - r.ci_lo < 0.02


def test_thresholds_reach_the_end_of_the_draw():
    for b in (0, 3, 10):
        first, cuts = H.poisson_cuts(b)
        assert list(cuts) == sorted(cuts) and cuts[0] >= 1 and H.PRIME - cuts[-1] < 1000
        assert first <= 2**b <= first + len(cuts)


def test_array_draws_equal_column_draws(spark):
    d = H.with_state(spark.range(50).coalesce(1), "u", 9, [F.col("id") - 7, F.lit(4)])
    got = [r.u for r in H.continue_draw(d, "u", F.lit(3)).collect()]
    assert got == H.draws(9, [np.arange(-7, 43, dtype=np.int64), np.int64(4)], np.int64(3)).tolist()
    sql = H.replicate_sql(9, ["i", "4"], "3")
    assert got == [r[0] for r in duckdb.sql(f"SELECT {sql} FROM (SELECT unnest(range(-7, 43)) AS i)").fetchall()]


def test_keys_equal_modulo_the_prime_draw_apart(spark):
    ids = [5, 5 + H.PRIME, 5 + 2 * H.PRIME, 5 + H.LANES[1][0], 5 + H.PRIME * 10**6, -5]
    d = spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1)
    u = [r.u for r in H.with_draw(d, "u", 3, [F.col("id")]).collect()]
    assert len(set(u)) == len(ids) and max(u) > 1 << 40
    assert u == [r[0] for r in duckdb.sql(f"SELECT {H.draw_sql(3, 'i')} FROM (SELECT unnest({ids}) AS i)").fetchall()]
    w = H.poisson_weights(3, [np.array(ids)], np.ones(len(ids), np.int64), np.arange(4000))
    same = np.corrcoef(w)[~np.eye(len(ids), dtype=bool)]
    assert np.abs(same).max() < 0.1


def medians_by_hand(v, c, n, seed):
    order = np.argsort(v)
    v, c = np.array(v)[order], np.array(c)[order]
    w = H.poisson_weights(seed, [infer._value_key(v)], c, np.arange(n, dtype=np.int64))
    return [np.median(np.repeat(v, w[:, j])) if w[:, j].sum() else None for j in range(n)]


@pytest.mark.parametrize("most", [1, 7, 100, 10**6])
def test_medians_do_not_depend_on_how_values_are_cut(spark, most):
    rng = np.random.default_rng(0)
    rows = [("a", float(x), int(k)) for x, k in zip(rng.normal(size=150), rng.integers(1, 9, 150), strict=True)] + [("a", 1e12, 1), ("b", 3.0, 1), ("c", 1.5, 2), ("c", 2.5, 40)]
    got = {}
    for r in infer._median_replicates(spark.createDataFrame(rows, "g string, _v double, _c long"), ["g"], 60, 5, most).collect():
        got.setdefault(r["g"], []).append(r["_s"])
    for g in "abc":
        want = medians_by_hand([v for k, v, _ in rows if k == g], [c for k, _, c in rows if k == g], 60, 5)
        assert sorted(x for x in got[g] if x is not None) == sorted(x for x in want if x is not None)


def test_a_median_without_groups_is_cut_too(spark):
    rows = [(float(x), 1) for x in np.random.default_rng(1).normal(size=90)]
    d = spark.createDataFrame(rows, "_v double, _c long")
    want = sorted(medians_by_hand([v for v, _ in rows], [1] * 90, 40, 3))
    for most in (8, 1000):
        assert sorted(r["_s"] for r in infer._median_replicates(d, [], 40, 3, most).collect()) == want


def test_interval_by_counts_has_the_width_of_drawing_rows(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 20, 400) / 2) * 2
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    for stat, f in (("median", np.median), ("mean", np.mean)):
        r = infer.bootstrap_ci(df, [], "v", ["id"], stat, n=2000, seed=1).first()
        direct = np.quantile([f(rng.choice(v, len(v))) for _ in range(2000)], [0.025, 0.975])
        assert r.n == 400 and abs(r.point - f(v)) < 1e-9
        assert abs(r.ci_lo - direct[0]) <= 1.0 and abs(r.ci_hi - direct[1]) <= 1.0


def test_cross_validated_fit_equals_its_sql_form(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute("WITH " + correction.cv_sql(40))
    names = [d[0] for d in rel.description]
    want = sorted((tuple(sorted(zip(names, r, strict=True))) for r in rel.fetchall()), key=str)
    got = sorted((tuple(sorted(r.asDict().items())) for r in correction.crossvalidate_offsets(spark, SF, 40).collect()), key=str)
    assert got == want and got
