import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from waymark import streaming
from waymark.operators import augment as X
from waymark.operators import score as Z
from waymark.operators import segment as S
from waymark.operators import signal as G
from waymark.schema import LANDMARKS_11
from waymark.sources import buckets, readers, writers

LM = LANDMARKS_11.order


def trace_df(spark, arrays):
    return spark.createDataFrame([("r", c, [float(v) for v in a]) for c, a in arrays.items()], "record_id string, lead string, trace array<double>")


def test_magnitude_and_velocity(spark):
    rng = np.random.default_rng(0)
    x = {c: rng.normal(size=40) for c in ("I", "II", "V1", "V2")}
    d = trace_df(spark, x)
    m = np.sqrt(sum((v - np.median(v)) ** 2 for v in x.values()))
    assert np.allclose(G.spatial_magnitude(d).first()["magnitude"], m)
    v = G.spatial_velocity(d).first()
    g = np.sqrt(sum(np.gradient(a) ** 2 for a in x.values()))
    assert np.allclose(v["velocity"], g) and v["floor"] == pytest.approx(np.sort(g)[3])


@pytest.mark.parametrize("mode", ["robust", "zscore", "abs_percentile"])
def test_normalise(spark, mode):
    x = np.random.default_rng(4).normal(size=50) * 3 + 1
    got = G.normalise(trace_df(spark, {"I": x}), mode).first()["normalised"]
    c = x.mean() if mode == "zscore" else np.median(x)
    s = {"zscore": x.std(), "robust": (np.percentile(x, 75) - np.percentile(x, 25)) / 1.349, "abs_percentile": np.percentile(np.abs(x - np.median(x)), 99)}[mode]
    assert np.allclose(got, (x - c) / s)
    flat = G.normalise(trace_df(spark, {"I": np.ones(40)}), mode).first()["normalised"]
    assert np.allclose(flat, 0)


def test_baseline_and_halving(spark):
    x = np.random.default_rng(6).normal(size=60)
    d = trace_df(spark, {"I": x})
    got = G.remove_baseline(d, window=11).first()["flat"]
    hop, half = round(11 * 0.5), 5
    k = int((60 - 11 * 0.5) // (11 * 0.5))
    centres = np.arange(k) * hop + half
    meds = [np.median(x[max(0, c - half): c + half + 1]) for c in centres]
    assert np.allclose(got, x - np.interp(np.arange(60), centres, meds))
    taps = np.array(G.lowpass_taps(150, 1000, 16))
    want = np.convolve(np.pad(x, 16, mode="edge"), taps, "same")[16:-16][::2]
    assert np.allclose(G.resample_half(d, order=16).first()["halved"], want) and abs(taps.sum() - 1) < 1e-12


def test_quantile_matching(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=300), rng.normal(size=300) * 2 + 5
    src, tgt = trace_df(spark, {"I": a}), trace_df(spark, {"I": b})
    table = G.quantile_match_table(src, tgt, levels=51)
    got = G.apply_quantile_match(src, table).first()["matched"]
    q = np.linspace(0, 1, 51)
    assert np.allclose(got, np.interp(a, np.quantile(a, q), np.quantile(b, q)))
    tied = G.quantile_match_table(trace_df(spark, {"I": [1.0] * 10}), tgt, levels=5).orderBy("level_no").collect()
    ext = [r["external"] for r in tied]
    assert all(y > x for x, y in zip(ext, ext[1:]))


def test_template_of_equal_beats_is_the_beat(spark):
    beat = np.array([0, 1, 4, 1, 0, -1, 0, 0, 0, 0], dtype=float)
    rng = np.random.default_rng(2)
    places = np.cumsum(10 + rng.integers(0, 3, size=30))
    x = np.zeros(places[-1] + 20)
    for p in places:
        x[p - 2:p + 6] = beat[:8]
    ev = spark.createDataFrame([("r", "I", i + 1, int(p)) for i, p in enumerate(places)], "record_id string, lead string, beat_id int, at int")
    t = G.template_average(ev, trace_df(spark, {"I": x}), "at", 2, 3).orderBy("offset").collect()
    assert [r["offset"] for r in t] == [-2, -1, 0, 1, 2, 3] and np.allclose([r["value"] for r in t], beat[:6])


def test_rule_based_delineation_of_a_clean_beat(spark):
    t = np.arange(400) * 2.0  # ms
    bump = lambda c, w, h: h * np.exp(-0.5 * ((t - c) / w) ** 2)
    x = bump(100, 8, 1.0) - bump(125, 7, 0.4) + bump(400, 35, 0.35) + 1e-5 * np.sin(t)
    r = G.delineate_rule_based(trace_df(spark, {"I": x})).first()
    assert r["t_peak"] == 200
    assert 30 <= r["qrs_onset"] <= 45 and 62 <= r["qrs_offset"] <= 90
    assert 145 <= r["t_onset"] < 200 < r["t_offset"] <= 270
    assert r["qrs_onset"] < r["qrs_offset"] < r["t_onset"]
    down = G.delineate_rule_based(trace_df(spark, {"I": x - 2 * bump(400, 35, 0.35)})).first()
    assert (down["t_peak"], down["t_offset"]) == (200, r["t_offset"])


def mode_by_hand(a, k):
    h = k // 2
    p = np.pad(a, h, mode="edge")
    return [int(np.argmax(np.bincount(p[i:i + k], minlength=4))) for i in range(len(a))]


def test_runs_modes_and_extrema(spark):
    a = [int(v) for v in np.random.default_rng(9).integers(0, 4, size=50)]
    d = spark.createDataFrame([(a,)], "a array<int>")
    assert d.select(S.mode_filter(F.col("a"), 9)).first()[0] == mode_by_hand(np.array(a), 9)
    assert d.select(S.mode_filter(F.col("a"), 4)).first()[0] == mode_by_hand(np.array(a), 5)
    r = spark.createDataFrame([([2, 2, 0, 1, 1, 1],)], "a array<int>").select(S.runs(F.col("a"))).first()[0]
    assert [tuple(x) for x in r] == [(2, 0, 1), (0, 2, 2), (1, 3, 5)]
    x = spark.createDataFrame([([0.0, 2.0, 2.0, 2.0, 1.0, 3.0, 3.0],)], "a array<double>")
    assert x.select(S.local_extrema(F.col("a"))).first()[0] == [2]
    assert x.select(S.local_extrema(F.col("a"), "min")).first()[0] == [4]


def test_region_choice(spark):
    d = spark.createDataFrame([([2] * 3 + [0] * 2 + [2] * 5 + [0] * 2 + [2] * 5,)], "a array<int>").withColumn("r", S.runs(F.col("a")))
    pick = lambda **k: d.select(S.pick_region(F.col("r"), 2, 2, **k)).first()[0]
    assert pick()["start"] == 5  # the longest, the first on a tie
    assert pick(largest=False)["start"] == 0
    assert pick(anchor=F.lit(13))["start"] == 12
    assert pick(window=(F.lit(0), F.lit(1)))["start"] == 0
    assert pick(window=(F.lit(3), F.lit(4)))["start"] == 5
    assert pick(window=(F.lit(3), F.lit(4)), strict=True) is None


def test_deflection_names(spark):
    def name(v, **k):
        d = spark.createDataFrame([([float(x) for x in v],)], "a array<double>")
        return d.select(S.name_deflections(F.col("a"), F.lit(0), F.lit(len(v) - 1), **k).alias("n")).first()["n"]

    r = name([0, -0.3, 0, 1.0, 0.2, -0.6, 0])
    assert (r["q_peak"], r["r_peak"], r["s_peak"], r["pattern"]) == (1, 3, 5, "qRS")
    qs = name([0, -0.4, -1.0, -0.4, 0])
    assert (qs["q_peak"], qs["r_peak"], qs["pattern"]) == (2, None, "QS")
    two = [0, 0.5, 0.1, 1.0, 0]
    assert name(two)["r_peak"] == 1 and name(two, choose="largest")["r_peak"] == 3
    assert name([0, 1])["pattern"] == ""


def window(spark):
    n = 80
    t = [0] * 10 + [1] * 8 + [0] * 6 + [2] * 8 + [0] * 10 + [3] * 16 + [0] * 22
    x = np.cos(np.arange(n) / 5.0)
    marks = dict(p_onset=10.0, p_peak=13.0, p_offset=17.0, qrs_onset=24.0, q_peak=None, r_peak=27.0, s_peak=29.0, qrs_offset=31.0, t_onset=42.0, t_peak=49.0, t_offset=57.0)
    row = ("r", "I", [float(v) for v in x], [True] * n, t, 4, 70, *[marks[c] for c in LM])
    schema = "record_id string, lead string, trace array<double>, valid array<boolean>, target array<int>, win_lo int, win_hi int, " + ", ".join(f"{c} double" for c in LM)
    return spark.createDataFrame([row], schema), x, t


def test_augmentations_move_everything_together(spark):
    d, x, t = window(spark)
    on = F.lit(True)
    s = X.stretch_last_limb(d, F.lit(1.5), on).first()
    assert s["t_offset"] == 49 + 12 and s["target"][61] == 3 and s["target"][62] == 0 and s["t_peak"] == 49
    short = X.stretch_last_limb(d, F.lit(0.5), on).first()
    assert short["t_offset"] == 53 and short["target"][53] == 3 and short["target"][54:58] == [0] * 4 and short["trace"][60] == x[60]
    m = X.mask_wave(d, on, blend=2).first()
    assert 1 not in m["target"] and m["p_peak"] is None and np.allclose(np.diff(m["trace"][8:20], 2), 0, atol=1e-12)
    dn = X.mask_wave(d, on, blend=2, donor=F.lit(0.4)).first()
    assert dn["trace"][8] == pytest.approx(x[8]) and dn["trace"][19] == pytest.approx(x[19])
    c = X.truncate_context(d, F.lit(24), F.lit(2), on).first()
    assert c["target"][:22] == [None] * 22 and c["p_onset"] is None and c["qrs_onset"] == 24 and not any(c["valid"][:22])
    j = X.jitter_last_offset(d, F.lit(-30)).first()
    assert j["t_offset"] == 50 and j["target"][50] == 3 and j["target"][51] == 0
    a = X.scale_last_wave(d, F.lit(0.5), on).first()
    assert a["trace"][42] == pytest.approx(x[42]) and a["trace"][57] == pytest.approx(x[57]) and a["target"] == t
    w = X.time_warp(d, F.lit(1.1)).first()
    assert w["t_offset"] == pytest.approx(62.7) and len(w["trace"]) == 80
    i = X.isolate_beat(d, F.lit(8), F.lit(60), F.lit(6), on).first()
    assert i["valid"].index(True) == 8 and i["valid"].count(True) == 59 and len(set(i["trace"][61:67])) == 1


def test_noise_is_reproducible_and_spares_the_target_channel(spark):
    d, x, _ = window(spark)
    kw = dict(keys=["record_id"], seed=3, noise=0.2, dropout=1.0)
    a = X.signal_noise(d, protect=F.lit(True), **kw).first()["trace"]
    b = X.signal_noise(d.repartition(3), protect=F.lit(True), **kw).first()["trace"]
    assert a == b and 0.1 < np.std(np.array(a) - x) < 0.3
    assert set(X.signal_noise(d, protect=F.lit(False), **kw).first()["trace"]) == {0.0}


def test_audit_catches_a_transform_that_never_fires(spark):
    d = spark.range(100).withColumns({"fired_a": F.col("id") < 20, "fired_b": F.lit(False), "fired_c": F.lit(False)})
    r = {x["transform"]: x["ok"] for x in X.fired_rates(d, {"a": 0.3, "b": 0.3, "c": 0.05}).collect()}
    assert r == {"a": 1, "b": 0, "c": 1}


# ---------------------------------------------------------------- sources and sinks


def test_landmark_csv_and_quarantine(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("record_id,lead,beat_id,x,note\nr1,I,1,12.0,\nr1,I,2,None,hello\nr1,I,3,NaN,None\nr1,,oops,4,z\n")
    schema = T._parse_datatype_string("record_id string, lead string, beat_id int, x int, note string, later int")
    d = readers.read_landmarks(spark, str(p), schema)
    assert [r["x"] for r in d.collect()] == [12, None, None, 4]
    assert [r["note"] for r in d.collect()] == [None, "hello", None, "z"]
    good, bad = readers.split_bad_rows(d, ["record_id", "lead", "beat_id"])
    assert good.count() == 3 and bad.first()["error"].endswith("lead,beat_id")
    pruned = readers.read_landmarks(spark, str(p), schema, columns=["x"])
    assert pruned.columns == ["x"]


def test_waveform_files_in_both_orientations(spark, tmp_path):
    (tmp_path / "a_raw.csv").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "b_raw.csv").write_text("1,4\n2,5\n3,6\n")
    (tmp_path / "c_raw.csv").write_text("1,2,3\n4,5,6\n7,8,9\n")
    (tmp_path / "d_raw.csv").write_text("1,2\n4,x\n")
    good, bad = readers.read_waveforms(spark, str(tmp_path), ["I", "II"], suffix="_raw")
    got = {(r["record_id"], r["lead"]): r["trace"] for r in good.collect()}
    assert got[("a", "II")] == [4, 5, 6] == got[("b", "II")] and got[("a", "I")] == [1, 2, 3] == got[("b", "I")]
    assert {r["record_id"]: r["error"] for r in bad.collect()} == {"c": "expected 2 channels, got 3 x 3", "d": "non-numeric cell"}
    kept, problems = writers.cache_waveforms(good, str(tmp_path / "cache"), 2)
    assert problems.count() == 0 and spark.read.parquet(str(tmp_path / "cache")).count() == 4
    assert writers.length_histogram(kept).first().asDict() == {"n_samples": 3, "n": 4}


def test_json_lines_keep_the_last_and_set_errors_apart(spark, tmp_path):
    lines = [{"k": "a", "v": 1}, {"k": "a", "v": 2}, {"k": "b", "error": "boom"}, {"k": "c", "v": 5}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    good, bad = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k string, v int", ["k"])
    assert sorted((r["k"], r["v"]) for r in good.collect()) == [("a", 2), ("c", 5)] and bad.first()["error"] == "boom"


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("##REC one\n1\n2\n##REC two\n3\n")
    got = sorted((r["section"], r["line"]) for r in readers.read_sections(spark, str(tmp_path / "s.txt")).collect())
    assert got == [("one", "1"), ("one", "2"), ("two", "3")]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(["##REC one", "1", "2", "##REC two", "3"])], "n long, value string").withColumn("f", F.lit(1))
    assert sorted((r["section"], r["value"]) for r in readers.fill_sections(d, ["f"], "n").collect()) == got
    (tmp_path / "h.json").write_text(json.dumps([{"epoch": 1, "val": {"loss": 0.5}}, {"epoch": 2, "val": {"loss": 0.25}}]))
    h = readers.read_history(spark, str(tmp_path / "h.json"), "struct<epoch:int,val:struct<loss:double>>")
    assert sorted((r["epoch"], r["val_loss"]) for r in h.collect()) == [(1, 0.5), (2, 0.25)]
    (tmp_path / "kv.txt").write_text("p/1.txt:APD.min,200\np/1.txt:APD.max,300\np/2.txt:other,1\n")
    assert readers.read_key_values(spark, str(tmp_path / "kv.txt"), ["APD.min", "APD.max"]).first().asDict() == {"path": "p/1.txt", "APD.min": 200.0, "APD.max": 300.0}


def test_versions_never_overwrite(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([(1,)], "n int")
    assert writers.write_versioned(a, root, write=False) is None
    writers.write_versioned(a, root)
    before = writers.read_current(spark, root)
    writers.write_versioned(before.withColumn("n", F.col("n") + 1), root)  # reads what it replaces
    assert writers.read_current(spark, root).first()["n"] == 2 and before.first()["n"] == 1
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "batch int, v string")
    writers.write_batches(b, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["batch=1", "batch=2"]


# ---------------------------------------------------------------- streams


def test_qc_stream_resumes(spark, tmp_path):
    cols = ", ".join(f"{c} long" for c in LM)
    schema = f"record_id string, lead string, beat_id int, fs_hz double, {cols}"
    row = lambda i: ("r", "I", i, 500.0, 100, 120, 140, 160, 168, 175, 185, 210, 260, 300, 350)
    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in (1, 2):
        spark.createDataFrame([row(k)], schema).write.mode("append").parquet(src)
        streaming.drain(streaming.qc_stream(spark, src, schema, sink, cp))
    out = spark.read.parquet(sink)
    assert sorted(r["beat_id"] for r in out.collect()) == [1, 2] and out.filter("qc_status = 'clean'").count() == 2


def test_feed_upserts_into_versions(spark, tmp_path):
    schema = "record_id string, lead string, edited_at timestamp, v int"
    src, root, cp = (str(tmp_path / x) for x in ("in", "t", "cp"))
    for ts, v in (("2024-01-02", 1), ("2024-01-01", 2), ("2024-01-03", 3)):
        d = spark.createDataFrame([("r", "I", ts, v)], "record_id string, lead string, t string, v int").select("record_id", "lead", F.to_timestamp("t").alias("edited_at"), "v")
        d.write.mode("append").parquet(src)
        streaming.drain(streaming.apply_feed(spark, src, schema, root, cp))
    assert [r["v"] for r in buckets.read_buckets(spark, root).collect()] == [3]


def test_late_events_are_dropped(spark, tmp_path):
    schema = "ts timestamp, u int"
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    (tmp_path / "in").mkdir()
    stream = streaming.rate_monitor(spark.readStream.schema(schema).parquet(src), "ts", ["u"], "1 hour", watermark="10 minutes")
    spark.createDataFrame([("2024-01-01 00:10:00", 1)], "t string, u int").select(F.to_timestamp("t").alias("ts"), "u").write.mode("append").parquet(src)
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", cp).start()
    try:
        q.processAllAvailable()
        for t in ("2024-01-01 05:00:00", "2024-01-01 00:20:00", "2024-01-01 09:00:00"):
            spark.createDataFrame([(t, 1)], "t string, u int").select(F.to_timestamp("t").alias("ts"), "u").write.mode("append").parquet(src)
            q.processAllAvailable()
        got = {str(r["from_ts"])[11:13]: r["n"] for r in spark.table("late").collect()}
    finally:
        q.stop()
    assert got == {"00": 1, "05": 1}


# ---------------------------------------------------------------- contract


def test_user_models_score_in_batches(spark):
    d = spark.range(10).select("id", F.array(F.col("id").cast("double")).alias("trace"))
    out = Z.score_units(d, lambda p: p.assign(n=p["trace"].map(len))[["id", "n"]], "id long, n long")
    assert out.agg(F.sum("n")).first()[0] == 10


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    r = entry.entry(spark)
    assert r.columns == ["disease_class", "qc_status", "n"] and r.count() > 0


def test_json_text_has_no_nan(spark):
    from waymark.functions.scalar import json_text

    d = spark.createDataFrame([(1.5, float("nan"))], "a double, b double")
    assert json.loads(d.select(json_text(F.struct("a", "b"))).first()[0]) == {"a": 1.5, "b": None}


def test_report_text(spark):
    d = spark.createDataFrame([("b", None), ("a", 1.5)], "k string, v double")
    assert Z.report_text(d, ["k", "v"], width=6).splitlines() == ["     k     v", "     a  1.50", "     b    --"]
    with pytest.raises(ValueError, match="at most 1"):
        Z.report_text(d, ["k", "v"], most=1)
    lines = Z.report_lines([("Part one", d, ["k", "v"]), ("Part two", d, ["k"])], width=6, digits=2).orderBy("part", "place").collect()
    assert [r["line"] for r in lines] == ["Part one", "     k     v", "     a  1.50", "     b    --", "Part two", "     k", "     a", "     b"]


def test_limb_leads_keep_a_record_that_lacks_leads(spark, tmp_path):
    rows = [(i, [float(i + j) for j in range(4)]) for i in (0, 1, 2, 3, 8, 9, 21)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.record_id, r["sample"]): r for r in entry.queries()["limb_leads"](spark, str(tmp_path)).collect()}
    assert set(got) == {(r, s) for r in (0, 1, 2) for s in range(4)}
    assert got[0, 2].II == 2.0 and got[0, 2].V1 == 2.0
    assert got[1, 3].I == 1.0 and got[1, 3].II is None and got[1, 3].aVR is None and got[2, 0].I is None


def test_label_targets_lay_out_each_kind_of_beat_once(spark):
    sf = "/root/testdata/sf0.001"
    q = entry.queries()["label_targets"](spark, sf)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "AS beats" in plan[plan.index("Generate explode"):]
    con = __import__("duckdb").connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT lead, label, n FROM ({entry.oracle_sql()['label_targets']}) q").fetchall()
    assert sorted((r.lead, r.label, r.n) for r in q.select("lead", "label", "n").collect()) == sorted(want)
