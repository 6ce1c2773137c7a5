"""Scoring predictions: confusion matrices, tolerance matching, error summaries, comparisons."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import half_even, ratio
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from .derive import BIOMARKERS
from .infer import cluster_bootstrap, cluster_bootstraps, verdict
from .ordered import attach
from .quantiles import grouped_quantiles, refined_quantiles

TOLERANCES_MS = (10, 25, 50, 75, 150)


# ---------------------------------------------------------------- label sequences


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), arrays: bool = False) -> DataFrame:
    """Counts by (truth, pred); pairs whose truth is absent are ignored."""
    if arrays:
        df = df.select(*by, F.inline(F.arrays_zip(F.col(truth).alias("truth"), F.col(pred).alias("pred"))))
    else:
        df = df.select(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
    return df.filter("truth is not null").groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, F1, IoU and support per class; undefined ratios are NULL."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("act"), F.lit(0).cast("bigint").alias("prd"), hit.alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("act"), F.col("n").alias("prd"), F.lit(0).cast("bigint").alias("tp")),
    )
    s = conf.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("act").alias("support"), F.sum("prd").alias("predicted")
    )
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    iou = ratio(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp"))
    return s.withColumns({"f1": f1, "iou": iou})


def mean_class_metrics(metrics: DataFrame, waves: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Means over the wave classes (undefined ones skipped), over all classes, and accuracy."""
    wave = F.col("class").isin(*waves)
    return metrics.groupBy(*by).agg(
        F.avg(F.when(wave, F.col("iou"))).alias("mean_iou_waves"), F.avg(F.when(wave, F.col("f1"))).alias("mean_f1_waves"),
        F.avg("iou").alias("mean_iou_all"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
    )


# ---------------------------------------------------------------- landmark errors


def tidy_errors(
    predicted: DataFrame, truth: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, on: Sequence[str] | None = None,
    extra: Sequence[str] = (), fs: str = "fs_hz",
) -> DataFrame:
    """One row per unit and landmark: ``pred_ms``, ``truth_ms``, ``err_ms``."""
    on = list(on or keys.unit)
    p = predicted.select(*on, *[F.col(c).alias(f"_p_{c}") for c in lm.order])
    j = truth.join(p, on)
    ms = F.lit(1000.0) / F.col(fs).cast("double")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("landmark"), (F.col(f"_p_{c}") * ms).alias("pred_ms"), (F.col(c) * ms).alias("truth_ms"))
            for c in lm.order
        ]
    )
    return j.select(*on, *extra, F.inline(cells)).withColumn("err_ms", F.col("pred_ms") - F.col("truth_ms"))


def detection_counts(errors: DataFrame, by: Sequence[str] = ("landmark",), primary_ms: float = 25.0) -> DataFrame:
    """tp / fp / fn / tn; a pair beyond the tolerance is both a false positive and a miss."""
    t, p = F.col("truth_ms").isNotNull(), F.col("pred_ms").isNotNull()
    near = F.abs("err_ms") <= primary_ms
    far = t & p & ~near
    return errors.groupBy(*by).agg(
        F.count_if(t & p & near).alias("tp"), F.count_if(far | (p & ~t)).alias("fp"), F.count_if(far | (t & ~p)).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )


def landmark_errors(
    errors: DataFrame, by: Sequence[str] = ("landmark",), primary_ms: float = 25.0, tolerances: Sequence[int] = TOLERANCES_MS,
) -> DataFrame:
    """Detection counts and rates, and the error summary over rows where both are present."""
    by = list(by)
    det = detection_counts(errors, by, primary_ms)
    e = F.col("err_ms")
    tr, pr = F.when(e.isNotNull(), F.col("truth_ms")), F.when(e.isNotNull(), F.col("pred_ms"))
    aggs = [
        F.count(e).alias("n_compared"), F.count("truth_ms").alias("n_truth"), F.count("pred_ms").alias("n_pred"),
        F.avg(e).alias("bias_ms"), F.avg(F.abs(e)).alias("mae_ms"), F.stddev_samp(e).alias("sd_ms"),
        *[F.avg((F.abs(e) <= t).cast("int")).alias(f"within_{t}ms") for t in tolerances],
        F.stddev_samp(pr).alias("predicted_sd_ms"), F.stddev_samp(tr).alias("reference_sd_ms"),
        F.var_pop(tr).alias("_vt"), F.var_pop(pr).alias("_vp"),
        F.covar_pop(tr, pr).alias("_cov"),
    ]
    s = errors.groupBy(*by).agg(*aggs)
    q = grouped_quantiles(errors.withColumn("_a", F.abs(e)), by, "_a", [0.5, 0.95], ["median_abs_ms", "p95_abs_ms"])
    j = det.join(s, by).join(q, by, "left")
    sens = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    prec = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    vary = (F.col("_vt") > 0) & (F.col("_vp") > 0) & (F.col("n_compared") > 1)
    j = j.withColumns({"sensitivity": sens, "precision": prec, "coverage": ratio(F.col("n_compared"), F.col("n_truth"))})
    return j.withColumns(
        {
            "f1": F.try_divide(F.lit(2.0) * F.col("sensitivity") * F.col("precision"), F.col("sensitivity") + F.col("precision")),
            "response_slope": F.when(vary, F.try_divide(F.col("_cov"), F.col("_vt"))),
            "response_r": F.when(vary, F.try_divide(F.col("_cov"), F.sqrt(F.col("_vt") * F.col("_vp")))),
        }
    ).drop("_vt", "_vp", "_cov")


def macro(summary: DataFrame, groups: Mapping[str, Sequence[str]], metrics: Sequence[str] = ("mae_ms",), by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over the landmarks of each named group; undefined ones are skipped."""
    aggs = [
        F.avg(F.when(F.col("landmark").isin(*names), F.col(m))).alias(f"{g}_{m}") for g, names in groups.items() for m in metrics
    ]
    return summary.groupBy(*by).agg(*aggs)


def by_group(errors: DataFrame, by: Sequence[str], landmarks: Sequence[str]) -> DataFrame:
    """All errors of a group pooled (not averaged per landmark first)."""
    return errors.filter(F.col("landmark").isin(*landmarks)).groupBy(*by).agg(
        F.count("err_ms").alias("n_landmarks"), F.avg("err_ms").alias("bias_ms"), F.avg(F.abs("err_ms")).alias("mae_ms")
    )


def biomarker_errors(
    predicted: DataFrame, truth: DataFrame, keys: Keys = KEYS, fs: str = "fs_hz", pairs: Mapping[str, tuple[str, str]] = BIOMARKERS,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Predicted minus reference interval per unit: rows (unit, biomarker, err_ms)."""
    need = sorted({c for ab in pairs.values() for c in ab})
    p = predicted.select(*keys.unit, *[F.col(c).alias(f"_p_{c}") for c in need])
    ms = F.lit(1000.0) / F.col(fs).cast("double")
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("biomarker"), (((F.col(f"_p_{a}") - F.col(f"_p_{b}")) - (F.col(a) - F.col(b))) * ms).alias("err_ms"))
            for n, (a, b) in pairs.items()
        ]
    )
    return truth.join(p, keys.unit).select(*keys.unit, *extra, F.inline(cells))


def biomarker_summary(errors: DataFrame, by: Sequence[str] = ("biomarker",)) -> DataFrame:
    s = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count("err_ms").alias("n_comparable"),
        ratio(F.count("err_ms"), F.count(F.lit(1))).alias("coverage"),
        F.avg("err_ms").alias("bias_ms"), F.avg(F.abs("err_ms")).alias("mae_ms"), F.stddev_samp("err_ms").alias("sd_ms"),
    )
    q = grouped_quantiles(errors.withColumn("_a", F.abs("err_ms")), list(by), "_a", [0.95], ["p95_abs_ms"])
    return s.join(q, list(by), "left")


def per_unit_errors(
    predicted: DataFrame, truth: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, fs: str = "fs_hz", crop_start: str | None = None,
    extra: Sequence[str] = (), anchor: str | None = None,
) -> DataFrame:
    """Wide table ``<lm>_pred``, ``<lm>_true`` (absolute samples), ``<lm>_err_ms`` per unit.

    ``anchor`` names a truth column; ``anchor_in_core`` says whether it lies in the predicted core.
    """
    p = predicted.select(*keys.unit, *[F.col(c).alias(f"_p_{c}") for c in lm.order])
    j = truth.join(p, keys.unit)
    base = F.col(crop_start) if crop_start else F.lit(0)
    ms = F.lit(1000.0) / F.col(fs).cast("double")
    cols = []
    for c in lm.order:
        cols += [
            half_even((F.col(f"_p_{c}") + base).cast("double")).cast("bigint").alias(f"{c}_pred"),
            half_even((F.col(c) + base).cast("double")).cast("bigint").alias(f"{c}_true"),
            F.round((F.col(f"_p_{c}") - F.col(c)) * ms, 3).alias(f"{c}_err_ms"),
        ]
    if anchor:
        inside = F.col(anchor).between(F.col(f"_p_{lm.core_wave.onset}"), F.col(f"_p_{lm.core_wave.offset}"))
        cols.append(inside.cast("int").alias("anchor_in_core"))
    return j.select(*keys.unit, *extra, *cols)


def geometry_audit(
    df: DataFrame, first_true: str, last_true: str, last_pred: str, crop_start: str, crop_length: int, window_end: str, read_end: str,
) -> DataFrame:
    """Where events sit in their crops, and predictions cut off at the edge of what could be seen."""
    d = df.withColumns(
        {
            "_slack": (F.col(window_end) - F.col(last_true)).cast("double"),
            "_off": (F.col(first_true) + F.col(last_true)) / F.lit(2.0) - F.col(crop_start) - F.lit(crop_length / 2.0),
        }
    )
    dw, dr = F.col(last_pred) - F.col(window_end), F.col(last_pred) - F.col(read_end)
    a = d.agg(
        F.count(last_pred).alias("n_pred"), F.count_if(dw == 0).alias("on_window_edge"), F.count_if(dw > 0).alias("past_window_edge"),
        F.count_if(dr == 0).alias("on_read_edge"), F.count_if(dr > 0).alias("past_read_edge"), F.count("_off").alias("_k"),
    )
    s = grouped_quantiles(d, [], "_slack", [0.5], ["window_slack_samples"])
    o = grouped_quantiles(d, [], "_off", [0.5, 0.25, 0.75], ["centre_offset_samples", "_lo", "_hi"])
    j = a.crossJoin(s).crossJoin(o)
    return j.select(
        "n_pred", "on_window_edge", "past_window_edge", "on_read_edge", "past_read_edge", "window_slack_samples", "centre_offset_samples",
        F.when(F.col("_k") > 3, F.col("_hi") - F.col("_lo")).alias("centre_offset_iqr"),
        (F.col("on_read_edge") > 0.05 * F.col("n_pred")).cast("int").alias("edge_warning"),
        (F.col("window_slack_samples") > 150).cast("int").alias("tail_warning"),
    )


# ---------------------------------------------------------------- strata, panels, queries

CELLS = ("A", "B", "C", "D")


def observability_cell(truncated: Column, p_present: Column) -> Column:
    """A whole with P, B truncated with P, C whole without P, D truncated without."""
    return F.when(~truncated & p_present, "A").when(p_present, "B").when(~truncated, "C").otherwise("D")


def cell_rates(df: DataFrame, cell: str, correct: Column, emits: Column) -> DataFrame:
    return df.groupBy(cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct.cast("int")).alias("share_correct"), F.avg(emits.cast("int")).alias("share_emitting")
    )


def worst_case_score(
    panels: DataFrame, by: Sequence[str] = (), miss_ms: float = 150.0, slope_ms: float = 50.0, iou_floor: float | None = None, iou: str = "mean_iou",
) -> DataFrame:
    """Largest of mae + 150(1-coverage) + 50|1-slope| over the panels; infinite where undefined."""
    inf = F.lit(float("inf"))
    s = F.col("mae_ms") + F.lit(miss_ms) * (1 - F.col("coverage")) + F.lit(slope_ms) * F.abs(1 - F.col("response_slope"))
    s = F.coalesce(s, inf)
    if iou_floor is not None:
        s = F.when(F.coalesce(F.col(iou) < iou_floor, F.lit(True)), inf).otherwise(s)
    return panels.groupBy(*by).agg(F.max(s).alias("worst_score"))


def query_spread(df: DataFrame, unit: Sequence[str], position: str = "pred_ms", by: Sequence[str] = ("landmark",)) -> DataFrame:
    """How far a unit's prediction moves over its queries: mean and median SD, share that moves."""
    per = df.groupBy(*by, *unit).agg(F.stddev_samp(position).alias("_sd"), F.count_distinct(position).alias("_m"))
    a = per.groupBy(*by).agg(F.avg("_sd").alias("mean_sd_ms"), F.avg((F.col("_m") > 1).cast("int")).alias("share_moved"))
    # Spreads are continuous, so their median goes through the histogram form.
    med = refined_quantiles(per, by, "_sd", [0.5]).select(*by, F.col("_sd").alias("median_sd_ms"))
    return a.join(med, list(by), "left")


def matched_ratio(df: DataFrame, matched: Column, by: Sequence[str] = ("landmark",), err: str = "err_ms") -> DataFrame:
    a = df.groupBy(*by).agg(
        F.avg(F.when(matched, F.abs(err))).alias("matched_mae_ms"), F.avg(F.when(~matched, F.abs(err))).alias("mismatched_mae_ms")
    )
    return a.withColumn("ratio", F.try_divide("mismatched_mae_ms", "matched_mae_ms"))


def degradation(df: DataFrame, unit: Sequence[str], true_col: str, query_col: str, mae: str) -> DataFrame:
    """Per unit and wrong query: its error minus the error under the right query."""
    right = F.max(F.when(F.col(true_col) == F.col(query_col), F.col(mae))).alias("_m0")
    j = attach(df, unit, right).filter(F.col(true_col) != F.col(query_col))
    return j.withColumn("degradation_ms", F.col(mae) - F.col("_m0")).filter("degradation_ms is not null").drop("_m0")


def degradation_matrix(deg: DataFrame, true_col: str, query_col: str, queries: Sequence) -> DataFrame:
    """Mean degradation, true channel by asked channel."""
    return deg.groupBy(true_col).pivot(query_col, list(queries)).agg(F.round(F.avg("degradation_ms"), 6))


def constant_predictor(errors: DataFrame, by: Sequence[str] = ("landmark",)) -> DataFrame:
    """Error of always answering the corpus median: adds ``const_err_ms``."""
    med = grouped_quantiles(errors, list(by), "truth_ms", [0.5], ["_med"])
    return errors.join(med, list(by), "left").withColumn("const_err_ms", F.col("_med") - F.col("truth_ms")).drop("_med")


def fold_means(runs: DataFrame, by: Sequence[str], err: str = "err_ms") -> DataFrame:
    """Mean absolute error per group, pooled over all folds' rows."""
    return runs.groupBy(*by).agg(F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae_ms"))


# ---------------------------------------------------------------- comparisons


def strict_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only one table has; must be empty before a 1:1 comparison."""
    x = a.select(*keys).withColumn("_a", F.lit(1))
    y = b.select(*keys).withColumn("_b", F.lit(1))
    return x.join(y, list(keys), "full").filter("_a is null or _b is null").select(
        *keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in")
    )


def mean_present(cols: Sequence[Column]) -> Column:
    """Row mean over the present values."""
    vals = F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull())
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / F.size(vals))


# Fixed values of the verdict column.
VERDICTS = ("baseline is closer", "model is closer", "no clear difference")


def compare(
    rows: DataFrame, by: Sequence[str], base: str, model: str, cluster: str, n: int = 5000, seed: int = 1337, names: tuple[str, str, str] = VERDICTS,
) -> DataFrame:
    """Absolute errors of two systems on the same rows, clustered; ``by`` may hold split and landmark. All three intervals use the same draws."""
    by = list(by)
    r = rows.withColumns({"_b": F.abs(base), "_m": F.abs(model)})
    out = cluster_bootstraps(r.withColumn("_d", F.col("_m") - F.col("_b")), by, ["_b", "_m", "_d"], cluster, "record_mean", n, seed)
    ends = [F.col(f"{c}_{i}").alias(f"{name}_{end}") for i, name in enumerate(("baseline", "model", "diff")) for c, end in (("point", "ms"), ("ci_lo", "lo"), ("ci_hi", "hi"))]
    out = out.select(*by, F.col("n_clusters_0").alias("n_clusters"), *ends)
    return out.withColumn("verdict", verdict(F.col("diff_lo"), F.col("diff_hi"), names[1], names[0], names[2]))


def comparison_rows(
    units: DataFrame, truth: str, base: str, model: str, landmarks: Sequence[str], boundaries: Sequence[str], biomarkers: Mapping[str, tuple[str, str]],
    splits: Mapping[str, Column], cluster: str = "record_id",
) -> DataFrame:
    """Long rows (split, measure, cluster, base_err, model_err) of two systems' readings of the same units, for ``compare``.

    ``truth``, ``base`` and ``model`` are column patterns in ms such as ``"true_{}"``. Measures: each landmark's error; ``boundary``, a unit's mean
    absolute error over the present of ``boundaries``; and each biomarker, the error of the interval between its two landmarks. A unit
    counts in every split whose condition it meets.
    """
    def err(of: str, k: str) -> Column:
        return F.col(of.format(k)) - F.col(truth.format(k))

    measures: dict[str, Callable[[str], Column]] = {k: lambda of, k=k: err(of, k) for k in landmarks}
    measures["boundary"] = lambda of: mean_present([F.abs(err(of, k)) for k in boundaries])
    measures |= {name: lambda of, s=s, e=e: err(of, e) - err(of, s) for name, (s, e) in biomarkers.items()}
    inside = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in splits.items()]))
    errors = {out: F.array(*[m(of).cast("double") for m in measures.values()]) for out, of in (("_b", base), ("_m", model))}
    wide = units.select(cluster, inside.alias("_in"), *[e.alias(out) for out, e in errors.items()])
    # the names are exploded, not the errors: a generator over computed structs is planned very slowly
    long = wide.select(cluster, "_b", "_m", F.explode("_in").alias("split")).select("*", F.posexplode(F.array(*[F.lit(m) for m in measures])).alias("_i", "measure"))
    return long.select("split", "measure", cluster, F.get("_b", F.col("_i")).alias("base_err"), F.get("_m", F.col("_i")).alias("model_err"))


def adjustment_ladder(
    units: DataFrame, steps: Sequence[tuple[str, Sequence[str], Mapping[str, float]]], base: str, model: str, cluster: str, n: int = 4000, seed: int = 1337,
) -> DataFrame:
    """Re-score under named adjustments: (label, landmarks, constant offsets taken off the model).

    ``base`` and ``model`` are column patterns such as ``"base_{}"``.
    """
    cells = []
    for label, marks, offsets in steps:
        b = mean_present([F.abs(F.col(base.format(m))) for m in marks])
        a = mean_present([F.abs(F.col(model.format(m)) - F.lit(float(offsets.get(m, 0.0)))) for m in marks])
        cells.append(F.struct(F.lit(label).alias("step"), a.alias("model_mae"), b.alias("base_mae")))
    r = units.select(cluster, F.inline(F.array(*cells))).filter("model_mae is not null and base_mae is not null")
    r = r.withColumn("_d", F.col("model_mae") - F.col("base_mae"))
    point = r.groupBy("step").agg(F.avg("model_mae").alias("model_ms"), F.avg("base_mae").alias("baseline_ms"))
    ci = cluster_bootstrap(r, ["step"], "_d", cluster, "units", n, seed)
    return point.join(ci, "step").withColumn(
        "verdict", verdict(F.col("ci_lo"), F.col("ci_hi"), VERDICTS[1], VERDICTS[0], VERDICTS[2])
    )


# ---------------------------------------------------------------- user models and reports


def score_units(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's model over Arrow batches of units; rows in, rows out, no grouping.

    ``predict`` sees one batch as a pandas frame. Load weights inside it (once per worker, e.g.
    in a cached function) rather than closing over them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)


def report_lines(parts: Sequence[tuple[str, DataFrame, Sequence[str]]], width: int = 12, digits: int = 3) -> DataFrame:
    """A fixed-width text report as rows (part, place, line): per part its title, a header and one line per row in the order of its first column.

    A part is (title, table, columns): a result with one row per class, landmark or biomarker. Numbers with a fraction are rounded to ``digits``,
    absent values are two dashes, all cells are right-aligned. Nothing is collected: the rows are written or shown in the order (part, place).
    """
    def cell(table: DataFrame, c: str) -> Column:
        text = F.format_string(f"%.{digits}f", F.round(c, digits)) if dict(table.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
        return F.lpad(F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit("--")), width, " ")

    out = []
    for number, (title, table, columns) in enumerate(parts, start=1):
        head = "".join(c.rjust(width) for c in columns)
        top = table.sparkSession.createDataFrame([(0, title), (1, head)], "place int, line string")
        # one task: a part has as many rows as there are classes or landmarks
        rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(columns[0]))
        body = table.select((rank + 1).cast("int").alias("place"), F.concat(*[cell(table, c) for c in columns]).alias("line"))
        out.append(top.unionByName(body).select(F.lit(number).alias("part"), "place", "line"))
    return functools.reduce(DataFrame.unionByName, out)


def report_text(summary: DataFrame, columns: Sequence[str], title: str = "", width: int = 12, most: int = 1000) -> str:
    """Fixed-width text of a small result (one row per landmark or class); more than ``most`` rows are refused."""
    rows = summary.select(*columns).orderBy(columns[0]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")

    def cell(v) -> str:
        if v is None:
            return "--".rjust(width)
        return (f"{v:.2f}" if isinstance(v, float) else str(v)).rjust(width)

    head = "".join(c.rjust(width) for c in columns)
    return "\n".join(([title] if title else []) + [head] + ["".join(cell(v) for v in r) for r in rows])
