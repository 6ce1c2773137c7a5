"""Bias corrections: residuals of a reviewed sample, offsets, their validation and application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import DRAW_GRAIN, key_parts, with_draw
from ..functions.scalar import half_even
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from ..session import materialise
from .consensus import repair_ranked
from .infer import bootstrap_ci, is_biased, paired_delta_ci
from .ordered import with_neighbours
from .quantiles import grouped_quantiles

OUTLIER_MS = 200.0
MIN_BIAS_MS = 2.0
MIN_CLASSES = 2
MIN_CLASS_ROWS = 12
# Fixed value: the landmark never corrected, its lean being a placeholder and not a measurement.
NEVER_ADOPT = ("q_peak",)
ALL = "ALL"


def pair_residuals(
    reference: DataFrame, reviewed: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, fs: str = "fs_hz",
    class_col: str = "disease_class",
) -> DataFrame:
    """Tidy residuals reviewed - reference per unit and landmark, in ms.

    Pairs on entity and channel; residuals above 200 ms are outliers, kept but not usable.
    """
    rev = reviewed.select(*keys.unit, *[F.col(c).alias(f"_r_{c}") for c in lm.order])
    ms = F.lit(1000.0) / F.col(fs).cast("double")
    j = reference.join(rev, keys.unit)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("fiducial"), (F.col(c) * ms).alias("ref_ms"), (F.col(f"_r_{c}") * ms).alias("rev_ms"))
            for c in lm.order
        ]
    )
    tidy = j.select(*keys.unit, class_col, F.inline(cells))
    res = F.col("rev_ms") - F.col("ref_ms")
    both = F.col("ref_ms").isNotNull() & F.col("rev_ms").isNotNull()
    return tidy.withColumns(
        {
            "residual_ms": res,
            "absent_ref": F.col("ref_ms").isNull(),
            "absent_rev": F.col("rev_ms").isNull(),
            "usable": both & F.coalesce(F.abs(res) <= OUTLIER_MS, F.lit(False)),
            "outlier": both & F.coalesce(F.abs(res) > OUTLIER_MS, F.lit(False)),
        }
    )


def review_coverage(reference: DataFrame, reviewed: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """One row: reference units, paired units, their share, reviewed units the reference lacks."""
    a = reference.select(*keys.unit).distinct().withColumn("_a", F.lit(1))
    b = reviewed.select(*keys.unit).distinct().withColumn("_b", F.lit(1))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    j = a.join(b, keys.unit, "full").agg(
        F.count("_a").alias("n_reference"), both.alias("n_paired"), F.count_if(F.col("_a").isNull()).alias("n_unknown")
    )
    share = F.round(F.col("n_paired") / F.greatest(F.col("n_reference"), F.lit(1)), 6)
    return j.withColumns({"coverage": share, "low_coverage": (share < 0.95).cast("int")})


def scoped(res: DataFrame, class_col: str = "disease_class") -> DataFrame:
    """Every row once for the global scope and once for its class."""
    scopes = F.array(
        F.struct(F.lit("global").alias("scope"), F.lit(ALL).alias("scope_class")),
        F.struct(F.lit("class").alias("scope"), F.col(class_col).alias("scope_class")),
    )
    return res.select("*", F.inline(scopes))


def offset_table(res: DataFrame, lm: Landmarks = LANDMARKS_11, class_col: str = "disease_class") -> DataFrame:
    """Counts and mean absolute residual for the whole sample and each class, as grouping sets."""
    usable = F.col("usable")
    g = res.groupingSets([["fiducial"], ["fiducial", class_col]], "fiducial", class_col).agg(
        F.grouping(class_col).alias("_g"),
        F.count_if("usable").alias("n"),
        F.count_if("outlier").alias("n_outlier"),
        F.count_if("absent_ref").alias("n_absent_ref"),
        F.count_if("absent_rev").alias("n_absent_rev"),
        F.avg(F.when(usable, F.abs("residual_ms"))).alias("_mae0"),
    )
    return g.select(
        F.when(F.col("_g") == 1, "global").otherwise("class").alias("scope"),
        F.when(F.col("_g") == 1, ALL).otherwise(F.col(class_col)).alias("scope_class"),
        "fiducial", F.col("fiducial").isin(lm.boundaries).cast("int").alias("is_boundary"),
        "n", "n_outlier", "n_absent_ref", "n_absent_rev", F.round("_mae0", 2).alias("mae_before_ms"),
    )


def fit_offsets(
    res: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, class_col: str = "disease_class", n_boot: int = 5000,
    seed: int = 20260725,
) -> DataFrame:
    """Median residual with its interval per landmark, globally and per class."""
    by = ["scope", "scope_class", "fiducial"]
    res = materialise(res)
    rows = scoped(res.filter("usable"), class_col)
    ci = materialise(bootstrap_ci(rows, by, "residual_ms", keys.unit, "median", n_boot, seed)).withColumnRenamed("n", "_n")
    # The offset is one number per scope and landmark; the rows come to it by a plain equi-join.
    after = rows.join(ci.select(*by, "point"), by).groupBy(*by).agg(
        F.round(F.avg(F.abs(F.col("residual_ms") - F.col("point"))), 2).alias("mae_after_ms")
    )
    nonzero = F.coalesce((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0), F.lit(False)).cast("int")
    return (
        offset_table(res, lm, class_col).join(ci, by, "left").join(after, by, "left")
        .select(
            *by, "is_boundary", "n", "n_outlier", "n_absent_ref", "n_absent_rev",
            F.round("point", 2).alias("offset_ms"), F.round("ci_lo", 2).alias("ci_lo_ms"), F.round("ci_hi", 2).alias("ci_hi_ms"),
            nonzero.alias("nonzero"), "mae_before_ms", "mae_after_ms",
        )
    )


def _offset_columns(rows: DataFrame, offsets: DataFrame, class_col: str) -> DataFrame:
    """Add ``og`` (global offset, else 0) and ``oc`` (class offset, else global)."""
    g = offsets.filter("scope = 'global'").select("fiducial", F.col("offset_ms").alias("_og"))
    c = offsets.filter("scope = 'class'").select("fiducial", F.col("scope_class").alias(class_col), F.col("offset_ms").alias("_oc"))
    j = rows.join(g, "fiducial", "left").join(c, ["fiducial", class_col], "left")
    og = F.coalesce("_og", F.lit(0.0))
    return j.withColumns({"og": og, "oc": F.coalesce(F.col("_oc"), og)}).drop("_og", "_oc")


def _biased(rows: DataFrame, by: Sequence[str], value: str, ids, n_boot: int, seed: int, least: float) -> DataFrame:
    ci = bootstrap_ci(rows, by, value, ids, "median", n_boot, seed)
    return ci.withColumn("sig", is_biased(F.col("point"), F.col("ci_lo"), F.col("ci_hi"), least))


def _outcome(rows: DataFrame, decided: DataFrame, class_col: str) -> DataFrame:
    """Report rows: one per class where the class offsets were adopted, else one per landmark."""
    j = rows.join(decided.select("fiducial", "adopted", "vetoed"), "fiducial")
    off = F.when(F.col("adopted") == "none", F.lit(0.0)).otherwise(F.col("used"))
    label = F.when(F.col("adopted") == "class", F.col(class_col)).otherwise(F.lit(ALL))
    value = F.when(F.col("adopted") == "class", F.col("oc")).when(F.col("adopted") == "global", F.col("og")).otherwise(0.0)
    j = j.withColumns({"scope_class": label, "after_ms": F.col("residual_ms") - off, "_val": value})
    by = ["fiducial", "adopted", "vetoed", "scope_class"]
    q0 = grouped_quantiles(j, by, "residual_ms", [0.5], ["bias_before_ms"])
    q1 = grouped_quantiles(j, by, "after_ms", [0.5], ["bias_after_ms"])
    agg = j.groupBy(*by).agg(
        F.round(F.max("_val"), 2).alias("offset_ms"), F.count(F.lit(1)).alias("n_test"),
        F.round(F.avg(F.abs("residual_ms")), 2).alias("mae_before_ms"), F.round(F.avg(F.abs("after_ms")), 2).alias("mae_after_ms"),
    )
    out = agg.join(q0, by).join(q1, by)
    return out.select(
        "fiducial", F.col("adopted").alias("scope"), "scope_class", F.col("vetoed").cast("int").alias("vetoed"), "offset_ms", "n_test",
        F.round("bias_before_ms", 2).alias("bias_before_ms"), F.round("bias_after_ms", 2).alias("bias_after_ms"),
        "mae_before_ms", "mae_after_ms",
    )


def validate_offsets(
    res: DataFrame, offsets: DataFrame, keys: Keys = KEYS, class_col: str = "disease_class", min_bias: float = MIN_BIAS_MS,
    min_classes: int = MIN_CLASSES, n_boot: int = 5000, seed: int = 101,
) -> DataFrame:
    """Decide none / global / class per landmark on a held-out sample.

    Bias first (interval clear of zero and large enough), then whether single classes still lean
    after the global offset; an offset that makes the absolute error significantly worse is vetoed.
    """
    rows = _offset_columns(res.filter("usable").select(*keys.unit, class_col, "fiducial", "residual_ms"), offsets, class_col)
    rows = materialise(rows)
    b0 = _biased(rows, ["fiducial"], "residual_ms", keys.unit, n_boot, seed, min_bias)
    rg = rows.withColumn("rg", F.col("residual_ms") - F.col("og"))
    lean = _biased(rg, ["fiducial", class_col], "rg", keys.unit, n_boot, seed + 101, min_bias)
    lean = lean.groupBy("fiducial").agg(F.count_if(F.col("sig") & (F.col("n") >= MIN_CLASS_ROWS)).alias("n_lean"))
    plan = materialise(b0.join(lean, "fiducial").select(
        "fiducial", F.when(~F.col("sig"), "none").when(F.col("n_lean") >= min_classes, "class").otherwise("global").alias("plan")
    ))
    used = F.when(F.col("plan") == "class", F.col("oc")).when(F.col("plan") == "global", F.col("og")).otherwise(0.0)
    r = rows.join(plan, "fiducial").withColumn("used", used)
    r = r.withColumns({"_e1": F.abs(F.col("residual_ms") - F.col("used")), "_e0": F.abs("residual_ms")})
    delta = paired_delta_ci(r, ["fiducial"], "_e1", "_e0", keys.unit, n_boot, seed + 202)
    worse = F.coalesce(F.col("ci_lo") > 0, F.lit(False)) & (F.col("plan") != "none")
    decided = materialise(plan.join(delta, "fiducial").select(
        "fiducial", F.when(worse, "none").otherwise(F.col("plan")).alias("adopted"), worse.alias("vetoed")
    ))
    return _outcome(r, decided, class_col)


def stratified_folds(
    df: DataFrame, by: Sequence[str], ids: Sequence[str], k: int = 5, seed: int = 20260725, out: str = "fold",
) -> DataFrame:
    """Shuffle within each stratum by hash, then deal the rows to the folds in turn."""
    d = with_draw(df, "_h", seed, key_parts(df, ids))
    d = with_neighbours(d, by, "_h", ties=ids, ordinal="_i", grain=DRAW_GRAIN)
    return d.withColumn(out, (F.col("_i") - 1) % k).drop("_h", "_i")


def crossvalidate_offsets(
    res: DataFrame, offsets: DataFrame, keys: Keys = KEYS, class_col: str = "disease_class", k: int = 5,
    never_adopt: Sequence[str] = NEVER_ADOPT, min_rows: int = 40, min_bias: float = MIN_BIAS_MS, min_classes: int = MIN_CLASSES,
    n_boot: int = 5000, seed: int = 1000,
) -> DataFrame:
    """Every fold decides from the other folds; a majority of the folds must agree on a scope.

    Held-out rows are judged with the offsets of their own fold's training part. Landmarks on the
    never-adopt list or with a significantly worse error stay uncorrected. The offsets reported
    are those of the full fit.
    """
    rows = _offset_columns(res.filter("usable").select(*keys.unit, class_col, "fiducial", "residual_ms"), offsets, class_col)
    rows = materialise(rows)
    enough = rows.groupBy("fiducial").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= min_rows).select("fiducial")
    rows = materialise(stratified_folds(rows.join(enough, "fiducial", "left_semi"), ["fiducial", class_col], keys.unit, k, seed))
    others = F.array(*[F.lit(i) for i in range(k)])
    train = rows.withColumn("kf", F.explode(F.filter(others, lambda i: i != F.col("fold"))))
    b0 = _biased(train, ["fiducial", "kf"], "residual_ms", keys.unit, n_boot, seed, min_bias)
    og_k = materialise(b0.select("fiducial", "kf", F.col("point").alias("og_k"), F.col("sig").alias("has_bias")))
    leaning = train.join(og_k, ["fiducial", "kf"]).withColumn("rg", F.col("residual_ms") - F.col("og_k"))
    per_class = _biased(leaning, ["fiducial", "kf", class_col], "rg", keys.unit, n_boot, seed + 1000, min_bias)
    n_lean = per_class.groupBy("fiducial", "kf").agg(
        F.count_if(F.col("sig") & (F.col("n") >= MIN_CLASS_ROWS)).alias("n_lean")
    )
    votes = materialise(og_k.join(n_lean, ["fiducial", "kf"], "left").select(
        "fiducial", "kf", "og_k",
        F.when(~F.col("has_bias"), "none").when(F.col("n_lean") >= min_classes, "class").otherwise("global").alias("vote"),
    ))
    oc_k = grouped_quantiles(train, ["fiducial", "kf", class_col], "residual_ms", [0.5], ["oc_k"])
    test = rows.withColumnRenamed("fold", "kf").join(votes, ["fiducial", "kf"]).join(oc_k, ["fiducial", "kf", class_col], "left")
    used = F.when(F.col("vote") == "class", F.coalesce("oc_k", "og_k")).when(F.col("vote") == "global", F.col("og_k")).otherwise(0.0)
    test = materialise(test.withColumn("used", used))
    test = test.withColumns({"_e1": F.abs(F.col("residual_ms") - F.col("used")), "_e0": F.abs("residual_ms")})
    delta = paired_delta_ci(test, ["fiducial"], "_e1", "_e0", keys.unit, n_boot, seed + 202).select("fiducial", "ci_lo")
    tally = votes.groupBy("fiducial").agg(*[F.count_if(F.col("vote") == v).alias(f"n_{v}") for v in ("none", "global", "class")])
    half = k // 2
    plan = F.when(F.col("n_class") > half, "class").when(F.col("n_global") > half, "global").otherwise("none")
    barred = F.col("fiducial").isin(*never_adopt) if never_adopt else F.lit(False)
    veto = (plan != "none") & (barred | F.coalesce(F.col("ci_lo") > 0, F.lit(False)))
    decided = materialise(tally.join(delta, "fiducial", "left").select(
        "fiducial", F.when(veto, "none").otherwise(plan).alias("adopted"), veto.alias("vetoed")
    ))
    return _outcome(test, decided, class_col)


def fold_spread(res: DataFrame, keys: Keys = KEYS, class_col: str = "disease_class", k: int = 5, seed: int = 1000) -> DataFrame:
    """Training medians of the folds per landmark: lowest, highest and their distance."""
    rows = stratified_folds(res.filter("usable"), ["fiducial", class_col], keys.unit, k, seed)
    # Equal residuals of a fold are counted before the fold is laid out for every training part it belongs to.
    counts = rows.groupBy("fiducial", "fold", "residual_ms").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("residual_ms").isNotNull())
    train = counts.withColumn("kf", F.explode(F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda i: i != F.col("fold"))))
    med = train.groupBy("fiducial", "kf").agg(F.percentile("residual_ms", 0.5, F.col("_n")).alias("m"))
    return med.groupBy("fiducial").agg(
        F.min("m").alias("lowest_ms"), F.max("m").alias("highest_ms"), (F.max("m") - F.min("m")).alias("spread_ms")
    )


def apply_offsets(
    df: DataFrame, validated: DataFrame, lm: Landmarks = LANDMARKS_11, class_col: str = "disease_class", fs: str = "fs_hz",
    strict: bool = False, held_out: DataFrame | None = None, keys: Keys = KEYS,
) -> DataFrame:
    """Shift landmarks by their adopted offsets, restore the order, round.

    A class row counts where there is one, else the global row, else nothing. Corrected landmarks
    hold their place in the order repair. Adds ``shift_<landmark>`` and the repair's diagnostics.
    """
    live = validated.filter("scope <> 'none'")
    # Landmarks x 1 numbers and names: one row, safe to broadcast.
    g = live.agg(
        F.collect_set("fiducial").alias("_pins"),
        *[F.max(F.when((F.col("fiducial") == c) & (F.col("scope") == "global"), F.col("offset_ms"))).alias(f"_g_{c}") for c in lm.order],
    )
    per_class = live.filter("scope = 'class'").groupBy(F.col("scope_class").alias(class_col)).agg(
        *[F.max(F.when(F.col("fiducial") == c, F.col("offset_ms"))).alias(f"_c_{c}") for c in lm.order]
    )
    d = df if held_out is None else df.join(held_out.select(keys.entity).distinct(), keys.entity, "left_anti")
    j = d.crossJoin(F.broadcast(g)).join(per_class, class_col, "left")
    per_ms = F.col(fs).cast("double") / F.lit(1000.0)
    moved = {}
    for c in lm.order:
        off = F.coalesce(F.col(f"_g_{c}"), F.col(f"_c_{c}"), F.lit(0.0))
        moved[c] = F.col(c) + off * per_ms
        moved[f"_was_{c}"] = F.col(c)
    out = repair_ranked(j.withColumns(moved), F.col("_pins"), lm, strict)
    out = out.withColumns({c: half_even(F.col(c)).cast("bigint") for c in lm.order})
    out = out.withColumns({f"shift_{c}": F.abs(F.col(c) - F.col(f"_was_{c}")) / per_ms for c in lm.order})
    return out.select(*df.columns, *[f"shift_{c}" for c in lm.order], "n_moved", "moved", "n_unresolved")


def shift_report(applied: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Median absolute shift over moved rows, and the share of rows that moved."""
    cells = F.array(*[F.struct(F.lit(c).alias("fiducial"), F.col(f"shift_{c}").alias("shift_ms")) for c in lm.boundaries])
    tidy = applied.select(F.inline(cells))
    share = tidy.groupBy("fiducial").agg(
        F.count_if(F.col("shift_ms") > 0).alias("n_shifted"),
        F.round(F.count_if(F.col("shift_ms") > 0) / F.count(F.lit(1)) * 100, 6).alias("reach_pct"),
    )
    med = grouped_quantiles(tidy.filter("shift_ms > 0"), ["fiducial"], "shift_ms", [0.5], ["median_shift_ms"])
    return share.join(med, "fiducial", "left")


def coincidence_split(before: DataFrame, moved: str, left: str, right: str, fs: str = "fs_hz") -> DataFrame:
    """How much room a moved landmark had: none (coincident), some (squeezed), and unmoved with room."""
    gap = (F.col(right) - F.col(left)) * F.lit(1000.0) / F.col(fs)
    m = F.col(moved)
    return before.agg(
        F.count_if(m & (gap <= 0)).alias("coincident"), F.count_if(m & (gap > 0)).alias("squeezed"),
        F.count_if(~m & (gap > 0)).alias("untouched_with_headroom"),
    )


def repeatability(first: DataFrame, second: DataFrame, columns: Sequence[str], keys: Keys = KEYS, fs: str = "fs_hz", least: int = 5) -> DataFrame:
    """Second placement against the first: units where every column is present and one changed."""
    b = second.select(*keys.unit, *[F.col(c).alias(f"_2_{c}") for c in columns])
    j = first.join(b, keys.unit)
    whole = F.lit(True)
    changed = F.lit(False)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & F.col(f"_2_{c}").isNotNull()
        changed = changed | (F.col(c) != F.col(f"_2_{c}"))
    ms = F.lit(1000.0) / F.col(fs)
    cells = F.array(*[F.struct(F.lit(c).alias("landmark"), ((F.col(f"_2_{c}") - F.col(c)) * ms).alias("d")) for c in columns])
    tidy = j.filter(whole & changed).select(F.inline(cells)).withColumn("a", F.abs("d"))
    stats = tidy.groupBy("landmark").agg(
        F.count(F.lit(1)).alias("n"), F.max("a").alias("max_ms"), F.round(F.avg("d"), 6).alias("mean_ms"),
        F.round(F.stddev_samp("d"), 6).alias("sd_ms"),
    )
    ranks = nearest_rank_quantiles(tidy, ["landmark"], "a", [0.25, 0.75], ["q25_ms", "q75_ms"])
    med = grouped_quantiles(tidy, ["landmark"], "a", [0.5], ["median_ms"])
    out = stats.join(ranks, "landmark").join(med, "landmark")
    return out.withColumn("enough", (F.col("n") >= least).cast("int"))


def nearest_rank_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Element number round(p * n) of the sorted values (at least the first), from value counts."""
    from pyspark.sql import Window as W

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    # One row per distinct value (whole ms): the window is as long as the value range.
    w = W.partitionBy(*keys)
    run = counts.withColumns({"_end": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    aggs = []
    for p, name in zip(probs, names):
        k = F.greatest(F.lit(1), F.least(F.col("_n"), F.round(F.col("_n") * F.lit(float(p))).cast("bigint")))
        aggs.append(F.min(F.when(F.col("_end") >= k, F.col(value))).alias(name))
    return run.groupBy(*keys).agg(*aggs)
