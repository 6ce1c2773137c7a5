"""Cutting tables and windows: samples, splits, folds, leakage checks, assembled label tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import DRAW_GRAIN, WHOLE, key_parts, with_draw
from ..functions.scalar import half_even, halve_rate, non_blank, remap, strip_suffix
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from ..session import materialise
from .consensus import repair_after_onset_shift
from .derive import null_placeholder
from .ordered import attach, keep_first, with_neighbours
from .qc import out_of_record


def ranked_in_order(df: DataFrame, by: Sequence[str], key: str, out: str = "_i") -> DataFrame:
    """1-based place of every row in key order within its group. Keys that are no whole numbers are cut into ranges by a sample of them."""
    if dict(df.dtypes)[key] in WHOLE:
        return with_neighbours(df, by, key, ordinal=out)
    d = materialise(df.repartitionByRange(key).withColumn("_kr", F.spark_partition_id().cast("bigint")))
    return with_neighbours(d, by, "_kr", ties=[key], ordinal=out, grain=1).drop("_kr")


def seeded_sample(df: DataFrame, by: Sequence[str], ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows per group without replacement, the same rows for the same seed and keys."""
    d = with_draw(df, "_h", seed, key_parts(df, ids))
    d = with_neighbours(d, by, "_h", ties=ids, ordinal="_k", grain=DRAW_GRAIN)
    return d.filter(F.col("_k") <= n).drop("_h", "_k")


def spread_sample(df: DataFrame, class_col: str, total: int, seed: int, keys: Keys = KEYS) -> DataFrame:
    """About ``total`` entities, an equal whole number of each class (at least one, at most all it has), each with its first unit."""
    first = one_unit_per_entity(df, keys)
    sizes = first.agg(F.greatest(F.lit(1), F.floor(F.lit(total) / F.count_distinct(class_col))).alias("_quota"))
    d = with_draw(first, "_h", seed, key_parts(first, [keys.entity]))
    d = with_neighbours(d, [class_col], "_h", ties=[keys.entity], ordinal="_k", grain=DRAW_GRAIN)
    return d.crossJoin(F.broadcast(sizes)).filter("_k <= _quota").drop("_h", "_k", "_quota")


def one_unit_per_entity(df: DataFrame, keys: Keys = KEYS, order: Sequence[str] | None = None) -> DataFrame:
    """The first row of every entity in key order."""
    return keep_first(df, [keys.entity], list(order or (keys.channel, keys.event)))


def alternate_split(df: DataFrame, by: Sequence[str], key: str, names: tuple[str, str] = ("calibration", "test"), out: str = "split") -> DataFrame:
    """Even places of a group's key order go to the first name, odd ones to the second."""
    r = ranked_in_order(df, by, key)
    return r.withColumn(out, F.when(F.col("_i") % 2 == 1, names[0]).otherwise(names[1])).drop("_i")


def first_n_split(df: DataFrame, by: Sequence[str], key: str, n_test: int = 10, n_val: int = 2, out: str = "role") -> DataFrame:
    """First records of a class test, next val, the rest pool; ``pool_place`` counts from 1 in the pool."""
    r = ranked_in_order(df, by, key)
    role = F.when(F.col("_i") <= n_test, "test").when(F.col("_i") <= n_test + n_val, "val").otherwise("pool")
    place = F.when(F.col("_i") > n_test + n_val, F.col("_i") - (n_test + n_val))
    return r.withColumns({out: role, "pool_place": place}).drop("_i")


def interleave(df: DataFrame, by: str, key: str, out: str = "turn") -> DataFrame:
    """Round-robin over the groups: order by (``turn``, group)."""
    return ranked_in_order(df, [by], key, out)


def nshot_ladder(
    entities: DataFrame, class_col: str, key: str, ns: Sequence[int] = (1, 2, 5, 8), n_test: int = 10, n_val: int = 2,
) -> DataFrame:
    """Rows (n, split, class, entity): nested training sets for each n; the test set has n = 0."""
    r = first_n_split(entities, [class_col], key, n_test, n_val)
    levels = F.array(*[F.lit(n) for n in ns])
    per_n = r.filter("role <> 'test'").withColumn("n", F.explode(levels)).filter(
        (F.col("role") == "val") | (F.col("pool_place") <= F.col("n"))
    )
    per_n = per_n.select("n", F.when(F.col("role") == "val", "val").otherwise("train").alias("split"), class_col, key)
    fixed = r.filter("role = 'test'").select(F.lit(0).alias("n"), F.col("role").alias("split"), class_col, key)
    return per_n.unionByName(fixed)


def cv_splits(
    entities: DataFrame, class_col: str, key: str, folds: int = 4, ns: Sequence[int] = (1, 2, 5, 8, 12), n_test: int = 5, n_val: int = 3,
    anchored: Sequence[str] | None = None, anchor_n: int = 2,
) -> DataFrame:
    """Rows (fold, n, split, class, entity). Fold f tests places 5f..5f+4 of every class.

    Of a class's other entities the first three validate and the next n train. With ``anchored``
    only the listed classes get n, the others a fixed few. Test rows carry n = 0.
    """
    r = ranked_in_order(entities, [class_col], key).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    i = F.col("_i") - 1
    lo = F.col("fold") * n_test
    is_test = (i >= lo) & (i < lo + n_test)
    pool = F.when(i >= lo + n_test, i - n_test).otherwise(i)
    r = r.withColumns({"_test": is_test, "_pool": pool})
    test = r.filter("_test").select("fold", F.lit(0).alias("n"), F.lit("test").alias("split"), class_col, key)
    rest = r.filter("not _test").withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns])))
    quota = F.col("n") if anchored is None else F.when(F.col(class_col).isin(*anchored), F.col("n")).otherwise(anchor_n)
    split = F.when(F.col("_pool") < n_val, "val").when(F.col("_pool") - n_val < quota, "train")
    rest = rest.withColumn("split", split).filter("split is not null").select("fold", "n", "split", class_col, key)
    return rest.unionByName(test)


def fold_coverage(splits: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Entities not tested exactly once (empty when the folds cover everything)."""
    tested = splits.filter("split = 'test'").groupBy(key).agg(F.count(F.lit(1)).alias("n_tested"))
    j = entities.select(key).distinct().join(tested, key, "left")
    return j.withColumn("n_tested", F.coalesce("n_tested", F.lit(0))).filter("n_tested <> 1")


def stratified_topup(
    pool: DataFrame, previous: DataFrame, quota: int, splits: Sequence[str], class_col: str, key: str, seed: int,
    keep: Column | None = None,
) -> DataFrame:
    """Keep the previous picks that still qualify and fill each class x split up to ``quota``.

    New picks come from pool entities never picked before, in seeded order; ``previous`` has
    (key, class, split). Returns (class, split, key, is_new).
    """
    fit = previous if keep is None else previous.filter(keep)
    kept = fit.select(class_col, "split", key, F.lit(0).alias("is_new"))
    have = kept.groupBy(class_col).agg(*[F.count_if(F.col("split") == s).alias(f"_have_{s}") for s in splits])
    fresh = pool.select(class_col, key).distinct().join(previous.select(key).distinct(), key, "left_anti")
    fresh = with_draw(fresh, "_h", seed, key_parts(fresh, [key]))
    fresh = with_neighbours(fresh, [class_col], "_h", ties=[key], ordinal="_i", grain=DRAW_GRAIN).join(have, class_col, "left")
    upto, pick = F.lit(0), F.lit(None).cast("string")
    arms = []
    for s in splits:
        need = F.greatest(F.lit(0), F.lit(quota) - F.coalesce(F.col(f"_have_{s}"), F.lit(0)))
        arms.append((upto, upto + need, s))
        upto = upto + need
    for lo, hi, s in arms:
        pick = F.when((F.col("_i") > lo) & (F.col("_i") <= hi), s).otherwise(pick)
    new = fresh.withColumn("split", pick).filter("split is not null").select(class_col, "split", key, F.lit(1).alias("is_new"))
    return kept.unionByName(new)


def quota_shortage(picks: DataFrame, quota: int, class_col: str) -> DataFrame:
    n = picks.groupBy(class_col, "split").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") < quota).withColumn("short_by", F.lit(quota) - F.col("n"))


# ---------------------------------------------------------------- leakage and windows


def held_out(*tables: DataFrame, key: str = "record_id") -> DataFrame:
    """Distinct ids of all the given tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def straddling(df: DataFrame, key: str = "record_id", split: str = "split") -> DataFrame:
    """Entities with rows in more than one split."""
    per = df.groupBy(key).agg(F.count_distinct(split).alias("n_splits"))
    return per.filter("n_splits > 1")


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys both tables hold (must be empty for disjoint sets)."""
    return a.select(*keys).intersect(b.select(*keys))


def leakage_check(train: DataFrame, test: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Shared entities and units, in one row."""
    def tagged(cols):
        x = train.select(*cols).distinct().withColumn("_t", F.lit(1))
        return x.join(test.select(*cols).distinct(), cols).agg(F.count(F.lit(1)).alias("n"))

    e = tagged([keys.entity]).withColumnRenamed("n", "shared_entities")
    return e.crossJoin(tagged(keys.unit).withColumnRenamed("n", "shared_units"))


def cut_windows(
    df: DataFrame, start: str, end: str, lm: Landmarks = LANDMARKS_11, pad_ms: float = 40.0, fs: str = "fs_hz", n_samples: str = "n_samples",
) -> DataFrame:
    """Open the event's span to all landmarks, pad, clip to the recording.

    Adds ``win_start``, ``win_end`` and ``clipped`` (a landmark still lies outside).
    """
    cols = [F.col(c) for c in lm.order]
    pad = F.lit(float(pad_ms)) * F.col(fs) / F.lit(1000.0)
    lo = F.floor(F.least(F.col(start), *cols) - pad)
    hi = F.ceil(F.greatest(F.col(end), *cols) + pad)
    out = df.withColumns(
        {"win_start": F.greatest(F.lit(0), lo).cast("bigint"), "win_end": F.least(F.col(n_samples) - 1, hi).cast("bigint")}
    )
    outside = F.exists(F.array(*[c.cast("bigint") for c in cols]), lambda v: (v < F.col("win_start")) | (v > F.col("win_end")))
    return out.withColumn("clipped", F.coalesce(outside, F.lit(False)).cast("int"))


def cut_corpus(clean: DataFrame, reviewed: DataFrame, gold: DataFrame, start: str, end: str, keys: Keys = KEYS, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Pretraining units (nobody reviewed or held out) and reviewed units, windows cut; ``part`` tells them apart."""
    out = held_out(gold, reviewed, key=keys.entity)
    pre = clean.join(out, keys.entity, "left_anti").withColumn("part", F.lit("pretrain"))
    both = pre.unionByName(reviewed.withColumn("part", F.lit("finetune")), allowMissingColumns=True)
    return cut_windows(both, start, end, lm)


# ---------------------------------------------------------------- assembled tables


def split_master(master: DataFrame, manifest: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Normalise the split, look up the subclass (a blank one never overwrites), group it."""
    m = manifest.select(keys.entity, non_blank(F.col("mi_subclass")).alias("_m"))
    j = master.join(m, keys.entity, "left")
    sub = F.coalesce("_m", "mi_subclass")
    return j.withColumns(
        {
            "split": remap(F.col("split"), {"validation": "val", "val": "val", "test": "test"}, default="train"),
            "mi_subclass": sub,
            "mi_group": strip_suffix(F.coalesce(sub, F.lit("")), ("_ant", "_post")),
        }
    ).drop("_m")


def assemble_clean_units(
    units: DataFrame, measured: DataFrame, offsets: DataFrame, record_info: DataFrame | None = None, lm: Landmarks = LANDMARKS_11,
    keys: Keys = KEYS, class_col: str = "disease_class", fs: str = "fs_hz", n_samples: str = "n_samples",
) -> DataFrame:
    """Clean units with measured positions, de-biased core onset and a squeezed neighbour wave.

    The offset is rounded to whole samples per class before it is added. Units without a measured
    row are the caller's error (see ``schema.assert_coverage``); the join keeps only pairs.
    """
    on = lm.core_wave.onset
    m = measured.select(*keys.unit, *lm.order)
    j = units.drop(*lm.order).join(m, keys.unit)
    j = null_placeholder(j, lm.core_wave.peaks[0], equals=on, flag="q_present")
    live = offsets.filter((F.col("fiducial") == on) & (F.col("scope") != "none"))
    g = live.agg(F.max(F.when(F.col("scope") == "global", F.col("offset_ms"))).alias("_g"))
    c = live.filter("scope = 'class'").select(F.col("scope_class").alias(class_col), F.col("offset_ms").alias("_c"))
    off = F.coalesce(F.col("_c"), F.col("_g"), F.lit(0.0))
    j = j.join(c, class_col, "left").crossJoin(F.broadcast(g))
    step = half_even(off * F.col(fs) / F.lit(1000.0)).cast("bigint")
    j = j.withColumns({on: F.col(on) + step, "onset_offset_ms": off}).drop("_g", "_c")
    j = repair_after_onset_shift(j, lm)
    if record_info is not None:
        j = j.join(record_info, keys.entity, "left")
    return j.withColumns(
        {"label_source": F.lit("measured_debiased"), "in_bounds": (~out_of_record(lm.order, n_samples)).cast("int")}
    )


def assemble_reviewed(
    corrections: DataFrame, master: DataFrame, paths: DataFrame, keys: Keys = KEYS, lm: Landmarks = LANDMARKS_11,
) -> tuple[DataFrame, DataFrame]:
    """(table, orphans): corrections with their master row's context and the first path of the record.

    A correction whose record is gone is an orphan to drop by name (``record_gone``); one whose
    event is missing is an error (``event_missing``).
    """
    ctx = [c for c in master.columns if c not in lm.order and c not in corrections.columns]
    m = master.select(*keys.row, *ctx, F.lit(1).alias("_hit"))
    j = corrections.join(m, keys.row, "left")
    known = master.select(keys.entity).distinct().withColumn("_known", F.lit(1))
    orphan = j.filter("_hit is null").join(known, keys.entity, "left").select(
        *keys.row, F.when(F.col("_known").isNull(), "record_gone").otherwise("event_missing").alias("problem")
    )
    first = keep_first(paths.select(keys.entity, "path_raw", "path_order"), [keys.entity], ["path_order"]).drop("path_order")
    ok = j.filter("_hit = 1").drop("_hit").join(first, keys.entity, "left")
    return ok.withColumn("label_source", F.lit("human_reviewed")), orphan


def skip_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """First rule a row fails as ``skip_reason``, NULL for rows that pass all."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(list(rules)):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return df.withColumn("skip_reason", out)


def halve_positions(df: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Positions at half the sampling rate, the originals kept as ``<name>_ms``."""
    return df.withColumns({f"{c}_ms": F.col(c) for c in lm.order} | {c: halve_rate(F.col(c)) for c in lm.order})


def table_problems(
    df: DataFrame, expected: DataFrame | None = None, n_channels: int = 12, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS,
    max_core_ms: float = 200.0, fs: str = "fs_hz", present: Mapping[str, str] | None = None,
) -> DataFrame:
    """Integrity findings in one long table: (problem, entity, channel)."""
    e, c = keys.entity, keys.channel
    core = lm.core_wave
    dup = df.groupBy(*keys.unit).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), e, c)
    none = F.lit(None).cast(dict(df.dtypes)[c])
    per = df.groupBy(e).agg(F.count_distinct(c).alias("n"), F.count_distinct(F.struct(core.onset, core.offset)).alias("m"))
    short = per.filter(F.col("n") < n_channels).select(F.lit("short_record").alias("problem"), e, none.alias(c))
    sets = per.filter("m > 1").select(F.lit("several_core_sets").alias("problem"), e, none.alias(c))
    width = (F.col(core.offset) - F.col(core.onset)) * F.lit(1000.0) / F.col(fs)
    chain = F.lit(False)
    for a, b in zip(lm.boundaries, lm.boundaries[1:]):
        chain = chain | F.coalesce(F.col(a) > F.col(b), F.lit(False))
    row = {"core_too_wide": width > max_core_ms, "out_of_order": chain}
    for flag, col in (present or {}).items():
        row[f"presence_{col}"] = (F.col(flag) == 1) != F.col(col).isNotNull()
    marks = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in row.items()]))
    rows = df.select(F.explode(marks).alias("problem"), e, c)
    out = dup.unionByName(short).unionByName(sets).unionByName(rows)
    if expected is not None:
        gone = expected.select(*keys.unit).subtract(df.select(*keys.unit)).select(F.lit("missing").alias("problem"), e, c)
        out = out.unionByName(gone)
    return out


def load_units(
    df: DataFrame, split: str | None = None, classes: Sequence[str] = (), channels: Sequence = (), drop_ids: DataFrame | None = None,
    max_units: int | None = None, order: Sequence[str] = ("record_id", "lead"), keys: Keys = KEYS, class_col: str = "disease_class",
) -> DataFrame:
    """Filtered units; an empty list keeps all, a cap takes the first in the given order."""
    out = df
    if split is not None:
        out = out.filter(F.col("split") == split)
    if classes:
        out = out.filter(F.col(class_col).isin(*classes))
    if channels:
        out = out.filter(F.col(keys.channel).isin(*channels))
    if drop_ids is not None:
        out = out.join(drop_ids.select(keys.entity).distinct(), keys.entity, "left_anti")
    return out.orderBy(*order).limit(max_units) if max_units is not None else out


def extract_record(df: DataFrame, entity, keys: Keys = KEYS) -> DataFrame:
    """All rows of one entity: the filter reaches the scan and prunes row groups sorted by entity."""
    return df.filter(F.col(keys.entity) == F.lit(entity))


def keyed_lookup(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a large table for a list of keys; the engine broadcasts the list while it is small."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def fill_rate(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count(c).alias(f"n_{c}") for c in columns], F.count(F.lit(1)).alias("n"))


def summary_text(df: DataFrame, out: str = "summary") -> DataFrame:
    """One readable line per unit table row (needs the derived intervals)."""
    part = lambda name, c: F.concat(F.lit(f"{name} "), F.coalesce(half_even(F.col(c)).cast("bigint").cast("string"), F.lit("--")), F.lit("ms"))
    return df.withColumn(out, F.concat_ws(" | ", part("P", "pdur_ms"), part("QRS", "qrsdur_ms"), part("QT", "qt_ms")))


def shard_of(key: Column, n: int) -> Column:
    """Stable shard number of a text key."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(n))


def entity_share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return attach(df, by, F.count(F.lit(1)).alias("n_group"))
