"""Worklists for reviewers, and merging their corrections back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even, rank_of, samples_to_ms
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from ..session import materialise
from .derive import representative
from .ordered import attach, keep_last, lay_out, with_neighbours
from .quantiles import ordered_median

# Landmarks whose cross-channel flag counts as primary (core and last wave).
PRIMARY = ("r_peak", "s_peak", "qrs_offset", "t_onset", "t_peak", "t_offset")
# Status ranks and the easy-to-hard order of the classes.
STATUS_RANK = ("critical", "minor", "clean")
CLASS_ORDER = ("sinus", "avblock", "iab", "lae", "fam", "rbbb", "lbbb", "mi")
BATCH_TARGET = 250


def primary_flag(flags: DataFrame, keys: Keys = KEYS, primary: Sequence[str] = PRIMARY) -> DataFrame:
    on = F.greatest(*[F.col(f"flag_{c}") for c in primary])
    return flags.select(*keys.unit, on.alias("crosslead_flag"))


def review_worklist(units: DataFrame, flags: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Persistent units, and units with any critical row that are also flagged across channels."""
    j = units.join(flags, keys.unit, "left").withColumn("crosslead_flag", F.coalesce("crosslead_flag", F.lit(0)))
    keep = F.col("persistent") | ((F.col("n_critical") > 0) & (F.col("crosslead_flag") == 1))
    tier = F.when(F.col("persistent"), "1_critical").otherwise("2_crosslead")
    return j.filter(keep).withColumn("priority_tier", tier)


def all_units_worklist(
    rows: DataFrame, units: DataFrame, worklist: DataFrame, flags: DataFrame, keys: Keys = KEYS,
) -> DataFrame:
    """An interior row of every unit with its tier status, worst status and both priorities."""
    rep = representative(rows, keys.unit, keys.event, how="interior_place")
    tiers = worklist.select(*keys.unit, "priority_tier")
    j = (
        rep.withColumnRenamed("qc_status", "rep_qc_status")
        .join(units.select(*keys.unit, F.col("worst_status").alias("unit_worst_status")), keys.unit)
        .join(tiers, keys.unit, "left").join(flags, keys.unit, "left")
    )
    status = F.when(F.col("priority_tier") == "1_critical", "critical").when(
        F.col("priority_tier") == "2_crosslead", "minor"
    ).otherwise("clean")
    j = j.withColumns({"qc_status": status, "crosslead_flag": F.coalesce("crosslead_flag", F.lit(0))})
    return crosslead_priority(
        j.withColumn("priority", rank_of(F.col("qc_status"), STATUS_RANK, 2) + 1).drop("priority_tier")
    )


def crosslead_priority(worklist: DataFrame) -> DataFrame:
    """1 critical, 2 worst row critical and flagged across channels, else 3; safe to repeat."""
    p = F.when(F.col("qc_status") == "critical", 1).when(
        (F.col("unit_worst_status") == "critical") & (F.col("crosslead_flag") == 1), 2
    ).otherwise(3)
    return worklist.withColumn("priority_crosslead", p)


def worklist_order(
    class_col: str = "disease_class", classes: Sequence[str] = CLASS_ORDER, channels: Sequence = (), keys: Keys = KEYS,
) -> list[Column]:
    return [
        rank_of(F.col(class_col), classes), rank_of(F.col("qc_status"), STATUS_RANK, 9), F.col(keys.entity),
        rank_of(F.col(keys.channel), channels) if channels else F.col(keys.channel),
    ]


def worst_of(status: Column) -> Column:
    """Aggregate: the worst status of a group."""
    return F.get(F.array(*[F.lit(s) for s in STATUS_RANK] + [F.lit("other")]), F.min(rank_of(status, STATUS_RANK, 3)))


def plan_position(df: DataFrame, group_rank: str, order: str, ties: Sequence[str] = (), out: str = "order_index") -> DataFrame:
    """1-based place in the order (group_rank, order, ties) over the whole table.

    Ranks are taken inside the groups and pieces of the order; group offsets come from one count
    per group. ``group_rank`` must be a small integer (there are as many groups as classes).
    """
    sizes = df.groupBy(group_rank).agg(F.count(F.lit(1)).alias("_n"))
    packed = sizes.agg(F.map_from_entries(F.collect_list(F.struct(group_rank, "_n"))).alias("_sizes"))
    inside = with_neighbours(df, [group_rank], order, ties=ties, ordinal="_k")
    earlier = F.aggregate(
        F.map_values(F.map_filter("_sizes", lambda k, v: k < F.col(group_rank))), F.lit(0).cast("bigint"), lambda s, v: s + v
    )
    return inside.crossJoin(F.broadcast(packed)).withColumn(out, F.col("_k") + earlier).drop("_k", "_sizes")


def pack_batches(entities: DataFrame, place: str, size: str, target: int = BATCH_TARGET, width: int = 1024) -> DataFrame:
    """Greedy batches over entities in the order of ``place`` (dense, from 1): adds ``batch``.

    An entity opens a new batch when the open one already holds ``target`` rows, and is never
    split. The open size matters only up to ``target``, so a run of ``width`` entities is a small
    table "size before -> size after, batches opened". Runs are tabulated in parallel, runs of
    runs are composed from those tables, and the start states are handed down again; the only
    sequential step works on one entry per ``width`` squared entities.
    """
    state = "struct<n:bigint,b:bigint>"

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        # All start sizes at once: one vector step per entity of the run.
        n = np.arange(target + 1)
        opened = np.zeros(target + 1, dtype=np.int64)
        for c in pdf.sort_values("place")["size"].to_numpy():
            full = n >= target
            opened += full
            n = np.minimum(target, np.where(full, 0, n) + c)
        return pd.DataFrame({"_run": [pdf["_run"].iloc[0]], "n": [n], "b": [opened]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n, b = int(pdf["n"].iloc[0]), int(pdf["b"].iloc[0])
        batches = []
        for c in pdf["size"].to_numpy():
            if n >= target:
                n, b = 0, b + 1
            n += int(c)
            batches.append(b)
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "batch": batches})

    def follow(acc: Column, table: Column) -> Column:
        hit = F.get(table, acc.getField("n").cast("int"))
        return F.struct(hit.getField("n").alias("n"), (acc.getField("b") + hit.getField("b")).alias("b")).cast(state)

    def start(n: Column, b: Column) -> Column:
        return F.struct(n.cast("bigint").alias("n"), b.cast("bigint").alias("b")).cast(state)

    def compose(items: Column) -> Column:
        maps = F.transform(items, lambda x: x.getField("m"))
        return F.transform(F.sequence(F.lit(0), F.lit(target)), lambda s: F.aggregate(maps, start(s, F.lit(0)), follow))

    def hand_down(items: Column, begin: Column) -> Column:
        """Per item its id and the state before it."""
        empty = F.array().cast(f"array<struct<id:bigint,at:{state}>>")

        def merge(acc: Column, x: Column) -> Column:
            here = F.struct(x.getField("id").alias("id"), acc.getField("s").alias("at"))
            return F.struct(
                F.concat(acc.getField("out"), F.array(here)).alias("out"), follow(acc.getField("s"), x.getField("m")).alias("s")
            )

        return F.aggregate(items, F.struct(empty.alias("out"), begin.alias("s")), merge, lambda acc: acc.getField("out"))

    def gathered(df: DataFrame, key: str | None, item: str) -> DataFrame:
        cell = F.array_sort(F.collect_list(F.struct(F.col(item).alias("id"), F.col("m").alias("m")))).alias("items")
        return df.groupBy(key).agg(cell) if key else df.agg(cell)

    # A run holds at most ``width`` entities, because places are dense.
    base = entities.select(
        F.floor((F.col(place) - 1) / width).cast("bigint").alias("_run"),
        F.col(place).cast("bigint").alias("place"), F.col(size).cast("bigint").alias("size"),
    )
    tables = base.groupBy("_run").applyInPandas(tabulate, "_run long, n array<long>, b array<long>").select(
        "_run", F.floor(F.col("_run") / width).cast("bigint").alias("_top"), F.arrays_zip("n", "b").cast(f"array<{state}>").alias("m")
    )
    tops = gathered(tables, "_top", "_run")
    whole = gathered(tops.select("_top", compose(F.col("items")).alias("m")), None, "_top")
    top_at = whole.select(F.inline(hand_down(F.col("items"), start(F.lit(0), F.lit(1))))).select(F.col("id").alias("_top"), "at")
    run_at = tops.join(top_at, "_top").select(F.inline(hand_down(F.col("items"), F.col("at")))).select(
        F.col("id").alias("_run"), "at.n", "at.b"
    )
    placed = base.join(run_at, "_run").groupBy("_run").applyInPandas(walk, "place long, batch long")
    return entities.join(placed.withColumnRenamed("place", place), place)


def corrector_plan(
    worklist: DataFrame, order: str, ties: Sequence[str] = (), class_col: str = "disease_class",
    classes: Sequence[str] = CLASS_ORDER, keys: Keys = KEYS, target: int = BATCH_TARGET,
) -> DataFrame:
    """Tier-1 units in plan order with ``order_index`` and ``batch``; ``order`` is numeric per entity.

    The units and the placed entities are read several times, so each is checkpointed once.
    """
    tier1 = worklist.filter(F.col("priority_tier") == "1_critical").withColumn("_cls", rank_of(F.col(class_col), classes))
    tier1 = materialise(tier1)
    per_entity = tier1.groupBy("_cls", keys.entity, order) if order != keys.entity else tier1.groupBy("_cls", keys.entity)
    ents = materialise(plan_position(per_entity.agg(F.count(F.lit(1)).alias("_size")), "_cls", order, ties, out="_place"))
    packed = pack_batches(ents, "_place", "_size", target)
    # Units of an entity follow each other, so their index is the rows before it plus their own rank.
    before = with_neighbours(packed.withColumn("_all", F.lit(0)), ["_all"], "_place", running={"_end": "_size"})
    ranked = with_neighbours(tier1, [keys.entity], keys.channel, ordinal="_u") if dict(tier1.dtypes)[keys.channel] != "string" else \
        with_neighbours(tier1.withColumn("_lr", F.lit(0)), [keys.entity], "_lr", ties=[keys.channel], ordinal="_u")
    out = ranked.join(before.select(keys.entity, "batch", (F.col("_end") - F.col("_size")).alias("_b4")), keys.entity)
    return out.withColumn("order_index", F.col("_b4") + F.col("_u")).drop("_b4", "_u", "_cls", "_lr")


def best_channel(
    units: DataFrame, consensus: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, fs: str = "fs_hz", default=None,
) -> DataFrame:
    """The channel whose own boundaries lie closest to the consensus, both measured from the anchor."""
    e, a = keys.entity, lm.anchor
    g = consensus.select(e, *[(F.col(c) - F.col(a)).alias(f"_g_{c}") for c in lm.boundaries])
    j = units.join(g, e)
    devs = F.filter(
        F.array(*[F.abs((F.col(c) - F.col(a)) - F.col(f"_g_{c}")).cast("double") for c in lm.boundaries]), lambda v: v.isNotNull()
    )
    mean = F.when(
        F.size(devs) > 0, F.aggregate(devs, F.lit(0.0), lambda s, v: s + v) / F.size(devs) * F.lit(1000.0) / F.col(fs)
    )
    d = j.withColumn("_dev", mean)
    by = F.when(F.col("_dev").isNotNull(), F.struct("_dev", keys.channel))
    out = d.groupBy(e).agg(F.min_by(keys.channel, by).alias("best"), F.min("_dev").alias("deviation_ms"))
    if default is not None:
        out = out.withColumn("best", F.coalesce("best", F.lit(default)))
    return out


def latest_corrections(feed: DataFrame, keys: Keys = KEYS, by: Sequence[str] = ("edited_at",)) -> DataFrame:
    """The last saved version of every reviewed unit."""
    return keep_last(feed.filter(F.coalesce(F.col("reviewed"), F.lit(0)) == 1), keys.unit, by)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Union in which the newer version of a key wins and no key is lost."""
    both = current.unionByName(changes, allowMissingColumns=True)
    return keep_last(both, keys, by)


def merge_corrections(
    master: DataFrame, corrections: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, n_samples: str = "n_samples",
    fs: str = "fs_hz", n_outside: str | None = None,
) -> DataFrame:
    """Carry each unit's correction to all its events.

    Waves up to the core move with the event's anchor; later waves hang on the new core offset,
    stretched by the ratio of the events' intervals (held to 0.5..2). Absent in the correction
    means absent everywhere; a position outside the recording becomes absent. Units without a
    usable reviewed event stay as they were. Anchors and intervals come from the old positions.

    What the master derives from positions follows them in the rows that change: ``<landmark>_ms``, ``qt_interval_ms`` (core onset to
    last offset), ``qt_peak_ms`` (core onset to last peak), and ``<wave>_present`` where the correction states it. ``n_outside`` names
    a column for the number of landmarks of a row that fell outside its recording.
    """
    core = lm.core_wave
    anchor = F.coalesce(F.col(core.onset), F.col(lm.anchor))
    k = [w.name for w in lm.waves].index(lm.core)
    late = {c for w in lm.waves[k + 1:] for c in (w.onset, *w.peaks, w.offset)}
    unit, ev = keys.unit, keys.event
    # Whole rows are laid out once; all that follows is joined or added up where they lie.
    master, laid = master.drop("_piece"), master if "_piece" in master.columns else lay_out(master, unit, ev)
    at = [*unit, "_piece"]
    m = with_neighbours(laid.withColumn("_a", anchor), unit, ev, lead={"_na": "_a"})
    m = m.withColumn("_rr0", F.nullif(F.col("_na") - F.col("_a"), F.lit(0)))
    # Intervals are shorter than the recording, so a unit has few distinct ones.
    counts = m.filter(F.col("_rr0").isNotNull()).groupBy(*at, "_rr0").agg(F.count(F.lit(1)).alias("_c"))
    med = ordered_median(counts, unit, "_rr0", "_med", upper=True, grain=None, count="_c")
    stated = [f"{w.name}_present" for w in lm.waves if f"{w.name}_present" in master.columns and f"{w.name}_present" in corrections.columns]
    c = corrections.select(*unit, F.col(ev).alias("_cb"), *[F.col(x).alias(f"_c_{x}") for x in [*lm.order, *stated]], F.lit(True).alias("_has"))
    c = materialise(c)
    places = laid.select(*at).distinct()
    # What a unit's events need of it comes from their anchors alone.
    slim = m.select(*at, ev, "_a", "_rr0").join(places.join(c.select(*unit, "_cb", f"_c_{core.onset}"), unit), at)
    same = F.coalesce(F.col(ev) == F.col("_cb"), F.lit(False))
    dist = F.abs(F.col("_a") - F.col(f"_c_{core.onset}"))
    # Of rows that repeat a key, the one with the lowest anchor, whatever the plan's order of rows.
    place = [(~same).cast("int").alias("x"), F.when(~same, dist).alias("d"), F.col(ev).alias("id"), F.col("_a").isNull().alias("none")]
    ranked = F.struct(*place, F.col("_a").alias("a"), F.col("_rr0").alias("rr"))
    rep = slim.groupBy(*unit).agg(F.min(F.when(same | dist.isNotNull(), ranked)).alias("_rep"))
    facts = places.join(med, unit, "left").join(c, unit, "left").join(rep, unit, "left")
    m = m.join(facts, at, "left").withColumns({"_rr": F.coalesce("_rr0", "_med"), "_rep_rr": F.coalesce("_rep.rr", "_med")})
    act = F.coalesce(F.col("_has"), F.lit(False)) & F.col("_rep.a").isNotNull() & F.col("_a").isNotNull()
    off = F.col(f"_c_{core.offset}")
    base = F.coalesce(F.nullif(F.col("_rep_rr"), F.lit(0)), F.col("_med"))
    scale = F.coalesce(
        F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.try_divide(F.col("_rr").cast("double"), base.cast("double")))), F.lit(1.0)
    )
    scale = F.when(F.col("_rr").isNull() | base.isNull(), F.lit(1.0)).otherwise(scale)
    m = m.withColumns({"_act": act, "_shift": F.col("_a") - F.col("_rep.a"), "_scale": scale})
    act, shift, scale = F.col("_act"), F.col("_shift"), F.col("_scale")

    def moved(x: str) -> Column:
        v = F.col(f"_c_{x}")
        return half_even(off + shift + (v - off) * scale).cast("bigint") if x in late else v + shift

    m = m.withColumns({f"_m_{x}": moved(x) for x in lm.order})
    new = {}
    outside = F.lit(0)
    for x in lm.order:
        within = (F.col(f"_m_{x}") >= 0) & (F.col(f"_m_{x}") <= F.col(n_samples) - 1)
        new[x] = F.when(act, F.when(within, F.col(f"_m_{x}"))).otherwise(F.col(x))
        outside = outside + F.when(act & ~within, 1).otherwise(0)
    last = lm.waves[-1]
    spans = {"qt_interval_ms": (last.offset, core.onset), "qt_peak_ms": (last.peaks[-1] if last.peaks else last.offset, core.onset)}
    derived = {f"{x}_ms": samples_to_ms(x, F.col(fs)) for x in lm.order} | {n: samples_to_ms(F.col(a) - F.col(b), F.col(fs)) for n, (a, b) in spans.items()}
    derived = {n: F.when(F.col("_act"), v).otherwise(F.col(n)) for n, v in derived.items() if n in master.columns}
    derived |= {n: F.when(F.col("_act"), F.coalesce(F.col(f"_c_{n}").cast(dict(master.dtypes)[n]), F.col(n))).otherwise(F.col(n)) for n in stated}
    source = F.when(act, F.lit("manual_corrected"))
    quality = F.when(act & (F.col(ev) == F.col("_rep.id")), "corrected").when(act, "propagated")
    keep = {"label_source": source, "label_quality": quality}
    for n, e in keep.items():
        if n in master.columns:
            keep[n] = F.coalesce(e, F.col(n))
    extra = {n_outside: outside} if n_outside else {}
    out = m.withColumns(new | keep | extra).withColumns(derived)
    return out.select(*master.columns, *[n for n in keep if n not in master.columns], *extra)


def unmatched_corrections(master: DataFrame, corrections: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Corrections of units that the master does not have."""
    return corrections.join(master.select(*keys.unit).distinct(), keys.unit, "left_anti")


def apply_exclusions(tables: Mapping[str, DataFrame], excluded: DataFrame, key: str = "record_id") -> dict[str, DataFrame]:
    """Remove excluded entities from every table that has the key; other tables pass unchanged."""
    ids = excluded.select(key).distinct()
    return {n: t.join(ids, key, "left_anti") if key in t.columns else t for n, t in tables.items()}


def exclusion_report(tables: Mapping[str, DataFrame], excluded: DataFrame, key: str = "record_id") -> DataFrame:
    """Kept and removed rows per table, in one pass over each."""
    ids = excluded.select(key).distinct().withColumn("_x", F.lit(1))
    out = None
    for n, t in tables.items():
        if key not in t.columns:
            continue
        r = t.select(key).join(ids, key, "left").agg(
            F.count_if(F.col("_x").isNull()).alias("kept"), F.count_if(F.col("_x") == 1).alias("removed")
        ).select(F.lit(n).alias("table_name"), "kept", "removed")
        out = r if out is None else out.unionByName(r)
    return out


def fill_from_sibling(df: DataFrame, column: str, keys: Keys = KEYS) -> DataFrame:
    """An absent value takes that of the first channel of the same entity that has one."""
    by = F.when(F.col(column).isNotNull(), F.col(keys.channel))
    return attach(df, [keys.entity], F.min_by(column, by).alias("_s")).withColumn(column, F.coalesce(column, "_s")).drop("_s")
