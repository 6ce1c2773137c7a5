"""One reading per event from many channels: aggregation, order repair, audits."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrays import fold_forward
from ..functions.scalar import clamp, half_away, half_even
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from ..session import materialise
from .derive import representative
from .ordered import attach, keep_first, with_neighbours
from .qc import record_status, unit_status
from .quantiles import ordered_median

# An (entity, event) group has one row per channel, so plain percentile aggregates are safe there.


def listed_level(ascending: Column, n: Column, p: float) -> Column:
    """``percentile`` of a sorted array that begins with its NULLs and ends with ``n`` values; NULL without values."""
    place = (n - 1) * F.lit(float(p))
    low, high = F.floor(place), F.ceil(place)
    nulls = F.size(ascending) - n

    def at(i: Column) -> Column:
        return F.get(ascending, (nulls + i).cast("int")).cast("double")

    between = (high - place) * at(low) + (place - low) * at(high)
    return F.when(n > 0, F.when((low == high) | (at(low) == at(high)), at(low)).otherwise(between))


def consensus_positions(
    df: DataFrame, q: float = 0.25, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, ref_channel=None,
    window: tuple[str, str] | None = None, flags: Sequence[str] = (), carry: Sequence[str] = (),
) -> DataFrame:
    """q-th percentile of onsets, (1-q)-th of offsets, median of peaks; q=0 gives min and max.

    With ``ref_channel`` its anchor peak replaces the consensus one, and ``r_ref_used`` says so.
    """
    if not 0 <= q <= 0.5:
        raise ValueError("q must lie in [0, 0.5]")

    levels = {c: q for c in lm.onsets} | {c: 1 - q for c in lm.offsets} | {c: 0.5 for c in lm.peaks}
    inner = [c for c, p in levels.items() if 0 < p < 1]
    # One list of rows per group instead of one buffer per landmark; the levels are then plain columns over it.
    aggs = [F.collect_list(F.struct(*inner)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in inner]] if inner else []
    aggs += [(F.min(c) if p == 0 else F.max(c)).cast("double").alias(c) for c, p in levels.items() if c not in inner]
    aggs += [F.max(c).alias(c) for c in flags] + [F.first(c).alias(c) for c in carry]
    if window:
        aggs += [F.min(window[0]).alias(window[0]), F.max(window[1]).alias(window[1])]
    aggs.append(F.count(F.lit(1)).alias("n_recon_leads"))
    if ref_channel is not None:
        aggs.append(F.max(F.when(F.col(keys.channel) == ref_channel, F.col(lm.anchor))).alias("_ref"))
    out = df.groupBy(*keys.occurrence).agg(*aggs)
    out = out.withColumns({f"_v_{c}": F.sort_array(F.col("_rows").getField(c)) for c in inner})
    found = {c: listed_level(F.col(f"_v_{c}"), F.col(f"_n_{c}"), levels[c]).alias(c) for c in inner}
    extra = [c for c in out.columns if c not in levels and c not in keys.occurrence and c[:3] not in ("_n_", "_v_") and c != "_rows"]
    out = out.select(*keys.occurrence, *[found.get(c, F.col(c)) for c in levels], *extra)
    if ref_channel is not None:
        out = out.withColumns(
            {"r_ref_used": F.col("_ref").isNotNull().cast("int"),
             lm.anchor: F.coalesce(F.col("_ref").cast("double"), F.col(lm.anchor))}
        ).drop("_ref")
    return out


def repair_midpoint(df: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Crossing neighbours both move to their midpoint, left to right; then a running maximum."""
    cols = lm.boundaries
    arr = F.array(*[F.col(c).cast("double") for c in cols])

    def settle(acc: Column, v: Column) -> Column:
        out = acc
        n = F.size(out)
        prev = F.element_at(out, -1)
        mid = (prev + v) / F.lit(2.0)
        crossed = F.coalesce(prev > v, F.lit(False))
        return F.when(crossed, F.concat(F.slice(out, 1, n - 1), F.array(mid, mid))).otherwise(
            F.concat(out, F.array(v))
        )

    head = F.slice(arr, 1, 1)
    settled = F.aggregate(F.slice(arr, 2, len(cols) - 1), head, settle)
    run = fold_forward(settled, lambda r, v: F.struct(F.greatest(r, v).alias("v"), F.greatest(r, v).alias("run")),
                       F.lit(None).cast("double"))
    return _spread(df, run, cols)


def _spread(df: DataFrame, arr: Column, cols: Sequence[str], name: str = "_arr") -> DataFrame:
    return df.withColumn(name, arr).withColumns({c: F.get(name, F.lit(i)) for i, c in enumerate(cols)}).drop(name)


def repair_core_first(df: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """The core wave is widened to hold the anchor; the waves around it give way; peaks stay inside."""
    core = lm.core_wave
    k = [w.name for w in lm.waves].index(lm.core)
    step1 = {core.onset: F.least(core.onset, lm.anchor), core.offset: F.greatest(core.offset, lm.anchor)}
    out = df.withColumns(step1)
    out = out.withColumn(core.offset, F.greatest(core.offset, core.onset))
    limit = core.onset
    for w in reversed(lm.waves[:k]):
        out = out.withColumn(w.offset, F.least(w.offset, limit)).withColumn(w.onset, F.least(w.onset, w.offset))
        limit = w.onset
    limit = core.offset
    for w in lm.waves[k + 1:]:
        out = out.withColumn(w.onset, F.greatest(w.onset, limit)).withColumn(w.offset, F.greatest(w.offset, w.onset))
        limit = w.offset
    peaks = {
        p: F.least(F.greatest(F.col(p), F.col(w.onset)), F.col(w.offset))
        for w in lm.waves for p in w.peaks if p != lm.anchor
    }
    return out.withColumns(peaks)


def repair_forward(df: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Each landmark is at least the largest one before it."""
    # A landmark left in place or raised never exceeds the largest one so far, so that one is the running bound.
    v = [F.col(c).cast("double") for c in chain]
    return df.withColumns({c: F.when(v[i].isNotNull(), _greatest(v[: i + 1])) for i, c in enumerate(chain)})


def _greatest(values: Sequence[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _least(values: Sequence[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def repair_ranked(
    df: DataFrame, corrected: Sequence[str] | Column = (), lm: Landmarks = LANDMARKS_11, strict: bool = False,
) -> DataFrame:
    """Peaks and corrected boundaries stay; the rest yields, first rightwards, then leftwards.

    ``corrected`` lists names, or is a column holding an array of them. Adds ``n_moved``, ``moved`` (names, joined) and ``n_unresolved`` (pinned pairs still crossed).
    """
    chain = lm.order

    def pinned(c: str) -> Column:
        if c in lm.peaks or strict:
            return F.lit(c in lm.peaks)
        return F.array_contains(corrected, c) if isinstance(corrected, Column) else F.lit(c in corrected)

    def pushed(prefix: str, c: str, bound: Column) -> Column:
        v = F.col(f"{prefix}{c}")
        return F.when(v.isNotNull() & ~F.col(f"_pin_{c}"), bound).otherwise(v)

    # A pass never moves a landmark beyond the largest (smallest) one it has met, so the bound of each is over plain columns.
    d = df.withColumns({f"_was_of_{c}": F.col(c).cast("double") for c in chain} | {f"_pin_{c}": pinned(c) for c in chain})
    d = d.withColumns({f"_fwd_{c}": pushed("_was_of_", c, _greatest([F.col(f"_was_of_{x}") for x in chain[: i + 1]])) for i, c in enumerate(chain)})
    d = d.withColumns({c: pushed("_fwd_", c, _least([F.col(f"_fwd_{x}") for x in chain[i:]])) for i, c in enumerate(chain)})
    diff = {c: F.coalesce(F.col(f"_was_of_{c}") != F.col(c), F.lit(False)) for c in chain}
    crossed = [F.coalesce(F.col(y) < F.col(x), F.lit(False)) for x, y in zip(chain, chain[1:])]
    d = d.withColumns(
        {
            "moved": F.concat_ws(";", *[F.when(m, c) for c, m in diff.items()]),
            "n_moved": functools.reduce(Column.__add__, [m.cast("int") for m in diff.values()]),
            "n_unresolved": functools.reduce(Column.__add__, [m.cast("int") for m in crossed]),
        }
    )
    return d.drop(*[f"{p}{c}" for p in ("_was_of_", "_pin_", "_fwd_") for c in chain])


def repair_after_onset_shift(df: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """After the core onset moved earlier, only the wave before it can be overtaken: squeeze it."""
    k = [w.name for w in lm.waves].index(lm.core)
    w = lm.waves[k - 1]

    def held(c: str, by: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.least(F.col(c), F.col(by)))

    out = df.withColumn(w.offset, held(w.offset, lm.core_wave.onset))
    return out.withColumns({c: held(c, w.offset) for c in (w.onset, *w.peaks)})


def round_positions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c)).cast("bigint") for c in columns})


def restrict_channels(df: DataFrame, worklist: DataFrame, keys: Keys = KEYS, keep_fallback: bool = False) -> DataFrame:
    """Keep listed channels. Entities with none keep all of theirs, or drop out entirely.

    ``recon_source`` tells the two kinds apart.
    """
    listed = worklist.select(*keys.unit).distinct().withColumn("_in", F.lit(1))
    marked = attach(
        df.join(listed, keys.unit, "left"), [keys.entity], F.max("_in").alias("_any")
    )
    source = F.when(F.col("_any") == 1, "worklist_clean").otherwise("all_leads_fallback")
    kept = marked.filter((F.col("_in") == 1) | (F.col("_any").isNull() & F.lit(keep_fallback)))
    return kept.withColumn("recon_source", source).drop("_in", "_any")


def fallback_entities(df: DataFrame, worklist: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Entities without a single listed channel (the audit list of what was dropped)."""
    hit = df.select(*keys.unit).distinct().join(worklist.select(*keys.unit).distinct(), keys.unit, "left_semi")
    return df.select(keys.entity).distinct().join(hit.select(keys.entity).distinct(), keys.entity, "left_anti")


def consensus(
    df: DataFrame, q: float = 0.25, repair: str = "core_first", ref_channel=None, worklist: DataFrame | None = None,
    keep_fallback: bool = False, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS,
    weights: Mapping[str, int] | None = None, class_col: str = "disease_class",
) -> DataFrame:
    """One repaired row per entity at its representative event, with status and review priority.

    ``df`` must carry ``qc_status`` (see ``qc.beat_qc``). ``repair`` is core_first, midpoint (its
    result is then also passed through core_first) or none.
    """
    used = df.withColumn("recon_source", F.lit("all_leads")) if worklist is None else restrict_channels(
        df, worklist, keys, keep_fallback
    )
    c = consensus_positions(used, q, lm, keys, ref_channel, carry=[class_col, "recon_source"])
    if repair == "midpoint":
        c = repair_midpoint(c, lm)
    if repair in ("midpoint", "core_first"):
        c = repair_core_first(c, lm)
    elif repair != "none":
        raise ValueError(f"unknown repair {repair!r}")
    rep = representative(round_positions(c, lm.order), [keys.entity], keys.event, median_over=df)
    status = record_status(unit_status(df, keys), keys)
    out = rep.join(status, keys.entity, "left").withColumnRenamed(keys.event, "rep_beat_id")
    w = F.lit(1)
    for k, v in (weights or {}).items():
        w = F.when(F.col(class_col) == k, v).otherwise(w)
    priority = F.when(F.col("qc_status") == "critical", w).otherwise(0) + F.col("n_problem_leads")
    return out.withColumns({"review_priority": priority.cast("bigint"), "recon_quantile": F.lit(float(q))})


def sync_intervals(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Keys = KEYS, fs: str = "fs_hz", floor: int = 5,
) -> DataFrame:
    """Second-latest end minus second-earliest start over the channels, in ms.

    Positions below ``floor`` count as missing; fewer than two readings give NULL.
    """
    def second(c: str, largest: bool) -> Column:
        vals = F.sort_array(F.collect_list(F.when(F.col(c) >= floor, F.col(c))), asc=not largest)
        return F.get(vals, F.lit(1))

    ms = F.lit(1000.0) / F.first(F.col(fs).cast("double"))
    aggs = [
        F.round((second(late, True) - second(early, False)) * ms, 3).alias(f"sync_{n}_ms")
        for n, (late, early) in pairs.items()
    ]
    return df.groupBy(*keys.occurrence).agg(*aggs)


def boundary_drivers(
    df: DataFrame, reviewable: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, fs: str = "fs_hz",
) -> DataFrame:
    """Boundaries of the representative event that a single, not reviewable channel sets alone.

    Rows: entity, channel, landmark, margin_ms (distance to the next distinct value).
    """
    med = ordered_median(df, [keys.entity], keys.event, "_med")
    ids = df.select(*keys.occurrence).distinct().join(med, keys.entity)
    rep = keep_first(
        ids.withColumn("_d", F.abs(F.col(keys.event) - F.col("_med"))), [keys.entity], ["_d", keys.event]
    ).select(*keys.occurrence)
    at_rep = df.join(rep, keys.occurrence, "left_semi")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("landmark"), F.lit(1 if c in lm.onsets else -1).alias("sign"), F.col(c).alias("v"))
            for c in lm.boundaries
        ]
    )
    tidy = at_rep.select(*keys.unit, F.col(fs).cast("double").alias("_fs"), F.inline(cells)).filter("v is not null")
    tidy = tidy.withColumn("s", F.col("v") * F.col("sign"))
    # One event of one entity: as many rows as channels in every group.
    per_value = tidy.groupBy(keys.entity, "landmark", "s").agg(
        F.count(F.lit(1)).alias("n"), F.min(keys.channel).alias(keys.channel), F.first("_fs").alias("_fs")
    )
    best = per_value.groupBy(keys.entity, "landmark").agg(
        F.min_by(F.struct("n", keys.channel, "s", "_fs"), "s").alias("b"), F.sum("n").alias("n_all"),
        F.slice(F.sort_array(F.collect_list("s")), 2, 1).alias("nx"),
    )
    sole = best.filter((F.col("n_all") >= 2) & (F.col("b.n") == 1))
    margin = F.coalesce(F.get("nx", F.lit(0)) - F.col("b.s"), F.lit(0)) * F.lit(1000.0) / F.col("b._fs")
    out = sole.select(keys.entity, F.col(f"b.{keys.channel}").alias(keys.channel), "landmark", margin.alias("margin_ms"))
    return out.join(reviewable.select(*keys.unit).distinct(), keys.unit, "left_anti")


def driver_units(drivers: DataFrame, keys: Keys = KEYS) -> DataFrame:
    return drivers.groupBy(*keys.unit).agg(
        F.count(F.lit(1)).alias("n_boundaries_driven"),
        F.array_join(F.array_sort(F.collect_set("landmark")), ";").alias("fiducials"),
        F.round(F.max("margin_ms"), 1).alias("max_margin_ms"),
    )


def margin_histogram(units: DataFrame, steps: Sequence[float] = (0, 4, 10, 20, 40)) -> DataFrame:
    cells = [F.struct(F.lit(float(s)).alias("at_least_ms"), (F.col("max_margin_ms") >= s).cast("int").alias("hit")) for s in steps]
    return units.select(F.inline(F.array(*cells))).groupBy("at_least_ms").agg(
        F.sum(F.col("hit").cast("bigint")).alias("n_units")
    )


def unify_core_boundary(
    df: DataFrame, fallback: DataFrame, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS,
) -> DataFrame:
    """Give all channels of an entity its most common (onset, offset) of the core wave.

    If that offset lies after the entity's earliest next onset, the fallback pair is used where it
    is complete. The next onset is then held at or after the offset. On a tie the smallest pair wins.
    """
    on, off = lm.core_wave.onset, lm.core_wave.offset
    k = [w.name for w in lm.waves].index(lm.core)
    nxt = lm.waves[k + 1].onset
    e = keys.entity
    tally = df.groupBy(e, on, off).agg(F.count(F.lit(1)).alias("_n"))
    common = tally.groupBy(e).agg(F.min_by(F.struct(on, off), F.struct(-F.col("_n"), F.col(on), F.col(off))).alias("_m"))
    first_next = df.groupBy(e).agg(F.min(nxt).alias("_t"))
    fb = fallback.select(e, F.struct(F.col(on), F.col(off)).alias("_f"))
    whole = F.col("_f").getField(on).isNotNull() & F.col("_f").getField(off).isNotNull()
    want = common.join(first_next, e).join(fb, e, "left").select(
        e,
        F.when((F.col("_t") < F.col("_m").getField(off)) & whole, F.col("_f")).otherwise(F.col("_m")).alias("_w"),
    )
    j = df.join(want, e, "left")
    return j.withColumns(
        {
            on: F.col("_w").getField(on),
            off: F.col("_w").getField(off),
            nxt: F.when(F.col(nxt).isNotNull(), F.greatest(F.col(nxt), F.col("_w").getField(off))),
        }
    ).select(*df.columns)


def widen_window(df: DataFrame, start: str, end: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {start: F.least(F.col(start), *[F.col(c) for c in columns]),
         end: F.greatest(F.col(end), *[F.col(c) for c in columns])}
    )


# ---------------------------------------------------------------- events across channels


def nearest_by_order(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: str, right_pos: str, left_id: str, right_id: str,
    tolerance: int | None = None, grain: int = 1 << 20,
) -> DataFrame:
    """The closest right row per left row, found by looking both ways along the position.

    Both sides are merged into one order and each left row takes the last right row before it and
    the first one after it: one sort, and no pair is ever formed, however dense the events are.
    Distances tie to the earlier row.
    """
    cols = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_pos).alias("_p"), F.lit(1).alias("_side"), (-F.col(left_id)).alias("_nid"),
                    F.struct(*cols).alias("_l"))
    b = right.select(*keys, F.col(right_pos).alias("_p"), F.lit(0).alias("_side"), (-F.col(right_id)).alias("_nid"),
                     F.struct(F.col(right_pos).alias("p"), F.col(right_id).alias("id")).alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    # At one position right rows come first, the smallest id last of them, so that one is carried.
    fwd = with_neighbours(both, keys, "_p", ties=["_side", "_nid"], carry={"_before": "_r"}, grain=grain)
    neg = fwd.withColumn("_np", -F.col("_p"))
    out = with_neighbours(neg, keys, "_np", ties=["_side", "_nid"], carry={"_after": "_r"}, grain=grain)
    out = out.filter("_side = 1")
    db = F.col("_p") - F.col("_before.p")
    da = F.col("_after.p") - F.col("_p")
    pick = F.when(F.col("_after").isNull() | (db <= da), F.col("_before")).otherwise(F.col("_after"))
    if tolerance is not None:
        pick = F.when(F.abs(pick.getField("p") - F.col("_p")) <= tolerance, pick)
    res = out.withColumn("_pick", pick)
    return res.select(*keys, "_l.*", F.col("_pick.id").alias(f"near_{right_id}"), F.col("_pick.p").alias(f"near_{right_pos}"))


def event_clusters(
    df: DataFrame, keys: Sequence[str], position: str, tolerance: int, tie: Sequence[str] = (), out: str = "cluster",
    grain: int = 1 << 20,
) -> DataFrame:
    """Label events by the start of their cluster: a gap above the tolerance opens a new one."""
    prev = with_neighbours(df, keys, position, ties=tie, lag={"_prev": position}, grain=grain)
    start = F.when(F.col("_prev").isNull() | (F.col(position) - F.col("_prev") > tolerance), F.col(position))
    opened = prev.withColumn("_start", start).drop("_prev")
    return with_neighbours(opened, keys, position, ties=tie, carry={out: "_start"}, grain=grain).drop("_start")


def event_consensus(
    df: DataFrame, keys: Sequence[str], channel: str, position: str, tolerance: int, n_channels: int,
    tie: Sequence[str] = (), share: float = 0.5, grain: int = 1 << 20,
) -> DataFrame:
    """Clusters that at least ``share`` of the channels agree on, with their rounded median position.

    A cluster is a chain of events no two neighbours of which are further apart than the
    tolerance, so a long chain is one cluster.
    """
    c = event_clusters(df, keys, position, tolerance, tie, grain=grain)
    med = ordered_median(c, [*keys, "cluster"], position, "_m")
    stats = c.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(channel).alias("n_agree")
    )
    ok = stats.filter(F.col("n_agree") >= n_channels * share)
    return ok.join(med, [*keys, "cluster"]).withColumn("position", F.round("_m").cast("bigint")).drop("_m")


def spread_consensus(df: DataFrame, agreed: DataFrame, keys: Sequence[str], channel: str, channels: Sequence) -> DataFrame:
    """Give every listed channel the agreed events it lacks (``matched`` = 0 on those)."""
    have = df.groupBy(*keys, "cluster", channel).agg(F.lit(1).alias("matched"))
    every = F.explode(F.array(*[F.lit(c) for c in channels])).alias(channel)
    grid = agreed.select(*keys, "cluster", "position", every)
    return grid.join(have, [*keys, "cluster", channel], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def matched_events(
    df: DataFrame, keys: Sequence[str], channel: str, position: str, event_id: str, landmarks: Sequence[str], channels: Sequence, tolerance: int,
    share: float = 0.5, grain: int = 1 << 20,
) -> DataFrame:
    """Events that enough channels agree on, by greedy matching with removal.

    Channels take their turn in the order of ``channels``. In its turn, every event a channel still has is matched with the nearest event each
    channel still has within ``tolerance`` (its own event is one of them; distances tie to the earlier, then to the smaller id). If at least
    ``share`` of all listed channels have a match, the event is agreed on, and each landmark becomes the median of its matches, rounded half
    away from zero, NULLs left out. Whatever was matched in a turn, agreed on or not, is out of later turns. Agreed events at one position of
    the record are one event, the one of the earliest turn.

    Rows: keys, ``turn`` (from 1), ``anchor`` (the event whose turn it was), ``position``, ``landmarks``, ``n_agree``, and ``matches``: one
    struct (channel, event_id, landmarks) per matching channel. Events without a position, or of a channel that is not listed, take no part;
    (keys, channel, event_id) must be unique.

    A turn is two passes over one order of the events still there (pieces of ``grain`` positions), in which every event carries the last event of
    each channel; no pairs are formed and no record is gathered.
    """
    keys, landmarks = list(keys), [c for c in landmarks if c != position]
    held = [position, *landmarks]
    left = df.filter(F.col(position).isNotNull() & F.col(channel).isin(*channels)).select(*keys, F.col(channel).alias("_ch"), F.col(event_id).alias("_id"), *[F.col(c) for c in held])
    left = materialise(left)
    event = F.struct(F.col("_id").alias("id"), *[F.col(c) for c in held])
    agreed = []
    for turn, own in enumerate(channels, start=1):
        seen = left.withColumns({f"_r{i}": F.when(F.col("_ch") == F.lit(c), event) for i, c in enumerate(channels)})
        seen = seen.withColumns({"_side": F.lit(0), "_nid": -F.col("_id"), "_p": F.col(position)})
        asks = left.filter(F.col("_ch") == F.lit(own)).withColumns({"_side": F.lit(1), "_nid": -F.col("_id"), "_p": F.col(position)})
        both = seen.unionByName(asks, allowMissingColumns=True)
        carry = [f"_r{i}" for i in range(len(channels))]
        # at one position the events come before those that ask, the smallest id last, so that one is carried
        fwd = with_neighbours(both, keys, "_p", ties=["_side", "_nid"], carry={f"_b{c}": c for c in carry}, grain=grain)
        back = with_neighbours(fwd.withColumn("_np", -F.col("_p")), keys, "_np", ties=["_side", "_nid"], carry={f"_a{c}": c for c in carry}, grain=grain)

        def nearest(i: int) -> Column:
            before, after = F.col(f"_b_r{i}"), F.col(f"_a_r{i}")
            db, da = F.col("_p") - before[position], after[position] - F.col("_p")
            pick = F.when(after.isNull() | (db <= da), before).otherwise(after)
            return F.when(F.abs(pick[position] - F.col("_p")) <= tolerance, pick)

        picked = [F.when(nearest(i).isNotNull(), F.struct(F.lit(c).alias("channel"), nearest(i).alias("event"))) for i, c in enumerate(channels)]
        found = back.filter("_side = 1").select(*keys, F.lit(turn).alias("turn"), F.col("_id").alias("anchor"), F.array_compact(F.array(*picked)).alias("matches"))
        found = materialise(found)
        agreed.append(found.filter(F.size("matches") >= len(channels) * share))
        if turn < len(channels):
            gone = found.select(*keys, F.explode("matches").alias("m")).select(*keys, F.col("m.channel").alias("_ch"), F.col("m.event.id").alias("_id")).distinct()
            left = materialise(left.join(gone, [*keys, "_ch", "_id"], "left_anti"))

    def middle(c: str) -> Column:
        have = F.filter(F.transform("matches", lambda m: m["event"][c].cast("double")), lambda v: v.isNotNull())
        return half_away(A.median(have)).cast("bigint").alias(c)

    rows = functools.reduce(DataFrame.unionByName, agreed)
    rows = rows.select(*keys, "turn", "anchor", *[middle(c) for c in held], F.size("matches").alias("n_agree"), "matches")
    return keep_first(rows, [*keys, position], ["turn", "anchor"])


def spread_matches(agreed: DataFrame, keys: Sequence[str], landmarks: Sequence[str], channels: Sequence, channel: str = "channel") -> DataFrame:
    """One row per agreed event and listed channel: the channel's own matched event, or the agreed landmarks where it has none.

    Rows: keys, turn, anchor, channel, matched, event_id (NULL if not matched), landmarks.
    """
    landmarks = list(landmarks)
    every = agreed.select(*keys, "turn", "anchor", "matches", *[F.col(c).alias(f"_{c}") for c in landmarks], F.explode(F.array(*[F.lit(c) for c in channels])).alias(channel))
    own = F.get(F.filter("matches", lambda m: m["channel"] == F.col(channel)), F.lit(0))["event"]
    with_own = every.withColumn("_own", own)
    has = F.col("_own").isNotNull()
    return with_own.select(
        *keys, "turn", "anchor", channel, has.alias("matched"), F.col("_own.id").alias("event_id"),
        *[F.when(has, F.col(f"_own.{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in landmarks])
