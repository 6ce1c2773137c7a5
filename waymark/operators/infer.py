"""Bootstrap intervals and the decisions taken on them.

A replicate gives every row (or cluster) an independent Poisson(1) weight. That is the distributed form of drawing n rows with replacement:
no draw needs to know the others. Equal values of a group are counted first, and c equal rows get one Poisson(c) weight, which has the
distribution of c single ones; so the work is distinct values times replicates. Weights are a pure function of (seed, value or cluster, replicate).
Replicates are laid out as a matrix inside tasks, and only their sums or medians leave a task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import continue_draw, key_parts, poisson_one, poisson_weights, with_state
from ..session import materialise
from .quantiles import grouped_quantiles, running_counts

MIN_ROWS = 8
RANGE_VALUES = 8192
REP_BLOCK = 500
MOST_GROUPS = 256


def replicates(df: DataFrame, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """Rows x replicates: adds ``rep`` and the weight ``w`` (0 in about a third of the cases).

    The row key is mixed before the replicates are laid out, so each of them costs one step.
    """
    keyed = with_state(df, "_u", seed, key_parts(df, ids))
    spread = keyed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return continue_draw(spread, "_u", F.col("rep")).withColumn("w", poisson_one(F.col("_u"))).drop("_u")


def _interval(stats: DataFrame, by: Sequence[str], alpha: float, names: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Interval ends of each statistic; ``names`` maps a column of replicates to the names of its ends."""
    names = names or {"_s": ("ci_lo", "ci_hi")}
    return stats.groupBy(*by).agg(*[F.percentile(c, p).alias(end) for c, ends in names.items() for p, end in zip((alpha / 2, 1 - alpha / 2), ends, strict=True)])


def _value_key(v: np.ndarray) -> np.ndarray:
    """A value as a whole number of millionths."""
    return np.rint(v * 1e6).astype(np.int64)


def weight_blocks(seed: int, v: np.ndarray, c: np.ndarray, reps: np.ndarray, cells: int = 1 << 21) -> Iterator[tuple[slice, np.ndarray]]:
    """Weights of values (rows) for replicates (columns), some replicates at a time so that a block stays small."""
    key = _value_key(v)
    step = max(1, cells // max(1, len(v)))
    for lo in range(0, len(reps), step):
        at = slice(lo, min(lo + step, len(reps)))
        yield at, poisson_weights(seed, [key], c, reps[at])


def ranked_values(v: np.ndarray, w: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value at a place (from 0) of each replicate's drawn rows; values ascend, and a replicate is a column of weights."""
    return v[(w.cumsum(0) <= place).sum(0)]


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in names)


def _one(t: pa.Table, columns: Sequence[str], n: int) -> dict:
    """The first row's values of ``columns``, ``n`` times."""
    row = pa.array(np.zeros(n, np.int64))
    return {c: t.column(c).take(row) for c in columns}


def _in_order(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v, c = t.column("_v").to_numpy(), t.column("_c").to_numpy()
    order = np.argsort(v, kind="stable")
    return v[order], c[order]


def _median_replicates(counts: DataFrame, by: list[str], n: int, seed: int, most: int = RANGE_VALUES) -> DataFrame:
    """(by, _s): one median per replicate from (by, _v, _c), where no task sees more than ``most`` distinct values of a group.

    A group with more is cut into ranges of its value order. Every range adds up its weights per replicate; running sums over the ranges of a
    group find the one or two ranges that hold each replicate's median and the place inside them; only there are values ranked. Weights depend
    on value and replicate alone, so the second look draws the same ones.
    """
    if not by:
        return _median_replicates(counts.withColumn("_all", F.lit(0)), ["_all"], n, seed, most).drop("_all")
    reps = np.arange(n, dtype=np.int64)
    counts = materialise(counts)
    size = materialise(counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_d")))
    whole = counts.join(size.filter(F.col("_d") <= most).select(*by), by, "left_semi")

    def direct(t: pa.Table) -> pa.Table:
        v, c = _in_order(t)
        out = np.full(n, np.nan)
        for at, w in weight_blocks(seed, v, c, reps):
            total = w.sum(0)
            live = np.flatnonzero(total)
            w, total = w[:, live], total[live]
            out[at][live] = (ranked_values(v, w, (total - 1) // 2) + ranked_values(v, w, total // 2)) / 2
        return pa.table({**_one(t, by, n), "_s": pa.array(out, from_pandas=True)})

    shape = _fields(counts, by)
    small = whole.groupBy(*by).applyInArrow(direct, shape + "_s double")
    if not size.filter(F.col("_d") > most).limit(1).count():
        return small
    wide = counts.join(size.filter(F.col("_d") > most).select(*by), by, "left_semi")
    run = running_counts(wide, by, "_v")
    inner = W.partitionBy(*by, "_piece").orderBy("_v")
    cut = materialise(run.withColumn("_range", F.floor((F.row_number().over(inner) - 1) / most)).select(*by, "_v", "_c", "_piece", "_range"))
    where = [*by, "_piece", "_range"]
    shape = _fields(cut, where)

    def sums(t: pa.Table) -> pa.Table:
        v, c = _in_order(t)
        total = np.zeros(n, np.int64)
        for at, w in weight_blocks(seed, v, c, reps):
            total[at] = w.sum(0)
        return pa.table({**_one(t, where, 1), "_w": pa.array([total], pa.list_(pa.int64()))})

    held = materialise(cut.groupBy(*where).applyInArrow(sums, shape + "_w array<bigint>"))
    laid = held.select(*where, F.posexplode("_w").alias("rep", "_w"))
    total = laid.groupBy(*by, "rep").agg(F.sum("_w").alias("_t"))
    order = W.partitionBy(*by, "rep").orderBy("_piece", "_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = laid.withColumn("_b", F.sum("_w").over(order) - F.col("_w")).join(total, [*by, "rep"])
    middle = F.explode(F.array(F.floor((F.greatest("_t", F.lit(1)) - 1) / 2), F.floor(F.col("_t") / 2))).alias("_place")
    wanted = upto.filter("_t > 0 and _w > 0").select(*where, "rep", "_b", "_w", middle)
    wanted = wanted.withColumn("_place", F.col("_place") - F.col("_b")).filter("_place >= 0 and _place < _w")
    asked = wanted.groupBy(*where).agg(F.collect_list(F.struct(F.col("rep").cast("long").alias("rep"), F.col("_place").cast("long").alias("place"))).alias("_asked"))

    def pick(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        # a range asks for two places of each replicate at most
        if not a.num_rows or not t.num_rows:
            return pa.table({**_one(t, by, 0), "rep": pa.array([], pa.int64()), "_x": pa.array([], pa.float64())})
        v, c = _in_order(t)
        rows = a.column("_asked").combine_chunks().flatten()
        rep, place = rows.field("rep").to_numpy(), rows.field("place").to_numpy()
        out = np.empty(len(rep))
        for at, w in weight_blocks(seed, v, c, rep):
            out[at] = ranked_values(v, w, place[at])
        return pa.table({**_one(t, by, len(rep)), "rep": pa.array(rep), "_x": pa.array(out)})

    picked = cut.groupBy(*where).cogroup(asked.groupBy(*where)).applyInArrow(pick, _fields(cut, by) + "rep bigint, _x double")
    medians = picked.groupBy(*by, "rep").agg(F.avg("_x").alias("_s")).drop("rep")
    return small.unionByName(medians)


def _codes(t: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each row's values of ``columns``, and the first row of each number."""
    code = np.zeros(len(t), np.int64)
    for c in columns:
        own = t.column(c).combine_chunks().dictionary_encode()
        index = pc.fill_null(own.indices, len(own.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(own.dictionary) + 1) + index, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _sum_replicates(per: DataFrame, by: list[str], keys: Sequence[str], n: int, seed: int, values: Sequence[tuple[str, str]] = (("_s0", "_n0"),)) -> DataFrame:
    """(by, _s0, _s1, ...): sum(s * w) / sum(n * w) per replicate for each pair (s, n) of ``values``, with weights Poisson(_c) by ``keys``.

    Rows with one key and count are brought together, so their weights are drawn once for all groups and values; a task multiplies them with
    a matrix of its rows' values. Blocks of ``REP_BLOCK`` replicates of each group are then added up over the tasks.
    """
    reps = np.arange(n, dtype=np.int64)
    columns = [c for pair in values for c in pair]
    blocks = [(i, slice(lo, min(lo + REP_BLOCK, n))) for i, lo in enumerate(range(0, n, REP_BLOCK))]
    heads = _fields(per, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: dict[str, pa.DataType] = {}

        def emit() -> pa.RecordBatch:
            many = len(blocks) * len(held)
            flat = [total[:, at].ravel() for total in held.values() for _, at in blocks]
            sizes = np.cumsum([0, *map(len, flat)])
            names = [pa.array([g[i] for g in held for _ in blocks], kinds[c]) for i, c in enumerate(by)]
            lists = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.concatenate(flat)))
            return pa.RecordBatch.from_arrays([*names, pa.array(np.tile([i for i, _ in blocks], len(held)).astype(np.int32)[:many]), lists], names=[*by, "_blk", "_a"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            kinds = {f.name: f.type for f in batch.schema}
            group, g_first = _codes(t, by)
            drawn, d_first = _codes(t, [*keys, "_c"])
            value = np.stack([t.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            names = list(zip(*(t.column(c).take(pa.array(g_first)).to_pylist() for c in by), strict=True)) if by else [()]
            parts = [t.column(c).to_numpy(zero_copy_only=False)[d_first] for c in keys]
            parts = [_value_key(k) if k.dtype.kind == "f" else k for k in parts]
            count = t.column("_c").to_numpy()[d_first]
            order = np.argsort(drawn, kind="stable")
            edge = np.searchsorted(drawn[order], np.arange(0, len(d_first) + 256, 256))
            for lo in range(0, len(d_first), 256):
                rows = order[edge[lo // 256] : edge[lo // 256 + 1]]
                w = poisson_weights(seed, [k[lo : lo + 256] for k in parts], count[lo : lo + 256], reps).astype(np.float64)
                seen, at = np.unique(group[rows], return_inverse=True)
                left = np.zeros((len(seen), len(columns), len(w)))
                np.add.at(left, (at[:, None], np.arange(len(columns)), (drawn[rows] - lo)[:, None]), value[:, rows].T)
                totals = (left.reshape(-1, len(w)) @ w).reshape(len(seen), len(columns), -1)
                for g, total in zip(seen, totals, strict=True):
                    if names[g] in held:
                        held[names[g]] += total
                    else:
                        held[names[g]] = total
            if len(held) > MOST_GROUPS:
                yield emit()
                held = {}
        if held:
            yield emit()

    def add_up(t: pa.Table) -> pa.Table:
        total = t.column("_a").combine_chunks().flatten().to_numpy().reshape(len(t), len(columns), -1).sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = [pa.array(np.where(total[2 * i + 1] != 0, total[2 * i] / total[2 * i + 1], np.nan), from_pandas=True) for i in range(len(values))]
        return pa.table({**_one(t, by, total.shape[1]), **{f"_s{i}": x for i, x in enumerate(out)}})

    # a number of partitions keeps adaptive execution from joining them by their bytes: the work is rows times replicates
    width = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = per.select(*dict.fromkeys([*by, *columns, "_c", *keys])).repartition(width, *keys, "_c")
    sums = slim.mapInArrow(run, f"{heads}_blk int, _a array<double>")
    return sums.groupBy(*by, "_blk").applyInArrow(add_up, heads + ", ".join(f"_s{i} double" for i in range(len(values))))


def bootstrap_ci(
    df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str],
    stat: str | Callable[[Column, Column], Column] = "median", n: int = 5000, seed: int = 20260725, alpha: float = 0.05,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Rows: by, n, point, ci_lo, ci_hi. Below ``min_rows`` rows only the point is given.

    ``stat`` is "median", "mean" or an aggregate factory taking (value, weight) columns; a factory is run on every row and replicate, with
    draws by ``ids``.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    size = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    if stat == "mean":
        point = counts.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("point"))
        per = counts.withColumns({"_s0": F.col("_v"), "_n0": F.lit(1.0)})
        stats = _sum_replicates(per, by, ["_v"], n, seed).withColumnRenamed("_s0", "_s")
    elif stat == "median":
        point = grouped_quantiles(rows, by, "_v", [0.5], ["point"])
        stats = _median_replicates(counts, by, n, seed)
    else:
        reps = replicates(rows.select(*by, "_v", *[c for c in ids if c not in by]), ids, n, seed)
        point = rows.groupBy(*by).agg(stat(F.col("_v"), F.lit(1)).alias("point"))
        stats = reps.groupBy(*by, "rep").agg(stat(F.col("_v"), F.col("w")).alias("_s"))
    ci = _interval(stats, by, alpha)
    out = size.join(point, by).join(ci, by) if by else size.crossJoin(point).crossJoin(ci)
    few = F.col("n") < min_rows
    return out.select(
        *by, "n", "point", F.when(~few, F.col("ci_lo")).alias("ci_lo"), F.when(~few, F.col("ci_hi")).alias("ci_hi")
    )


def paired_delta_ci(
    df: DataFrame, by: Sequence[str], a: str, b: str, ids: Sequence[str], n: int = 5000, seed: int = 20260726, alpha: float = 0.05,
) -> DataFrame:
    """mean(a) - mean(b) over rows that have both, with its interval (as ``point``)."""
    d = df.withColumn("_d", F.col(a).cast("double") - F.col(b).cast("double"))
    return bootstrap_ci(d, by, "_d", ids, "mean", n, seed, alpha)


def cluster_bootstraps(
    df: DataFrame, by: Sequence[str], values: Sequence[str], cluster: str, mode: str = "record_mean", n: int = 5000, seed: int = 1337, alpha: float = 0.05,
) -> DataFrame:
    """Intervals of several means under the same draws of clusters: by, and for each value i from 0 n_clusters_i, point_i, ci_lo_i, ci_hi_i.

    record_mean  the mean of cluster means
    units        the mean over rows, drawn cluster by cluster
    Rows are reduced to (sum, count) per cluster before anything is replicated; a value counts the clusters in which it is present.
    """
    if mode not in ("record_mean", "units"):
        raise ValueError(f"unknown mode {mode!r}")
    by, each = list(by), range(len(values))
    sums = [F.sum(F.col(v).cast("double")).alias(f"_s{i}") for i, v in enumerate(values)]
    per = df.filter(functools.reduce(lambda x, y: x | y, (F.col(v).isNotNull() for v in values))).groupBy(*by, cluster).agg(*sums, *[F.count(v).cast("double").alias(f"_n{i}") for i, v in enumerate(values)])
    if mode == "record_mean":
        per = per.select(*by, cluster, *[F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}") / F.col(f"_n{i}")).alias(f"_s{i}") for i in each], *[F.when(F.col(f"_n{i}") > 0, 1.0).otherwise(0.0).alias(f"_n{i}") for i in each])
    per = materialise(per.fillna(0.0, [f"_s{i}" for i in each]))
    point = per.groupBy(*by).agg(
        *[F.count_if(F.col(f"_n{i}") > 0).alias(f"n_clusters_{i}") for i in each], *[F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(f"point_{i}") for i in each])
    drawn = per.withColumns({"_c": F.lit(1).cast("long"), "_key": key_parts(per, [cluster])[0].cast("long")})
    stats = _sum_replicates(drawn, by, ["_key"], n, seed, [(f"_s{i}", f"_n{i}") for i in each])
    ci = _interval(stats, by, alpha, {f"_s{i}": (f"ci_lo_{i}", f"ci_hi_{i}") for i in each})
    return point.join(ci, by, "left") if by else point.crossJoin(ci)


def cluster_bootstrap(
    df: DataFrame, by: Sequence[str], value: str, cluster: str, mode: str = "record_mean", n: int = 5000, seed: int = 1337,
    alpha: float = 0.05,
) -> DataFrame:
    """Interval of a mean whose resampling unit is the cluster: by, n_clusters, point, ci_lo, ci_hi (see ``cluster_bootstraps``)."""
    out = cluster_bootstraps(df, by, [value], cluster, mode, n, seed, alpha)
    return out.withColumnsRenamed({f"{c}_0": c for c in ("n_clusters", "point", "ci_lo", "ci_hi")})


def verdict(lo: Column, hi: Column, negative: str, positive: str, none: str = "no difference") -> Column:
    """Named side when the interval clears zero."""
    return F.when(hi < 0, negative).when(lo > 0, positive).otherwise(none)


def is_biased(point: Column, lo: Column, hi: Column, least: float = 2.0) -> Column:
    """Interval clear of zero and at least ``least`` in size; undefined intervals decide nothing."""
    return F.coalesce(((lo > 0) | (hi < 0)) & (F.abs(point) >= least), F.lit(False))
