"""Exact top-k search over beat vectors, a block at a time, with bounds from term maxima.

A beat vector's components are its terms, quantised to whole numbers. Vectors of one coarse cell lie together in ranges, and each range is cut
into blocks. A block is a forward index (its vectors, term by term) with every term's largest and smallest value. For a query, the sum over
terms of the larger of ``q * max`` and ``q * min`` bounds every score in the block. A query works through the blocks in falling order of that
bound and stops when it falls below the score of its k-th best vector so far; only blocks that reach the bound are scored.

Queries come in batches of a fixed size and meet every range of blocks, one (batch, range) row at a time; a first pass over each batch's own
range gives every query a k-th score to start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = 256
RANGE = 16384
BATCH = 1024
EXACT = 1 << 53
LOW = -(2**63) + 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, or null if the vector is null or holds a null or non-finite component."""
    v = vector.cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good, F.transform(v, lambda x: F.floor(F.lit(scale) * x)))


def scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating-point matrix products only where no sum can leave the exact range."""
    if q.size and d.size and int(np.abs(q).max()) * int(np.abs(d).max()) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    return q @ d.T


def _pair(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a range for each query, among scores of at least its ``floor``: query row, vector id, score."""
    width = max(q.shape[1], d.shape[1])
    q, d = _pair(q, width), _pair(d, width)
    cut = np.arange(0, len(d), BLOCK)
    top, low = np.maximum.reduceat(d, cut, axis=0), np.minimum.reduceat(d, cut, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = scores(up, top) + scores(down, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), LOW)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = floor.copy()
    for turn in range(len(cut)):
        block = order[:, turn]
        live = bound[np.arange(len(q)), block] >= floor
        if not live.any():
            break
        for b in np.unique(block[live]):
            who = np.flatnonzero(live & (block == b))
            at = slice(cut[b], cut[b] + BLOCK)
            s = scores(q[who], d[at])
            own = d_ids[at][None, :] == q_ids[who][:, None]
            s = np.where(own, LOW, s)
            s = np.concatenate([best[who], s], axis=1)
            i = np.concatenate([best_id[who], np.broadcast_to(d_ids[at], own.shape)], axis=1)
            i = np.where(s == LOW, np.iinfo(np.int64).max, i)
            if s.shape[1] > 4 * k:
                part = np.argpartition(-s, k - 1, axis=1)[:, :k]
                kth = np.take_along_axis(s, part, 1).min(1)
                clear = (s >= kth[:, None]).sum(1) == k
                done, rest = np.flatnonzero(clear), np.flatnonzero(~clear)
                for r, p in ((done, part[done]), (rest, np.lexsort((i[rest], -s[rest]), axis=1)[:, :k])):
                    best[who[r]], best_id[who[r]] = np.take_along_axis(s[r], p, 1), np.take_along_axis(i[r], p, 1)
            else:
                p = np.lexsort((i, -s), axis=1)[:, :k]
                best[who], best_id[who] = np.take_along_axis(s, p, 1), np.take_along_axis(i, p, 1)
        floor = np.maximum(floor, best.min(1))
    row, col = np.nonzero((best_id != np.iinfo(np.int64).max) & (best >= floor[:, None]))
    return row, best_id[row, col], best[row, col]


def _packs(rows: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """One row per ``key``: its ids, its vectors (row after row, padded to the longest) and how many there are. Keys hold a bounded number of rows."""

    def pack(t: pa.Table) -> pa.Table:
        width = max((len(x) for x in t.column("v").to_pylist()), default=0)
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        m = np.zeros((t.num_rows, width), np.int64)
        for i, x in enumerate(t.column("v").to_pylist()):
            m[i, : len(x)] = x
        ids = t.column("id").to_numpy()[order]
        return pa.table({key: [t.column(key)[0].as_py()], names[0]: [ids.astype(np.int64).tobytes()], names[1]: [m[order].tobytes()], names[2]: [width]}, schema=pa.schema([(key, pa.int64()), (names[0], pa.binary()), (names[1], pa.binary()), (names[2], pa.int32())]))

    return rows.groupBy(key).applyInArrow(pack, f"{key} long, {names[0]} binary, {names[1]} binary, {names[2]} int")


def _found(pairs: DataFrame, k: int) -> DataFrame:
    """Run ``search`` on every (batch, range) row: (query_id, unit_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q_vec, q_width, d_ids, d_vec, d_width, floors = (b.column(c)[i].as_py() for c in ("q_ids", "q_vec", "q_width", "d_ids", "d_vec", "d_width", "floors"))
                q_ids, d_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(d_ids, np.int64)
                q, d = np.frombuffer(q_vec, np.int64).reshape(len(q_ids), q_width), np.frombuffer(d_vec, np.int64).reshape(len(d_ids), d_width)
                floor = np.full(len(q_ids), LOW) if floors is None else np.frombuffer(floors, np.int64)
                r, v, s = search(q_ids, q, floor, d_ids, d, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(v), pa.array(s)], names=["query_id", "unit_id", "score"])

    cols = ["q_ids", "q_vec", "q_width", "d_ids", "d_vec", "d_width", "floors"]
    return pairs.select(*cols).mapInArrow(run, "query_id long, unit_id long, score long")


def best_matches(units: DataFrame, queries: Column, unit_id: str = "unit_id", beat: str = "beat", k: int = 5, scale: int = 256, cells: int = 64) -> DataFrame:
    """The ``k`` beat vectors with the largest integer inner product to each query vector.

    units: one row per unit with its representative beat as an array of numbers; ``queries``: a condition that says which units are queries.
    Components become floor(``scale`` * x). Returns (query_id, rank from 1, unit_id, score), ties to the smaller id; a query never meets its own
    id; with fewer than ``k`` others all are returned. The result is exact.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; missing components count as zero.
    Rows that repeat an id with the same vector are one; with another vector the one with the larger sum of components stays. Other columns are not
    read. Scores are whole numbers of 64 bits.
    """
    base = units.select(F.col(unit_id).cast("long").alias("id"), quantised(F.col(beat), scale).alias("v"), queries.alias("is_query")).filter("id is not null and v is not null")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    base = base.groupBy("id").agg(F.max_by("v", F.struct(size, F.array_size("v"), F.xxhash64("v"))).alias("v"), F.max("is_query").alias("is_query"))
    # a coarse cell: the strongest component, signed; equal cells are cut by id hash, so no range grows with a cell
    strongest = F.aggregate(F.transform("v", lambda x, i: F.struct(F.abs(x).alias("a"), (i * 2 + (x < 0).cast("int")).alias("c"))), F.struct(F.lit(-1).cast("long").alias("a"), F.lit(0).alias("c")), lambda a, x: F.when(x["a"] > a["a"], x).otherwise(a))["c"]
    base = materialise(base.withColumn("cell", F.pmod(strongest, F.lit(cells))))
    count = {r[0]: r[1] for r in base.groupBy("cell").agg(F.count(F.lit(1))).collect()}  # at most ``cells`` rows
    total = sum(count.values())
    if not total:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("unit_id"), F.lit(0).cast("long").alias("score")).filter("false")
    # cells share ranges in order of their number; a range holds about RANGE vectors, a large cell many ranges
    edge, at = {}, 0
    for c in sorted(count):
        edge[c] = at
        at += count[c]
    ranges = max(1, -(-total // RANGE))
    place = F.element_at(F.create_map(*[F.lit(x) for c in edge for x in (c, edge[c])]), F.col("cell"))
    width = F.element_at(F.create_map(*[F.lit(x) for c in count for x in (c, count[c])]), F.col("cell"))
    spot = place + (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * width).cast("long")
    ranged = base.select("id", "v", "is_query", F.floor(spot * F.lit(ranges) / F.lit(total)).cast("long").alias("rng"))
    docs = materialise(_packs(ranged, "rng", ("d_ids", "d_vec", "d_width")))
    asked = ranged.filter("is_query")
    n_q = asked.count()
    batches = max(1, -(-n_q // BATCH))
    asked = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(batches)).alias("batch"))
    q = materialise(_packs(asked, "batch", ("q_ids", "q_vec", "q_width")))
    none = F.lit(None).cast("binary").alias("floors")
    start = q.withColumn("rng", F.pmod("batch", F.lit(ranges))).join(docs, "rng").select("*", none)
    first = materialise(_found(start, k))
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).select("query_id", "s")
    known = asked.select("id", "batch").join(floors, F.col("id") == F.col("query_id"), "left").select("batch", "id", F.coalesce("s", F.lit(LOW).cast("long")).alias("s"))

    def line_up(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        return pa.table({"batch": [t.column("batch")[0].as_py()], "floors": [t.column("s").to_numpy()[order].tobytes()]}, schema=pa.schema([("batch", pa.int64()), ("floors", pa.binary())]))

    floors = known.groupBy("batch").applyInArrow(line_up, "batch long, floors binary")
    others = q.join(floors, "batch").withColumn("rng", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long")))).filter(F.col("rng") != F.pmod("batch", F.lit(ranges)))
    rest = _found(others.repartition(max(8, min(4096, batches * ranges)), "rng", "batch").join(docs, "rng"), k)
    both = first.unionAll(rest)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit_id"))
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "unit_id", "score")
