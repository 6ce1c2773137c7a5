"""Byte-balanced shards of records by Karmarkar-Karp differencing.

Records with the same note must stay together. Each such group starts as a partial partition: one shard holds it, the others are empty. The two
partial partitions with the largest spread (fullest minus emptiest shard) are combined in opposite order, the fullest of one with the emptiest
of the other, again and again, until one is left.

Differencing runs in tasks on a bounded number of partial partitions each, and what they leave is differenced again, level by level: a
partial partition is just its shard sums, so a level is smaller than the one below by the number of groups a task takes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

GROUPS = 4096
CHUNK = 20000


def difference(sums: np.ndarray) -> np.ndarray:
    """Combine partial partitions (one row each, shard sums in falling order) into one; gives each row's shards their place in it.

    The result's shards are in falling order of their sums too. Equal spreads are taken in row order.
    """
    n, k = sums.shape
    total = {i: sums[i] for i in range(n)}
    heap = [(-int(s[0] - s[-1]), i) for i, s in total.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        c = total.pop(i) + total.pop(j)[::-1]
        order = np.argsort(-c, kind="stable")
        rank = np.empty(k, np.int64)
        rank[order] = np.arange(k)
        new = n + len(made)
        made.append((i, j, rank))
        total[new] = c = c[order]
        heapq.heappush(heap, (-int(c[0] - c[-1]), new))
    place = np.empty((n + len(made), k), np.int64)
    place[-1] = np.arange(k)
    for m in range(len(made) - 1, -1, -1):
        i, j, rank = made[m]
        up = place[n + m]
        place[i] = up[rank]
        place[j] = up[rank[::-1]]
    return place[:n]


def _level(nodes: DataFrame, n_nodes: int, n_shards: int) -> tuple[DataFrame, int]:
    """Difference partial partitions (node, pos, bytes) inside tasks: (node, pos, up, up_pos), and how many are left."""
    left = -(-n_nodes // GROUPS)

    def run(t: pa.Table) -> pa.Table:
        node, pos, size = (t.column(c).to_numpy() for c in ("node", "pos", "bytes"))
        order = np.lexsort((pos, node))
        node, pos, size = node[order], pos[order], size[order]
        own, row = np.unique(node, return_inverse=True)
        sums = np.zeros((len(own), n_shards), np.int64)
        sums[row, pos] = size
        place = difference(sums)
        return pa.table({"node": node, "pos": pos.astype(np.int32), "up": np.full(len(node), t.column("up")[0].as_py(), np.int64), "up_pos": place[row, pos].astype(np.int32)})

    dealt = nodes.select("node", "pos", "bytes", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(left)).alias("up"))
    return materialise(dealt.groupBy("up").applyInArrow(run, "node long, pos int, up long, up_pos int")), left


def shard_records(records: DataFrame, n_shards: int = 40, record_id: str = "record_id", text: str = "notes", overhead: int = 16) -> DataFrame:
    """Put every record into one of ``n_shards`` shards of nearly equal bytes; records with equal notes stay together.

    A record's size is its note's UTF-8 bytes (null: none) plus ``overhead``. Returns ``record_id``, ``size``, ``text_crc32`` (unsigned, of
    the UTF-8 bytes; null for a null note), ``shard`` (int from 0) and ``slot`` (long, gapless from 0 inside its shard, by a hash of the id).

    All null notes are one group, all empty ones another. Repeated rows each take a slot. Rows with a null id are placed too. A group larger
    than a fair share fills its shard alone as far as it can; nothing is split. Other columns are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    note = F.col(text).cast("string")
    raw = note.cast("binary")
    rows = records.select(
        F.col(record_id).cast("long").alias("record_id"), (F.coalesce(F.octet_length(note), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(raw)), F.lit(bytearray(b""))).alias("key"))
    rows = materialise(rows)
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    # a group's number only has to be its own within its bucket of the first level
    n = groups.count()
    cut = max(1, -(-n // GROUPS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(cut))

    def first(t: pa.Table) -> pa.Table:
        key, size = t.column("key").combine_chunks(), t.column("bytes").to_numpy()
        order = np.lexsort((np.array([k.as_py() for k in key], object).astype("S16"), -size))
        sums = np.zeros((len(size), n_shards), np.int64)
        sums[:, 0] = size[order]
        place = np.empty(len(size), np.int64)
        place[order] = difference(sums)[:, 0]
        return pa.table({"key": key, "bytes": size, "n": t.column("n"), "node": np.full(len(size), t.column("node")[0].as_py(), np.int64), "pos": place.astype(np.int32)})

    placed = materialise(groups.withColumn("node", bucket).groupBy("node").applyInArrow(first, "key binary, bytes long, n long, node long, pos int"))
    step = materialise(placed.groupBy("node", "pos").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    path = step.select("node", "pos", F.col("node").alias("up"), F.col("pos").alias("up_pos"))
    left = cut
    while left > 1:
        # every node states all its shards, the empty ones too
        shape = step.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("pos")).join(step.select("node", "pos", "bytes"), ["node", "pos"], "left").fillna(0, ["bytes"])
        moved, left = _level(shape, left, n_shards)
        step = materialise(step.join(moved, ["node", "pos"]).groupBy(F.col("up").alias("node"), F.col("up_pos").alias("pos")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
        path = materialise(path.join(moved.select(F.col("node").alias("up"), F.col("pos").alias("up_pos"), F.col("up").alias("_u"), F.col("up_pos").alias("_p")), ["up", "up_pos"]).select("node", "pos", F.col("_u").alias("up"), F.col("_p").alias("up_pos")))
    shard = path.select("node", "pos", F.col("up_pos").alias("shard"))
    home = placed.select("key", "node", "pos").join(shard, ["node", "pos"]).select("key", "shard")
    most = step.agg(F.max("n")).first()[0] or 0
    chunks = max(1, -(-most // CHUNK))
    order = F.xxhash64("record_id")
    dealt = materialise(rows.join(home, "key").select("record_id", "size", "text_crc32", "key", "shard", F.pmod(order, F.lit(chunks)).cast("int").alias("chunk")))
    many = dealt.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select("shard", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("shard", "chunk").orderBy(order, "record_id", "key")
    return dealt.join(many, ["shard", "chunk"]).select("record_id", "size", "text_crc32", "shard", (F.col("_from") + F.row_number().over(inside) - 1).cast("long").alias("slot"))
