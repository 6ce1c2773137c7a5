"""Structured Streaming forms of the jobs that run as tables arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import with_neighbours
from ..operators.qc import QcRules, beat_qc
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from ..sources.buckets import fold_changes


def qc_stream(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, lm: Landmarks = LANDMARKS_11, rules: QcRules = QcRules(),
) -> StreamingQuery:
    """Rate newly landed landmark files, each exactly once; restarting goes on where it stopped.

    The row rules keep no state, so the stream is the batch operator between a file source and a
    file sink.
    """
    rated = beat_qc(spark.readStream.schema(schema).parquet(source), lm, rules)
    out = rated.withColumn("qc_flags", F.array_join("qc_flags", ";"))
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_feed(
    spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, keys: Keys = KEYS, by: tuple[str, ...] = ("edited_at",), n_buckets: int = 64,
) -> StreamingQuery:
    """Fold an append-only corrections feed into a bucketed table, the newest version of a key winning.

    A micro-batch rewrites the buckets that hold its keys and no others. A replayed batch changes nothing: its number is part of the version that
    it made.
    """
    def fold(batch: DataFrame, number: int) -> None:
        fold_changes(batch, root, keys.unit, by, n_buckets, feed=checkpoint, batch=number)

    feed = spark.readStream.schema(schema).parquet(source)
    return feed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_excluded(stream: DataFrame, excluded: DataFrame, key: str = "record_id") -> DataFrame:
    """Stream rows of entities that are not excluded (stream-static anti join)."""
    return stream.join(excluded.select(key).distinct(), key, "left_anti")


def rate_monitor(
    events: DataFrame, time: str, by: list[str], window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes",
) -> DataFrame:
    """Counts per window; rows later than the watermark are dropped. Works on batch tables too."""
    e = events.withWatermark(time, watermark) if events.isStreaming else events
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return e.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), *by, "n")


def burst_monitor(events: DataFrame, time: str, by: list[str], gap: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Chains of events with gaps below ``gap`` per group: start, last event's gap end, count."""
    e = events.withWatermark(time, watermark) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), *by, "n")


def short_gaps(events: DataFrame, keys: Sequence[str], position: str, event_id: str, limit: int, grain: int = 1 << 20) -> DataFrame:
    """Events that follow the previous event of their unit at ``limit`` or less, from a table: keys, previous, event_id, position, gap.

    Events at one position are in the order of their ids.
    """
    found = with_neighbours(events, list(keys), position, ties=[event_id], lag={"previous": event_id, "_before": position}, grain=grain)
    gap = F.col(position) - F.col("_before")
    return found.withColumn("gap", gap).filter(F.col("gap") <= limit).select(*keys, "previous", event_id, position, "gap")


def short_gap_monitor(
    events: DataFrame, keys: Sequence[str], time: str, position: str, event_id: str, limit: int, watermark: str = "10 minutes", n_buckets: int = 1024,
) -> DataFrame:
    """``short_gaps`` on a stream: a gap counts although its events arrive in different micro-batches, or out of order.

    Per unit the state holds the last event that is final and the events above the watermark, which a late one may still precede; so its size is
    what a unit can send within the delay. ``time`` is the event time of ``position``. When the watermark passes an event it is compared with the
    one before it and reported, by a timer if the unit sends nothing more. Rows later than the watermark are dropped.

    Units come in ``n_buckets`` buckets by a hash of their keys, and a bucket's units share one call and one state row: a call costs some
    milliseconds however few its rows, so there must not be one for each unit and micro-batch. The count is fixed for a checkpoint's life. Keys
    go to Python as text, in which an absent one stays absent.
    """
    kinds = dict(events.dtypes)
    held_as = {k: "binary" if kinds[k] == "binary" else "string" for k in keys}
    out = ", ".join([*(f"`{k}` {held_as[k]}" for k in keys), f"previous {kinds[event_id]}, `{event_id}` {kinds[event_id]}, `{position}` bigint, gap bigint"])
    units = ", ".join(f"key{n} array<{held_as[k]}>" for n, k in enumerate(keys))
    state = f"{units}, last_pos array<bigint>, last_id array<{kinds[event_id]}>, at array<int>, ms array<bigint>, pos array<bigint>, ids array<{kinds[event_id]}>"
    names = [*keys, "previous", event_id, position, "gap"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *columns, last_pos, last_id, at, ms, pos, ids = (list(c) for c in held.get) if held.exists else ([] for _ in range(len(keys) + 6))
        known = {unit: n for n, unit in enumerate(zip(*columns, strict=True))}
        waiting = list(zip(at, ms, pos, ids, strict=True))
        for f in frames:
            at = [known.setdefault(unit, len(known)) for unit in zip(*(f[k].tolist() for k in keys), strict=True)]
            waiting += zip(at, f["_ms"].tolist(), f[position].tolist(), f[event_id].tolist(), strict=True)
        last_pos += [None] * (len(known) - len(last_pos))
        last_id += [None] * (len(known) - len(last_id))
        unit_of = list(known)
        mark = held.getCurrentWatermarkMs()
        final = sorted((e for e in waiting if e[1] <= mark), key=lambda e: (e[0], *e[2:]))
        waiting = [e for e in waiting if e[1] > mark]
        rows = []
        for n, _, p, i in final:
            if last_pos[n] is not None and p - last_pos[n] <= limit:
                rows.append((*unit_of[n], last_id[n], i, p, p - last_pos[n]))
            last_pos[n], last_id[n] = p, i
        above = [list(c) for c in zip(*waiting, strict=True)] or [[], [], [], []]
        held.update((*(list(c) for c in zip(*unit_of, strict=True)), last_pos, last_id, *above))
        if waiting:
            held.setTimeoutTimestamp(max(min(e[1] for e in waiting), mark + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    marked = events.filter(F.col(position).isNotNull()).withWatermark(time, watermark)
    slim = marked.select(
        F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int").alias("_bucket"), *[F.col(k).cast(held_as[k]).alias(k) for k in keys],
        time, F.col(position).cast("bigint").alias(position), event_id, F.unix_millis(time).alias("_ms"),
    )
    found = slim.groupBy("_bucket").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *names[len(keys):])


def drain(query: StreamingQuery, timeout: int | None = None, then: Callable[[], None] | None = None) -> None:
    """Wait for an available-now query to finish; it ends by itself, so only a ``timeout`` in seconds that the caller names stops it."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not finish in time")
    if then:
        then()
