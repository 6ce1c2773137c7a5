"""Queries on parsing, set operations and event rates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import streaming
from ..functions import scalar as S
from ..session import materialise, shared_folder
from ..sources import readers
from .fixtures import BEATS_SQL, EVENTS_SQL, beats, events, micros, table
from .registry import query


@query(
    "event_rate_hourly",
    "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS from_us, count(*) AS n FROM events GROUP BY ALL",
)
def event_rate_hourly(spark, sf):
    r = streaming.rate_monitor(table(spark, sf, "events"), "ts", ["event_type"])
    return r.select("event_type", micros("from_ts").alias("from_us"), "n")


@query(
    "event_rate_sliding",
    """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events)
    SELECT event_type, epoch_us(s) AS from_us, count(*) AS n FROM w GROUP BY ALL""",
)
def event_rate_sliding(spark, sf):
    r = streaming.rate_monitor(table(spark, sf, "events"), "ts", ["event_type"], "2 hours", "1 hour")
    return r.select("event_type", micros("from_ts").alias("from_us"), "n")


@query(
    "event_bursts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS from_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_bursts(spark, sf):
    b = streaming.burst_monitor(table(spark, sf, "events"), "ts", ["user_id"])
    return b.select("user_id", micros("from_ts").alias("from_us"), "n")


@query(
    "key_value_lines",
    "SELECT 'p' || CAST(user_id AS VARCHAR) AS path, max(CASE WHEN event_type = 'click' THEN user_id + 0.5::DOUBLE END) AS \"APD.min\", max(CASE WHEN event_type = 'view' THEN user_id + 1.5::DOUBLE END) AS \"APD.max\" "
    "FROM events WHERE event_type IN ('click','view') GROUP BY user_id",
)
def key_value_lines(spark, sf):
    e = table(spark, sf, "events")
    key = F.when(F.col("event_type") == "click", "APD.min").when(F.col("event_type") == "view", "APD.max").otherwise(F.col("event_type"))
    v = F.col("user_id") + F.when(F.col("event_type") == "click", 0.5).otherwise(1.5)
    lines = e.select(F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit(":"), key, F.lit(","), v.cast("string")).alias("value"))
    return readers.key_values(lines, ["APD.min", "APD.max"])


@query(
    "run_log_lines",
    "SELECT CAST(l_linenumber AS INTEGER) AS epoch, CAST(l_partkey % 90 AS INTEGER) AS step, 90 AS steps, l_discount AS loss, CAST((l_linenumber - 1)*90 + l_partkey % 90 AS INTEGER) AS global_step FROM lineitem",
)
def run_log_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.concat(
        F.lit("12:00:01 epoch "), F.col("l_linenumber").cast("string"), F.lit(" step "), (F.col("l_partkey") % 90).cast("string"), F.lit("/90 loss "), F.col("l_discount").cast("string"))
    return readers.run_log(li.select(text.alias("value")))


@query(
    "parsed_numbers",
    "SELECT count(*) FILTER (s <> '' AND s <> 'None') AS n_present, count(*) FILTER (s = '' OR s = 'None') AS n_absent, CAST(sum(CASE WHEN s NOT IN ('', 'None') THEN CAST(CAST(s AS DOUBLE) AS BIGINT) END) AS BIGINT) AS total "
    "FROM (SELECT CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'None' ELSE CAST(l_quantity AS VARCHAR) END AS s FROM lineitem) z",
)
def parsed_numbers(spark, sf):
    t = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, " None ").otherwise(F.col("l_quantity").cast("string"))
    d = table(spark, sf, "lineitem").select(S.parse_int(t).alias("v"))
    return d.agg(F.count("v").alias("n_present"), F.count_if(F.col("v").isNull()).alias("n_absent"), F.sum("v").alias("total"))


@query(
    "union_of_shards",
    f"WITH {BEATS_SQL}, a AS (SELECT record_id, lead FROM beats WHERE lead <= 3), b AS (SELECT record_id, lead FROM beats WHERE lead >= 3) "
    "SELECT lead, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) z GROUP BY lead",
)
def union_of_shards(spark, sf):
    b = beats(spark, sf).select("record_id", "lead")
    return b.filter("lead <= 3").unionByName(b.filter("lead >= 3")).groupBy("lead").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pending_inputs",
    f"WITH {BEATS_SQL} SELECT DISTINCT c_custkey AS record_id FROM customer WHERE c_custkey NOT IN (SELECT record_id FROM beats WHERE disease_class IN ('BUILDING','FURNITURE'))",
)
def pending_inputs(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"))
    return readers.pending(c, beats(spark, sf).filter("disease_class in ('BUILDING', 'FURNITURE')"), ["record_id"])


@query(
    "lookup_overwrite_non_blank",
    "SELECT c_mktsegment AS kind, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) z GROUP BY 1",
)
def lookup_overwrite_non_blank(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(" ").alias("m"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.groupBy(F.coalesce(S.non_blank(F.col("m")), F.col("c_mktsegment")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "custom_order_rank",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 99 END AS rank FROM orders ORDER BY rank, o_orderkey",
)
def custom_order_rank(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.rank_of(F.col("o_orderstatus"), ("P", "F", "O")).alias("rank")).orderBy("rank", "o_orderkey")


GAP = 1_800_000_000
_GAPS_SQL = f"""{EVENTS_SQL}, p AS (SELECT record_id, event_id, pos, lag(event_id) OVER w AS previous, pos - lag(pos) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY record_id ORDER BY pos, event_id))"""


@query("short_gaps", f"WITH {_GAPS_SQL} SELECT record_id, previous, event_id, pos, gap FROM p WHERE gap <= {GAP}")
def short_gaps(spark, sf):
    return streaming.short_gaps(events(spark, sf), ["record_id"], "pos", "event_id", GAP, grain=86_400_000_000)


@query(
    "short_gaps_live",
    f"WITH {_GAPS_SQL} SELECT record_id, previous, event_id, pos, gap FROM p WHERE gap <= {GAP} AND pos // 1000 <= (SELECT max(pos) FROM ev) // 1000 - 600000",
)
def short_gaps_live(spark, sf):
    """The same as a stream over files that land in order of time; events the last watermark has not passed are not reported yet."""
    root = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    ev = materialise(events(spark, sf).select("record_id", "event_id", "pos", F.timestamp_micros("pos").alias("ts")))
    cuts = ev.agg(F.percentile_approx("pos", [0.3, 0.6])).first()[0]
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = ev.filter((F.lit(lo).isNull() | (F.col("pos") > F.lit(lo))) & (F.lit(hi).isNull() | (F.col("pos") <= F.lit(hi))))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    feed = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    found = streaming.short_gap_monitor(feed, ["record_id"], "ts", "pos", "event_id", GAP)
    sink = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    streaming.drain(sink)
    return spark.read.schema(found.schema).parquet(f"{root}/out")


_DOCUMENT = """CASE WHEN beat_id % 17 = 0 THEN 'beat lost' ELSE '{"lead_' || lead || '":{"qrs":' || qrs_onset || ',"t":' || coalesce(CAST(t_peak AS STRING), 'null') || '},"last":' || beat_id || ',"tag":"x' || beat_id % 5 || '"}' END"""


@query(
    "merged_documents",
    f"""WITH {BEATS_SQL}, g AS (SELECT * FROM beats WHERE beat_id % 17 <> 0),
    l AS (SELECT record_id, beat_id, lead, 'lead_' || lead || '/qrs' AS path, CAST(qrs_onset AS VARCHAR) AS value FROM g UNION ALL SELECT record_id, beat_id, lead, 'lead_' || lead || '/t', coalesce(CAST(t_peak AS VARCHAR), 'null') FROM g
      UNION ALL SELECT record_id, beat_id, lead, 'last', CAST(beat_id AS VARCHAR) FROM g UNION ALL SELECT record_id, beat_id, lead, 'tag', '"x' || beat_id % 5 || '"' FROM g),
    m AS (SELECT record_id, path, value FROM l QUALIFY row_number() OVER (PARTITION BY record_id, path ORDER BY beat_id DESC, lead DESC) = 1)
    SELECT * FROM m UNION ALL SELECT record_id, 'set aside', CAST(count(*) AS VARCHAR) FROM beats WHERE beat_id % 17 = 0 GROUP BY record_id""",
)
def merged_documents(spark, sf):
    docs = beats(spark, sf).select("record_id", "beat_id", "lead", F.expr(_DOCUMENT).alias("value"))
    merged, bad = readers.merge_documents(materialise(docs), ["record_id"], ["beat_id", "lead"], depth=4)
    aside = bad.groupBy("record_id").agg(F.count(F.lit(1)).cast("string").alias("value")).select("record_id", F.lit("set aside").alias("path"), "value")
    return merged.select("record_id", F.array_join("path", "/").alias("path"), "value").unionByName(aside)
