"""The driver's tables seen as landmark tables, corrections, traces, label runs and events.

Each view exists twice: as a DataFrame and as the text of a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import with_neighbours
from ..schema import LANDMARKS_11
from ..session import materialise

LM = LANDMARKS_11.order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- landmark rows

LINE_SQL = """lines AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax,
               l_returnflag, l_linestatus) AS rn FROM lineitem) u WHERE rn = 1)"""

BEATS_SQL = LINE_SQL + """, beats AS (
  SELECT o_custkey AS record_id, c_mktsegment AS disease_class, l_linenumber AS lead, o_orderkey AS beat_id,
   500 AS fs_hz, 5000 AS n_samples, o_orderdate AS edited_at,
   CASE WHEN pab THEN NULL ELSE b-30-20*d END AS p_onset,
   CASE WHEN pab THEN NULL ELSE b-10-20*d END AS p_peak,
   CASE WHEN pab THEN NULL ELSE b-20*d+q END AS p_offset,
   b AS qrs_onset,
   CASE WHEN x=0 THEN NULL ELSE b+x END AS q_peak,
   CASE WHEN l_partkey%17=0 THEN NULL ELSE b+10+d END AS r_peak,
   b+18+d+x AS s_peak,
   b+15+2*q AS qrs_offset,
   CASE WHEN tab THEN NULL ELSE b+20+2*q+3*d-4*x END AS t_onset,
   CASE WHEN tab THEN NULL ELSE b+50+3*q+3*d-4*x END AS t_peak,
   CASE WHEN tab THEN NULL ELSE b+90+3*q+8*d-4*x END AS t_offset
  FROM (SELECT l.*, o.*, c.c_mktsegment,
     400*dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + l_partkey%7 AS b,
     CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d,
     CAST(round(l_tax*100) AS BIGINT) AS x,
     (l_returnflag='R' AND l_linestatus='O') AS pab, (l_suppkey%23=0) AS tab
    FROM lines l JOIN orders o ON l_orderkey=o_orderkey JOIN customer c ON o_custkey=c_custkey) z)"""


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record = customer, beat = order, lead = line number (one row per key)."""
    li = table(spark, sf_dir, "lineitem")
    pick = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    # Laid out by order once, for the first of each line number and for the join with the orders; an order has few lines.
    first = W.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.col(c).asc_nulls_last() for c in pick])
    lines = (
        li.select("l_orderkey", "l_linenumber", *pick).repartition("l_orderkey")
        .withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    )
    orders = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = with_neighbours(orders, ["o_custkey"], "o_orderkey", ordinal="_ord")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    z = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("record_id"),
        F.col("c_mktsegment").alias("disease_class"),
        F.col("l_linenumber").alias("lead"),
        F.col("o_orderkey").alias("beat_id"),
        F.col("o_orderdate").alias("edited_at"),
        (F.lit(400) * F.col("_ord") + F.col("l_partkey") % 7).alias("b"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("x"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("pab"),
        (F.col("l_suppkey") % 23 == 0).alias("tab"),
        (F.col("l_partkey") % 17 == 0).alias("rab"),
    )
    b, q, d, x = (F.col(n) for n in "bqdx")
    p, t = ~F.col("pab"), ~F.col("tab")
    return z.select(
        "record_id", "disease_class", "lead", "beat_id",
        F.lit(500).alias("fs_hz"), F.lit(5000).alias("n_samples"), "edited_at",
        F.when(p, b - 30 - 20 * d).alias("p_onset"),
        F.when(p, b - 10 - 20 * d).alias("p_peak"),
        F.when(p, b - 20 * d + q).alias("p_offset"),
        b.alias("qrs_onset"),
        F.when(x != 0, b + x).alias("q_peak"),
        F.when(~F.col("rab"), b + 10 + d).alias("r_peak"),
        (b + 18 + d + x).alias("s_peak"),
        (b + 15 + 2 * q).alias("qrs_offset"),
        F.when(t, b + 20 + 2 * q + 3 * d - 4 * x).alias("t_onset"),
        F.when(t, b + 50 + 3 * q + 3 * d - 4 * x).alias("t_peak"),
        F.when(t, b + 90 + 3 * q + 8 * d - 4 * x).alias("t_offset"),
    )


# ---------------------------------------------------------------- units, corrections, predictions

UNITS_SQL = BEATS_SQL + """, units AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead ORDER BY beat_id) AS urn FROM beats) u
  WHERE urn = 1)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first beat of every (record, lead)."""
    # The limit of one row per key is applied before the shuffle as well.
    first = W.partitionBy("record_id", "lead").orderBy("beat_id")
    return beats(spark, sf_dir).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: for queries that read their units several times."""
    return materialise(units(spark, sf_dir))


_SHIFT_SQL = "(2*(record_id%11-5)+lead+CASE WHEN record_id%29=0 THEN 150 ELSE 0 END)"
CORR_SQL = UNITS_SQL + ", corr AS (SELECT record_id, disease_class, lead, beat_id, edited_at, " + (
    "CASE WHEN record_id%3<>0 THEN 1 ELSE 0 END AS reviewed, "
) + ", ".join(
    (f"CASE WHEN record_id%5=0 THEN NULL ELSE {c}+{_SHIFT_SQL} END AS {c}" if c == "q_peak" else f"{c}+{_SHIFT_SQL} AS {c}")
    for c in LM
) + " FROM units), feed AS (SELECT * FROM corr UNION ALL SELECT record_id, disease_class, lead, beat_id, " + (
    "edited_at - INTERVAL 30 DAY AS edited_at, reviewed, "
) + ", ".join(f"{c}+4 AS {c}" for c in LM) + " FROM corr WHERE record_id%7=0)"


def corrections(spark: SparkSession, sf_dir: str, u: DataFrame | None = None) -> DataFrame:
    """Reviewed rows, one per unit, as last saved (derived from ``u`` where given)."""
    rec, lead = F.col("record_id"), F.col("lead")
    shift = F.lit(2) * (rec % 11 - 5) + lead + F.when(rec % 29 == 0, 150).otherwise(0)
    u = units(spark, sf_dir) if u is None else u
    cols = [
        (F.when(rec % 5 != 0, F.col(c) + shift) if c == "q_peak" else F.col(c) + shift).alias(c) for c in LM
    ]
    return u.select(
        "record_id", "disease_class", "lead", "beat_id", "edited_at",
        F.when(rec % 3 != 0, 1).otherwise(0).alias("reviewed"), *cols,
    )


def correction_feed(spark: SparkSession, sf_dir: str, u: DataFrame | None = None) -> DataFrame:
    """The same with an older version of some rows before the last one."""
    c = corrections(spark, sf_dir, u)
    older = c.filter(F.col("record_id") % 7 == 0).select(
        "record_id", "disease_class", "lead", "beat_id",
        (F.col("edited_at") - F.expr("INTERVAL 30 DAYS")).alias("edited_at"), "reviewed",
        *[(F.col(x) + 4).alias(x) for x in LM],
    )
    return c.unionByName(older)


# ---------------------------------------------------------------- traces and label runs

TRACE_SQL = """trace AS (
  SELECT CAST((vec_id - vec_id % 8) / 8 AS BIGINT) AS record_id, vec_id % 8 AS lead,
    CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS sample, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""
LABELS_SQL = TRACE_SQL + """, labs AS (
  SELECT *, CASE WHEN v < -0.1 THEN 1 WHEN v < 0 THEN 0 WHEN v < 0.1 THEN 2 ELSE 3 END AS label FROM trace)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (record, lead) with its waveform as an array."""
    vid = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        ((vid - vid % 8) / 8).cast("bigint").alias("record_id"), (vid % 8).alias("lead"),
        F.col("embedding").cast("array<double>").alias("trace"),
    )


def label_of(v):
    return F.when(v < -0.1, 1).when(v < 0, 0).when(v < 0.1, 2).otherwise(3)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).withColumn("labels", F.transform("trace", label_of))


# ---------------------------------------------------------------- events

EVENTS_SQL = """ev AS (
  SELECT user_id AS record_id, event_type AS channel, event_id, epoch_us(ts) AS pos, value FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on the channel of their type, positioned in microseconds."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_type").alias("channel"), "event_id",
        micros("ts").alias("pos"), "value",
    )


def micros(c: str):
    """Microseconds since 1970-01-01 of a zone-less timestamp, whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp"))


# ---------------------------------------------------------------- two-class results

CONF_SQL = """conf AS (
  SELECT l.doc_id, d.lang, l.quality AS truth, l.toxic AS pred,
    CASE WHEN d.n_chars > 5000 THEN 2 ELSE l.quality END AS truth3,
    CASE WHEN d.n_chars > 4000 THEN 2 ELSE l.toxic END AS pred3
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return j.select(
        "doc_id", "lang", F.col("quality").alias("truth"), F.col("toxic").alias("pred"),
        F.when(F.col("n_chars") > 5000, 2).otherwise(F.col("quality")).alias("truth3"),
        F.when(F.col("n_chars") > 4000, 2).otherwise(F.col("toxic")).alias("pred3"),
    )
