"""Queries on readers, writers, table checks and feeds: tables are written to the shared folder in a format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, streaming
from ..functions import scalar as S
from ..functions.hashing import LANES, PRIME, poisson_one_sql, replicate_sql, _state_sql
from ..operators import augment as X
from ..operators import infer
from ..operators import score as Z
from ..session import materialise, shared_folder
from ..sources import readers, writers
from .fixtures import BEATS_SQL, LM, TRACE_SQL, UNITS_SQL, beats, stored_units, table, traces, units
from .quality import QC_SQL
from .registry import query
from .scoring import r6

CHANNELS = list(range(8))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- waveform files


def _waveform_files(spark: SparkSession, sf: str) -> str:
    """One file per recording, channels x samples or turned; some lack a channel."""
    path = _folder(spark, "signals")
    t = traces(spark, sf).filter("record_id % 7 <> 0 or lead <> 3")
    rows = t.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lead", "trace"))), lambda x: x["trace"]).alias("m"))
    turned = F.transform(F.sequence(F.lit(0), F.size(F.get("m", F.lit(0))) - 1), lambda i: F.transform("m", lambda r: F.get(r, i)))
    lines = F.transform(F.when(F.col("record_id") % 5 == 0, turned).otherwise(F.col("m")), lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), ","))
    rows.select("record_id", F.array_join(lines, "\n").alias("value")).write.partitionBy("record_id").text(path)
    return path


WAVE_SQL = TRACE_SQL + ", held AS (SELECT * FROM trace WHERE record_id % 7 <> 0 OR lead <> 3), full8 AS (SELECT record_id FROM held GROUP BY 1 HAVING count(DISTINCT lead) = 8)"


@query(
    "waveform_files",
    f"""WITH {WAVE_SQL} SELECT CAST(record_id AS VARCHAR) AS record_id, CAST(lead AS INTEGER) AS lead, CAST(count(*) AS INTEGER) AS n, round(sum(v), 6) AS total, NULL AS error FROM held SEMI JOIN full8 USING (record_id) GROUP BY ALL
    UNION ALL SELECT CAST(record_id AS VARCHAR), NULL, NULL, NULL, CASE WHEN record_id % 5 = 0 THEN 'expected 8 channels, got 64 x ' || count(DISTINCT lead) ELSE 'expected 8 channels, got ' || count(DISTINCT lead) || ' x 64' END
     FROM held WHERE record_id NOT IN (SELECT * FROM full8) GROUP BY record_id""",
)
def waveform_files(spark, sf):
    good, bad = readers.read_waveforms(spark, _waveform_files(spark, sf), CHANNELS, folder="record_id")
    rows = good.select("record_id", "lead", F.size("trace").alias("n"), F.round(F.aggregate("trace", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))
    return rows.unionByName(bad.select("record_id", "error"), allowMissingColumns=True)


@query("waveform_cache", f"WITH {WAVE_SQL} SELECT CAST(record_id AS VARCHAR) AS record_id, CAST(lead AS INTEGER) AS lead, round(max(v), 6) AS top FROM held SEMI JOIN full8 USING (record_id) GROUP BY ALL")
def waveform_cache(spark, sf):
    good, _ = readers.read_waveforms(spark, _waveform_files(spark, sf), CHANNELS, folder="record_id")
    path = _folder(spark, "cache")
    # recordings found under two paths are kept once
    twice = materialise(good.unionByName(good.withColumn("path", F.concat("path", F.lit("~")))))
    writers.cache_waveforms(twice, path, len(CHANNELS))
    return spark.read.parquet(path).select("record_id", "lead", F.round(F.array_max("trace"), 6).alias("top"))


# ---------------------------------------------------------------- lines and sections

_JSON = """CASE WHEN beat_id % 19 = 0 THEN '{"record_id":' || record_id || ',"error":"beat ' || beat_id || '"}' ELSE '{"record_id":' || record_id || ',"beat_id":' || beat_id || ',"lead":' || lead || ',"t_peak":' || coalesce(CAST(t_peak AS STRING), 'null') || '}' END"""


@query(
    "json_lines",
    f"""WITH {BEATS_SQL}, ok AS (SELECT record_id, beat_id, lead, t_peak FROM beats WHERE beat_id % 19 <> 0 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY beat_id DESC, lead DESC) = 1)
    SELECT record_id, beat_id, CAST(lead AS BIGINT) AS lead, t_peak, NULL AS error FROM ok UNION ALL SELECT record_id, NULL, NULL, NULL, 'beat ' || beat_id FROM beats WHERE beat_id % 19 = 0""",
)
def json_lines(spark, sf):
    path = _folder(spark, "lines")
    beats(spark, sf).select(F.expr(_JSON).alias("value")).write.text(path)
    good, bad = readers.read_jsonl(spark, path, "record_id long, beat_id long, lead long, t_peak long", ["record_id"], order=["beat_id", "lead"])
    return good.unionByName(bad.select("record_id", "error"), allowMissingColumns=True)


_SECTION_SQL = f"WITH {UNITS_SQL} SELECT 'r' || record_id AS section, lead || ',' || beat_id AS line FROM units"


@query("section_files", _SECTION_SQL)
def section_files(spark, sf):
    """A bundle of text files, each with several sections."""
    path = _folder(spark, "bundle")
    u = units(spark, sf).groupBy("record_id").agg(F.sort_array(F.collect_list(F.concat_ws(",", "lead", "beat_id"))).alias("l"))
    u.select(F.concat(F.lit("##REC r"), F.col("record_id").cast("string"), F.lit("\n"), F.array_join("l", "\n")).alias("value")).write.text(path)
    return readers.read_sections(spark, path).select("section", "line")


@query("section_lines", _SECTION_SQL)
def section_lines(spark, sf):
    """The same from numbered lines: the heading is carried forward."""
    u = units(spark, sf).select("record_id", "lead", "beat_id")
    heads = u.groupBy("record_id").agg(F.concat(F.lit("##REC r"), F.col("record_id").cast("string")).alias("value")).withColumn("n", F.col("record_id") * 100)
    body = u.select("record_id", F.concat_ws(",", "lead", "beat_id").alias("value"), (F.col("record_id") * 100 + F.col("lead")).alias("n"))
    lines = heads.unionByName(body).withColumn("book", F.lit(1))
    return readers.fill_sections(lines, ["book"], "n").select("section", F.col("value").alias("line"))


# ---------------------------------------------------------------- sinks

_KEPT = ["record_id", "lead", "beat_id", "p_onset", "qrs_onset"]


@query("csv_round_trip", f"WITH {UNITS_SQL} SELECT {', '.join(_KEPT)} FROM units")
def csv_round_trip(spark, sf):
    u = stored_units(spark, sf)
    path = _folder(spark, "table")
    writers.write_table(u, path, columns=_KEPT, fmt="csv", write=False)  # a dry run leaves no file behind
    writers.write_table(u, path, columns=_KEPT, fmt="csv")
    return readers.read_landmarks(spark, path, u.select(*_KEPT).schema)


@query("batch_files", f"WITH {UNITS_SQL} SELECT CAST(lead AS INTEGER) AS lead, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows FROM units GROUP BY lead")
def batch_files(spark, sf):
    path = _folder(spark, "batches")
    writers.write_batches(units(spark, sf).select("record_id", "beat_id", "lead"), path, batch="lead", fmt="parquet")
    got = spark.read.parquet(path).select("lead", F.col("_metadata.file_path").alias("f"))
    return got.groupBy("lead").agg(F.count_distinct("f").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "versioned_table",
    f"WITH {UNITS_SQL} SELECT record_id, lead, qrs_onset + 2 AS qrs_onset, 3 AS n_versions FROM units",
)
def versioned_table(spark, sf):
    """Three versions, each made from the one before while that one is being read."""
    root = _folder(spark, "versions")
    writers.write_versioned(units(spark, sf).select("record_id", "lead", "qrs_onset"), root)
    for _ in range(2):
        writers.write_versioned(writers.read_current(spark, root).withColumn("qrs_onset", F.col("qrs_onset") + 1), root)
    n = writers.versions(spark, root).count()
    return writers.read_current(spark, root).withColumn("n_versions", F.lit(n))


@query(
    "quarantined_rows",
    f"""WITH {BEATS_SQL} SELECT coalesce(error, 'good') AS outcome, count(*) AS n FROM (SELECT CASE WHEN p_onset IS NULL AND t_peak IS NULL THEN 'absent or unreadable: p_onset,t_peak' WHEN p_onset IS NULL THEN 'absent or unreadable: p_onset'
      WHEN t_peak IS NULL THEN 'absent or unreadable: t_peak' END AS error FROM beats) z GROUP BY 1""",
)
def quarantined_rows(spark, sf):
    good, bad = readers.split_bad_rows(materialise(beats(spark, sf)), ["record_id", "p_onset", "t_peak"])
    return good.withColumn("outcome", F.lit("good")).select("outcome").unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- table checks

@query(
    "aligned_columns",
    f"WITH {UNITS_SQL} SELECT record_id, lead, qrs_onset AS onset, CAST(NULL AS BIGINT) AS reviewer, 'units' AS origin FROM units",
)
def aligned_columns(spark, sf):
    u = schema.require_columns(units(spark, sf), ["record_id", "lead", "qrs_onset"])
    out = schema.align(u, ["record_id", "lead", "onset", "reviewer", "origin"], rename={"qrs_onset": "onset"}, constants={"origin": "units"})
    return out.withColumn("reviewer", F.col("reviewer").cast("bigint"))


@query(
    "unique_left_join",
    f"WITH {UNITS_SQL} SELECT u.record_id, u.lead, c_acctbal AS balance FROM units u LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON u.record_id = c.c_custkey",
)
def unique_left_join(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("record_id"), F.col("c_acctbal").alias("balance"))
    return units(spark, sf).select("record_id", "lead").join(schema.assert_unique(c, ["record_id"]), "record_id", "left")


@query(
    "json_text_rows",
    f"""WITH {UNITS_SQL} SELECT record_id, lead, '{{"id":' || beat_id || ',"rate":' || CASE WHEN p_onset IS NULL THEN 'null' ELSE CAST(qrs_onset AS VARCHAR) || '.5' END || '}}' AS text FROM units""",
)
def json_text_rows(spark, sf):
    rate = F.when(F.col("p_onset").isNull(), F.lit(float("nan"))).otherwise(F.col("qrs_onset") + F.lit(0.5))
    return units(spark, sf).select("record_id", "lead", S.json_text(F.struct(F.col("beat_id").alias("id"), rate.alias("rate"))).alias("text"))


# ---------------------------------------------------------------- noise

_NOISE = dict(seed=41, scale=0.2, wander=0.1, noise=0.05, dropout=0.3)


def _u_sql(seed: int, parts: list[str], last: int) -> str:
    return f"(({replicate_sql(seed, parts, str(last))} + 0.5::DOUBLE) / {PRIME}::DOUBLE)"


def _at_sql(salt: int) -> str:
    """The uniform number of a sample, from the states sx and sy."""
    p, a, b = LANES[0]
    return f"list_transform([(sx * {a} + (((sample + {salt} + 1) * (sy + 1)) % {p}) * {b}) % {p}], lambda z: ((list_transform([(z * z + 3 * z + 12345) % {p}], lambda y: (y * y + 777) % {p})[1]) + 0.5::DOUBLE) / {p}::DOUBLE)[1]"


_U2 = ["record_id", "lead"]


@query(
    "signal_noise",
    f"""WITH {TRACE_SQL}, k AS (SELECT record_id, lead, 0.8::DOUBLE + 0.4::DOUBLE * {_u_sql(41, ["record_id"], 1)} AS scale, 2 * pi() * {_u_sql(42, _U2, 1)} AS phase, {_u_sql(42, _U2, 2)} < 0.3 AND lead <> 2 AS off,
      {_state_sql(43, _U2, 0)} AS sx, {_state_sql(43, _U2, 1)} AS sy FROM (SELECT DISTINCT record_id, lead FROM trace) z),
     g AS (SELECT t.record_id, t.lead, t.sample, v, scale, phase, off, {_at_sql(1)} AS u1, {_at_sql(500009)} AS u2 FROM trace t JOIN k USING (record_id, lead))
    SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(CASE WHEN off THEN 0 ELSE v * scale + 0.1::DOUBLE * sin(2 * pi() * 0.5 / 500 * sample + phase) + 0.05::DOUBLE * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) END, 6) AS v FROM g""",
)
def signal_noise(spark, sf):
    n = X.signal_noise(traces(spark, sf), ["record_id"], protect=F.col("lead") == 2, **_NOISE)
    return r6(n.select("record_id", "lead", F.posexplode("trace").alias("sample", "v")), "v")


# ---------------------------------------------------------------- feeds, user statistics, user models


@query("qc_stream_rows", f"WITH {QC_SQL} SELECT record_id, lead, beat_id, qc_status, qc_flags FROM qcd")
def qc_stream_rows(spark, sf):
    """Files that land in two lots, each rated exactly once; the second run goes on where the first stopped."""
    root = _folder(spark, "landed")
    b = materialise(beats(spark, sf).select("record_id", "lead", "beat_id", "fs_hz", "n_samples", *LM))
    shape = ", ".join(f"{c} {t}" for c, t in b.dtypes)
    for lot in ("lead <= 3", "lead > 3"):
        b.filter(lot).write.mode("append").parquet(f"{root}/in")
        streaming.drain(streaming.qc_stream(spark, f"{root}/in", shape, f"{root}/out", f"{root}/state"))
    return spark.read.parquet(f"{root}/out").select("record_id", "lead", "beat_id", "qc_status", "qc_flags")


REPS = 200


def _weighted_spread(value: Column, weight: Column) -> Column:
    """Mean square, a statistic the library has no name for."""
    return F.try_divide(F.sum(value * value * weight), F.sum(weight))


@query(
    "bootstrap_own_statistic",
    f"""WITH {UNITS_SQL}, v AS (SELECT disease_class, record_id, lead, CAST(qrs_offset - qrs_onset AS DOUBLE) AS d FROM units), r AS (SELECT disease_class, rep, d, {poisson_one_sql("u")} AS w FROM
       (SELECT v.*, rep, {replicate_sql(9, _U2, "rep")} AS u FROM v, (SELECT unnest(range({REPS})) AS rep) q) z),
     s AS (SELECT disease_class, rep, sum(d * d * w) / nullif(sum(w), 0) AS s FROM r GROUP BY ALL), p AS (SELECT disease_class, count(*) AS n, sum(d * d) / count(*) AS point FROM v GROUP BY 1)
    SELECT disease_class, n, round(point, 6) AS point, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM p JOIN (SELECT disease_class, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM s GROUP BY 1) i USING (disease_class)""",
)
def bootstrap_own_statistic(spark, sf):
    u = units(spark, sf).withColumn("d", F.col("qrs_offset") - F.col("qrs_onset"))
    return r6(infer.bootstrap_ci(u, ["disease_class"], "d", _U2, _weighted_spread, REPS, 9), "point", "ci_lo", "ci_hi")


@query("user_model_scores", f"WITH {TRACE_SQL} SELECT record_id, lead, arg_max(sample, struct_pack(a := v, s := -sample)) AS top, round(max(v), 6) AS height FROM trace GROUP BY ALL")
def user_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model of the user's own, run over Arrow batches: here, the place of the highest sample."""
    def predict(batch):
        import numpy as np

        at = batch["trace"].map(lambda a: int(np.argmax(a)))
        return batch.assign(top=at, height=[round(float(a[i]), 6) for a, i in zip(batch["trace"], at)])[["record_id", "lead", "top", "height"]]

    return Z.score_units(traces(spark, sf), predict, "record_id long, lead long, top long, height double")
