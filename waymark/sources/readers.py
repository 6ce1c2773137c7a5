"""Readers. Every spelling of absence becomes NULL here, and nowhere else."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import parse_number
from ..operators.ordered import keep_last, with_neighbours
from ..session import materialise

NULL_TOKENS = ("", "None", "NaN", "nan")


def read_landmarks(
    spark: SparkSession, path: str, schema: T.StructType, null_tokens: Sequence[str] = NULL_TOKENS, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Header CSV with typed columns. Whole-number columns accept "12" and "12.0".

    Columns are matched by the header, which all files of ``path`` must share: one with other names or another order fails when it is
    read. ``columns`` prunes before anything is parsed.
    """
    found = spark.read.option("header", True).csv(path)
    raw = spark.read.schema(found.schema).option("header", True).option("enforceSchema", False).csv(path)
    out = []
    for f in schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if f.name not in raw.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(~F.trim(c).isin(*null_tokens), c).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.DateType, T.BooleanType)):
            out.append(F.when(~F.trim(c).isin(*null_tokens), c).try_cast(f.dataType).alias(f.name))
        else:
            out.append(parse_number(c, null_tokens).try_cast(f.dataType).alias(f.name))
    return raw.select(*out)


def split_bad_rows(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): rows with every required value, and the others with the reason."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = df.withColumn("_why", F.array_join(missing, ","))
    good = marked.filter("_why = ''").drop("_why")
    bad = marked.filter("_why <> ''").withColumn("error", F.concat(F.lit("absent or unreadable: "), F.col("_why"))).drop("_why")
    return good, bad


def read_waveforms(spark: SparkSession, paths: str | Sequence[str], channels: Sequence, suffix: str = "", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, quarantine) from headerless numeric matrices, one file per recording.

    Files may hold channels x samples or samples x channels; anything else is quarantined, as are
    non-numeric cells. The entity is the file name without extension and ``suffix``, or with ``folder`` what follows
    that name and an equals sign in the name of the file's folder.
    """
    k = len(channels)
    path = F.col("_metadata.file_path")
    named = F.regexp_extract(path, rf"/{folder}=([^/]*)/[^/]*$", 1) if folder else F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"{suffix}\.[^.]*$", "")
    text = spark.read.text(paths, wholetext=True).select(
        named.alias("record_id"),
        F.col("_metadata.file_path").alias("path"), "value",
    )
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    m = text.withColumn("m", F.transform(lines, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double")))).drop("value")
    m = m.withColumns({"rows": F.size("m"), "cols": F.array_max(F.transform("m", lambda r: F.size(r))), "narrow": F.array_min(F.transform("m", lambda r: F.size(r)))})
    even = F.coalesce(F.col("cols") == F.col("narrow"), F.lit(False))
    numeric = ~F.exists("m", lambda r: F.exists(r, lambda v: v.isNull()))
    ok = even & numeric & ((F.col("rows") == k) | (F.col("cols") == k))
    turned = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.transform("m", lambda r: F.get(r, j)))
    sig = F.when(F.col("rows") == k, F.col("m")).otherwise(turned)
    sig = F.transform(sig, lambda r: F.transform(r, lambda v: F.when(~F.isnan(v), v)))  # a written NaN is an absent sample
    names = F.array(*[F.lit(c) for c in channels])
    good = m.filter(ok).select("record_id", "path", F.posexplode(sig).alias("_i", "trace")).select(
        "record_id", F.get(names, F.col("_i")).alias("lead"), "trace", "path"
    )
    why = F.when(~even, "ragged rows").when(~numeric, "non-numeric cell").otherwise(
        F.format_string("expected %d channels, got %d x %d", F.lit(k), F.col("rows"), F.col("cols")))
    return good, m.filter(~ok).select("record_id", "path", why.alias("error"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, keys: Sequence[str], order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines: objects with ``error`` apart, the last row per key over all shards.

    Order is given by columns, or by (file path, position in the file) when none are.
    """
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if "error" not in st.names:
        st = T.StructType([*st.fields, T.StructField("error", T.StringType())])
    df = spark.read.schema(st).json(path)
    if not order:
        df = df.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"), "_i": F.monotonically_increasing_id()})
        order = ("_f", "_b", "_i")
    good = keep_last(df.filter("error is null"), keys, order)
    return good.drop("error", "_f", "_b", "_i"), df.filter("error is not null").drop("_f", "_b", "_i")


def read_key_values(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Lines ``path:key,value`` as one row per path with a column per key (last value wins)."""
    lines = spark.read.text(path).withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"), "_i": F.monotonically_increasing_id()})
    return key_values(lines, names, order=("_f", "_b", "_i"))


def key_values(lines: DataFrame, names: Sequence[str], text: str = "value", order: Sequence[str] = ()) -> DataFrame:
    """Parsed lines; the last readable value of a key is the one greatest in ``order``, without it the one with the greatest value."""
    part = lambda g: F.regexp_extract(text, r"^(.*):([^:,]+),(.*)$", g)
    v = F.trim(part(3)).try_cast("double")
    kv = lines.select(part(1).alias("path"), part(2).alias("key"), v.alias("v"), F.struct(*order, v.alias("_last")).alias("_at"))
    kv = kv.filter(F.col("key").isin(*names) & F.col("v").isNotNull())
    return kv.groupBy("path").pivot("key", list(names)).agg(F.max_by("v", "_at"))


def run_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows of lines like ``epoch 2 step 30/90 loss 0.51``, with the global step (epoch-1)*total+step."""
    pat = r"epoch\s+(\d+)\s+step\s+(\d+)/(\d+)\s+loss\s+([-+.0-9eE]+)"
    g = lambda i: F.regexp_extract(text, pat, i)
    hit = lines.filter(F.col(text).rlike(pat)).select(
        g(1).cast("int").alias("epoch"), g(2).cast("int").alias("step"), g(3).cast("int").alias("steps"), g(4).try_cast("double").alias("loss"))
    return hit.withColumn("global_step", (F.col("epoch") - 1) * F.col("steps") + F.col("step"))


def read_run_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return run_log(spark.read.text(path))


def read_history(spark: SparkSession, path: str | Sequence[str], item: str) -> DataFrame:
    """A JSON list of per-epoch objects (``item`` is the object's schema), structs flattened one level."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"array<{item}>")).alias("e")).select("e.*")
    flat = []
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StructType):
            flat += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            flat.append(F.col(f.name))
    return rows.select(*flat)


def document_leaves(docs: DataFrame, keys: Sequence[str], text: str = "value", depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """(leaves, bad) of JSON documents: one row (keys, path, value) per leaf, and the rows whose text is no JSON object.

    ``path`` is the list of member names down to the leaf; ``value`` is the leaf's JSON text (a string in its quotes). Lists, empty objects and
    whatever lies below ``depth`` names are leaves. Documents of any shape may be mixed, since no schema is inferred.
    """
    parsed = docs.withColumn("_v", F.try_parse_json(text))
    whole = F.schema_of_variant("_v").startswith("OBJECT")
    bad = parsed.filter(~F.coalesce(whole, F.lit(False))).drop("_v")
    level = parsed.filter(whole).select(*keys, F.array().cast("array<string>").alias("path"), "_v", F.lit(True).alias("_open"))
    for _ in range(depth):
        # one pass: what is open is replaced by its members, leaves go on as they are; a text is parsed once, whatever the depth
        members = F.map_entries(F.from_json(F.to_json("_v"), "map<string,variant>"))
        inner = F.transform(members, lambda e: F.struct(F.concat("path", F.array(e["key"])).alias("path"), e["value"].alias("_v"), F.lit(True).alias("_new")))
        same = F.array(F.struct("path", "_v", F.lit(False).alias("_new")))
        level = level.select(*keys, F.explode(F.when(F.col("_open"), inner).otherwise(same)).alias("_e")).select(*keys, "_e.*")
        shape = F.schema_of_variant("_v")
        object_inside = F.coalesce(shape.startswith("OBJECT<") & ~shape.isin("OBJECT<>"), F.lit(False))
        level = level.withColumn("_open", F.when(F.col("_new"), object_inside).otherwise(False)).drop("_new")
    return level.select(*keys, "path", F.to_json("_v").alias("value")), bad


def merge_documents(docs: DataFrame, keys: Sequence[str], by: Sequence[str], text: str = "value", depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(merged, bad): the leaves of all documents of a key in one, the last document (by ``by``) winning path by path.

    With ``depth`` 1 a member of the top level is taken over or replaced as a whole; deeper, objects are merged member by member. Where one document
    has a leaf and another one has members below that path, the later of the two decides. No document's path is lost unless a later one states it.
    Rows: keys, path, value, and the columns ``by`` of the document the value is from.
    """
    keys, by = list(keys), list(by)
    leaves, bad = document_leaves(docs, [*keys, *by], text, depth)
    leaves = leaves.withColumn("_at", F.struct(*by))
    last = leaves.groupBy(*keys, "path").agg(F.max(F.struct("_at", "value")).alias("_l")).select(*keys, "path", "_l._at", "_l.value")
    if depth > 1:
        last = materialise(last)
        above = last.filter(F.size("path") > 1).select(
            *keys, F.col("path").alias("_in"), F.col("_at").alias("_inner"),
            F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path"))
        # a leaf with members of another document below it: the earlier of the two goes, mostly there are none
        clash = materialise(last.drop("value").join(above, [*keys, "path"]))
        beaten = clash.filter("_inner >= _at").select(*keys, "path").unionByName(clash.filter("_at > _inner").select(*keys, F.col("_in").alias("path"))).distinct()
        last = last.join(beaten, [*keys, "path"], "left_anti")
    return last.select(*keys, "path", "value", "_at.*"), bad


def read_sections(spark: SparkSession, path: str | Sequence[str], marker: str = "##REC ") -> DataFrame:
    """Rows (section, line_no, line) of text in which a marker line names the section that follows.

    A marker counts at the start of a line only; text before the first one belongs to no section. A file is read as one text.
    """
    whole = spark.read.text(path, wholetext=True)
    bodies = F.split(F.concat(F.lit("\n"), "value"), F.lit("\n" + re.escape(marker)))
    parts = whole.select(F.explode(F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0)))).alias("value"))
    lines = F.split("value", r"\r?\n")
    return parts.select(F.trim(F.get(lines, F.lit(0))).alias("section"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line_no", "line")).filter(
        F.trim("line") != "")


def fill_sections(lines: DataFrame, keys: Sequence[str], order: str, text: str = "value", marker: str = "##REC ") -> DataFrame:
    """The same for lines that already carry a number: the section is carried forward along it."""
    named = lines.withColumn("_h", F.when(F.col(text).startswith(marker), F.trim(F.substring(F.col(text), F.lit(len(marker) + 1), F.length(text)))))
    out = with_neighbours(named, keys, order, carry={"section": "_h"})
    return out.filter(F.col("_h").isNull()).drop("_h")


def pending(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs whose key is not in the output yet (a resumable run)."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")
