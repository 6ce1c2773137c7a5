"""How exclusion filters on reviewers' notes interact: what each removes in every order of applying them.

A row's fate in any order depends only on the set of filters it fails. So the rows are reduced to that set once, as bits, and counted by
(part, bits, marks); all orders are then read off these few counts. Filters on the text itself are columns. The copy filter needs the other
rows: an existential self-join, a left-semi join on hash, exact text and smaller record_id, marks the copies, and their ids are united with those
of the other failures.

The copied side of the join is the first record of every text that occurs more than once, found by partial aggregation, so a text with very many
copies is one row there. The probing side of such a text is dealt over several tasks; there are at most ``HOT`` such texts, whatever the corpus.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

COPY = "E"
HOT = 1000
DEALT = 64
_WHITE = "[\\x20\\x09-\\x0D]+"


def text_filters(min_words: int = 100, distinct: int = 80, capitals: int = 10) -> dict[str, Callable[[Mapping[str, Column]], Column]]:
    """Filters on a note's own counts, by letter: short, repetitive, shouting, marked-up."""
    return {
        "A": lambda c: c["n_words"] < min_words,
        "B": lambda c: 100 * c["n_distinct"] < distinct * c["n_words"],
        "C": lambda c: 100 * c["n_capitals"] > capitals * c["n_chars"],
        "D": lambda c: c["has_symbol"],
    }


def note_counts(notes: DataFrame, text: str) -> DataFrame:
    """Adds n_words, n_distinct, n_capitals, n_chars and has_symbol of the text column (not null)."""
    words = notes.withColumn("_words", F.array_remove(F.split(text, _WHITE), ""))
    return words.withColumns({
        "n_words": F.size("_words"), "n_distinct": F.size(F.array_distinct("_words")), "n_chars": F.length(text),
        "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")), "has_symbol": F.col(text).rlike("[#$%&*|]"),
    }).drop("_words")


def copies_of_earlier(notes: DataFrame) -> DataFrame:
    """The rows of (record_id, hash, notes, ...) whose exact text also stands in a row with a smaller record_id, by a left-semi self-join."""
    many = notes.filter("record_id is not null").groupBy("hash").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    many = materialise(many.select("hash", "n"))
    total = many.agg(F.sum("n")).first()[0] or 0
    # shares above 1 / HOT of the rows: at most HOT texts
    hot = F.broadcast(many.filter(F.col("n") * HOT > total).select(F.col("hash").alias("_hot")))
    copied = notes.join(many.select("hash"), "hash", "left_semi")
    probing = copied.join(hot, F.col("hash") == F.col("_hot"), "left")
    probing = probing.withColumn("deal", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("record_id"), F.lit(DEALT))).otherwise(0)).drop("_hot")
    first = copied.filter("record_id is not null").groupBy("hash", "notes").agg(F.min("record_id").alias("first_id")).join(hot, F.col("hash") == F.col("_hot"), "left")
    first = first.select("hash", "notes", "first_id", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("deal"))
    a, b = probing.alias("a"), first.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.deal") == F.col("b.deal")) & (F.col("a.notes") == F.col("b.notes")) & (F.col("b.first_id") < F.col("a.record_id"))
    return a.join(b, same, "left_semi").drop("deal")


def failure_sets(notes: DataFrame, filters: Mapping[str, Callable[[Mapping[str, Column]], Column]]) -> tuple[DataFrame, list[str]]:
    """(record_id, part, bits, n): how many rows of each id and part fail exactly the filters in ``bits``, and the letters in bit order.

    Input: record_id, notes (not null), part. The copy filter takes the last bit.
    """
    letters = [*filters, COPY]
    hashed = notes.withColumn("hash", F.xxhash64("notes"))
    counted = note_counts(hashed, "notes")
    own = {c: F.col(c) for c in ("n_words", "n_distinct", "n_capitals", "n_chars", "has_symbol")}
    bits = sum((F.when(fails(own), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = counted.select("record_id", "hash", "part", bits.cast("int").alias("bits"), F.lit(1).cast("long").alias("n"))
    copies = copies_of_earlier(hashed).select("record_id", "hash", "part", F.lit(1 << len(filters)).cast("int").alias("bits"), F.lit(0).cast("long").alias("n"))
    keyed = rows.unionByName(copies).groupBy("record_id", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return keyed.groupBy("record_id", "part", "bits").agg(F.sum("n").alias("n")), letters


def audit_orders(cells: DataFrame, letters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """All orders and steps from counts (part, bits, n, and one count for each of ``marks``)."""
    k = len(letters)
    sets = range(1 << k)
    count = {c: F.array(*[F.coalesce(F.sum(F.when(F.col("bits") == m, F.col(c))), F.lit(0)) for m in sets]).alias(f"_{c}") for c in ("n", *marks)}
    parts = cells.groupBy("part").agg(*count.values())
    steps = []
    for order in itertools.permutations(range(k)):
        before = 0
        for at, f in enumerate(order):
            steps.append(("".join(letters[i] for i in order), at + 1, before, 1 << f))
            before |= 1 << f
    table = "array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'before', {b}, 'own', {f})" for o, s, b, f in steps) + ")"
    laid = parts.withColumn("_s", F.explode(F.expr(table))).select("part", *[f"_{c}" for c in count], "_s.*")

    def total(of: str, when: Callable[[Column], Column], weight: Callable[[int], int] | None = None) -> Column:
        numbered = F.arrays_zip(F.array(*[F.lit(m) for m in sets]).alias("m"), F.col(f"_{of}").alias("c"), F.array(*[F.lit(weight(m) if weight else 1) for m in sets]).alias("w"))
        return F.aggregate(numbered, F.lit(0).cast("long"), lambda t, x: t + F.when(when(x["m"]), x["c"] * x["w"]).otherwise(0))

    own, before = F.col("own"), F.col("before")

    def fails(m: Column) -> Column:
        return m.bitwiseAND(own) != 0

    def alive(m: Column) -> Column:
        return m.bitwiseAND(before) == 0

    # of the orders, a failing filter comes first among the filters of its set in one of as many as the set has
    share = {m: math.factorial(k) // max(1, bin(m).count("1")) for m in sets}
    return laid.select(
        "part", "filter_order", "step",
        total("n", lambda m: alive(m) & ~fails(m)).alias("kept"), total("n", lambda m: alive(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~alive(m) & fails(m)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        *[total(c, lambda m: alive(m) & fails(m)).alias(f"{c}_lost") for c in marks],
        total("n", fails, share.get).alias("shapley"))


def audit_filters(
    notes: DataFrame, marks: DataFrame | None = None, filters: Mapping[str, Callable[[Mapping[str, Column]], Column]] | None = None,
    record_id: str = "record_id", text: str = "notes", part: str = "class",
) -> DataFrame:
    """What each exclusion filter removes, in every order of the filters, for each class of records.

    ``filters`` maps a letter to a condition on ``note_counts``; filter E, "the exact text stands in a record with a smaller id, removed or not", is
    always added. ``marks`` has the record id and boolean columns, such as "usable"; a mark holds if any of its rows for the id says so. Returns one
    row per part, filter_order (all permutations of the letters) and step (int from 1): kept, removed, redundant (fails this filter, removed
    before), unique_fails (fails no other), ``<mark>_lost`` per mark (of the removed), and shapley (this filter's removed, summed over all orders).

    A null text is an empty one, a null part the empty string. Repeated rows count each; rows with one id are no copies of each other. A row with
    a null id is no copy, makes none and has no marks. An empty table gives an empty result. Other columns are not read. At most six filters.
    """
    filters = text_filters() if filters is None else filters
    if len(filters) > 5 or COPY in filters:
        raise ValueError("at most five filters, none of them called E")
    rows = notes.select(F.col(record_id).alias("record_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("notes"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    sets, letters = failure_sets(rows, filters)
    names = [c for c in marks.columns if c != record_id] if marks is not None else []
    if names:
        told = marks.filter(F.col(record_id).isNotNull()).groupBy(F.col(record_id).alias("record_id")).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in names])
        sets = sets.join(told, "record_id", "left")
    cells = sets.groupBy("part", "bits", *names).agg(F.sum("n").alias("n"))
    counts = cells.select("part", "bits", "n", *[F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in names])
    return audit_orders(counts, letters, names)
