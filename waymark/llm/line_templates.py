"""Recurring line templates in notes and run logs, found with a fixed-depth parse tree.

The tree's first level is the number of tokens of a line, the next ``depth`` levels are its leading tokens, with every token that holds a digit
read as a variable field. Inside a leaf, a later token is fixed if at least ``min_notes`` different notes have it at its place, and a variable
field otherwise; a line whose fixed tokens make up at least ``similarity`` of it belongs to the template of those tokens. A template recurs if
at least ``min_notes`` different notes hold it.

A line that is nearly all fixed needs no such number: if fixed tokens make up at least ``close`` of it, 2 different notes are enough from 8 tokens
on, 3 for 5 to 7 tokens and 5 for shorter lines (``FEW``). Lines that recur as they stand are found first; the tree is built once more, with
these numbers, over the lines that do not. Where both trees have a template for a line, the one of ``min_notes`` holds.

The unit is the line: a passage that starts inside a line, or whose copies end at different words, is found only by what its lines share in full.

Everything is counts by (leaf), (leaf, place, token) and (template), so a frequent line is merged before each shuffle and no leaf is ever
gathered; the order in which lines arrive has no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

FIELD = "<*>"
# The blanks that separate tokens, the digits that make a token a variable field.
BLANKS = "[ \\t\\r\\f]+"
# The token is read from its start and never anew from a place inside it.
HAS_DIGIT = "(?<![^ \\n])[^ \\n0-9]*+[0-9][^ \\n]*+"
# (tokens, notes): from so many tokens on, a line that is nearly all fixed recurs in so many different notes. Longest first.
FEW = ((8, 2), (5, 3), (0, 5))


def normal_lines(text: Column) -> Column:
    """A text whose lines have single blanks, none at their ends, and the field mark for tokens with a digit. Works on the whole text at once."""
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f") | text.contains(" \n") | text.contains("\n ")
    bare = F.replace(F.replace(F.regexp_replace(text, BLANKS, " "), F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    plain = F.trim(F.when(odd, bare).otherwise(text))
    return F.when(text.rlike("[0-9]"), F.regexp_replace(plain, HAS_DIGIT, FIELD)).otherwise(plain)


def n_tokens_of(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def lines_of(notes: DataFrame, record_id: str, text: str, min_tokens: int) -> DataFrame:
    """(record_id, note, place, line): the lines of every note with at least ``min_tokens`` tokens; ``note`` tells different texts apart."""
    src = notes.select(F.col(record_id).alias("record_id"), F.col(text).cast("string").alias("_t")).filter("_t is not null")
    cut = src.select("record_id", F.xxhash64("_t").alias("note"), F.posexplode(F.split(normal_lines(F.col("_t")), "\n")).alias("place", "line"))
    enough = F.substring_index("line", " ", min_tokens - 1) != F.col("line") if min_tokens > 1 else F.lit(True)
    return cut.filter((F.col("line") != "") & enough)


def leaf_of(depth: int) -> list[Column]:
    return [n_tokens_of(F.col("line")).alias("n_tokens"), F.substring_index("line", " ", depth).alias("lead")]


def few(min_notes: int) -> Column:
    """The notes that a line which is nearly all fixed needs, by its number of tokens; never more than ``min_notes``."""
    out = F.lit(min(FEW[-1][1], min_notes))
    for n_tokens, notes in reversed(FEW[:-1]):
        out = F.when(F.col("n_tokens") >= n_tokens, min(notes, min_notes)).otherwise(out)
    return out


def _often(lines: DataFrame, shaped: DataFrame, least: Column) -> DataFrame:
    """(line_id, template, n_notes) of the shaped lines whose template enough different notes hold."""
    member = lines.select("line_id", "note").distinct().join(shaped.select("line_id", "n_tokens", "template"), "line_id")
    often = member.select("template", "n_tokens", "note").distinct().groupBy("template", "n_tokens").agg(F.count(F.lit(1)).alias("n_notes")).filter(F.col("n_notes") >= least)
    return shaped.select("line_id", "n_tokens", "template").join(often, ["template", "n_tokens"]).select("line_id", "template", "n_notes")


def _tree(kept: DataFrame, depth: int, min_notes: int, similarity: float) -> DataFrame:
    leaf = ["n_tokens", "lead"]
    shapes = kept.select(*leaf, "line", "note").distinct()
    tokens = shapes.select(*leaf, "note", F.posexplode(F.split("line", " ")).alias("at", "token")).filter(F.col("at") >= depth)
    fixed = tokens.distinct().groupBy(*leaf, "at", "token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_notes).filter(F.col("token") != FIELD)
    marks = fixed.groupBy(*leaf).agg(F.collect_set(F.concat(F.col("at").cast("string"), F.lit(" "), F.col("token"))).alias("_fixed"))
    words = F.split("line", " ")
    mark = F.transform(words, lambda t, i: F.when((i < depth) | F.array_contains(F.col("_fixed"), F.concat(i.cast("string"), F.lit(" "), t)), t).otherwise(FIELD))
    distinct_lines = kept.select(*leaf, "line_id", "line").distinct().join(marks, leaf, "left").select(*leaf, "line_id", "line", F.coalesce("_fixed", F.array().cast("array<string>")).alias("_fixed"))
    shaped = distinct_lines.select("line_id", "n_tokens", mark.alias("_m"))
    constant = F.size(F.filter("_m", lambda t: t != FIELD))
    shaped = materialise(shaped.filter(constant >= F.lit(similarity) * F.col("n_tokens")).select("line_id", "n_tokens", F.array_join("_m", " ").alias("template")))
    return _often(kept, shaped, F.lit(min_notes))


def _enough(close: float) -> Column:
    """Fixed tokens that make a line nearly all fixed."""
    return F.ceil(F.lit(close) * F.col("n_tokens") - 1e-9)


def _close(kept: DataFrame, depth: int, min_notes: int, close: float) -> DataFrame:
    """Lines that are nearly all fixed: those that recur as they stand, then templates among the rest.

    A leaf with few notes may hold any number of different tokens, so marks are joined token by token instead of gathered by leaf.
    """
    enough = _enough(close)
    words = F.split("line", " ")
    able = kept.filter("sure")
    # lines in as many notes as it takes stand for themselves; only the others are cut into tokens
    own = able.select("line_id", "n_tokens", "note").distinct().groupBy("line_id", "n_tokens").agg(F.count(F.lit(1)).alias("_n"))
    own = materialise(own.filter(F.col("_n") >= few(min_notes)).select("line_id"))
    rest = materialise(able.join(own, "line_id", "left_anti").select("line_id", "n_tokens", F.xxhash64("n_tokens", "lead").alias("leaf"), "line", "note").distinct())
    token = rest.select("line_id", "leaf", "n_tokens", "note", F.posexplode(F.split("line", " ")).alias("at", "token")).filter((F.col("at") >= depth) & (F.col("token") != FIELD))
    token = token.select("line_id", "n_tokens", "note", "at", F.xxhash64("leaf", "at", "token").alias("token"))
    fixed = token.select("token", "n_tokens", "note").distinct().groupBy("token", "n_tokens").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= few(min_notes)).select("token")
    at = token.select("line_id", "at", "token").distinct().join(fixed, "token").groupBy("line_id").agg(F.collect_set("at").alias("_at"))
    mark = F.transform(words, lambda t, i: F.when((i < depth) | F.array_contains("_at", i), t).otherwise(FIELD))
    near = rest.select("line_id", "n_tokens", "line").distinct().join(at, "line_id").select("line_id", "n_tokens", mark.alias("_m"))
    near = near.filter(F.size(F.filter("_m", lambda t: t != FIELD)) >= enough).select("line_id", "n_tokens", F.array_join("_m", " ").alias("template"))
    same = able.join(own, "line_id", "left_semi").select("line_id", "n_tokens", F.col("line").alias("template")).distinct()
    return _often(able, materialise(same.unionByName(near)), few(min_notes))


def recurring_lines(notes: DataFrame, record_id: str = "record_id", text: str = "notes", depth: int = 3, min_notes: int = 20, similarity: float = 0.5, min_tokens: int = 3, close: float = 0.8) -> DataFrame:
    """Every line of every note that belongs to a recurring template.

    Returns ``record_id``, ``place`` (line number from 0), ``n_tokens``, ``template`` (variable fields as ``<*>``) and ``n_notes``, the number of
    different note texts that hold the template. A template recurs in ``min_notes`` texts; one whose fixed tokens make up ``close`` of it recurs in 2
    texts from 8 tokens on, in 3 with 5 to 7 tokens and in 5 with fewer. Copies of one text count once. Null notes and blank lines have no template. A line's text is
    compared after blanks are made single; case counts. Lines of fewer than ``min_tokens`` tokens are too short to be told from chance and are left alone. Repeated rows return their lines each time.
    """
    n_tokens, lead = leaf_of(depth)
    lines = lines_of(notes, record_id, text, min_tokens).select("*", n_tokens).select("*", F.xxhash64("n_tokens", lead).alias("leaf"))
    busy = lines.select("leaf", "n_tokens", "note").distinct().groupBy("leaf", "n_tokens").agg(F.count(F.lit(1)).alias("_n"))
    busy = materialise(busy.filter(F.col("_n") >= few(min_notes)).select("leaf", "n_tokens", "_n"))
    # merged at every size: what moves then grows in proportion. What follows sees only lines of leaves that enough notes share; equal lines of one text are one row
    kept = lines.join(busy.hint("merge"), ["leaf", "n_tokens"]).select("record_id", "note", "place", "line", "n_tokens", lead, "_n", F.xxhash64("line").alias("line_id"))
    n_fixed = F.when(F.col("line").contains(FIELD), F.size(F.filter(F.split("line", " "), lambda t: t != FIELD))).otherwise(F.col("n_tokens"))
    kept = materialise(kept.withColumn("sure", n_fixed >= _enough(close)))
    high = materialise(_tree(kept.filter(F.col("_n") >= min_notes), depth, min_notes, similarity))
    low = _close(kept, depth, min_notes, close).join(high, "line_id", "left_anti")
    found = materialise(high.unionByName(low))
    return kept.join(found, "line_id").select("record_id", "place", "n_tokens", "template", "n_notes")


def drop_recurring_lines(notes: DataFrame, record_id: str = "record_id", text: str = "notes", depth: int = 3, min_notes: int = 20, similarity: float = 0.5, min_tokens: int = 3, close: float = 0.8) -> DataFrame:
    """Drop recurring lines from notes; the note with the smallest id that holds a template keeps its lines, so no content is lost.

    Returns all rows and columns of ``notes`` with ``text`` rewritten where lines went, plus ``n_dropped`` (int). Ids are expected to be unique: rows that
    share an id share their dropped places. Null notes and rows with a null id stay as they are. A note whose lines all go becomes empty.
    """
    taken = [c for c in ("n_dropped", "_at") if c in notes.columns]
    if taken:
        notes = notes.drop(*taken)
    lines = recurring_lines(notes, record_id, text, depth, min_notes, similarity, min_tokens, close)
    first = materialise(lines.groupBy("template").agg(F.min("record_id").alias("_first")))
    gone = lines.join(first, "template").filter("record_id <> _first").select("record_id", "place").distinct().groupBy("record_id").agg(F.collect_set("place").alias("_at"))
    gone = materialise(gone)
    j = notes.join(gone.withColumnRenamed("record_id", "_rid"), notes[record_id] == F.col("_rid"), "left").drop("_rid")
    left = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("_at", i))
    new = F.when(F.col("_at").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return j.select(*[new.alias(c) if c == text else F.col(c) for c in notes.columns], F.coalesce(F.size("_at"), F.lit(0)).alias("n_dropped"))
