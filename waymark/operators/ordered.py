"""Neighbour, carry and position columns along an order, without one task per key.

A plain window sends a whole key to one task, which fails when a key holds a large share of all
rows. Here each key is cut into pieces of ``grain`` units of its (numeric) order column. A window
runs inside the pieces, a summary with one row per piece is built by partial aggregation, and the
summary's own window supplies what crosses a piece border. With a unique integer order column a
piece holds at most ``grain`` rows, whatever the size of its key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import materialise_by

GRAIN = 1 << 20
# The piece of rows without an order in a table laid out by ``lay_out``; they come before all others.
NO_PIECE = -(1 << 62)


def lay_out(df: DataFrame, keys: Sequence[str], order: str, grain: int = GRAIN) -> DataFrame:
    """``df`` written once, in buckets of (keys, ``_piece``), for several steps along ``order``.

    ``with_neighbours``, and joins or aggregates on (keys, ``_piece``), then shuffle none of its rows, and a key with a third of all rows is spread
    over the buckets by its pieces.
    """
    piece = F.coalesce(F.floor(F.col(order) / F.lit(grain)).cast("bigint"), F.lit(NO_PIECE))
    return materialise_by(df.withColumn("_piece", piece), [*keys, "_piece"], [*keys, "_piece", order])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    ties: Sequence[str] = (),
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    carry: Mapping[str, str] | None = None,
    ordinal: str | None = None,
    running: Mapping[str, str] | None = None,
    total: str | None = None,
    grain: int | None = GRAIN,
) -> DataFrame:
    """Add columns that look along ``order`` inside ``keys``.

    ``lag``/``lead`` map a new column to the column read from the previous/next row; ``carry``
    to the column whose last non-NULL value up to this row is wanted; ``running`` to the column
    summed up to this row; ``ordinal`` names a 1-based row number and ``total`` the key's row
    count. ``grain=None`` runs a plain window, for groups known to be small. Keys must not be NULL,
    and names starting with an underscore are reserved. A table from ``lay_out`` keeps its pieces.
    """
    lag, lead, carry, running = dict(lag or {}), dict(lead or {}), dict(carry or {}), dict(running or {})
    keys = list(keys)
    sort = [F.col(order), *[F.col(t) for t in ties]]
    if grain is None:
        w = W.partitionBy(*keys).orderBy(*sort)
        upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        new: dict[str, Column] = {o: F.lag(c).over(w) for o, c in lag.items()}
        new |= {o: F.lead(c).over(w) for o, c in lead.items()}
        new |= {o: F.last(c, ignorenulls=True).over(upto) for o, c in carry.items()}
        new |= {o: F.sum(c).over(upto) for o, c in running.items()}
        if ordinal:
            new[ordinal] = F.row_number().over(w).cast("bigint")
        if total:
            new[total] = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumns(new)

    piece = F.floor(F.col(order) / F.lit(grain)).cast("bigint")
    base = df if "_piece" in df.columns else df.withColumn("_piece", piece)
    at = F.struct(*sort)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lag.items()]), at).alias("_tail"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(o) for o, c in lead.items()]), at).alias("_head"))
    for o, c in carry.items():
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_c_{o}"))
    for o, c in running.items():
        aggs.append(F.sum(c).alias(f"_s_{o}"))
    pieces = base.groupBy(*keys, "_piece").agg(*aggs)
    pw = W.partitionBy(*keys).orderBy("_piece")
    before = pw.rowsBetween(W.unboundedPreceding, -1)
    side = [F.col(k) for k in keys] + [F.col("_piece"), F.col("_n")]
    if lag:
        side.append(F.lag("_tail").over(pw).alias("_tail"))
    if lead:
        side.append(F.when(F.col("_piece") != F.lit(NO_PIECE), F.lead("_head").over(pw)).alias("_head"))
    for o in carry:
        side.append(F.last(f"_c_{o}", ignorenulls=True).over(before).alias(f"_c_{o}"))
    for o in running:
        side.append(F.sum(f"_s_{o}").over(before).alias(f"_s_{o}"))
    if ordinal:
        side.append(F.sum("_n").over(before).alias("_before"))
    if total:
        side.append(F.sum("_n").over(W.partitionBy(*keys)).alias("_all"))
    borders = pieces.select(*side)

    inner = W.partitionBy(*keys, "_piece").orderBy(*sort)
    upto = inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    local: dict[str, Column] = {"_rn": F.row_number().over(inner)}
    local |= {f"_l_{o}": F.lag(c).over(inner) for o, c in lag.items()}
    local |= {f"_f_{o}": F.lead(c).over(inner) for o, c in lead.items()}
    local |= {f"_k_{o}": F.last(c, ignorenulls=True).over(upto) for o, c in carry.items()}
    local |= {f"_r_{o}": F.sum(c).over(upto) for o, c in running.items()}
    joined = base.withColumns(local).join(borders, [*keys, "_piece"], "left")
    out = {}
    for o in lag:
        out[o] = F.when(F.col("_rn") == 1, F.col("_tail").getField(o)).otherwise(F.col(f"_l_{o}"))
    for o in lead:
        out[o] = F.when(F.col("_rn") == F.col("_n"), F.col("_head").getField(o)).otherwise(F.col(f"_f_{o}"))
    for o in carry:
        out[o] = F.coalesce(F.col(f"_k_{o}"), F.col(f"_c_{o}"))
    for o in running:
        out[o] = F.when(
            F.col(f"_r_{o}").isNotNull() | F.col(f"_s_{o}").isNotNull(),
            F.coalesce(F.col(f"_r_{o}"), F.lit(0)) + F.coalesce(F.col(f"_s_{o}"), F.lit(0)),
        )
    if ordinal:
        out[ordinal] = F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0))
    if total:
        out[total] = F.col("_all")
    return joined.select(*[F.col(c) for c in df.columns if c not in out], *[e.alias(o) for o, e in out.items()])


def attach(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Give every row its group's aggregates.

    Partial aggregation shrinks a large key before the shuffle, and the join back has one row
    per key on its small side, which adaptive execution can split around a hot key.
    """
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")


def keep_last(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One whole row per key: the one with the greatest ``by``. Aggregates map-side first."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def text_rank(c: Column) -> Column:
    """A number that grows with the text's first bytes, to cut text orders into pieces."""
    head = F.rpad(F.hex(F.substring(c, 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("bigint")


def with_frame(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    before: int,
    after: int,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    grain: int = GRAIN,
) -> DataFrame:
    """Bounded row frames over a dense row number, piece by piece.

    Rows within ``before``/``after`` of a piece border are copied to the neighbouring piece, so a
    window over (keys, piece) sees everything a home row needs. Each entry of ``columns`` maps a
    window specification to a Column.
    """
    home = F.floor(F.col(ordinal) / F.lit(grain)).cast("bigint")
    reach = F.array_distinct(
        F.array(
            home,
            F.floor((F.col(ordinal) - after) / F.lit(grain)).cast("bigint"),
            F.floor((F.col(ordinal) + before) / F.lit(grain)).cast("bigint"),
        )
    )
    w = W.partitionBy(*keys, "_piece").orderBy(ordinal)
    spread = df.withColumns({"_home": home, "_piece": F.explode(reach)})
    out = spread.withColumns({name: make(w) for name, make in columns.items()})
    return out.filter("_piece = _home").drop("_piece", "_home")
