"""Reproducible pseudo-random draws: a pure function of (seed, key, replicate).

Two lanes mix the key side by side, each with 64-bit integer arithmetic modulo a prime of its own, so any SQL engine can replay a draw, a lost
task recomputes the same values, and no state is kept. Whole numbers enter both lanes; two keys share both states only if they are equal modulo
both primes, that is modulo 4.6e18. A draw has 62 bits, a lane's end in each half. A replicate of a key is one more step of the first
lane, by a multiple of the replicate's number that the second lane's state sets; it has 31 bits.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
# (prime, state multiplier, part multiplier) of each lane
LANES = ((PRIME, 48271, 69621), (2147483629, 40692, 39373))
DRAWS = PRIME << 31
# a stretch of the draws' order that one piece of ``with_neighbours`` covers: some thousands of pieces in all
DRAW_GRAIN = 1 << 49
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _enter(x: Column, part: Column, lane: int) -> Column:
    p, a, b = LANES[lane]
    return F.pmod(x * F.lit(a) + F.pmod(part.cast("bigint"), F.lit(p)) * F.lit(b), F.lit(p))


def _stir(y: Column, lane: int) -> Column:
    return F.pmod(y * y + y * F.lit(3) + F.lit(12345), F.lit(LANES[lane][0]))


def _close(x: Column, lane: int) -> Column:
    return F.pmod(x * x + F.lit(777) + x * F.lit(5), F.lit(LANES[lane][0]))


def draw(seed: int, *parts: Column) -> Column:
    """Integer in [0, DRAWS) from integer parts, by repeated quadratic mixing."""
    ends = []
    for lane, (p, _, _) in enumerate(LANES):
        x = F.lit(seed % p).cast("bigint")
        for part in parts:
            x = _stir(_enter(x, part, lane), lane)
        ends.append(_close(x, lane))
    return ends[0] * F.lit(1 << 31) + ends[1]


def with_state(df: DataFrame, out: str, seed: int, parts: Sequence[Column]) -> DataFrame:
    """The lanes' states after ``parts``, a struct of x and y; one projection per step, so no step is evaluated twice."""
    names = [f"{out}_{lane}" for lane in range(len(LANES))]
    d = df.withColumns({n: F.lit(seed % p).cast("bigint") for n, (p, _, _) in zip(names, LANES, strict=True)})
    for part in parts:
        d = d.withColumns({n: _enter(F.col(n), part, lane) for lane, n in enumerate(names)})
        d = d.withColumns({n: _stir(F.col(n), lane) for lane, n in enumerate(names)})
    return d.withColumn(out, F.struct(*[F.col(n).alias(c) for n, c in zip(names, "xy", strict=True)])).drop(*names)


def with_draw(df: DataFrame, out: str, seed: int, parts: Sequence[Column]) -> DataFrame:
    """``draw`` as a column of ``df``, evaluated step by step."""
    s = F.col(out)
    return with_state(df, out, seed, parts).withColumn(out, _close(s["x"], 0) * F.lit(1 << 31) + _close(s["y"], 1))


def replicate_step(state: Column, part: Column) -> Column:
    """The first lane's state as ``part`` enters it for a replicate; it is stirred and closed next."""
    p, a, b = LANES[0]
    many = F.pmod((F.pmod(part.cast("bigint"), F.lit(p)) + 1) * (state["y"] + 1), F.lit(p))
    return F.pmod(state["x"] * F.lit(a) + many * F.lit(b), F.lit(p))


def continue_draw(df: DataFrame, out: str, part: Column) -> DataFrame:
    """Finish a state column with one more part, the replicate: an integer in [0, PRIME)."""
    d = df.withColumn(out, replicate_step(F.col(out), part))
    d = d.withColumn(out, _stir(F.col(out), 0))
    return d.withColumn(out, _close(F.col(out), 0))


def key_parts(df: DataFrame, ids: Sequence[str]) -> list[Column]:
    """Integer parts for key columns: whole numbers as they are, other types by their 64-bit hash."""
    types = dict(df.dtypes)
    return [F.col(c) if types[c] in WHOLE else F.xxhash64(F.col(c)) for c in ids]


def _whole_sql(p: str, m: int) -> str:
    return f"(((CAST({p} AS BIGINT) % {m}) + {m}) % {m})"


def _state_sql(seed: int, parts: Sequence[str], lane: int) -> str:
    m, a, b = LANES[lane]
    x = f"CAST({seed % m} AS BIGINT)"
    for p in parts:
        y = f"(({x} * {a} + {_whole_sql(p, m)} * {b}) % {m})"
        x = f"(({y} * {y} + {y} * 3 + 12345) % {m})"
    return x


def _close_sql(x: str, lane: int) -> str:
    return f"(({x} * {x} + 777 + {x} * 5) % {LANES[lane][0]})"


def draw_sql(seed: int, *parts: str) -> str:
    """The same draw as SQL text, for replaying it in another engine."""
    x, y = (_close_sql(_state_sql(seed, parts, lane), lane) for lane in range(len(LANES)))
    return f"({x} * {1 << 31} + {y})"


def replicate_sql(seed: int, parts: Sequence[str], last: str) -> str:
    """``continue_draw`` of the parts' state as SQL text."""
    m, a, b = LANES[0]
    x, y = (_state_sql(seed, parts, lane) for lane in range(len(LANES)))
    z = f"(({x} * {a} + ((({_whole_sql(last, m)} + 1) * ({y} + 1)) % {m}) * {b}) % {m})"
    return _close_sql(f"(({z} * {z} + {z} * 3 + 12345) % {m})", 0)


def uniform(seed: int, *parts: Column) -> Column:
    return (draw(seed, *parts).cast("double") + F.lit(0.5)) / F.lit(float(DRAWS))


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal by the Box-Muller transform of two independent draws."""
    u1 = uniform(seed, *parts)
    u2 = uniform(seed + 7919, *parts)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


@functools.cache
def poisson_cuts(power: int = 0) -> tuple[int, tuple[int, ...]]:
    """Integer thresholds of the Poisson(2 ** power) distribution function on the range of a replicate's draw.

    Returns k0 and cuts: a draw with i thresholds at or below it is the value k0 + i. Values whose whole tail is under one step of the draw
    have no threshold, so nothing else is cut off.
    """
    mean = 2.0**power
    reach = 12 * math.sqrt(mean) + 40
    total, first, cuts = 0.0, None, []
    for k in range(max(0, int(mean - reach)), int(mean + reach)):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        cut = int(total * PRIME)
        if cut < 1:
            continue
        if cut >= PRIME - 1:
            break
        if first is None:
            first = k
        cuts.append(cut)
    return first or 0, tuple(cuts)


def poisson_one(u: Column) -> Column:
    """Poisson(1) weight of a replicate's draw: how many thresholds lie at or below it."""
    first, cuts = poisson_cuts()
    out = F.when(u < cuts[0], first)
    for k, cut in enumerate(cuts[1:], start=first + 1):
        out = out.when(u < cut, k)
    return out.otherwise(first + len(cuts))


def poisson_one_sql(u: str) -> str:
    first, cuts = poisson_cuts()
    arms = " ".join(f"WHEN {u} < {c} THEN {k}" for k, c in enumerate(cuts, start=first))
    return f"(CASE {arms} ELSE {first + len(cuts)} END)"


def poisson_table_sql(powers: int) -> str:
    """Rows (b, k, lo): the draw that reaches ``lo``, and no later one, is the value k of Poisson(2 ** b)."""
    parts = []
    for b in range(powers):
        first, cuts = poisson_cuts(b)
        parts.append(f"SELECT {b} AS b, {first} + unnest(range({len(cuts) + 1})) AS k, unnest([0, {', '.join(map(str, cuts))}]) AS lo")
    return " UNION ALL ".join(parts)


CELLS = 1 << 16  # cells of a block that stays in a core's cache
FEW_CUTS = 40


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo 2 ** 31 - 1, in place: below 2 ** 33 for any x, and at most 2 ** 31 when done twice."""
    high = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += high
    return x


def draws(seed: int, parts: Sequence[np.ndarray], last: np.ndarray) -> np.ndarray:
    """``continue_draw`` on arrays (broadcast against each other), for kernels that lay replicates out as a matrix.

    The first lane's prime is 2 ** 31 - 1, so its remainders in the last step, the only one taken for every replicate, are shifts and sums.
    """
    state = []
    for p, a, b in LANES:
        x = np.int64(seed % p)
        for part in parts:
            x = (x * a + np.mod(part, p) * b) % p
            x = (x * x + x * 3 + 12345) % p
        state.append(np.asarray(x).astype(np.uint64))
    p, a, b = LANES[0]
    many = (np.mod(last, p) + 1).astype(np.uint64)
    x = np.asarray(many * (state[1] + np.uint64(1)))
    _fold(_fold(x))
    x *= np.uint64(b)
    x += state[0] * np.uint64(a)
    _fold(_fold(x))
    x *= x + np.uint64(3)
    x += np.uint64(12345)
    _fold(_fold(x))
    x *= x + np.uint64(5)
    x += np.uint64(777)
    _fold(_fold(x))
    x -= (x >= np.uint64(PRIME)) * np.uint64(PRIME)
    return x.astype(np.int64)


def _counted(cuts: tuple[int, ...], u: np.ndarray) -> np.ndarray:
    """How many of the ascending cuts lie at or below each draw."""
    if len(cuts) > FEW_CUTS:
        return np.searchsorted(np.array(cuts), u, side="right")
    low = u.astype(np.int32)
    out = np.zeros(u.shape, np.int8)
    for cut in cuts:
        out += low >= np.int32(cut)
    return out


def poisson_weights(seed: int, keys: Sequence[np.ndarray], count: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Poisson(count) weights, one row per key and one column per replicate.

    A count is split into powers of two and one weight is drawn for each; sums of Poisson weights are Poisson, so the weight of ``count``
    equal rows has the distribution it would have if each were drawn for itself.
    """
    out = np.zeros((len(count), len(reps)), np.int64)
    step = max(1, CELLS // max(1, len(reps)))
    for b in range(int(count.max()).bit_length() if len(count) else 0):
        on = np.flatnonzero((count >> b) & 1)
        first, cuts = poisson_cuts(b)
        for lo in range(0, len(on), step):
            rows = on[lo : lo + step]
            u = draws(seed, [*(k[rows, None] for k in keys), np.int64(b)], reps[None, :])
            out[rows] += first + _counted(cuts, u)
    return out
