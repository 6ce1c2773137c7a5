"""Column vocabulary: key names, the landmark preset and the checks on a table's layout.

NULL is the only spelling of "absent" inside the library; readers turn every other one into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keys:
    """Names of the three key columns of a landmark table."""

    entity: str = "record_id"
    channel: str = "lead"
    event: str = "beat_id"

    @property
    def unit(self) -> list[str]:
        return [self.entity, self.channel]

    @property
    def occurrence(self) -> list[str]:
        return [self.entity, self.event]

    @property
    def row(self) -> list[str]:
        return [self.entity, self.channel, self.event]


@dataclass(frozen=True)
class Wave:
    """One wave: its two boundaries and the peaks between them, in time order."""

    name: str
    onset: str
    peaks: tuple[str, ...]
    offset: str


@dataclass(frozen=True)
class Landmarks:
    """An ordered set of waves; ``core`` names the wave that holds the anchor peak."""

    waves: tuple[Wave, ...]
    core: str
    anchor: str

    @property
    def order(self) -> list[str]:
        return [c for w in self.waves for c in (w.onset, *w.peaks, w.offset)]

    @property
    def onsets(self) -> list[str]:
        return [w.onset for w in self.waves]

    @property
    def offsets(self) -> list[str]:
        return [w.offset for w in self.waves]

    @property
    def boundaries(self) -> list[str]:
        return [c for w in self.waves for c in (w.onset, w.offset)]

    @property
    def peaks(self) -> list[str]:
        return [c for w in self.waves for c in w.peaks]

    @property
    def core_wave(self) -> Wave:
        return next(w for w in self.waves if w.name == self.core)

    def core_positions(self) -> list[int]:
        """Places in ``order`` that belong to the core wave."""
        w = self.core_wave
        names = {w.onset, *w.peaks, w.offset}
        return [i for i, c in enumerate(self.order) if c in names]

    def with_suffix(self, suffix: str) -> "Landmarks":
        return Landmarks(
            tuple(
                Wave(w.name, w.onset + suffix, tuple(p + suffix for p in w.peaks), w.offset + suffix)
                for w in self.waves
            ),
            self.core,
            self.anchor + suffix,
        )


LANDMARKS_11 = Landmarks(
    (
        Wave("p", "p_onset", ("p_peak",), "p_offset"),
        Wave("qrs", "qrs_onset", ("q_peak", "r_peak", "s_peak"), "qrs_offset"),
        Wave("t", "t_onset", ("t_peak",), "t_offset"),
    ),
    core="qrs",
    anchor="r_peak",
)

KEYS = Keys()

# Channel names in their usual order, and the eight that are independent of each other.
LEADS_12 = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
INDEPENDENT_LEADS = ("I", "II", "V1", "V2", "V3", "V4", "V5", "V6")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or name every missing column at once."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise with the first few offending rows if ``violations`` has any."""
    rows = violations.limit(show).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    assert_empty(duplicate_keys(df, keys), f"duplicate key {tuple(keys)}")
    return df


def assert_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of ``left`` must exist in ``right``; nothing is guessed for the rest."""
    orphans = left.select(*keys).join(right.select(*keys).distinct(), list(keys), "left_anti")
    assert_empty(orphans, f"no match on {tuple(keys)}")
    return left


def align(
    df: DataFrame,
    columns: Sequence[str],
    rename: dict[str, str] | None = None,
    constants: dict[str, object] | None = None,
) -> DataFrame:
    """Rename, add constant provenance columns, fill absent ones with NULL, order canonically."""
    out = df.withColumnsRenamed(rename or {})
    if constants:
        out = out.withColumns({k: F.lit(v) for k, v in constants.items()})
    have = set(out.columns)
    return out.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])
