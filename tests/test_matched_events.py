"""Events agreed on by greedy matching with removal, against a plain loop."""

import random
import statistics

import pytest

from waymark.operators import consensus as C

SHAPE = "rec string, ch string, id long, pos long, on long"


def half_away(x):
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def by_hand(rows, channels, tol, share=0.5):
    """{record: [(turn, anchor, pos, on, {channel: id})]}, one record at a time."""
    out = {}
    for rec in sorted({r[0] for r in rows}):
        left = {c: sorted(((r[3], r[2], r[4]) for r in rows if r[0] == rec and r[1] == c and r[3] is not None)) for c in channels}
        agreed = []
        for turn, own in enumerate(channels, 1):
            gone = {c: set() for c in channels}
            for p, i, _ in left[own]:
                hits = {}
                for c in channels:
                    near = min(left[c], key=lambda e: (abs(e[0] - p), e[0], e[1]), default=None)
                    if near is not None and abs(near[0] - p) <= tol:
                        hits[c] = near
                        gone[c].add(near[1])
                if len(hits) >= share * len(channels):
                    on = [e[2] for e in hits.values() if e[2] is not None]
                    agreed.append((turn, i, half_away(statistics.median(e[0] for e in hits.values())), half_away(statistics.median(on)) if on else None, {c: e[1] for c, e in hits.items()}))
            left = {c: [e for e in left[c] if e[1] not in gone[c]] for c in channels}
        first = {}
        for a in sorted(agreed, key=lambda a: a[:2]):
            first.setdefault(a[2], a)
        out[rec] = sorted(first.values(), key=lambda a: a[2])
    return out


def run(spark, rows, channels, tol, grain):
    d = spark.createDataFrame(rows, SHAPE)
    got = C.matched_events(d, ["rec"], "ch", "pos", "id", ["on"], channels, tol, grain=grain)
    out = {}
    for r in got.collect():
        out.setdefault(r.rec, []).append((r.turn, r.anchor, r.pos, r.on, {m.channel: m.event.id for m in r.matches}))
    return {k: sorted(v, key=lambda a: a[2]) for k, v in out.items()}, got


def test_a_chain_is_not_one_event(spark):
    rows = [("r", c, i, p, p - 5) for i, (c, p) in enumerate([("a", 0), ("b", 90), ("c", 180), ("d", 270)])]
    got, agreed = run(spark, rows, ["a", "b", "c", "d"], 100, 64)
    # the first channel takes the second one's event; the other two are left to each other
    assert got == {"r": [(1, 0, 45, 40, {"a": 0, "b": 1}), (3, 2, 225, 220, {"c": 2, "d": 3})]} == by_hand(rows, ["a", "b", "c", "d"], 100)
    full = C.spread_matches(agreed, ["rec"], ["pos", "on"], ["a", "b", "c", "d"]).collect()
    assert sorted((r.turn, r.channel, r.matched, r.pos) for r in full) == [
        (1, "a", True, 0), (1, "b", True, 90), (1, "c", False, 45), (1, "d", False, 45), (3, "a", False, 225), (3, "b", False, 225), (3, "c", True, 180), (3, "d", True, 270)]


@pytest.mark.parametrize("grain", [50, 1 << 20])
def test_dense_events_equal_the_loop(spark, grain):
    rng = random.Random(5)
    channels = ["a", "b", "c"]
    rows = [(rng.choice("xyz"), rng.choice([*channels, "other"]), i, rng.choice([None, *[rng.randrange(700)] * 12]), rng.choice([None, rng.randrange(700)])) for i in range(240)]
    got, _ = run(spark, rows, channels, 20, grain)
    want = {k: v for k, v in by_hand([r for r in rows if r[1] != "other"], channels, 20).items() if v}
    assert got == want


def test_no_events(spark):
    got, agreed = run(spark, [("r", "a", 1, None, 2)], ["a", "b"], 10, 64)
    assert got == {} and C.spread_matches(agreed, ["rec"], ["pos"], ["a", "b"]).count() == 0
