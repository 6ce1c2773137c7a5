"""Quality rules, whitening and the filter audit against brute force and on odd tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import filter_audit, note_rules, queries, whitening

CLASH = "record_id long, notes string, kept boolean, n_words string, rule string, mask string, hash string, n string, bits string, class string"
ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (103, "one"), (None, "lead axis " * 30), (104, "wave " * 30000), (105, "é# x\n\né# x\né# y")]


def plain(rng, n, vocabulary="beat lead onset offset peak Wave axis noise drift tall flat late early small rate qu'à".split()):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


def base_by_hand(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def verdict_by_hand(t):
    n, chars, symbols, dup, repeated = base_by_hand(t)
    if n < 20 or 100 * repeated > 30 * n:
        return True, False
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    fails = [
        chars < 3 * n or chars > 12 * n, 10 * symbols > n, 2 * dup > len(lines), len(re.findall("[A-Z]", t)) > len(re.findall("[a-z]", t)), 5 * t.count("!") > n,
        100 * sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words) < 80 * n, 100 * sum(s.endswith("...") for s in lines) > 30 * len(lines),
        100 * sum(s[0] in "-*" for s in lines) > 90 * len(lines), 100 * max(Counter(words).values()) > 30 * n, 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n,
    ]
    return False, not any(fails)


def failing_texts(rng):
    body = [plain(rng, rng.randrange(15, 200)) for _ in range(40)]
    spoilt = [
        " ".join("ab" for _ in range(9)) + " " + " ".join(rng.choice("abcdefgh") for _ in range(60)), plain(rng, 60).replace(" ", " # "), "\n".join([plain(rng, 5).replace("\n", " ")] * 1 + ["same line"] * 9) + plain(rng, 60),
        plain(rng, 80).upper(), plain(rng, 80).replace(" ", "! "), " ".join(str(rng.randrange(1000, 99999)) for _ in range(50)), "\n".join(plain(rng, 9).replace("\n", " ") + "..." for _ in range(9)),
        "\n".join("- " + plain(rng, 8).replace("\n", " ") for _ in range(9)), " ".join(w for i in range(40) for w in ("wave", rng.choice(["lead", "peak", "rate", "axis", "beat"]))),
    ]
    spoilt.append(" ".join(w for i in range(9) for w in [f"run{i}"] * 5))
    twice = plain(rng, 30)
    return body + spoilt + [twice + " " + twice, twice + " x " + plain(rng, 90) + " " + twice]


def test_base_counts_and_verdicts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = failing_texts(rng)
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    out = note_rules.judge_notes(spark.createDataFrame(rows, "record_id long, notes string").repartition(3)).collect()
    got = sorted(((r.record_id, *[r[c] for c in note_rules.BASE], r.base_failed, r.kept) for r in out), key=str)
    assert got == sorted(((i, *base_by_hand(t), *verdict_by_hand(t)) for i, t in rows), key=str)
    assert all((r.failed_rule is None) == r.kept and (r.failed_rule == "base") == r.base_failed for r in out)
    assert {r.failed_rule for r in out} >= {"capitals", "symbols", "letterless"}


def test_verdicts_do_not_depend_on_the_order():
    texts = failing_texts(random.Random(2))
    t = note_rules.counted(pa.array(texts))
    verdicts = set()
    for seed in range(12):
        rules = list(note_rules.RULES)
        random.Random(seed).shuffle(rules)
        verdicts.add(tuple(note_rules.cascade(t, rules) == len(rules)))
    assert len(verdicts) == 1


def test_a_rule_sees_only_what_earlier_rules_passed():
    seen = []

    def spy(name, fails):
        return note_rules.Rule(name, lambda t: (seen.append((name, len(t.texts))), fails(t))[1])

    texts = [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(6)]
    t = note_rules.counted(pa.array([*texts, "short"]))
    first = note_rules.cascade(t, [spy("a", lambda t: np.arange(len(t.texts)) < 4), spy("b", lambda t: np.arange(len(t.texts)) < 2), spy("c", lambda t: np.zeros(len(t.texts), bool))])
    assert seen == [("a", 6), ("b", 2)] and first.tolist() == [0, 0, 0, 0, 1, 1, -1]


def test_order_is_by_rejection_per_cost():
    # rule 2 rejects all that rule 0 does and is cheaper, so rule 0 gains nothing after it
    assert note_rules.cheapest_order({0b101: 50, 0b100: 10, 0b010: 20, 0: 20}, [1.0, 1.0, 0.9]) == [2, 1, 0]
    assert note_rules.cheapest_order({0b11: 10, 0b01: 30}, [10.0, 1.0]) == [1, 0]
    assert note_rules.cheapest_order({}, [3.0, 1.0, 2.0]) == [1, 2, 0]


def test_rules_on_odd_tables(spark):
    empty = spark.createDataFrame([], "record_id long, notes string")
    assert note_rules.judge_notes(empty).count() == 0
    d = spark.createDataFrame([(i, t, *[None] * 8) for i, t in ODD], CLASH)
    r = note_rules.judge_notes(d)
    assert sorted(((x.record_id, x.n_words) for x in r.collect()), key=str) == sorted(((i, base_by_hand(t)[0]) for i, t in ODD), key=str)
    ids = spark.createDataFrame([("a", "x")], "rid string, body string")
    assert note_rules.judge_notes(ids, "rid", "body").first()[:2] == ("a", 1)


def vectors(rng, n, d=24, spread=3.0):
    mix = rng.normal(size=(d, d)) * np.linspace(spread, 0.3, d)
    return (rng.normal(size=(n, d)) @ mix.T).astype(np.float32)


def by_hand(v, k):
    x = np.floor(64 * v.astype(float)) + 1_000_000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    e, u = e[::-1], u[:, ::-1]
    return x.astype(np.int64), e[:k], (c @ u[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitened_vectors_equal_an_eigendecomposition(spark):
    v = vectors(np.random.default_rng(1), 700, 40)
    d = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "unit_id long, beat array<float>").repartition(5)
    k = 6
    out = whitening.whitened_beats(d, k).toPandas().sort_values(["component", "unit_id"])
    x, e, w, share = by_hand(v, k)
    n = len(v)
    assert len(out) == n * k and (out["n"] == n).all() and out["identity_error"].max() < 1e-9
    for j in range(k):
        mine = out[out["component"] == j + 1]
        sign = np.sign(mine["whitened"].to_numpy() @ w[:, j])
        assert np.allclose(mine["whitened"], sign * w[:, j], atol=1e-8) and np.allclose(mine["explained"], share[j], rtol=1e-9)
    want = [int(((n * r - x.sum(0)) ** 2).sum()) for r in x]
    assert out[out["component"] == 1]["deviation"].tolist() == want


@pytest.mark.parametrize("case", ["flat", "steep", "tied", "wide"])
def test_iteration_finds_the_leading_pairs_in_few_passes(monkeypatch, case):
    rng = np.random.default_rng(3)
    d, k = 60, 8
    scale = {"flat": np.linspace(1.2, 1.0, d), "steep": np.geomspace(1e4, 1, d), "tied": np.r_[np.full(12, 9.0), np.full(d - 12, 1.0)], "wide": np.r_[500, np.linspace(2, 1, d - 1)]}[case]
    x = np.round(rng.normal(size=(3000, d)) * scale * 40).astype(np.int64) + 1_000_000
    monkeypatch.setattr(whitening, "_total", lambda table, kernel, rows, cols, kind="double": kernel(x))

    class Table:
        def agg(self, *a):
            return self

        def first(self):
            return d, len(x)

    class Names:
        def __getattr__(self, name):
            return lambda *a: self

    monkeypatch.setattr(whitening, "F", Names())
    found = whitening.leading_components(Table(), k, guard=8)
    c = x - x.mean(0)
    e = np.linalg.eigvalsh(c.T @ c / len(c))[::-1]
    assert np.allclose(found.values, e[:k], rtol=1e-11) and found.residual <= 1e-12 * e[0] and abs(found.trace / e.sum() - 1) < 1e-12
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(k), atol=1e-13) and found.passes < 200


def test_whitening_of_odd_tables(spark):
    shape = "unit_id long, beat array<double>, x string, component string"
    bad = [(50, None, "", ""), (51, [1.0, None], "", ""), (52, [float("nan"), 1.0], "", ""), (53, [float("inf"), 0.0], "", ""), (54, [], "", ""), (55, [1.0, 2.0, 3.0], "", "")]
    assert whitening.whitened_beats(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whitened_beats(spark.createDataFrame(bad[:5], shape)).count() == 0
    same = [(i, [1.0, 2.0], "", "") for i in range(4)]
    assert whitening.whitened_beats(spark.createDataFrame(same, shape)).count() == 0
    line = [(0, [0.0, 1.0], "", ""), (0, [0.0, 1.0], "", ""), (None, [2.0, 1.0], "", ""), (3, [4.0, 1.0], "", ""), *bad]
    got = sorted(((r.unit_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in whitening.whitened_beats(spark.createDataFrame(line, shape)).collect()), key=str)
    off = [4 * v - 384 for v in (0, 0, 128, 256)]
    size = np.sqrt(np.mean(np.square(off)))
    assert got == sorted([(i, 1, 4, o * o, round(abs(o) / size, 9)) for i, o in zip((0, 0, None, 3), off)], key=str)


def audit_by_hand(rows, marks):
    def white(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    cells = Counter()
    for i, t, part in rows:
        t = t or ""
        w = white(t)
        fails = "".join(c for c, hit in zip("ABCDE", [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (s or "") == t for j, s, _ in rows)]) if hit)
        cells[part or "", fails, any(i is not None and m[0] == i and m[1] for m in marks), any(i is not None and m[0] == i and m[2] for m in marks)] += 1
    out = {}
    for part in {c[0] for c in cells}:
        mine = [(f, good, bad, n) for (p, f, good, bad), n in cells.items() if p == part]
        for order in itertools.permutations("ABCDE"):
            for s, own in enumerate(order):
                gone = set(order[:s])
                removed = [(g, b, n) for f, g, b, n in mine if own in f and not gone & set(f)]
                out[part, "".join(order), s + 1] = (
                    sum(n for f, _, _, n in mine if not (gone | {own}) & set(f)), sum(n for *_, n in removed), sum(n for f, _, _, n in mine if own in f and gone & set(f)),
                    sum(n for f, _, _, n in mine if f == own), sum(n for g, _, n in removed if g), sum(n for _, b, n in removed if b))
    return out


def test_audit_equals_applying_every_order(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT", 5)
    rng = random.Random(4)
    texts = [plain(rng, rng.choice([20, 90, 150, 300])) for _ in range(12)] + ["A B C " * 40, "x # y", "", None, plain(rng, 120).upper()]
    distinct = " ".join(f"w{i}" for i in range(140))
    rows = [(rng.randrange(400), rng.choice([*texts, distinct, distinct, distinct]), rng.choice(["NORM", "MI", None])) for _ in range(160)] + [(None, distinct, "MI"), (None, "x # y", "MI"), (7, distinct, "MI"), (7, distinct, "MI")]
    marks = [(rng.randrange(400), rng.random() < 0.5, rng.random() < 0.3) for _ in range(200)] + [(None, True, True)]
    notes = spark.createDataFrame([(*r, "x", "y") for r in rows], "record_id long, notes string, class string, bits string, hash string").repartition(3)
    out = filter_audit.audit_filters(notes, spark.createDataFrame(marks, "record_id long, usable boolean, abusive boolean"))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["usable_lost"], r["abusive_lost"]) for r in out.collect()}
    want = audit_by_hand(rows, marks)
    assert got == want
    for r in out.filter("filter_order in ('ABCDE', 'EDCBA')").collect():
        own = r["filter_order"][r["step"] - 1]
        assert r["shapley"] == sum(v[1] for (p, o, s), v in want.items() if p == r["part"] and o[s - 1] == own)


def test_audit_of_odd_tables(spark):
    shape = "record_id long, notes string, class string"
    assert filter_audit.audit_filters(spark.createDataFrame([], shape)).count() == 0
    one = filter_audit.audit_filters(spark.createDataFrame([(1, "word " * 50000, None), (2, None, None)], shape), filters={"A": lambda c: c["n_words"] < 5})
    assert sorted((r.filter_order, r.step, r.kept, r.removed) for r in one.collect()) == [("AE", 1, 1, 1), ("AE", 2, 1, 0), ("EA", 1, 2, 0), ("EA", 2, 1, 1)]
    assert {r.part for r in one.collect()} == {""}


def test_queries_state_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_quality_rules(spark, sf).dtypes[:6] == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    w = queries.op12_embedding_whitening(spark, sf)
    assert w.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    a = queries.op13_filter_audit(spark, sf)
    assert a.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"] and a.count() % 600 == 0
