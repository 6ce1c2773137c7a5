"""Similarity join, decontamination, line templates and shards against brute force and on odd tables."""

import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import chosen_path, decontaminate, line_templates, sharding
from waymark.llm.components import components
from waymark.llm.words import Words, distinct_per_row, shingles

NOTES = "record_id long, notes string"
# names that the operators use inside
CLASH = "record_id long, notes string, key string, node string, path string, place string, line string, n_dropped string, blk string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def shingle_sets(texts):
    w = Words(pa.array(texts, pa.string()))
    v, s = distinct_per_row(*shingles(w, 5))
    return [set(v[s[i] : s[i + 1]].tolist()) for i in range(len(texts))]


def brute_classes(rows):
    rep = {}
    for i, t in sorted(rows):
        rep.setdefault(t, i)
    texts = list(rep)
    sets = shingle_sets(texts)
    links, root = Counter(), {rep[t]: rep[t] for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both + 1e-9 >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[rep[texts[a]]] += 1
            links[rep[texts[b]]] += 1
            x, y = find(rep[texts[a]]), find(rep[texts[b]])
            root[max(x, y)] = min(x, y)
    return {i: (find(rep[t]), rep[t], links[rep[t]]) for i, t in rows}


def test_words_do_not_depend_on_their_neighbours():
    texts = ["Änna b-c", None, "", "  ", "b c", "ÄNNA"]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [3, 0, 0, 0, 2, 1]
    assert w.hash[0] == w.hash[5] and w.hash[1] == w.hash[3] and w.hash[2] == w.hash[4]
    assert len(set(w.hash.tolist())) == 3
    v, s = shingles(w, 5)
    assert np.diff(s).tolist() == [1, 0, 0, 0, 1, 1]


def test_components_join_long_chains(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_equals_brute_force_with_a_large_near_group(spark):
    rng = random.Random(4)
    base = words(rng, 120)
    near = [edited(rng, base, rng.randrange(3)) for _ in range(90)]
    plain = [words(rng, rng.randrange(1, 80)) for _ in range(60)]
    boiler = [words(rng, 60) + " " + words(random.Random(1), 30) for _ in range(50)]
    chain = [words(random.Random(9), 200)]
    for _ in range(5):
        chain.append(edited(rng, chain[-1], 3))
    texts = near + plain + boiler + chain + plain[:5] + near[:3]
    rows = list(enumerate(texts))
    got = {r.record_id: (r.class_id, r.text_id, r.n_links) for r in chosen_path.linked_notes(spark.createDataFrame(rows, NOTES)).collect()}
    assert got == brute_classes(rows)


def test_join_on_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "one two"), (6, "One, two!"), (None, "one two"), (7, "a b c d e f"), (7, "a b c d e f")]
    df = spark.createDataFrame([(*r, *["z"] * 7) for r in rows], CLASH)
    got = sorted((tuple(r) for r in chosen_path.linked_notes(df).collect()), key=str)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1] == (1, 1, 1, 1, 0) and by[2] == (2, 2, 2, 1, 0)
    assert by[3][1:3] == by[4][1:3] == (3, 3) and by[4][4] == 0
    assert by[5][1] == by[6][1] == 5 and by[5][4] == by[6][4] == 1
    assert by[None] == (None, None, None, by[None][3], 0)
    assert [r for r in got if r[0] == 7] == [(7, 7, 7, 2, 0)] * 2
    assert chosen_path.linked_notes(spark.createDataFrame([], NOTES)).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    gold = [(i, words(rng, n, 3000)) for i, n in enumerate([3, 5, 14, 20, 33, 52, 52, 80, 120])] + [(50, None), (51, ""), (None, "x y z")]
    notes = []
    for i in range(120):
        g = rng.choice(gold[:9])[1]
        e = edited(rng, g, rng.choice([0, 0, 1, 1, 2]))
        e = " ".join(e.split()[rng.randrange(3) :]) or g
        notes.append((i, " ".join([words(rng, rng.randrange(30), 3000), e, words(rng, rng.randrange(30), 3000)]) if i % 4 else e))
    notes += [(200, None), (201, ""), (202, "?!"), (None, gold[4][1]), (5, notes[5][1])]
    got = decontaminate.leaked_notes(spark.createDataFrame(notes, NOTES), spark.createDataFrame(gold, "gold_id long, notes string")).collect()
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = []
    for i, t in notes:
        w = (t or "").lower().replace("?!", "").split()
        for g, x in gold:
            y = (x or "").split()
            if g is None or not y or not w:
                continue
            b, best = grams(y), None
            for s in range(max(1, len(w) - len(y) + 1)):
                a = grams(w[s : s + len(y)])
                both = sum((a & b).values())
                sim = both / (a.total() + b.total() - both)
                if sim + 1e-9 >= 0.8 and (best is None or sim > best[1] + 1e-12):
                    best = (s, sim)
            if best:
                want.append((i, g, best[0], round(best[1], 9)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.record_id, r.gold_id, r.first_word, round(r.similarity, 9)) for r in got), key=key) == sorted(want, key=key)
    assert len({r[3] for r in want}) > 2


def test_leaks_with_a_replaced_head_tail_or_block_are_found_at_the_threshold(spark):
    rng = random.Random(12)
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    def similarity(x, y):
        both = sum((grams(x) & grams(y)).values())
        return both / (len(x) + len(y) - 8 - both)

    gold, notes, want = [], [], {}
    for g in range(90):
        n = [100, 200, 400][g % 3]
        x = words(rng, n, 3000).split()
        gold.append((g, " ".join(x)))
        for kind in range(3):
            # as many words as leave a similarity of 0.8: a shingle that a replaced word touches is lost, so a block loses 4 more
            cut = (n - 4) // 9 - (4 if kind == 2 else 0)
            at = [0, n - cut, n // 2][kind]
            y = x[:at] + words(rng, cut, 3000).split() + x[at + cut :]
            notes.append((3 * g + kind, " ".join(y)))
            want[3 * g + kind, g] = similarity(x, y)
    assert all(0.8 <= s < 0.82 for s in want.values())
    got = decontaminate.leaked_notes(spark.createDataFrame(notes, NOTES), spark.createDataFrame(gold, "gold_id long, notes string")).collect()
    assert {(r.record_id, r.gold_id): round(r.similarity, 9) for r in got} == {k: round(s, 9) for k, s in want.items()}
    assert sum(r.distance > 11 for r in got) > 5


def test_multi_index_loses_no_fingerprint_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontaminate.GoldIndex(list(range(30)), [words(random.Random(i), 20) for i in range(30)], 5, 0.8, 11)
    probes = index.print[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (30, 11)).astype(np.uint64))
    for i in range(30):
        p = np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 11, replace=False).astype(np.uint64)) ^ index.print[i]
        for q in (p, *probes[i]):
            assert any((keys == index.block_key(np.array([q]), index.size[i : i + 1], b)[0]).any() for b, (keys, _) in enumerate(index.tables))


def test_clean_rows_stay_when_leaks_go(spark):
    text = words(random.Random(1), 40)
    df = spark.createDataFrame([(1, text, "k"), (2, "other words", "k"), (None, text, "k"), (3, None, "k")], "record_id long, notes string, gold_id string")
    left = decontaminate.without_leaks(df, spark.createDataFrame([(9, text)], "gold_id long, notes string"))
    assert left.columns == df.columns
    assert sorted((r[0] or 0) for r in left.collect()) == [0, 2, 3]
    assert decontaminate.without_leaks(df, spark.createDataFrame([], "gold_id long, notes string")).count() == 4


def test_line_templates(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        own = words(rng, 8)
        log = f"epoch {i} step {i * 7}/90 loss {rng.random():.3f} on {rng.choice(['cpu', 'mps', 'gpu'])} device"
        rows.append((i, "\n".join([own, "All rights reserved.", f"  {log}\t", "", "tail " + words(rng, 5)])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "All rights reserved."), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, *["z"] * 7) for r in rows], CLASH)
    got = line_templates.recurring_lines(df, min_notes=10).collect()
    shapes = {r.template: r.n_notes for r in got}
    assert shapes["All rights reserved."] == 31  # the row without an id too; the repeated row once
    log = next(t for t in shapes if t.startswith("epoch"))
    assert log.split()[1] == "<*>" and log.split()[3] == "<*>" and log.endswith("device") and shapes[log] >= 10
    assert all(r.place in (0, 1, 2) for r in got)
    left = line_templates.drop_recurring_lines(df, min_notes=10)
    assert left.columns == [c for c in df.columns if c != "n_dropped"] + ["n_dropped"]
    by = {(r.record_id, r.notes) for r in left.collect()}
    assert (0, rows[0][1]) in by  # the first note keeps its lines
    assert all("reserved" not in (t or "") for i, t in by if i not in (0, None))
    assert (100, None) in by and (101, "") in by
    assert line_templates.recurring_lines(spark.createDataFrame([], NOTES)).count() == 0


def plain(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("texts", [2, 5, 19])
def test_lines_that_few_texts_share_recur_at_the_default(spark, texts):
    rng = random.Random(texts)
    passage, brief = plain(rng, 60), plain(rng, 5)
    rows = [(i, "\n".join([plain(rng, 10), passage, brief, plain(rng, 3)])) for i in range(texts)]
    rows += [(50 + i, plain(rng, 30)) for i in range(20)]
    df = spark.createDataFrame(rows, NOTES)
    got = {(r.record_id, r.place): (r.template, r.n_notes) for r in line_templates.recurring_lines(df).collect()}
    want = {(i, 1): (passage, texts) for i in range(texts)}
    if texts >= 3:
        want |= {(i, 2): (brief, texts) for i in range(texts)}
    assert got == want
    left = {r.record_id: r.notes for r in line_templates.drop_recurring_lines(df).collect()}
    assert passage in left[0] and all(passage not in left[i] for i in range(1, texts))
    assert all(left[i] == t for i, t in rows if i >= 50)


def test_lines_are_made_normal_in_one_reading(spark):
    texts = [" a  b c \n\t d 5x e\r\n \n\nx y z", "a1 b\x0cc  9\n  ", "\n a b c\n", "é1 ü 2 ß  3\u0085 q w\n7", "1\n2 3 4\n 5  6 7 8", "a b\n c d e \r", "x2x\ty\n\r\n0", "p q r"]
    texts += ["a 7 " + "x" * 400000 + " b 8"]  # a long token beside one with a digit is read once, not from each of its places
    began = time.time()
    got = {(r.record_id, r.place): r.line for r in line_templates.lines_of(spark.createDataFrame(list(enumerate(texts)), "record_id long, notes string"), "record_id", "notes", 1).collect()}
    assert time.time() - began < 30
    want = {}
    for i, t in enumerate(texts):
        for place, line in enumerate(t.split("\n")):
            line = " ".join("<*>" if re.search("[0-9]", x) else x for x in re.split("[ \t\r\f]+", line) if x)
            if line:
                want[i, place] = line
    assert got == want


def test_lines_with_one_variable_word_recur_in_few_texts(spark):
    rng = random.Random(8)
    rows = [(i, plain(rng, 20) + f"\nThe notes were written by {plain(rng, 1)} of the same team") for i in range(4)]
    got = line_templates.recurring_lines(spark.createDataFrame(rows, NOTES)).collect()
    assert sorted((r.record_id, r.place, r.template, r.n_notes) for r in got) == [(i, 1, "The notes were written by <*> of the same team", 4) for i in range(4)]


def test_differencing_is_tight_and_keeps_groups_whole(spark):
    rng = np.random.default_rng(1)
    sums = np.zeros((500, 7), np.int64)
    sums[:, 0] = np.sort(rng.integers(1, 10_000, 500))[::-1]
    place = sharding.difference(sums)
    load = np.bincount(place[:, 0], sums[:, 0], 7)
    assert load.max() - load.min() <= 3
    # two partial partitions meet in opposite order
    pair = sharding.difference(np.array([[9, 4, 1], [8, 2, 0]]))
    assert sorted((np.bincount(pair[0], [9, 4, 1], 3) + np.bincount(pair[1], [8, 2, 0], 3)).tolist()) == [6, 9, 9]


@pytest.mark.parametrize("groups", [4096, 16])
def test_shards(spark, monkeypatch, groups):
    monkeypatch.setattr(sharding, "GROUPS", groups)
    monkeypatch.setattr(sharding, "CHUNK", 9)
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(60)) for _ in range(120)]
    rows = list(enumerate(texts + texts[:30] * 2)) + [(900, None), (901, None), (902, ""), (None, "x"), (5, texts[5])]
    df = spark.createDataFrame([(*r, *["z"] * 7) for r in rows], CLASH)
    got = sharding.shard_records(df, 6).collect()
    assert len(got) == len(rows)
    load, slots, home = Counter(), {}, {}
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(load) == 6
    assert max(load.values()) - min(load.values()) <= 200
    text_of = dict(rows)
    for r in got:
        assert home.setdefault(text_of[r.record_id], r.shard) == r.shard
        assert r.size == len((text_of[r.record_id] or "").encode()) + 16
    assert sharding.shard_records(spark.createDataFrame([], NOTES), 6).count() == 0
