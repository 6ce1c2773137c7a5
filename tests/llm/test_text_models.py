"""Learned operators, the piece sampler and the block search on fixtures and odd tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import block_search, html_text, language, pieces, pseudo_likelihood, toxicity
from waymark.llm.words import Words

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
NOTES = "record_id long, notes string"
CLASH = "record_id long, notes string, score string, pieces string, draw string, word string, letter string"


def plain(rng, n, vocabulary="beat lead onset offset peak wave axis noise drift tall flat late early small rate".split()):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


ODD = [(100, None), (101, ""), (102, "?!"), (103, "one"), (103, "one"), (None, "lead axis"), (104, "wave " * 20000)]


FAR = [(None if i is None else i + 1000, t) for i, t in ODD]


def clash(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 5) for r in rows], CLASH)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        ev, turn = rng.normal(0, 1.5, n), rng.normal(0, 1, 2)
        p, change = toxicity.marginals(ev, np.array([0, n]), turn)
        total, want, pairs = 0.0, np.zeros(n), np.zeros(2)
        for s in range(1 << n):
            y = [(s >> i) & 1 for i in range(n)]
            w = np.exp(sum(ev[i] for i in range(n) if y[i]) + sum(turn[([0] + y)[i]] for i in range(n) if y[i]))
            total += w
            want += w * np.array(y)
            pairs += w * np.array([sum(1 for a, b in zip([0] + y, y) if b and a == k) for k in (0, 1)])
        assert np.allclose(p, want / total) and np.allclose(change, pairs / total)


def test_marginals_of_long_chains_do_not_depend_on_lanes(monkeypatch):
    rng = np.random.default_rng(1)
    first = np.array([0, 0, 300, 301, 1000])
    ev, turn = rng.normal(-1, 2, 1000), np.array([-0.5, 1.2])
    p, c = toxicity.marginals(ev, first, turn)
    monkeypatch.setattr(toxicity, "LANE", 5000)
    q, d = toxicity.marginals(ev, first, turn)
    assert np.allclose(p, q) and np.allclose(c, d)


def test_abusive_spans(spark):
    rng = random.Random(1)
    bad = ["moron", "idiotic", "scumbag"]
    rows, labels = [], []
    for i in range(300):
        w = plain(rng, 30).split()
        y = i % 3 == 0
        if y:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        if i < 240:
            labels.append((i, int(y)))
    labels += [(999, None), (None, 1), (998, 5)]
    lab = spark.createDataFrame(labels, "record_id long, abusive int")
    got = toxicity.score_notes(clash(spark, rows + ODD), lab).collect()
    assert len(got) == len(rows) + len(ODD)
    text = dict(rows)
    for r in got:
        if r.record_id is not None and 240 <= r.record_id < 300:
            assert r.predicted == int(r.record_id % 3 == 0)
            for s in r.spans:
                assert set(text[r.record_id][s.start : s.end].split()) <= set(bad)
            assert (r.n_spans > 0) == (r.record_id % 3 == 0)
    odd = {r.record_id: r for r in got}
    assert all(odd[i].predicted == 0 and odd[i].spans == [] for i in (100, 101, 102, 103))
    assert all(0 <= r.score <= 1 for r in got)
    empty = toxicity.score_notes(spark.createDataFrame([], NOTES), lab.limit(0))
    assert empty.count() == 0
    assert toxicity.score_notes(spark.createDataFrame([(1, "moron")], NOTES), lab.limit(0)).first().predicted == 0


def test_languages(spark):
    rng = random.Random(2)
    syl = {"aa": ["ba", "na", "ta", "la"], "bb": ["esch", "icht", "ung", "ver"], "cc": ["eau", "oi", "ment", "que"]}
    say = lambda k, n: " ".join("".join(rng.choice(syl[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, say(("aa", "bb", "cc")[i % 3], 20), ("aa", "bb", "cc")[i % 3]) for i in range(300)]
    lab = spark.createDataFrame([(i, t, y if i % 10 else None) for i, t, y in rows[:240]] + [(None, "x", "aa"), (7, None, "bb")], "record_id long, notes string, language string")
    got = language.note_languages(clash(spark, [(i, t) for i, t, _ in rows] + FAR), lab, sample=150).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.record_id is not None and 240 <= r.record_id < 300]
    assert np.mean([r.language == truth[r.record_id] for r in held]) >= 0.95 and np.mean([r.accepted for r in held]) > 0.5
    odd = {r.record_id: r for r in got}
    assert len(got) == len(rows) + len(FAR)
    assert all((odd[i].language, odd[i].score, odd[i].accepted) == ("und", 0.0, False) for i in (1100, 1101, 1102))
    assert odd[1103].language in ("aa", "bb", "cc") and odd[1104].language in ("aa", "bb", "cc") and odd[None].language in ("aa", "bb", "cc")
    twice = [r for r in got if r.record_id == 1103]
    assert len(twice) == 2 and twice[0].language == twice[1].language and twice[0].score == pytest.approx(twice[1].score, abs=1e-5)
    assert all(0 <= r.score <= 1 for r in got)
    blank = language.note_languages(spark.createDataFrame([(1, None), (2, ""), (3, "12 ?")], NOTES), lab, sample=150).collect()
    assert {(r.language, r.score, r.accepted) for r in blank} == {("und", 0.0, False)}
    assert language.note_languages(spark.createDataFrame([(1, "x")], NOTES), lab.limit(0)).first().language == "und"
    assert language.note_languages(spark.createDataFrame([], NOTES), lab).count() == 0


def test_pseudo_likelihood_learns_from_both_sides(spark):
    rng = random.Random(3)
    succ = {w: f"n{w}" for w in "abcdefgh"}
    rows = [(i, " ".join(x for _ in range(40) for w in [rng.choice("abcdefgh")] for x in (w, succ[w]))) for i in range(200)]
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    df = clash(spark, rows + [(150, " ".join(shuffled))] + FAR)
    got = pseudo_likelihood.note_likelihoods(df, share=1.0, passes=4, shard_windows=20000).collect()
    assert len(got) == len(rows) + 1 + len(FAR)
    by = {r.record_id: r for r in got}
    assert by[0].per_word > -2.4 and by[0].per_word > [r for r in got if r.record_id == 150][-1].per_word
    mixed = [r for r in got if r.record_id == 150]
    assert len(mixed) == 2 and abs(mixed[0].per_word - mixed[1].per_word) > 0.1
    assert all((by[i].n_words, by[i].log_likelihood, by[i].per_word) == (0, 0.0, None) for i in (1100, 1101, 1102))
    assert (by[1103].n_words, by[None].n_words, by[1104].n_words) == (1, 2, 20000) and all(by[i].log_likelihood < 0 for i in (1103, 1104, None))
    assert by[1104].per_word == pytest.approx(by[1104].log_likelihood / 20000)
    blank = pseudo_likelihood.note_likelihoods(spark.createDataFrame([(1, None), (2, ""), (3, "?")], NOTES)).collect()
    assert {(r.n_words, r.log_likelihood, r.per_word) for r in blank} == {(0, 0.0, None)}
    assert pseudo_likelihood.note_likelihoods(spark.createDataFrame([], NOTES)).count() == 0


def test_rare_words_are_scored_by_spelling_and_the_vocabulary_grows(spark):
    rng = random.Random(4)
    known = [f"k{i}" for i in range(992)]
    usual = lambda: "".join(rng.choice(["ba", "na", "ta"]) for _ in range(4))
    rows = [(i, " ".join([*known, *known, *(usual() for _ in range(30))])) for i in range(4)]
    # rare in the corpus, all of them; one is spelled as rare words are, one is not
    rows += [(10, " ".join(["k1", "k2", "banatana", "k3", "k4"])), (11, " ".join(["k1", "k2", "zqxjvwqz", "k3", "k4"]))]
    by = {r.record_id: r.log_likelihood for r in pseudo_likelihood.note_likelihoods(spark.createDataFrame(rows, NOTES)).collect()}
    assert by[10] > by[11] + 5
    assert pseudo_likelihood.side_for(10**6) == 32 and pseudo_likelihood.side_for(4 * 10**6) == 64 and pseudo_likelihood.side_for(135 * 10**6) == 128


def test_spelling_probabilities_sum_to_one():
    w = Words(pa.array(["ab a b? ba", "aab", None]))
    s = pseudo_likelihood.Spelling(pseudo_likelihood.pair_counts(w, np.arange(5)))
    step = np.exp(s.log)
    reach, done = step[0].copy(), 0.0
    for _ in range(2000):
        done += reach @ step[:, 0]
        reach = reach @ np.where(np.arange(256) > 0, step, 0)
    assert abs(done - 1) < 1e-6
    assert np.allclose(s.log_probs(w)[[0, 4]], [s.log[0, 97] + s.log[97, 98] + s.log[98, 0], s.log[0, 97] + s.log[97, 97] + s.log[97, 98] + s.log[98, 0]])


def test_network_probabilities_sum_to_one():
    net = pseudo_likelihood.Network(1)
    x = np.array([[1, 2, 3, 1024]], np.int32)
    every = np.arange(pseudo_likelihood.SIZE, dtype=np.int32)
    assert abs(np.exp(net.log_probs(np.repeat(x, len(every), 0), every).astype(float)).sum() - 1) < 1e-4


def test_a_word_costs_few_outputs_and_steps_follow_the_gradient(monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "CROWD", 1e9)
    net = pseudo_likelihood.Network(1, 128)
    assert sum(o.shape[1] for o in net.out) == 48
    x = np.array([[1, 2, 300, 128 * 128]], np.int32)
    every = np.arange(128 * 128, dtype=np.int32)
    assert abs(np.exp(net.log_probs(np.repeat(x, len(every), 0), every).astype(float)).sum() - 1) < 1e-4
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.Network(2)
    start = net.flat() + rng.normal(0, 0.2, len(net.flat())).astype(np.float32)
    # two notes of different lengths, with words that come again
    number = np.array([5, 900, 5, 7, 1010, 5, 900, 33, 34, 35, 5], np.int32)
    text, place = pseudo_likelihood.laid_out(number, np.array([0, 4, 11]), 32)
    around = text[place[:, None] + np.array(pseudo_likelihood.REACH)].astype(np.int64)

    def value(w):
        return pseudo_likelihood.Network.of(w, 32).log_probs(around, number).sum()

    net = pseudo_likelihood.Network.of(start, 32)
    net.fit(pseudo_likelihood.runs(text, 8), rate=0.25 * 1e-3 * 11, batch=1 << 12)
    moved = (net.flat() - start) / 1e-3
    far = np.argsort(-np.abs(moved))[:60]
    for i in np.concatenate([far[::4], rng.choice(np.flatnonzero(moved), 15)]):
        up, down = start.copy(), start.copy()
        up[i] += 0.02
        down[i] -= 0.02
        assert moved[i] == pytest.approx((value(up) - value(down)) / 0.04, abs=0.02)
    unmoved = rng.choice(np.flatnonzero(moved == 0), 5)
    for i in unmoved:
        up = start.copy()
        up[i] += 0.5
        assert value(up) == pytest.approx(value(start), abs=1e-4)


def test_runs_of_every_length_are_added_up_once():
    rng = np.random.default_rng(8)
    many = np.concatenate([np.arange(1, 40), [1, 1, 300, 2, 64], rng.integers(17, 30, 40)])
    cut, n = np.cumsum(many) - many, int(many.sum())
    order = rng.permutation(n)
    rows = np.concatenate([rng.normal(size=(n, 3)), np.zeros((1, 3))])
    got, tables = np.full((len(many), 3), np.nan), 0
    for some, size, at, member in pseudo_likelihood._by_length(cut, order):
        assert np.isnan(got[some]).all() and (size == many[some]).all()
        got[some] = rows[at].sum(1) if member is None else member @ rows[at]
        tables += 1
    assert np.allclose(got, np.add.reduceat(rows[order], cut)) and tables < 12


def test_only_rare_words_are_spelled_and_windows_are_summed_where_words_are(spark, monkeypatch):
    rng = random.Random(9)
    w = Words(pa.array([plain(rng, 500), "rare zebra", None]))
    chain, first = pseudo_likelihood.chained(w, np.array([500, 501]))
    assert bytes(chain) == b"rare\0zebra\0" and first.tolist() == [0, 5, 11]
    s = pseudo_likelihood.Spelling(pseudo_likelihood.pair_counts(w, np.arange(502)))
    assert s.sums(chain, first) == pytest.approx(s.log_probs(w)[500:])
    assert s.sums(*pseudo_likelihood.chained(w, np.zeros(0, np.int64))).tolist() == []
    net = pseudo_likelihood.Network(3)
    text, place = pseudo_likelihood.laid_out(np.array([3, 1, 1023, 7], np.int32), np.array([0, 1, 4]), 32)
    around = text[place[:, None] + np.array(pseudo_likelihood.REACH)].astype(np.int64)
    want = np.tanh(net.lean + sum(net.context[around[:, i], i] for i in range(4)))
    assert np.allclose(net.hidden(text, place), want, atol=1e-6)


def test_weights_travel_in_ranges(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, plain(rng, 60)) for i in range(40)], NOTES)
    want = {r.record_id: r.log_likelihood for r in pseudo_likelihood.note_likelihoods(df).collect()}
    monkeypatch.setattr(pseudo_likelihood, "RANGE", 10007)
    got = {r.record_id: r.log_likelihood for r in pseudo_likelihood.note_likelihoods(df).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(PIECES)


def segmentations(vocab, text):
    known = {b: (w, i) for b, i, w in _spelled(vocab)}

    def walk(b):
        if not b:
            return [((), 0.0)]
        return [((known[b[:n]][1], *r), known[b[:n]][0] + q) for n in range(1, len(b) + 1) if b[:n] in known for r, q in walk(b[n:])]

    every = walk((" " + text).encode())
    z = np.logaddexp.reduce([q for _, q in every])
    return {s: q - z for s, q in every}


def _spelled(vocab):
    weight = dict(zip(vocab.id.tolist(), vocab.weight.tolist(), strict=True))
    bytes_ids = set(vocab.byte_id.tolist())
    return [(b, i, weight[i]) for i, b in enumerate(vocab.bytes_of) if b and i not in bytes_ids]


def drawn(d, i):
    return tuple(d["pieces"][d["offsets"][i] : d["offsets"][i + 1]].tolist())


def test_draws_follow_the_lattice_and_never_repeat(vocab):
    want, n = segmentations(vocab, "the ab"), 12000
    once, twice = Counter(), Counter()
    for lo in range(0, n, 4000):
        a, b = pieces.segment(vocab, np.arange(lo, lo + 4000), pa.array(["the ab"] * 4000), 2, 5)
        for i in range(4000):
            x, y = drawn(a, i), drawn(b, i)
            assert x != y and a["perturbed"][i] >= b["perturbed"][i] >= b["kappa"][i]
            once[x] += 1
            twice[x, y] += 1
    assert abs(a["log_prob"][7] - want[drawn(a, 7)]) < 1e-9
    for s, q in want.items():
        e = n * np.exp(q)
        assert abs(once[s] - e) <= 5 * np.sqrt(e) + 3
    for (x, y), c in twice.items():
        e = n * np.exp(want[x] + want[y]) / (1 - np.exp(want[x]))
        assert abs(c - e) <= 5 * np.sqrt(e) + 4


def test_all_segmentations_are_found(vocab):
    want = segmentations(vocab, "beat")
    out = [d for d in pieces.segment(vocab, np.array([3]), pa.array(["beat"]), len(want) + 9, 1) if d["live"][0]]
    assert len(out) == len(want) and {drawn(d, 0) for d in out} == set(want)
    g = [d["perturbed"][0] for d in out]
    assert g == sorted(g, reverse=True) and np.isneginf(out[0]["kappa"][0])


def test_only_choices_that_may_win_are_scored(vocab, monkeypatch):
    drawn_numbers, plain_uniform = [], pieces._uniform
    monkeypatch.setattr(pieces, "_uniform", lambda key: drawn_numbers.append(len(key)) or plain_uniform(key))
    out = pieces.segment(vocab, np.arange(2), pa.array(["wave lead onset " * 4000, "axis"]), 3, 5)
    choices = sum(len(d["pieces"]) for d in out)
    assert len(out) == 3 and choices > 36000 and sum(drawn_numbers) < 1.1 * choices


def test_draws_of_long_units_have_their_probability(vocab):
    known = {b: w for b, _, w in _spelled(vocab)}
    for text in ("beatleadonsetoffset" * 12, "ab"):
        b = (" " + text).encode()
        log_sum = [0.0] + [-np.inf] * len(b)
        for j in range(1, len(b) + 1):
            log_sum[j] = np.logaddexp.reduce([log_sum[i] + known[b[i:j]] for i in range(max(0, j - vocab.longest), j) if b[i:j] in known])
        for d in pieces.segment(vocab, np.array([4]), pa.array([text]), 3, 9):
            got = [vocab.bytes_of[i] for i in drawn(d, 0)]
            assert b"".join(got) == b and d["log_prob"][0] == pytest.approx(sum(known[x] for x in got) - log_sum[-1], abs=1e-9)


def test_odd_piece_lists_are_spelled(vocab):
    raw = vocab.byte_id
    lists = [[], [-1, 10**6], [raw[0x20], raw[0x20], raw[0x61]], [-1, raw[0x20], raw[0x62]], [raw[0xFF], raw[0x63]], [raw[0xC3], raw[0xA9]]]
    cut = np.cumsum([0, *map(len, lists)])
    flat = np.array([i for x in lists for i in x], np.int64)
    assert pieces.spelled(vocab, flat, cut).to_pylist() == ["", "", " a", "b", "\ufffdc", "\u00e9"]
    assert pieces.spelled(vocab, flat[:0], cut[:2]).to_pylist() == [""] and pieces.spelled(vocab, flat[:0], cut[:1]).to_pylist() == []


def test_pieces_round_trip(spark):
    texts = ["", " ", "a", "  two  spaces ", "▁mark▁", "日本語🙂\n\ttab", "\u0000nul", "x" * 500, "QRS onset 45.2 ms; p-wave."]
    rows = list(enumerate(texts)) + [(50, None), (None, "lead"), (2, "a")]
    got = pieces.sample_segmentations(clash(spark, rows), PIECES, k=3)
    back = pieces.decode_pieces(got, PIECES).collect()
    by = {}
    for r in back:
        by.setdefault(r.record_id, []).append(r)
    for i, t in rows:
        for r in by[i]:
            assert r.notes == (t or "") and r.n_pieces == len(r.pieces) and r.log_inclusion <= 1e-12
    assert len(by[0]) == 1 and by[0][0].log_inclusion == 0 and by[50][0].pieces == []
    assert sorted((r.draw, r.pieces) for r in by[2])[0] == sorted((r.draw, r.pieces) for r in by[2])[1]
    assert all(len({tuple(r.pieces) for r in v}) == len(v) for i, v in by.items() if i != 2)
    again = pieces.sample_segmentations(clash(spark, rows).repartition(7), PIECES, k=3).collect()
    assert sorted((str(r.record_id), r.draw, r.pieces) for r in again) == sorted((str(r.record_id), r.draw, r.pieces) for r in back)
    assert pieces.sample_segmentations(spark.createDataFrame([], NOTES), PIECES).count() == 0


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(block_search, "RANGE", 50)
    monkeypatch.setattr(block_search, "BATCH", 9)
    monkeypatch.setattr(block_search, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 6) / 256]) for i in rng.permutation(400)]
    odd = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (1004, []), (1005, [0.5]), (None, [1.0]), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(i, v, "z", "z") for i, v in rows + odd], "unit_id long, beat array<double>, score string, cell string")
    got = block_search.best_matches(df, df["unit_id"] % 5 == 0).collect()
    vec = {i: np.array([int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v)), np.int64) for i, v in rows + [(1004, []), (1005, [0.5])]}
    want = []
    for q in vec:
        if q % 5 == 0:
            best = sorted((-int(vec[q] @ vec[d]), d) for d in vec if d != q)[:5]
            want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    one = block_search.best_matches(df.filter("unit_id = 5"), df["unit_id"] % 5 == 0)
    assert one.count() == 0
    assert block_search.best_matches(df.limit(0), df["unit_id"] % 5 == 0).count() == 0


def test_scores_stay_exact_beyond_doubles():
    q = np.array([[2**40 + 1, 3]], np.int64)
    assert block_search.scores(q, np.array([[2**20 + 1, 5]], np.int64))[0, 0] == (2**40 + 1) * (2**20 + 1) + 15


ARTICLE = "<h1>{t}</h1><p>First, a sentence of some length about {t}. It goes on, as they do.</p><p>Second <b>para</b>graph&nbsp;here &amp; there, longer than most. Yes.<p>Third, left open. It ends here."


def page(i):
    rng = random.Random(i)
    nav = "".join(f'<li><a href="/{k}">item {k}</a></li>' for k in range(rng.randint(3, 6)))
    return f'<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><div class="ad">Buy {i} now</div><article>{ARTICLE.format(t="lead " + str(i))}</article><footer>&copy; {i}</footer><script>var a="</p>";</script></body></html>'


def test_main_text_of_known_and_other_layouts(spark):
    rows = [(i, page(i)) for i in range(60)] + [(100, None), (101, ""), (102, "<p"), (5, page(5)), (None, page(7)), (103, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, html string, text string, n_chars string")
    got = html_text.page_texts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 60:
            t = f"lead {r.page_id}"
            assert r.text == f"{t} First, a sentence of some length about {t}. It goes on, as they do. Second paragraph here & there, longer than most. Yes. Third, left open. It ends here."
        assert r.n_chars == len(r.text)
    assert [r.text for r in got if r.page_id in (100, 101, 102)] == ["", "", ""]
    assert html_text.page_texts(df.limit(0)).count() == 0
    model = html_text.train([p for _, p in rows[:60]])
    rng, ok = random.Random(77), 0
    for i in range(60, 100):
        p = html_text.Page(page(i))
        new = html_text.laid_out_anew(p, html_text.told(p), ["A reader says this, at some length, about the lead. I agree."], rng)
        q = html_text.Page(new)
        ok += html_text.extract(model, [new])[0] == html_text.main_text(q, html_text.told(q) > 0)
    assert ok >= 36


def test_decoding_never_contradicts_an_ancestor():
    p = html_text.Page("<div><section><p>a</p><p>b</p></section><div><p>c</p></div></div>")
    rng = np.random.default_rng(0)
    n = len(p.parent)
    for _ in range(50):
        z = rng.normal(0, 3, n)
        kept = html_text.decode(p, z)
        assert all(not kept[i] or kept[p.parent[i]] for i in range(1, n))
        lp = lambda k: sum(-np.logaddexp(0, -z[i]) if k[i] else -np.logaddexp(0, z[i]) for i in range(1, n))
        best = max((lp(k) for s in range(1 << (n - 1)) for k in [[True] + [bool(s >> j & 1) for j in range(n - 1)]] if all(not k[i] or k[p.parent[i]] for i in range(1, n))))
        assert abs(lp(kept) - best) < 1e-9


def test_words_of_repeated_text():
    assert len(Words(pa.array(["wave " * 20000])).start) == 20000
