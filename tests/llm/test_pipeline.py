"""The corpus pipeline, stage by stage, against what each stage's own input says."""

import random

import pytest

import corpus_pipeline
from waymark.llm.words import Words, distinct_per_row, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    root = str(tmp_path_factory.mktemp("sf"))
    gold = [(i, words(rng, 30)) for i in range(5)]
    texts, toxic, labels = {}, set(), []
    for i in range(240):
        t = words(rng, 60)
        if i % 4 == 0:
            toxic.add(i)
            w = t.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["moron", "scumbag", "idiot"])
            t = " ".join(w)
        texts[i] = t + "\n" + words(rng, 12)
        labels.append((i, 1, int(i % 4 == 0)))
    for i in (1, 2, 3, 5, 6):
        texts[300 + i] = texts[i]  # exact copies
        w = texts[i].split(" ")
        w[2] = "edited"
        texts[400 + i] = " ".join(w)  # near copies
    for i in range(5):
        texts[500 + i] = words(rng, 20) + " " + gold[i][1] + "\n" + words(rng, 20)
    for i in range(30):
        texts[600 + i] = words(rng, 30) + "\nAll rights are reserved here."
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id at all", "en", "s", 12)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(gold, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, toxic


def test_stages(spark, folder):
    root, toxic = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "sentencepiece encoding"]
    (_, tox), (_, lines), (_, near), (_, leaks), (_, encode) = corpus_pipeline.STAGES
    ids = lambda d: sorted(-1 if r.doc_id is None else r.doc_id for r in d.select("doc_id").collect())

    kept = tox(spark, docs, root).cache()
    assert kept.columns == docs.columns and set(ids(docs)) - set(ids(kept)) == toxic

    lined = lines(spark, kept, root).cache()
    assert lined.columns == docs.columns and ids(lined) == ids(kept)
    text = {r.doc_id: r for r in lined.collect()}
    assert text[600].text.endswith("here.") and not any("reserved" in text[600 + i].text for i in range(1, 30))
    assert text[601].n_chars == len(text[601].text) and text[1].text == {r.doc_id: r.text for r in kept.collect()}[1]

    single = near(spark, lined, root).cache()
    gone = set(ids(lined)) - set(ids(single))
    assert single.columns == docs.columns and gone == {300 + i for i in (1, 2, 3, 5, 6)} | {400 + i for i in (1, 2, 3, 5, 6)}
    rest = [r.text for r in single.collect() if r.text]
    v, s = distinct_per_row(*shingles(Words(__import__("pyarrow").array(rest)), 5))
    sets = [set(v[s[i] : s[i + 1]].tolist()) for i in range(len(rest))]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)

    clean = leaks(spark, single, root).cache()
    assert clean.columns == docs.columns and set(ids(single)) - set(ids(clean)) == set(range(500, 505))

    out = encode(spark, clean, root).collect()
    assert len(out) == clean.count()
    want = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.text == (want[r.doc_id] or "") and len(r.pieces) == r.n_pieces for r in out)


def test_run_is_the_stages_in_order(spark, folder):
    root, toxic = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, root).select("doc_id").collect()}
    assert not got & (toxic | set(range(500, 505)) | {301, 401}) and {1, 600, 629, 900, 901, None} <= got


def test_encode_draws_as_many_segmentations_as_the_operator(spark, folder):
    from waymark.llm import pieces

    root, _ = folder
    docs = spark.createDataFrame([(1, "one more visit in the evening"), (2, ""), (3, None), (None, "no id"), (None, "no id"), (4, "a"), (5, "kept é text\n\nwith lines")], "doc_id long, text string")
    got = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    flat = sorted((r.doc_id or 0, i + 1, tuple(p), t) for r in got for i, (p, t) in enumerate([(r.pieces, r.text), *((o.pieces, o.text) for o in r.others)]))
    each = pieces.sample_segmentations(docs, corpus_pipeline.PIECES, "doc_id", "text", decoded="text").collect()
    assert len(got) == 7 and flat == sorted((r.record_id or 0, r.draw, tuple(r.pieces), r.text) for r in each)
    assert {r.doc_id: len(r.others) for r in got if r.doc_id in (1, 2, 3, 5)} == {1: 2, 2: 0, 3: 0, 5: 2}
