"""Orders along text keys that share a long prefix."""

from waymark.operators import corpus


def test_places_of_text_keys_with_one_prefix(spark):
    rows = [(c, f"record_medal_care_{(i * 37) % 500:04d}") for c in ("AVB", "LBBB") for i in range(500)]
    df = spark.createDataFrame(rows, "disease_class string, record_id string")
    got = {}
    for r in corpus.ranked_in_order(df, ["disease_class"], "record_id").collect():
        got.setdefault(r.disease_class, []).append((r._i, r.record_id))
    for v in got.values():
        v.sort()
        assert [i for i, _ in v] == list(range(1, 501)) and [k for _, k in v] == sorted(k for _, k in v)


def test_splits_on_text_keys(spark):
    df = spark.createDataFrame([("c", f"prefix_{i:03d}") for i in range(40)], "disease_class string, record_id string")
    halves = corpus.alternate_split(df, ["disease_class"], "record_id").collect()
    assert all((r.split == "calibration") == (int(r.record_id[-3:]) % 2 == 0) for r in halves)
    roles = {r.record_id: r.role for r in corpus.first_n_split(df, ["disease_class"], "record_id").collect()}
    assert [roles[f"prefix_{i:03d}"] for i in (0, 9, 10, 11, 12)] == ["test", "test", "val", "val", "pool"]
