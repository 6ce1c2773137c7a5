"""Readers on input whose order, headers or gaps matter."""

import pytest

from waymark.sources import readers


def test_last_value_is_the_last_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p:APD.min,1\np:APD.min,9\np:APD.min,2\np:APD.min,x\nq:APD.max,3\n")
    got = {r["path"]: (r["APD.min"], r["APD.max"]) for r in readers.read_key_values(spark, str(tmp_path), ["APD.min", "APD.max"]).collect()}
    assert got == {"p": (2.0, None), "q": (None, 3.0)}


def test_headers_in_another_order_are_refused(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("record_id,lead,r_peak\n1,II,40\n")
    (tmp_path / "b.csv").write_text("record_id,r_peak,lead\n2,50,II\n")
    schema = T._parse_datatype_string("record_id int, lead string, r_peak int")
    with pytest.raises(Exception, match="header|Header"):
        readers.read_landmarks(spark, str(tmp_path), schema).collect()
    assert readers.read_landmarks(spark, str(tmp_path / "a.csv"), schema).first()["r_peak"] == 40


def test_written_nan_is_absent(spark, tmp_path):
    (tmp_path / "7.csv").write_text("0.5,NaN,1\n1,2,3\n")
    (tmp_path / "8.csv").write_text("0.5,oops,1\n1,2,3\n")
    good, bad = readers.read_waveforms(spark, str(tmp_path), ["I", "II"])
    assert {r.lead: r.trace for r in good.collect()} == {"I": [0.5, None, 1.0], "II": [1.0, 2.0, 3.0]}
    assert [r.error for r in bad.collect()] == ["non-numeric cell"]


def test_sections_begin_at_marker_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("preamble\nmore\n##REC a\none ##REC not\ntwo\n##REC b\n\nthree\n")
    got = sorted(tuple(r) for r in readers.read_sections(spark, str(tmp_path)).select("section", "line").collect())
    assert got == [("a", "one ##REC not"), ("a", "two"), ("b", "three")]
