"""Channels, self-check and layout on small frames."""

import pytest
from pyspark.sql import functions as F

from evigrid.operators import channels, findings, layout

PIN = "doc_id string, ord bigint, pin_number string, name string, side string, side_order int, description string"


def pins(spark, *data):
    return spark.createDataFrame([(d, i, n, name, side, i, desc) for i, (d, n, name, side, desc) in enumerate(data)], PIN)


def test_no_figure_is_silent_and_an_empty_figure_contradicts(spark, rows):
    text = pins(spark, ("a", "1", "VDD", "unknown", ""), ("b", "1", "VDD", "unknown", ""), ("b", "1", "VCC", "unknown", ""))
    none = spark.createDataFrame([], "doc_id string, pos int, pin_number string, side string")
    figures = spark.createDataFrame([("b",)], "doc_id string")
    merged, conflicts = channels.merge_channels(text, none, figures)
    assert rows(merged, "doc_id", "pin_number", "name", "agreement") == [("a", "1", "VDD", None), ("b", "1", "VDD", False)]
    got = rows(conflicts.select("doc_id", "field", F.map_keys("values")[0].alias("k")))
    assert got == [("b", "pin_number", "duplicate"), ("b", "side", "text")]


def test_figure_gives_side_and_order(spark, rows):
    text = pins(spark, ("a", "1", "A", "unknown", ""), ("a", "2", "B", "unknown", ""))
    seen = spark.createDataFrame([("a", 0, "2", "left"), ("a", 1, "1", "left"), ("a", 2, "9", "right")], "doc_id string, pos int, pin_number string, side string")
    merged, conflicts = channels.merge_channels(text, seen, seen.select("doc_id"))
    assert rows(merged, "pin_number", "side", "side_order") == [("1", "left", 1), ("2", "left", 0)]
    assert rows(conflicts.select("pin_number", "field", F.col("values")["vision"])) == [("9", "pin_number", "right")]


@pytest.mark.parametrize("name, expected, observed, description, side, agreed, confidence, want", [
    ("INO", "INO", "IN0", "Analog input channel 0", "left", True, 0.95, "channel_number"),
    ("INO", "INO", "IN0", "Analog input channel 1", "left", True, 0.95, None),
    ("IN1", "IN1", "IN2", "Analog input channel 2", "left", True, 0.95, None),
    ("INO", "INO", "IN0", "Analog input channel 0", "left", False, 0.95, None),
    ("INO", "INO", "IN0", "Analog input channel 0", "left", True, 0.5, None),
    ("VDD", "VCC", "VEE", "", "left", True, 0.95, None),
    ("v dd", "VCC", "VDD", "", "left", True, 0.95, "already_equal"),
    ("EP", "EP", "EPAD", "Exposed pad", "unknown", False, None, "pad_alias"),
    ("7", "7", "SDA", "", "left", True, None, "placeholder"),
])
def test_name_verdicts(spark, name, expected, observed, description, side, agreed, confidence, want):
    p = spark.createDataFrame([("d", "7", name, side, description, [(1, "vision", None, agreed)])],
                              "doc_id string, pin_number string, name string, side string, description string, evidence array<struct<page int, source string, bbox array<double>, agreement boolean>>")
    m = spark.createDataFrame([("d", "7", expected, observed)], "doc_id string, pin_number string, expected string, observed string")
    ob = spark.createDataFrame([("d", "7", confidence, False)], "doc_id string, pin_number string, confidence double, uncertain boolean")
    assert channels.name_resolution(p, m, ob).first()["reason"] == want


def test_refused_answers_change_nothing(spark, rows):
    p = pins(spark, ("a", "1", "X", "left", ""), ("b", "1", "X", "left", ""))
    conflicts = spark.createDataFrame([("a", "1", "name"), ("b", "1", "name"), ("b", "1", "side")], "doc_id string, pin_number string, field string")
    answers = spark.createDataFrame([("a", "1", "name", "Y"), ("b", "1", "name", "Y")], "doc_id string, pin_number string, field string, value string")
    assert rows(channels.resolution_issues(answers, conflicts)) == [("b", "1", "side", "uncovered")]
    assert rows(channels.apply_resolutions(p, answers, conflicts), "doc_id", "name") == [("a", "Y"), ("b", "X")]


def test_report_scores_and_gaps(spark, rows):
    p = pins(spark, ("a", "1", "A", "left", ""), ("a", "4", "", "left", ""), ("a", "4", "C", "unknown", ""))
    docs = spark.createDataFrame([("a", "LM317", "x"), ("b", "", "")], "doc_id string, device string, file_stem string")
    found = findings.check_pins(p, docs)
    assert rows(found, "doc_id", "code", "severity", "items", "detail") == [
        ("a", "empty_pin_names", "warn", 1, "4"), ("a", "pin_numbers_duplicated", "error", 1, "4"),
        ("a", "pin_numbers_not_contiguous", "warn", 2, "2、3"), ("a", "sides_unknown", "warn", 1, "4"),
        ("b", "device_suspicious", "warn", 0, ""), ("b", "no_pins", "error", 0, "")]
    assert rows(findings.report(found, docs), "doc_id", "score", "verdict") == [("a", 60, "broken"), ("b", 70, "broken")]


def test_layout_is_centred(spark, rows):
    p = pins(spark, *[("a", str(i), f"P{i}", "left" if i < 3 else "right", "") for i in range(5)])
    out = layout.symbol_layout(p)
    assert rows(out, "pin_number", "x", "y", "hx") == [
        ("0", -50, -20, -60), ("1", -50, 0, -60), ("2", -50, 20, -60), ("3", 50, -10, 60), ("4", 50, 10, 60)]


def test_dual_row_rotation_needs_proof(spark, rows):
    f = [("a", str(n), i, "top" if n <= 2 else "bottom") for i, n in enumerate((1, 2, 3, 4))]
    f += [("b", "1", 0, "top"), ("b", "2", 1, "bottom"), ("b", "3", 2, "top"), ("b", "4", 3, "bottom")]
    figure = spark.createDataFrame(f, "doc_id string, pin_number string, pos int, side string")
    packages = spark.createDataFrame([("a", "DFN4"), ("b", "DFN4")], "doc_id string, package string")
    out = channels.dual_row_rotation(figure, packages)
    assert rows(out.where("doc_id = 'a'"), "pin_number", "side", "pos") == [("1", "left", 0), ("2", "left", 1), ("3", "right", 3), ("4", "right", 2)]
    assert not out.where("doc_id = 'b'").first()["rotated"]


def test_rollup_keeps_cases_without_a_status(spark, rows):
    from evigrid.operators import fusion
    out = fusion.status_rollup(spark.createDataFrame([("ok",), (None,), (None,)], "status string"))
    assert rows(out, "status", "cases") == [(None, 2), ("ok", 1), ("total", 3)]


def test_one_channel_written_twice_is_one(spark):
    from evigrid.operators import channels
    e = "array<struct<page:int,source:string,bbox:array<double>,agreement:boolean>>"
    pins = spark.createDataFrame([("d", "1", "A1N0", "left", "analog input channel 0, Analog Input Channel 00", [(1, "vision", None, True)])],
                                 f"doc_id string, pin_number string, name string, side string, description string, evidence {e}")
    differ = spark.createDataFrame([("d", "1", "A1N0", "AIN0")], "doc_id string, pin_number string, expected string, observed string")
    seen = spark.createDataFrame([("d", "1", 0.95, False)], "doc_id string, pin_number string, confidence double, uncertain boolean")
    assert [r.reason for r in channels.name_resolution(pins, differ, seen).collect()] == ["channel_number"]


def test_set_differences_take_null_as_a_value(spark, rows):
    """As EXCEPT does: a key with a null on both sides is on both sides, repeats count once."""
    from evigrid.operators import channels
    schema = "doc_id string, pin_number string"
    left = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", None), ("e", None), (None, "2")], schema)
    right = spark.createDataFrame([("d", "2"), ("d", None), ("d", None), (None, "2"), (None, "3")], schema)
    got = rows(channels.set_differences(left, right, ["doc_id", "pin_number"]), "doc_id", "pin_number", "kind")
    assert sorted(got, key=str) == sorted([("d", "1", "missing"), ("e", None, "missing"), ("d", "2", "extra"), (None, "3", "extra")], key=str)
