"""Answers as a whole, links of a view, merged views, identity state, package tables."""

from pyspark.sql import functions as F

from evigrid.operators import answers, families, fusion, geometry, text


def test_answers_as_a_whole(spark, rows):
    kind = "doc_id string, action string, text string, slots map<string, struct<value: double, unit: string>>"
    a = spark.createDataFrame([
        ("slots first", None, "pitch 9 mm body width 2 mm", {"terminal_pitch": (20.0, "mil")}), ("cancel", " Cancel ", "pitch 1", None),
        ("action", "drop", "pitch 1", None), ("foreign", "", None, {"pin_span": (1.0, None)}), ("long", "", "pitch 1" + " " * 4000, None),
        ("none", "", "subpitch 4 mm", None), ("bounds", "", "pitch -1 mm", None), ("unasked", "", "pitch 1", None), ("null", None, None, None)], kind)
    asked = spark.createDataFrame([(d, f) for d in ("slots first", "cancel", "action", "foreign", "long", "none", "bounds", "null")
                                   for f in ("terminal_pitch", "body_width", "body_width", None)], "doc_id string, field string")
    slots, status = answers.answered_slots(a, asked)
    assert rows(slots, "doc_id", "field", "alias", "value", "issue") == [
        ("bounds", "terminal_pitch", "pitch", None, "bounds"), ("slots first", "body_width", "body width", 2.0, None),
        ("slots first", "terminal_pitch", None, 0.508, None)]
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {
        "slots first": "accepted", "cancel": "cancelled", "action": "action", "foreign": "unknown_field", "long": "text_too_long", "none": "no_slot",
        "bounds": "values", "unasked": "nothing_asked", "null": "no_slot"}


def test_a_view_keeps_links_to_its_lines(spark, rows):
    kept = spark.createDataFrame([("d", "r1", "a"), ("d", "r1", "b"), ("d", "r2", "b")], "doc_id string, region_id string, id string")
    links = spark.createDataFrame([("d", "a", "l1", 1), ("d", "a", "l2", 2), ("d", "a", "l3", 3), ("d", "b", "l3", 1), ("d", "b", "l4", 2), ("d", "b", "l1", 3), ("d", "c", "l9", 1)],
                                  "doc_id string, id string, line_id string, rank int")
    assert rows(geometry.view_links(kept, links), "region_id", "id", "line_id") == [
        ("r1", "a", "l1"), ("r1", "a", "l2"), ("r1", "a", "l3"), ("r1", "b", "l1"), ("r1", "b", "l3"), ("r1", "b", "l4"), ("r2", "b", "l3"), ("r2", "b", "l4")]


def test_assignments_of_views_in_order(spark, rows):
    df = spark.createDataFrame([("d", 2, 0, "x"), ("d", 1, 1, "x"), ("d", 1, 0, "y"), ("e", 3, 0, "z")], "doc_id string, view_no int, pos int, canonical_name string")
    assert rows(fusion.merged_assignments(df), "doc_id", "place", "canonical_name") == [("d", 1, "y"), ("d", 2, "x"), ("d", 3, "x"), ("e", 1, "z")]


def test_identity_state_with_empty_parts(spark):
    classes = spark.createDataFrame([("d", "QFN"), ("e", None)], "doc_id string, package_type string")
    tokens = spark.createDataFrame([("d", 1, "48 leads", 0.9)], "doc_id string, ord int, text string, confidence double")
    views = spark.createDataFrame([("d", "top"), ("d", "side"), ("d", "top"), ("d", None)], "doc_id string, view_type string")
    features = spark.createDataFrame([("d", i, f"f{i % 23}") for i in range(30)], "doc_id string, pos int, name string")
    got = {r["doc_id"]: r for r in text.identity_state(classes, text.identity_rows(tokens), views, features).collect()}
    assert got["d"]["identified_views"] == ["side", "top"] and got["d"]["detected_features"] == [f"f{i}" for i in range(20)]
    assert got["d"]["drawing_text"] == ["48 leads"] and got["d"]["pin_counts"] == [48]
    assert tuple(got["e"])[1:] == ("", [], [], [], [])


def test_package_table_counts_and_open_fields(spark, rows):
    table = spark.createDataFrame([("d", 1, "k1", "A", 0.8, "", "x1", None)], "doc_id string, ord int, label_token string, label string, confidence double, nom string, max string, min string")
    identity = spark.createDataFrame([("d", 3, "t3", "16 pins"), ("d", 2, "t2", "UFQFPN 48-Leads"), ("d", 1, "t1", "A1234-lead")], "doc_id string, ord int, token_id string, text string")
    found = families.package_semantics(table, identity)
    assert rows(found, "canonical_name", "label_token", "value_token") == [("nominal_pin_count", "t2", None), ("total_height", "k1", "x1")]
    left = families.unresolved_fields(table.select("doc_id"), found).select(F.col("field"))
    assert {r[0] for r in left.collect()} == set(families.REQUIRED[families.QFN]) - {"nominal_pin_count", "total_height"}


def test_gate_keeps_one_row_per_document(spark, rows):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    params = spark.createDataFrame([("a", "x", "table_row", 0.9, 0.9), ("a", "y", "dimension_line", 0.5, 0.9), ("b", "z", "dimension_line", 0.9, 0.9), ("a", None, "table_row", 0.9, 0.9)],
                                   "doc_id string, canonical_name string, evidence_kind string, ocr_confidence double, semantic_confidence double").withColumn("evidence_ids", F.array(F.lit("t")))
    issues = spark.createDataFrame([("a", "unresolved", "x"), ("a", "missing", "w"), ("b", "unit", "z"), ("b", "conflict", "z"), ("b", "other", "x")], "doc_id string, kind string, field string")
    required = spark.createDataFrame([("a", ["x", "y", None]), ("b", ["x", "z", "x"])], "doc_id string, fields array<string>")
    features = spark.createDataFrame([("a", ["f", "g"]), ("a", ["f"])], "doc_id string, features array<string>")
    findings, verdicts = fusion.evidence_gate(params, issues, required, features, spark.createDataFrame([("a", "g"), ("b", "f")], "doc_id string, feature string"), docs)
    assert sorted(map(str, rows(findings, "doc_id", "kind", "field"))) == sorted(map(str, [
        ("a", "missing", "x"), ("a", "missing", None), ("a", "low_confidence", "y"), ("a", "missing", "feature:f"), ("b", "missing", "x"), ("b", "conflict", "z")]))
    assert rows(verdicts, "doc_id", "missing", "conflict", "low_confidence", "parameters", "passed") == [("a", 3, 0, 1, 2, False), ("b", 1, 1, 0, 1, False), ("c", 0, 0, 0, 0, True)]
    assert "Join" not in findings._jdf.queryExecution().optimizedPlan().toString()
