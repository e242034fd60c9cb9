"""Evidence: references, values of assignments, fusion of fields, gates, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T
from ..functions.dimensions import explicit_count, with_dimensions
from ..session import settled
from .ordering import ranked, top_per_key

COUNT_FIELDS = ("circuit_count", "nominal_pin_count")
ASSIGNMENT = ["doc_id", "assignment_id"]
# What is known of a field at the gate, a bit each
HELD, OPEN, CLASH, UNSURE = (1 << k for k in range(4))
# Quantities that cannot share one numeric token, and the families they belong to
EXCLUSIVE = (("total_height", "terminal_length"), ("body_standoff", "terminal_length"),
             ("body_standoff", "terminal_thickness"), ("pin_span", "overall_width"))
EXCLUSIVE_FAMILIES = ("ic/gullwing_ic", "gullwing_ic", "ic/quad_gullwing_ic", "quad_gullwing_ic")


def resolved_references(assignments: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """How many token and line references of each assignment exist, against how many it makes."""
    def found(column, known, key):
        refs = assignments.select(*ASSIGNMENT, F.explode(column).alias(key))
        hits = refs.join(known.select("doc_id", key).distinct(), ["doc_id", key], "left_semi")
        return hits.groupBy(*ASSIGNMENT).agg(F.count("*").alias(f"{column}_found"))
    out = assignments.select(*ASSIGNMENT, "canonical_name", F.size("token_ids").alias("tokens_wanted"), F.size("line_ids").alias("lines_wanted"))
    out = out.join(found("token_ids", tokens, "token_id"), ASSIGNMENT, "left").join(found("line_ids", lines, "line_id"), ASSIGNMENT, "left")
    out = out.fillna(0, ["token_ids_found", "line_ids_found"])
    ok = (F.col("token_ids_found") == F.col("tokens_wanted")) & (F.col("line_ids_found") == F.col("lines_wanted"))
    return out.withColumn("resolved", ok)


def assignment_values(assignments: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Value, unit and outcome of every assignment; a model never supplies the number, only the references.

    outcome is `fused`, `missing` or `unit`. Numbers within 1e-6 agree; two with a line, or three stacked with
    a line, mean their maximum.
    """
    typed = with_dimensions(tokens, "text", F.col("value_role").startswith("table_"), ("nominal", "minimum", "maximum", "unit"))
    typed = typed.withColumn("_count", explicit_count("text"))
    refs = assignments.select(*ASSIGNMENT, "canonical_name", F.posexplode("token_ids").alias("_pos", "token_id"))
    rows = refs.join(typed, ["doc_id", "token_id"])
    counting = F.col("canonical_name").isin(*COUNT_FIELDS)
    as_count = counting & F.col("nominal").isNull() & F.col("_count").isNotNull()
    rows = rows.withColumns({"_unit": F.when(as_count, "count").otherwise(F.col("unit")),
                             "_nominal": F.when(as_count, F.col("_count").cast("double")).otherwise(F.col("nominal"))})
    value = F.coalesce("_nominal", "maximum")
    rows = rows.withColumns({"_value": value, "_cx": (F.col("x1") + F.col("x2")) / 2.0, "_cy": (F.col("y1") + F.col("y2")) / 2.0})
    numeric = F.col("_value").isNotNull()

    def of_numeric(c):
        return F.when(numeric, c)
    unit = F.when(F.col("_nominal").isNotNull(), F.when(F.col("_unit") == "unknown", F.col("unit_context")).otherwise(F.col("_unit")))
    facts = rows.groupBy(*ASSIGNMENT).agg(
        F.count("*").alias("_tokens"), F.count("_value").alias("_numbers"), F.min_by("_value", of_numeric(F.col("_pos"))).alias("_first"),
        F.min("_value").alias("_low"), F.max("_value").alias("_high"),
        (F.max(of_numeric(F.col("_cx"))) - F.min(of_numeric(F.col("_cx")))).alias("_dx"),
        (F.max(of_numeric(F.col("_cy"))) - F.min(of_numeric(F.col("_cy")))).alias("_dy"),
        F.avg(of_numeric(F.col("x2") - F.col("x1"))).alias("_w"), F.avg(of_numeric(F.col("y2") - F.col("y1"))).alias("_h"),
        F.min(of_numeric(F.col("confidence"))).alias("ocr_confidence"), F.bool_or(F.col("value_role").startswith("table_")).alias("_table"),
        F.bool_or(F.col("_count").isNotNull()).alias("_counted"), F.min(unit).alias("_u0"), F.max(unit).alias("_u1"),
        F.bool_or(F.col("minimum").isNotNull() & F.col("maximum").isNotNull()).alias("_ranged"))
    line_refs = assignments.select(*ASSIGNMENT, F.explode("line_ids").alias("line_id")).join(
        lines.select("doc_id", "line_id").distinct(), ["doc_id", "line_id"], "left_semi")
    found = line_refs.groupBy(*ASSIGNMENT).agg(F.count("*").alias("_lines"))
    all_ = assignments.join(facts, ASSIGNMENT, "left").join(found, ASSIGNMENT, "left").fillna(0, ["_tokens", "_numbers", "_lines"])
    all_ = all_.fillna(False, ["_table", "_counted", "_ranged"])
    identity = counting & F.col("_counted")
    unresolved = ((F.col("_tokens") != F.size("token_ids")) | (F.col("_lines") != F.size("line_ids"))
                  | ((F.col("_lines") == 0) & ~F.col("_table") & ~identity) | (F.col("_numbers") == 0))
    spread = F.col("_high") - F.col("_low") > 1e-6
    stacked = (F.col("_dx") <= F.greatest(F.lit(20.0), F.col("_w") * 0.75)) | (F.col("_dy") <= F.greatest(F.lit(20.0), F.col("_h") * 0.75))
    pick = (F.when(~spread, F.col("_first")).when((F.col("_numbers") == 2) & (F.col("_lines") > 0), F.col("_high"))
            .when((F.col("_numbers") == 3) & (F.col("_lines") > 0) & stacked, F.col("_high")))
    angle = F.col("canonical_name").endswith("_deg")
    unit = (F.when(counting, "count").when(angle, "deg")
            .when((F.col("_u0") == F.col("_u1")) & (F.col("_u0") != "unknown"), F.col("_u0")))
    staged = all_.withColumns({"_pick": pick, "_unit": unit, "_identity": identity, "_missing": unresolved})
    outcome = F.when(F.col("_missing") | F.col("_pick").isNull(), "missing").when(F.col("_unit").isNull(), "unit").otherwise("fused")
    kind = (F.when(F.col("_table"), "table_row").when(F.col("_identity"), "identity_text")
            .when(angle & F.col("_ranged"), "explicit_range").otherwise("dimension_line"))
    staged = staged.withColumn("outcome", outcome)
    done = F.col("outcome") == "fused"
    return staged.select(
        *ASSIGNMENT, "canonical_name", "outcome", F.when(done, F.col("_pick")).alias("value"), F.when(done, F.col("_unit")).alias("unit"),
        F.when(done, kind).alias("evidence_kind"), F.when(done, F.col("ocr_confidence")).alias("ocr_confidence"),
        F.col("confidence").alias("semantic_confidence"), F.concat("token_ids", "line_ids").alias("evidence_ids"), "token_ids", "target_feature")


def fuse_fields(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One parameter per field, and the issues (doc_id, kind, field) of the others.

    A field with one distinct value and unit is fused; else a single table value wins; else it is a conflict.
    The surest assignment speaks for a field, the first of equals. Failed assignments of a fused or
    conflicting field raise no issue.
    """
    key = ["doc_id", "canonical_name"]
    values = settled(values)
    fused = values.where(F.col("outcome") == "fused")
    mark = F.struct(F.round("value", 8).alias("v"), F.col("unit").alias("u"))
    table = F.col("evidence_kind") == "table_row"
    # The groups feed the parameters and the conflicts.
    rank = F.struct("semantic_confidence", (-F.col("assignment_id")).alias("o"))
    row = F.struct("assignment_id", "value", "unit", "evidence_kind", "ocr_confidence", "semantic_confidence", "evidence_ids", "token_ids", "target_feature")
    groups = fused.groupBy(*key).agg(
        F.min(mark).alias("_m0"), F.max(mark).alias("_m1"), F.min(F.when(table, mark)).alias("_t0"), F.max(F.when(table, mark)).alias("_t1"),
        F.max_by(row, rank).alias("_best"), F.max_by(row, F.when(table, rank)).alias("_table"), F.count_if(table).alias("_tables"))
    groups = settled(groups)
    single = F.col("_m0") == F.col("_m1")
    by_table = (F.col("_tables") > 0) & (F.col("_t0") == F.col("_t1"))
    chosen = F.when(single, F.col("_best")).when(by_table, F.col("_table"))
    params = groups.where(single | by_table).select(*key, chosen.alias("_c")).select(*key, "_c.*")
    conflicts = groups.where(~(single | by_table)).select("doc_id", F.lit("conflict").alias("kind"), F.col("canonical_name").alias("field"))
    state = values.groupBy(*key).agg(F.bool_or(F.col("outcome") == "fused").alias("_f"), F.bool_or(F.col("outcome") == "unit").alias("_u"), F.bool_or(F.col("outcome") == "missing").alias("_m"))
    failed = state.where(~F.col("_f")).select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("_u"), "unit"), F.when(F.col("_m"), "missing")))).alias("kind"),
                                              F.col("canonical_name").alias("field"))
    return params, conflicts.unionByName(failed)


def evidence_gate(params: DataFrame, issues: DataFrame, required: DataFrame, features: DataFrame, seen_features: DataFrame, docs: DataFrame,
                  ocr: float = T.OCR_CONFIDENCE, semantic: float = T.SEMANTIC_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Gate findings (doc_id, kind, field) and one verdict row per document.

    required(doc_id, fields ARRAY), features(doc_id, features ARRAY), seen_features(doc_id, feature), issues(doc_id, kind,
    field) with kinds missing, unresolved, conflict and unit. Missing evidence and unresolved fields count
    only where the field is required. Both results read the inputs once; a program that wants both should settle the inputs.
    """
    key, kind = ["doc_id", "field"], F.col("kind")
    floor_of = F.col("evidence_kind")
    floor = F.when(floor_of == "table_row", min(semantic, T.TABLE_CONFIDENCE)).when(floor_of == "explicit_range", min(semantic, T.RANGE_CONFIDENCE)).otherwise(semantic)
    by_hand = F.forall("evidence_ids", lambda e: e.startswith("human_input:")) & (F.size("evidence_ids") > 0)
    exempt = (floor_of == "human_input") | ((floor_of == "derived") & by_hand)
    unsure = ~exempt & ((F.col("ocr_confidence") < ocr) | (F.col("semantic_confidence") < floor))
    named = F.col("doc_id").isNotNull() & F.col("field").isNotNull()  # a null meets nothing
    known = params.select("doc_id", F.col("canonical_name").alias("field"), F.when(unsure, HELD | UNSURE).otherwise(HELD).alias("_b")).unionByName(
        issues.where(kind.isin("missing", "unresolved", "conflict", "unit")).select(*key, F.when(kind.isin("conflict", "unit"), CLASH).otherwise(OPEN).alias("_b")))
    known = known.groupBy(*key).agg(F.bit_or("_b").alias("_b")).where(F.col("_b") != OPEN)

    def has(bit):
        return F.col("_b").bitwiseAND(bit) != 0

    def finding(name, test):
        return F.when(test, F.struct("field", F.lit(name).alias("kind")))
    # Then all of a document meets once: lists of different names, which the vocabulary of fields and features bounds.
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<struct<field:string,kind:string>>")
    feature = F.array(F.concat(F.lit("feature:"), "feature"))
    told = F.array_compact(F.array(finding("conflict", has(CLASH)), finding("low_confidence", has(UNSURE))))
    parts = required.select("doc_id", F.col("fields").alias("_asked"), none.alias("_met"), nothing.alias("_told"), F.lit(0).alias("_held"))
    parts = parts.unionByName(features.select("doc_id", F.transform("features", lambda f: F.concat(F.lit("feature:"), f)).alias("_asked"), none.alias("_met"), nothing.alias("_told"), F.lit(0).alias("_held")))
    parts = parts.unionByName(known.select("doc_id", none.alias("_asked"), F.when(named & has(HELD) & ~has(OPEN), F.array("field")).otherwise(none).alias("_met"), told.alias("_told"),
                                           (has(HELD) & F.col("field").isNotNull()).cast("int").alias("_held")))
    parts = parts.unionByName(seen_features.select("doc_id", none.alias("_asked"), F.when(F.col("doc_id").isNotNull() & F.col("feature").isNotNull(), feature).otherwise(none).alias("_met"),
                                                   nothing.alias("_told"), F.lit(0).alias("_held")))
    whole = parts.groupBy("doc_id").agg(*[F.flatten(F.collect_set(c)).alias(c) for c in ("_asked", "_met", "_told")], F.sum("_held").alias("parameters"))
    absent = F.array_except("_asked", "_met")
    found = F.concat(F.transform(absent, lambda f: F.struct(f.alias("field"), F.lit("missing").alias("kind"))), "_told")
    findings = whole.select("doc_id", F.inline(found))

    def times(name):
        return F.size(F.filter("_told", lambda t: t.kind == name)).cast("long")
    counts = whole.select("doc_id", F.size(absent).cast("long").alias("missing"), *[times(k).alias(k) for k in ("conflict", "low_confidence")], "parameters")
    verdicts = docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["missing", "conflict", "low_confidence", "parameters"])
    passed = (F.col("missing") + F.col("conflict") + F.col("low_confidence")) == 0
    return findings, verdicts.withColumn("passed", passed).withColumn(
        "status", F.when(passed, "dimensions_valid").otherwise("stopped_insufficient_extraction"))


def semantic_collisions(assignments: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """Numeric tokens that two mutually exclusive quantities of one drawing refer to.

    Every token keeps one flag per quantity of the exclusive pairs, so owners are never listed.
    """
    typed = with_dimensions(tokens, "text", F.col("value_role").startswith("table_"), ("nominal", "minimum", "maximum"))
    numbers = typed.where(F.coalesce("nominal", "minimum", "maximum").isNotNull()).select("doc_id", "token_id", "source_region_id")
    families = docs.where(F.col("family_id").isin(*EXCLUSIVE_FAMILIES)).select("doc_id")
    refs = assignments.join(families, "doc_id", "left_semi").select("doc_id", "canonical_name", F.explode("token_ids").alias("token_id"))
    names = sorted({n for pair in EXCLUSIVE for n in pair})
    owned = refs.where(F.col("canonical_name").isin(*names)).groupBy("doc_id", "token_id").agg(
        *[F.bool_or(F.col("canonical_name") == n).alias(n) for n in names])
    pairs = F.array_compact(F.array(*[F.when(F.col(a) & F.col(b), F.struct(F.lit(min(a, b)).alias("first"), F.lit(max(a, b)).alias("second")))
                                      for a, b in EXCLUSIVE]))
    hits = owned.join(numbers, ["doc_id", "token_id"]).select("doc_id", "token_id", "source_region_id", F.explode(pairs).alias("_p"))
    return hits.select("doc_id", "token_id", "source_region_id", "_p.first", "_p.second")


def merge_views(classes: DataFrame, views: DataFrame, assignments: DataFrame, features: DataFrame, unresolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge per-view readings: features and open fields in first-seen order, and the least confidence.

    classes(doc_id, confidence), views(doc_id, view_no, confidence), assignments(doc_id, view_no,
    canonical_name), features and unresolved(doc_id, view_no, pos, name) with view_no -1 for the
    classification. Only views with assignments lower the confidence.
    """
    used = assignments.select("doc_id", "view_no").distinct()
    lowest = classes.select("doc_id", "confidence").unionByName(
        views.join(used, ["doc_id", "view_no"], "left_semi").select("doc_id", "confidence")).groupBy("doc_id").agg(F.min("confidence").alias("confidence"))
    place = F.min(F.struct("view_no", "pos"))
    kept = features.groupBy("doc_id", "name").agg(place.alias("place"))
    done = assignments.select("doc_id", F.col("canonical_name").alias("name")).unionByName(features.select("doc_id", "name")).distinct()
    left = unresolved.join(done, ["doc_id", "name"], "left_anti").groupBy("doc_id", "name").agg(place.alias("place"))
    return lowest, kept, left


def merged_assignments(assignments: DataFrame) -> DataFrame:
    """The assignments of all views of a document in the order of views and places, numbered from 1 as `place`.

    assignments(doc_id, view_no, pos, ...). Views are the buckets, so a document of very many views is numbered in many tasks.
    """
    return ranked(assignments, ["doc_id"], [F.col("view_no"), F.col("pos")], F.col("view_no"), "place")


def first_seen(rows: DataFrame) -> DataFrame:
    """Distinct names of a document with their first place (view_no, pos): what stays of ambiguities."""
    return rows.groupBy("doc_id", "name").agg(F.min(F.struct("view_no", "pos")).alias("place"))


def repair_extraction(original: DataFrame, repair: DataFrame, issue_fields: DataFrame) -> DataFrame:
    """Dimensions after a second reading: only fields at issue are replaced.

    original and repair(doc_id, canonical_name, ...), issue_fields(doc_id, canonical_name).
    """
    key = ["doc_id", "canonical_name"]
    fresh = repair.join(issue_fields.select(*key).distinct(), key, "left_semi")
    return original.join(fresh.select(*key), key, "left_anti").withColumn("repaired", F.lit(False)).unionByName(fresh.withColumn("repaired", F.lit(True)))


def golden_issues(cases: DataFrame, expected: DataFrame, extracted: DataFrame, known_missing: DataFrame, minimum: float = T.SEMANTIC_CONFIDENCE) -> DataFrame:
    """Issues (case_id, field, issue) of extracted dimensions against a golden case.

    cases(case_id, blind_mode), expected(case_id, field, nominal, tolerance), extracted(case_id, field,
    nominal_value, evidence_type, confidence), known_missing(case_id, field). Blind cases check presence only.
    """
    key = ["case_id", "field"]
    rows = expected.join(cases.select("case_id", "blind_mode"), "case_id").join(extracted, key, "left")
    value, known = F.col("nominal_value"), F.col("nominal_value").isNotNull()
    off = ~F.col("blind_mode") & F.col("nominal").isNotNull() & F.col("tolerance").isNotNull() & (F.abs(value - F.col("nominal")) > F.col("tolerance"))
    issues = F.array_compact(F.array(
        F.when(~known, F.lit("missing")), F.when(known & (F.col("evidence_type") == "visual_reference"), F.lit("reference_not_numeric")),
        F.when(known & (F.coalesce("confidence", F.lit(0.0)) < minimum), F.lit("low_confidence")), F.when(known & off, F.lit("conflict"))))
    found = rows.select(*key, F.explode(issues).alias("issue"))
    already = found.where(F.col("issue") == "missing").select(*key)
    extra = known_missing.select(*key).distinct().join(already, key, "left_anti")
    extra = extra.select(*key, F.explode(F.array(F.lit("missing"), F.lit("not_explicitly_dimensioned"))).alias("issue"))
    return found.unionByName(extra).unionByName(known_missing.select(*key).distinct().withColumn("issue", F.lit("unresolved")))


def golden_verdicts(cases: DataFrame, issues: DataFrame, minimum: float = T.SEMANTIC_CONFIDENCE) -> DataFrame:
    """Pass flag of every case; cases(case_id, overall_confidence)."""
    counts = issues.groupBy("case_id").agg(F.count("*").alias("issues"))
    out = cases.select("case_id", "overall_confidence").join(counts, "case_id", "left").fillna(0, ["issues"])
    return out.withColumn("passed", (F.col("issues") == 0) & (F.col("overall_confidence") >= minimum))


def status_rollup(results: DataFrame) -> DataFrame:
    """Cases by status, and in total; cases without a status are a row without one."""
    counts = results.rollup("status").agg(F.count("*").alias("cases"), F.grouping("status").alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, "total").otherwise(F.col("status")).alias("status"), "cases")


def route_gate(decisions: DataFrame, options: DataFrame, top: float = T.ROUTE_PROBABILITY, margin: float = T.ROUTE_MARGIN,
               confidence: float = T.ROUTE_CONFIDENCE) -> DataFrame:
    """Whether a routing answer is valid and sure enough to follow.

    decisions(decision_id, choice, confidence), options(decision_id, name, probability).
    """
    chosen = options.join(decisions.select("decision_id", "choice"), "decision_id")
    sums = chosen.groupBy("decision_id").agg(
        F.sum("probability").alias("_sum"), F.max(F.when(F.col("name") == F.col("choice"), F.col("probability"))).alias("_own"),
        F.max("probability").alias("_max"), F.bool_and(F.col("probability").between(0, 1)).alias("_range"))
    best = top_per_key(options, ["decision_id"], [F.desc("probability"), F.asc("name")], 2, "_k").where(F.col("_k") == 2)
    rows = decisions.join(sums, "decision_id", "left").join(best.select("decision_id", F.col("probability").alias("_second")), "decision_id", "left")
    own, second = F.coalesce("_own", F.lit(0.0)), F.coalesce("_second", F.lit(0.0))
    valid = F.coalesce(F.col("_range") & (F.abs(F.col("_sum") - 1) <= 0.02) & (F.col("_own") == F.col("_max")) & F.col("confidence").between(0, 1), F.lit(False))
    gap = own - second
    auto = (F.col("choice") != "unknown") & (own >= top) & (F.col("confidence") >= confidence) & (gap >= margin)
    return rows.select("decision_id", "choice", own.alias("top_probability"), second.alias("second_probability"), gap.alias("margin"),
                       valid.alias("valid"), auto.alias("auto_route"))


def review_candidate_issues(candidates: DataFrame, assignments: DataFrame, tokens: DataFrame, lines: DataFrame, groups: DataFrame, allowed: DataFrame) -> DataFrame:
    """Issues (doc_id, region_id, assignment_id, issue) of a review answer against what its view was shown.

    candidates(doc_id, region_id, answered_region_id, view_type, answered_view_type), assignments(doc_id,
    region_id, assignment_id, canonical_name, token_ids, line_ids), tokens(doc_id, region_id, token_id, text,
    value_role, source_region_id), lines(doc_id, region_id, line_id, source_region_id), groups(doc_id,
    region_id, dimension_id, evidence_type, member_ids, context_token_ids, value_token_ids, group_line_ids),
    allowed(doc_id, field).
    """
    view = ["doc_id", "region_id"]
    key = [*view, "assignment_id"]

    def flag(df, issue):
        return df.select(*key, F.lit(issue).alias("issue")).distinct()
    whole = candidates.select(*view, F.lit(None).cast("int").alias("assignment_id"), F.explode(F.array_compact(F.array(
        F.when(F.col("answered_region_id") != F.col("region_id"), F.lit("region_mismatch")),
        F.when(F.col("answered_view_type") != F.col("view_type"), F.lit("view_mismatch"))))).alias("issue"))
    outside = assignments.join(allowed.select("doc_id", F.col("field").alias("canonical_name")), ["doc_id", "canonical_name"], "left_anti")
    trefs = assignments.select(*key, "canonical_name", F.explode("token_ids").alias("token_id")).distinct()
    lrefs = assignments.select(*key, F.explode("line_ids").alias("line_id")).distinct()
    in_rows = groups.where(F.col("evidence_type") == "table_row")
    cells = in_rows.select(*view, "dimension_id", F.explode("value_token_ids").alias("token_id"))
    context = groups.select(*view, F.explode("context_token_ids").alias("token_id")).distinct().withColumn("_context", F.lit(True))
    table = cells.select(*view, "token_id").distinct().withColumn("_cell", F.lit(True))
    shown = tokens.join(table, [*view, "token_id"], "left").join(context, [*view, "token_id"], "left").fillna(False, ["_cell", "_context"])
    shown = shown.withColumn("_table", F.col("_cell") | F.col("value_role").startswith("table_"))
    typed = with_dimensions(shown, "text", F.col("_table"), ("nominal", "minimum", "maximum"))
    facts = typed.select(*view, "token_id", "_table", "_context", F.coalesce("nominal", "minimum", "maximum").isNotNull().alias("_numeric"),
                         explicit_count("text").isNotNull().alias("_count"),
                         (~F.coalesce("source_region_id", F.lit("")).isin("", "unassigned") & (F.col("source_region_id") != F.col("region_id"))).alias("_foreign"))
    # The references with what is known of them feed several rules, as do the totals.
    t = settled(trefs.join(facts, [*view, "token_id"], "left"))
    known_lines = lines.select(*view, "line_id", (~F.coalesce("source_region_id", F.lit("")).isin("", "unassigned") & (F.col("source_region_id") != F.col("region_id"))).alias("_foreign"))
    li = settled(lrefs.join(known_lines, [*view, "line_id"], "left"))
    counting = F.col("canonical_name").isin(*COUNT_FIELDS)
    per = t.groupBy(*key, "canonical_name").agg(
        F.count_if("_numeric").alias("_numbers"), F.count_if(F.col("_numeric") & F.col("_table")).alias("_cells"), F.bool_or(counting & F.coalesce("_count", F.lit(False))).alias("_counted"))
    per = settled(assignments.select(*key, F.size("line_ids").alias("_lines")).join(per, key, "left").fillna(0, ["_numbers", "_cells"]).fillna(False, ["_counted"]))
    table_value = (F.col("_numbers") > 0) & (F.col("_cells") == F.col("_numbers"))
    own_count = F.col("_counted") & (F.col("_numbers") == 0)
    rules = per.select(*key, F.explode(F.array_compact(F.array(
        F.when((F.col("_numbers") == 0) & ~F.col("_counted"), F.lit("no_number")),
        F.when((F.col("_lines") == 0) & ~(table_value | own_count), F.lit("line_required")),
        F.when(table_value & (F.col("_cells") != 1), F.lit("more_than_one_cell"))))).alias("issue"))
    # A table value must share one row with every other reference of its assignment.
    single = per.where(table_value).select(*key)
    rows = t.where(F.col("_numeric") & F.col("_table")).join(single, key, "left_semi").join(cells, [*view, "token_id"]).select(*key, "dimension_id").distinct()
    wanted = assignments.select(*key, F.array_distinct(F.concat("token_ids", "line_ids")).alias("_refs"))
    member = in_rows.select(*view, "dimension_id", F.concat("member_ids", "group_line_ids").alias("_members"))
    checked = rows.join(member, [*view, "dimension_id"]).join(wanted, key)
    fits = checked.groupBy(*key).agg(F.bool_or(F.size(F.array_except("_refs", "_members")) == 0).alias("_fits"))
    return (whole.unionByName(flag(outside, "field_outside_contract")).unionByName(flag(t.where(F.col("_numeric").isNull()), "unknown_token"))
            .unionByName(flag(li.where(F.col("_foreign").isNull()), "unknown_line"))
            .unionByName(flag(t.where("_foreign").select(*key).unionByName(li.where("_foreign").select(*key)), "foreign_view"))
            .unionByName(flag(t.where("_context"), "context_token")).unionByName(rules).unionByName(flag(fits.where(~F.col("_fits")), "row_mismatch")))


def assess_extraction(readings: DataFrame, evidence: DataFrame, required: tuple[str, ...], minimum: float = 0.9) -> DataFrame:
    """Issues (doc_id, field, issue) of a reading: value missing, evidence weak or uncertain, unit not millimetres.

    readings(doc_id, unit, values MAP), evidence(doc_id, field, confidence, uncertain); `required` is the short
    list of fields every reading needs.
    """
    slots = readings.select("doc_id", F.explode(F.map_entries("values")).alias("_e")).select("doc_id", F.col("_e.key").alias("field"), F.col("_e.value").alias("value"))
    wanted = readings.select("doc_id", F.explode(F.array(*[F.lit(f) for f in required])).alias("field"))
    rows = wanted.join(slots, ["doc_id", "field"], "left").join(evidence, ["doc_id", "field"], "left")
    issue = F.array_compact(F.array(
        F.when(F.col("value").isNull(), F.lit("missing")),
        F.when(F.col("value").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) < minimum), F.lit("weak")),
        F.when(F.coalesce("uncertain", F.lit(False)), F.lit("uncertain"))))
    units = readings.where(F.col("unit") != "mm").select("doc_id", F.lit("unit").alias("field"), F.lit("unit").alias("issue"))
    return rows.select("doc_id", "field", F.explode(issue).alias("issue")).unionByName(units)


def detect_table_regions(tokens: DataFrame) -> DataFrame:
    """Regions that hold a dimension table, by the words of their headers: limits, key-value labels, pin matrix.

    tokens(doc_id, source_region_id, text).
    """
    raw = F.lower(F.trim("text"))
    word = F.regexp_replace(raw, "[^a-z0-9]+", "")
    # Texts count once, so equal ones are merged before the region totals.
    texts = tokens.groupBy("doc_id", "source_region_id", raw.alias("raw")).agg(F.max(word).alias("w"))
    w, r = F.col("w"), F.col("raw")
    words = texts.groupBy("doc_id", "source_region_id", "w").agg(F.count_if(r.rlike(r"^dimension\s+\S+")).alias("labels"))
    flags = words.groupBy("doc_id", "source_region_id").agg(
        F.bool_or(w.contains("millimet") | w.startswith("miimet") | w.startswith("milimet")).alias("metric"),
        F.bool_or(w.startswith("inch")).alias("inch"), F.bool_or(w == "min").alias("min"), F.bool_or(w.isin("nom", "typ")).alias("nom"),
        F.bool_or(w == "max").alias("max"), F.bool_or(w.contains("dimension")).alias("dimension"), F.bool_or(w == "symbol").alias("symbol"),
        F.bool_or(w.contains("dimensions")).alias("dimensions"), F.sum("labels").alias("labels"), F.count_if(w.rlike(r"\d")).alias("digits"),
        F.bool_or(w.contains("pins")).alias("pins"), F.bool_or(w.isin("dim", "amax", "amin")).alias("matrix"))
    limits = (F.col("metric") | F.col("inch")) & F.col("min") & F.col("nom") & F.col("max") & (F.col("dimension") | F.col("symbol"))
    pairs = F.col("dimensions") & (F.col("labels") >= 2) & (F.col("digits") >= 2)
    matrix = F.col("pins") & F.col("matrix") & (F.col("digits") >= 4)
    return flags.where(limits | pairs | matrix).select("doc_id", "source_region_id", limits.alias("limits"), pairs.alias("key_value"), matrix.alias("matrix"))

