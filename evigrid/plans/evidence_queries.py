"""Evidence, families and gates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..operators import families, fusion
from .registry import query
from .shapes import ctes, frame

N = D.NUMBER


def _frames(spark, sf, *names):
    return [frame(spark, sf, n) for n in names]


# --- assignments ------------------------------------------------------------------------------------------------------
@query("j3_resolved_references", ctes("ev_assignments", "ev_token_rows", "ev_lines") + """, t AS (SELECT doc_id, assignment_id, count(*) AS n FROM (SELECT doc_id, assignment_id, unnest(token_ids) AS token_id FROM ev_assignments) SEMI JOIN ev_token_rows USING (doc_id, token_id) GROUP BY 1, 2),
  l AS (SELECT doc_id, assignment_id, count(*) AS n FROM (SELECT doc_id, assignment_id, unnest(line_ids) AS line_id FROM ev_assignments) SEMI JOIN ev_lines USING (doc_id, line_id) GROUP BY 1, 2)
  SELECT a.doc_id, a.assignment_id, canonical_name, CAST(len(token_ids) AS INT) AS tokens_wanted, CAST(len(line_ids) AS INT) AS lines_wanted, coalesce(t.n, 0) AS token_ids_found, coalesce(l.n, 0) AS line_ids_found,
    coalesce(t.n, 0) = len(token_ids) AND coalesce(l.n, 0) = len(line_ids) AS resolved FROM ev_assignments a LEFT JOIN t USING (doc_id, assignment_id) LEFT JOIN l USING (doc_id, assignment_id)""")
def j3(spark, sf):
    return fusion.resolved_references(*_frames(spark, sf, "ev_assignments", "ev_token_rows", "ev_lines"))


# Texts of the derived tokens: a name, a stated count, millimetres, a range, or one number.
VALUES = ctes("ev_assignments", "ev_token_rows", "ev_lines") + f""", typed AS (SELECT *, CASE WHEN text = 'A1' OR text LIKE '%PINS' OR text = '1.0-2.0' THEN NULL ELSE CAST(regexp_extract(text, '{N}') AS DOUBLE) END AS nominal,
    CASE WHEN text = '1.0-2.0' THEN 1.0 END AS lo, CASE WHEN text = '1.0-2.0' THEN 2.0 END AS hi, CASE WHEN text LIKE '%mm' THEN 'mm' ELSE 'unknown' END AS unit, CASE WHEN text LIKE '%PINS' THEN 8 END AS cnt FROM ev_token_rows),
  refs AS (SELECT doc_id, assignment_id, canonical_name, i AS pos, token_ids[i] AS token_id FROM (SELECT *, unnest(range(1, 1 + len(token_ids))) AS i FROM ev_assignments)),
  r AS (SELECT r.*, t.* EXCLUDE (doc_id, token_id, nominal, unit), CASE WHEN nominal IS NULL AND cnt IS NOT NULL AND canonical_name = 'nominal_pin_count' THEN 8.0 ELSE nominal END AS nominal,
    CASE WHEN nominal IS NULL AND cnt IS NOT NULL AND canonical_name = 'nominal_pin_count' THEN 'count' ELSE unit END AS unit FROM refs r JOIN typed t USING (doc_id, token_id)),
  v AS (SELECT *, coalesce(nominal, hi) AS val FROM r),
  f AS (SELECT doc_id, assignment_id, count(*) AS nt, count(val) AS nn, arg_min(val, pos) FILTER (val IS NOT NULL) AS first, min(val) AS low, max(val) AS high,
    (max(x1 + x2) FILTER (val IS NOT NULL) - min(x1 + x2) FILTER (val IS NOT NULL)) / 2.0 AS dx, (max(y1 + y2) FILTER (val IS NOT NULL) - min(y1 + y2) FILTER (val IS NOT NULL)) / 2.0 AS dy,
    avg(x2 - x1) FILTER (val IS NOT NULL) AS w, avg(y2 - y1) FILTER (val IS NOT NULL) AS h, min(confidence) FILTER (val IS NOT NULL) AS ocr, bool_or(value_role LIKE 'table%') AS tab, bool_or(cnt IS NOT NULL) AS counted,
    min(CASE WHEN nominal IS NOT NULL THEN CASE WHEN unit = 'unknown' THEN unit_context ELSE unit END END) AS u0, max(CASE WHEN nominal IS NOT NULL THEN CASE WHEN unit = 'unknown' THEN unit_context ELSE unit END END) AS u1,
    bool_or(lo IS NOT NULL) AS ranged FROM v GROUP BY 1, 2),
  nl AS (SELECT doc_id, assignment_id, count(*) AS nl FROM (SELECT doc_id, assignment_id, unnest(line_ids) AS line_id FROM ev_assignments) SEMI JOIN ev_lines USING (doc_id, line_id) GROUP BY 1, 2),
  a AS (SELECT s.*, coalesce(nt, 0) AS nt, coalesce(nn, 0) AS nn, first, low, high, dx, dy, w, h, ocr, coalesce(tab, false) AS tab, coalesce(counted, false) AND canonical_name = 'nominal_pin_count' AS ident, u0, u1, coalesce(ranged, false) AS ranged, coalesce(nl, 0) AS nl
    FROM ev_assignments s LEFT JOIN f USING (doc_id, assignment_id) LEFT JOIN nl USING (doc_id, assignment_id)),
  b AS (SELECT *, CASE WHEN NOT (high - low > 1e-6) THEN first WHEN nn = 2 AND nl > 0 THEN high WHEN nn = 3 AND nl > 0 AND (dx <= greatest(20.0, w * 0.75) OR dy <= greatest(20.0, h * 0.75)) THEN high END AS pick,
    CASE WHEN canonical_name = 'nominal_pin_count' THEN 'count' WHEN suffix(canonical_name, '_deg') THEN 'deg' WHEN u0 = u1 AND u0 <> 'unknown' THEN u0 END AS u,
    nt <> len(token_ids) OR nl <> len(line_ids) OR (nl = 0 AND NOT tab AND NOT ident) OR nn = 0 AS bad FROM a),
  vals AS (SELECT doc_id, assignment_id, canonical_name, CASE WHEN bad OR pick IS NULL THEN 'missing' WHEN u IS NULL THEN 'unit' ELSE 'fused' END AS outcome, pick, u, ocr, confidence AS semantic_confidence,
    CASE WHEN tab THEN 'table_row' WHEN ident THEN 'identity_text' WHEN suffix(canonical_name, '_deg') AND ranged THEN 'explicit_range' ELSE 'dimension_line' END AS kind FROM b),
  values_ AS (SELECT doc_id, assignment_id, canonical_name, outcome, CASE WHEN outcome = 'fused' THEN pick END AS value, CASE WHEN outcome = 'fused' THEN u END AS unit, CASE WHEN outcome = 'fused' THEN kind END AS evidence_kind,
    CASE WHEN outcome = 'fused' THEN ocr END AS ocr_confidence, semantic_confidence FROM vals),
  g AS (SELECT doc_id, canonical_name, count(DISTINCT (round(value, 8), unit)) AS nd, count(DISTINCT (round(value, 8), unit)) FILTER (evidence_kind = 'table_row') AS ntab,
    arg_max((assignment_id, value, unit, evidence_kind, ocr_confidence, semantic_confidence), (semantic_confidence, -assignment_id)) AS best,
    arg_max((assignment_id, value, unit, evidence_kind, ocr_confidence, semantic_confidence), (semantic_confidence, -assignment_id)) FILTER (evidence_kind = 'table_row') AS btab FROM values_ WHERE outcome = 'fused' GROUP BY 1, 2),
  fused AS (SELECT doc_id, canonical_name, CASE WHEN nd = 1 THEN best ELSE btab END AS c FROM g WHERE nd = 1 OR ntab = 1),
  params AS (SELECT doc_id, canonical_name, c[1] AS assignment_id, c[2] AS value, c[3] AS unit, c[4] AS evidence_kind, c[5] AS ocr_confidence, c[6] AS semantic_confidence FROM fused),
  issues AS (SELECT doc_id, 'conflict' AS kind, canonical_name AS field FROM g WHERE NOT (nd = 1 OR ntab = 1)
    UNION ALL SELECT DISTINCT doc_id, CASE outcome WHEN 'unit' THEN 'unit' ELSE 'missing' END, canonical_name FROM values_ v WHERE outcome <> 'fused' AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = v.doc_id AND g.canonical_name = v.canonical_name))"""


def _values(spark, sf):
    return fusion.assignment_values(*_frames(spark, sf, "ev_assignments", "ev_token_rows", "ev_lines"))


@query("a10_assignment_values", VALUES + " SELECT * FROM values_")
def a10(spark, sf):
    return _values(spark, sf).drop("evidence_ids", "token_ids", "target_feature")


@query("a9_fused_parameters", VALUES + " SELECT * FROM params")
def a9(spark, sf):
    return fusion.fuse_fields(_values(spark, sf))[0].drop("evidence_ids", "token_ids", "target_feature")


@query("a9_fusion_issues", VALUES + " SELECT * FROM issues")
def a9_issues(spark, sf):
    return fusion.fuse_fields(_values(spark, sf))[1]


def rows_of(table: dict, name: str, column: str) -> str:
    cells = ", ".join(f"('{f}', '{n}')" for f, names in table.items() for n in names)
    return f"{name}(family_id, {column}) AS (VALUES {cells})"


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


REQ = f""", {rows_of(families.REQUIRED, 'req', 'field')}, {rows_of(families.FEATURES, 'feat', 'feature')},
  seen AS (SELECT doc_id, max(value) FILTER (canonical_name = 'nominal_pin_count') AS n, bool_or(canonical_name IN ({quoted(families.ROWS)})) AS r, bool_or(canonical_name IN ({quoted(families.ROW_WIDTHS)})) AS w,
    bool_or(canonical_name IN ({quoted(families.ROW_LENGTHS)})) AS l, bool_or(canonical_name IN ({quoted(families.ROW_THICKNESSES)})) AS t FROM @params GROUP BY 1),
  gl AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(r, false) AS r, coalesce(w, false) AS w, coalesce(l, false) AS l, coalesce(t, false) AS t, regexp_matches(trim(package_type), '{families.SOT_NAME}') AS sot
    FROM @docs d LEFT JOIN seen USING (doc_id) WHERE family_id = 'ic/gullwing_ic'),
  need AS (SELECT doc_id, field FROM @docs JOIN req USING (family_id) UNION SELECT doc_id, unnest([{quoted(families.ROWS)}]) FROM gl WHERE sot OR r OR w OR l OR t OR (n >= 3 AND n = floor(n) AND n % 2 <> 0)
    UNION SELECT doc_id, unnest([{quoted(families.ROW_WIDTHS)}]) FROM gl WHERE sot OR w OR l OR t UNION SELECT doc_id, unnest([{quoted(families.ROW_LENGTHS)}]) FROM gl WHERE l UNION SELECT doc_id, unnest([{quoted(families.ROW_THICKNESSES)}]) FROM gl WHERE t)"""


def requirements(params: str, docs: str) -> str:
    return REQ.replace("@params", params).replace("@docs", docs)


GATE = VALUES + ctes("ev_docs", "ev_features", "ev_unresolved").replace("WITH", ",", 1) + requirements("params", "ev_docs") + """,
  every AS (SELECT * FROM issues UNION ALL SELECT * FROM ev_unresolved),
  findings AS (SELECT doc_id, field, 'missing' AS kind FROM (SELECT doc_id, field FROM need EXCEPT SELECT doc_id, canonical_name FROM params)
    UNION SELECT doc_id, field, 'missing' FROM every SEMI JOIN need USING (doc_id, field) WHERE kind IN ('missing', 'unresolved')
    UNION SELECT doc_id, 'feature:' || feature, 'missing' FROM (SELECT doc_id, feature FROM ev_docs JOIN feat USING (family_id)) ANTI JOIN ev_features USING (doc_id, feature)
    UNION SELECT doc_id, field, 'conflict' FROM every WHERE kind IN ('conflict', 'unit')
    UNION SELECT doc_id, canonical_name, 'low_confidence' FROM params WHERE ocr_confidence < 0.80 OR semantic_confidence < CASE evidence_kind WHEN 'table_row' THEN 0.80 WHEN 'explicit_range' THEN 0.75 ELSE 0.85 END)"""


def _gate(spark, sf):
    params, issues = fusion.fuse_fields(_values(spark, sf))
    docs, features, open_ = _frames(spark, sf, "ev_docs", "ev_features", "ev_unresolved")
    wanted = docs.join(F.broadcast(families.contract_lists(spark, "feature")), "family_id").select("doc_id", F.col("names").alias("features"))
    return fusion.evidence_gate(params, issues.unionByName(open_), families.gate_requirements(params, docs), wanted, features, docs)


@query("a11_gate_findings", GATE + " SELECT * FROM findings")
def a11_findings(spark, sf):
    return _gate(spark, sf)[0]


@query("a11_gate_verdicts", GATE + """, c AS (SELECT doc_id, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'conflict') AS conflict, count(*) FILTER (kind = 'low_confidence') AS low_confidence FROM findings GROUP BY 1),
  z AS (SELECT doc_id, count(*) AS parameters FROM params GROUP BY 1)
  SELECT d.doc_id, coalesce(missing, 0) AS missing, coalesce(conflict, 0) AS conflict, coalesce(low_confidence, 0) AS low_confidence, coalesce(parameters, 0) AS parameters,
    coalesce(missing, 0) + coalesce(conflict, 0) + coalesce(low_confidence, 0) = 0 AS passed, CASE WHEN coalesce(missing, 0) + coalesce(conflict, 0) + coalesce(low_confidence, 0) = 0 THEN 'dimensions_valid' ELSE 'stopped_insufficient_extraction' END AS status
  FROM ev_docs d LEFT JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)""")
def a11_verdicts(spark, sf):
    return _gate(spark, sf)[1]


PAIRS = " OR ".join(f"(a = '{min(p)}' AND b = '{max(p)}')" for p in fusion.EXCLUSIVE)


@query("a13_semantic_collisions", ctes("ev_assignments", "ev_token_rows", "ev_docs") + f""", o AS (SELECT DISTINCT doc_id, canonical_name, unnest(token_ids) AS token_id FROM ev_assignments),
  n AS (SELECT doc_id, token_id, source_region_id FROM ev_token_rows WHERE NOT (text = 'A1' OR text LIKE '%PINS'))
  SELECT x.doc_id, x.token_id, source_region_id, x.canonical_name AS first, y.canonical_name AS second FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.token_id = y.token_id
  JOIN n ON n.doc_id = x.doc_id AND n.token_id = x.token_id JOIN ev_docs d ON d.doc_id = x.doc_id WHERE family_id IN ('ic/gullwing_ic', 'ic/quad_gullwing_ic') AND ({PAIRS.replace('a = ', 'x.canonical_name = ').replace('b = ', 'y.canonical_name = ')})""")
def a13(spark, sf):
    return fusion.semantic_collisions(*_frames(spark, sf, "ev_assignments", "ev_token_rows", "ev_docs"))


# --- views, repairs, golden cases ----------------------------------------------------------------------------------------
def _views(spark, sf):
    return fusion.merge_views(*_frames(spark, sf, "view_classes", "view_confidences", "view_assignments", "view_features", "view_unresolved"))


@query("a14_view_confidence", ctes("view_classes", "view_confidences", "view_assignments") + """ SELECT doc_id, min(confidence) AS confidence FROM (SELECT * FROM view_classes UNION ALL
    SELECT doc_id, confidence FROM view_confidences SEMI JOIN view_assignments USING (doc_id, view_no)) GROUP BY 1""")
def a14(spark, sf):
    return _views(spark, sf)[0]


# The first view that names it, then the first place there; a place can be above a million
FIRST_SEEN = """ SELECT doc_id, name, CAST(first.view_no * 1000000 + first.pos AS BIGINT) AS place
    FROM (SELECT doc_id, name, min({{'view_no': view_no, 'pos': pos}}) AS first FROM {} GROUP BY 1, 2)"""


@query("a14_view_features", ctes("view_features") + FIRST_SEEN.format("view_features"))
def a14_features(spark, sf):
    return _views(spark, sf)[1].select("doc_id", "name", (F.col("place.view_no") * 1000000 + F.col("place.pos")).cast("bigint").alias("place"))


@query("a14_merged_assignments", ctes("placed_assignments") + " SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY view_no, pos) AS place FROM placed_assignments")
def a14_assignments(spark, sf):
    return fusion.merged_assignments(frame(spark, sf, "placed_assignments"))


@query("a14_ambiguities", ctes("view_unresolved") + FIRST_SEEN.format("view_unresolved"))
def a14_ambiguities(spark, sf):
    return fusion.first_seen(frame(spark, sf, "view_unresolved")).select("doc_id", "name", (F.col("place.view_no") * 1000000 + F.col("place.pos")).cast("bigint").alias("place"))


@query("a14_open_fields", ctes("view_assignments", "view_features", "view_unresolved") + """ SELECT DISTINCT doc_id, name FROM view_unresolved u
  WHERE NOT EXISTS (SELECT 1 FROM view_assignments a WHERE a.doc_id = u.doc_id AND a.canonical_name = u.name) AND NOT EXISTS (SELECT 1 FROM view_features f WHERE f.doc_id = u.doc_id AND f.name = u.name)""")
def a14_open(spark, sf):
    return _views(spark, sf)[2].select("doc_id", "name")


@query("j14_repaired_extraction", ctes("first_reading", "second_reading", "reading_issues") + """, fresh AS (SELECT * FROM second_reading SEMI JOIN reading_issues USING (doc_id, canonical_name))
  SELECT *, false AS repaired FROM first_reading ANTI JOIN fresh USING (doc_id, canonical_name) UNION ALL SELECT *, true FROM fresh""")
def j14(spark, sf):
    return fusion.repair_extraction(*_frames(spark, sf, "first_reading", "second_reading", "reading_issues"))


GOLDEN = ctes("golden_cases", "golden_expected", "golden_extracted", "golden_missing") + """, j AS (SELECT e.*, x.nominal_value, x.evidence_type, x.confidence, blind_mode FROM golden_expected e JOIN golden_cases USING (case_id) LEFT JOIN golden_extracted x USING (case_id, field)),
  f AS (SELECT case_id, field, 'missing' AS issue FROM j WHERE nominal_value IS NULL UNION ALL SELECT case_id, field, 'reference_not_numeric' FROM j WHERE nominal_value IS NOT NULL AND evidence_type = 'visual_reference'
    UNION ALL SELECT case_id, field, 'low_confidence' FROM j WHERE nominal_value IS NOT NULL AND confidence < 0.85
    UNION ALL SELECT case_id, field, 'conflict' FROM j WHERE nominal_value IS NOT NULL AND NOT blind_mode AND abs(nominal_value - nominal) > tolerance),
  issues AS (SELECT * FROM f UNION ALL SELECT case_id, field, unnest(['missing', 'not_explicitly_dimensioned']) FROM golden_missing ANTI JOIN (SELECT * FROM f WHERE issue = 'missing') USING (case_id, field)
    UNION ALL SELECT case_id, field, 'unresolved' FROM golden_missing)"""


def _golden(spark, sf):
    return fusion.golden_issues(*_frames(spark, sf, "golden_cases", "golden_expected", "golden_extracted", "golden_missing"))


@query("j10_golden_issues", GOLDEN + " SELECT * FROM issues")
def j10(spark, sf):
    return _golden(spark, sf)


@query("j10_golden_verdicts", GOLDEN + """, n AS (SELECT case_id, count(*) AS issues FROM issues GROUP BY 1)
  SELECT case_id, overall_confidence, coalesce(issues, 0) AS issues, coalesce(issues, 0) = 0 AND overall_confidence >= 0.85 AS passed FROM golden_cases LEFT JOIN n USING (case_id)""")
def j10_verdicts(spark, sf):
    return fusion.golden_verdicts(frame(spark, sf, "golden_cases"), _golden(spark, sf))


@query("a12_status_rollup", ctes("symbol_jobs") + " SELECT status, count(*) AS cases FROM symbol_jobs GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM symbol_jobs")
def a12(spark, sf):
    return fusion.status_rollup(frame(spark, sf, "symbol_jobs").select("status"))


@query("a17_table_regions", ctes("header_tokens") + """, t AS (SELECT DISTINCT doc_id, source_region_id, lower(trim(text)) AS raw, regexp_replace(lower(trim(text)), '[^a-z0-9]+', '', 'g') AS w FROM header_tokens),
  f AS (SELECT doc_id, source_region_id, bool_or(contains(w, 'millimet') OR w LIKE 'miimet%' OR w LIKE 'milimet%' OR w LIKE 'inch%') AS u, bool_or(w = 'min') AND bool_or(w IN ('nom', 'typ')) AND bool_or(w = 'max') AS lim,
    bool_or(contains(w, 'dimension') OR w = 'symbol') AS h, bool_or(contains(w, 'dimensions')) AS dims, count(*) FILTER (regexp_matches(raw, '^dimension\\s+\\S+')) AS labels, count(DISTINCT w) FILTER (regexp_matches(w, '\\d')) AS digits,
    bool_or(contains(w, 'pins')) AS pins, bool_or(w IN ('dim', 'amax', 'amin')) AS m FROM t GROUP BY 1, 2),
  k AS (SELECT doc_id, source_region_id, u AND lim AND h AS limits, dims AND labels >= 2 AND digits >= 2 AS key_value, pins AND m AND digits >= 4 AS matrix FROM f) SELECT * FROM k WHERE limits OR key_value OR matrix""")
def a17(spark, sf):
    return fusion.detect_table_regions(frame(spark, sf, "header_tokens"))


@query("a19_route_gate", ctes("decisions", "decision_options") + """, o AS (SELECT decision_id, d.choice, d.confidence, max(probability) FILTER (name = choice) AS own, max(probability) AS mx, list_sort(list(probability), 'DESC')[2] AS second,
    sum(probability) AS s FROM decision_options JOIN decisions d USING (decision_id) GROUP BY 1, 2, 3)
  SELECT decision_id, choice, round(own, 6) AS top_probability, round(second, 6) AS second_probability, round(own - second, 6) AS margin, abs(s - 1) <= 0.02 AND own = mx AS valid,
    choice <> 'unknown' AND own >= 0.70 AND confidence >= 0.60 AND own - second >= 0.20 AS auto_route FROM o""")
def a19(spark, sf):
    out = fusion.route_gate(*_frames(spark, sf, "decisions", "decision_options"))
    return out.withColumns({c: F.round(c, 6) for c in ("top_probability", "second_probability", "margin")})


@query("a27_extraction_assessment", ctes("read_values", "read_evidence", "required_slots") + """, s AS (SELECT doc_id, field, CASE field WHEN 'body_x' THEN values['body_x'] WHEN 'pitch' THEN values['pitch'] END AS v FROM read_values CROSS JOIN required_slots),
  j AS (SELECT s.*, confidence, uncertain FROM s LEFT JOIN read_evidence USING (doc_id, field))
  SELECT doc_id, field, 'missing' AS issue FROM j WHERE v IS NULL UNION ALL SELECT doc_id, field, 'weak' FROM j WHERE v IS NOT NULL AND coalesce(confidence, 0) < 0.9 UNION ALL SELECT doc_id, field, 'uncertain' FROM j WHERE uncertain
  UNION ALL SELECT doc_id, 'unit', 'unit' FROM read_values WHERE unit <> 'mm'""")
def a27(spark, sf):
    return fusion.assess_extraction(*_frames(spark, sf, "read_values", "read_evidence"), ("body_x", "pitch", "pad_count"))


# --- families ------------------------------------------------------------------------------------------------------------
WIDE = "w AS (SELECT doc_id, family_id, " + ", ".join(
    f"max(value) FILTER (canonical_name = '{n}') AS {n}" for n in families.PARAMETERS) + " FROM params GROUP BY 1, 2)"
PARAMS = ctes("params", "family_docs") + ", " + WIDE


@query("v2_chain_conflicts", PARAMS + " " + " UNION ALL ".join(
    f"SELECT doc_id, family_id, '{code}' AS conflict FROM w WHERE {families._needs(f, needed)} AND ({cond})" for f, code, needed, cond in families.CHAIN_RULES))
def v2(spark, sf):
    return families.chain_conflicts(frame(spark, sf, "params"))


@query("v2_checked_relations", PARAMS + " SELECT doc_id, family_id, " + " + ".join(
    f"CASE WHEN {families._needs(f, needed)} THEN {n} ELSE 0 END" for f, needed, n in families.CHECKED) + " AS checked FROM w")
def v2_checked(spark, sf):
    return families.checked_relations(frame(spark, sf, "params"))


DERIVED = PARAMS + f""", b AS (SELECT w.*, regexp_matches(package_type, '{families.SOT_NAME}') AS is_sot FROM w LEFT JOIN family_docs USING (doc_id, family_id)),
  t AS (SELECT doc_id, family_id, array_to_string(raw_texts, ' ') AS t FROM params WHERE family_id = 'ic/qfn_ufqfpn' AND canonical_name = 'nominal_pin_count'),
  derived AS (""" + " UNION ALL ".join(
    f"""SELECT doc_id, family_id, '{name}' AS canonical_name, CAST({value} AS DOUBLE) AS value, '{unit}' AS unit, '{formula}' AS formula, [{quoted(sources)}] AS sources FROM b
    WHERE family_id = '{family}' AND {name} IS NULL AND {' AND '.join(f'{s} IS NOT NULL' for s in sources if not (formula.startswith('mean(') and s.startswith('overall_')))} AND ({guard})"""
    for family, name, unit, formula, sources, guard, value in families.DERIVATIONS) + "".join(
    f""" UNION ALL SELECT doc_id, family_id, '{name}', TRY_CAST(regexp_extract(t, '{pattern}', {g}) AS DOUBLE), 'mm', '{formula}', ['nominal_pin_count'] FROM t JOIN w USING (doc_id, family_id)
    WHERE regexp_matches(t, '{pattern}') AND {name} IS NULL"""
    for name, pattern, g, formula in (("body_length", families.TITLE_SIZE, 1, "package_title_length"), ("body_width", families.TITLE_SIZE, 2, "package_title_width"),
                                      ("terminal_pitch", families.TITLE_PITCH, 1, "package_title_pitch"))) + ")"


@query("v3_derived_parameters", DERIVED + """, s AS (SELECT d.doc_id, d.family_id, d.canonical_name, d.value, d.unit, i AS pos, sources[i] AS src FROM (SELECT *, unnest(range(1, 1 + len(sources))) AS i FROM derived) d),
  j AS (SELECT s.doc_id, s.family_id, s.canonical_name, any_value(s.value) AS value, any_value(s.unit) AS unit, coalesce(min(ocr_confidence) FILTER (evidence_kind <> 'human_input'), 0) AS ocr_confidence,
    coalesce(min(semantic_confidence) FILTER (evidence_kind <> 'human_input'), 0) AS semantic_confidence, string_agg(token_ids[1], '|' ORDER BY pos) AS tokens
    FROM s JOIN params p ON p.doc_id = s.doc_id AND p.canonical_name = s.src GROUP BY 1, 2, 3)
  SELECT doc_id, family_id, canonical_name, round(value, 6) AS value, unit, ocr_confidence, semantic_confidence, tokens FROM j""")
def v3(spark, sf):
    out = families.derive_parameters(*_frames(spark, sf, "params", "family_docs")).where("evidence_kind = 'derived'")
    return out.select("doc_id", "family_id", "canonical_name", F.round("value", 6).alias("value"), "unit", "ocr_confidence", "semantic_confidence",
                      F.array_join("token_ids", "|").alias("tokens"))


@query("v4_row_layout_issues", ctes("layouts") + f", w AS (SELECT * FROM layouts) SELECT doc_id, coalesce({families._first(families.ROW_LAYOUT_RULES)}, {families._first(families.WIDTH_RULES)}) AS issue FROM w")
def v4(spark, sf):
    return families.row_layout_issues(frame(spark, sf, "layouts")).select("doc_id", "issue")


@query("v4_row_positions", ctes("layouts") + f""", v AS (SELECT * FROM layouts WHERE coalesce({families._first(families.ROW_LAYOUT_RULES)}, {families._first(families.WIDTH_RULES)}) IS NULL),
  r AS (SELECT doc_id, -1 AS side, CAST(coalesce(negative_side_pin_count, floor(nominal_pin_count / 2)) AS INT) AS n, CASE WHEN negative_side_pin_count IS NOT NULL THEN negative_side_pin_span ELSE (floor(nominal_pin_count / 2) - 1) * terminal_pitch END AS s FROM v
    UNION ALL SELECT doc_id, 1, CAST(coalesce(positive_side_pin_count, floor(nominal_pin_count / 2)) AS INT), CASE WHEN positive_side_pin_count IS NOT NULL THEN positive_side_pin_span ELSE (floor(nominal_pin_count / 2) - 1) * terminal_pitch END FROM v)
  SELECT doc_id, side, CAST(i AS INT) AS i, round(CASE WHEN n = 1 THEN 0 ELSE -s / 2 + i * s / (n - 1) END, 6) AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM r)""")
def v4_positions(spark, sf):
    return families.row_positions(frame(spark, sf, "layouts")).withColumn("x", F.round("x", 6))


LOC = ", ".join(f"('{f}', '{c}', {'NULL' if s is None else repr(s)})" for f, (c, s) in families.LOCATIONS.items())
ALIAS = ", ".join(f"('{a}', '{f}')" for a, f in families.ALIASES.items())


@query("v9_resolved_families", ctes("family_selections") + f""", loc(f, c, s) AS (VALUES {LOC}), al(a, f) AS (VALUES {ALIAS}),
  n AS (SELECT doc_id, trim(family_id) AS raw, lower(trim(category_id)) AS cat, nullif(lower(trim(subcategory_id)), '') AS sub, identity_text AS t FROM family_selections),
  k AS (SELECT *, cat = 'resistor' OR regexp_matches(t, '{families.RESISTOR_WORDS}') AS r, cat = 'capacitor' OR regexp_matches(t, '{families.CAPACITOR_WORDS}') AS p FROM n),
  g AS (SELECT k.*, CASE WHEN raw = 'two_terminal_chip' THEN CASE WHEN r AND NOT p THEN 'resistor/two_terminal_chip' WHEN p AND NOT r THEN 'capacitor/two_terminal_chip' END ELSE coalesce(al.f, raw) END AS fam FROM k LEFT JOIN al ON al.a = raw),
  h AS (SELECT g.*, loc.c AS fc, loc.s AS fs FROM g LEFT JOIN loc ON loc.f = fam),
  st AS (SELECT *, CASE WHEN fam IS NULL THEN 'needs_human_follow_up' WHEN fam <> '' AND fc IS NULL THEN 'stopped_unsupported_template' WHEN fam <> '' AND cat <> '' AND cat <> fc THEN 'invalid_hierarchy'
    WHEN fam <> '' AND sub IS NOT NULL AND sub IS DISTINCT FROM fs THEN 'invalid_hierarchy' WHEN fam <> '' THEN 'resolved' WHEN cat NOT IN ({quoted(families.CATEGORIES)}) THEN 'stopped_unsupported_template'
    WHEN cat = 'connector' AND coalesce(sub NOT IN ('cn', 'mt'), true) THEN 'needs_human_follow_up' ELSE 'stopped_unsupported_template' END AS status FROM h)
  SELECT doc_id, status, CASE WHEN status = 'resolved' THEN fam ELSE '' END AS family_id, CASE WHEN status = 'resolved' OR (status = 'invalid_hierarchy' AND (cat = '' OR cat = fc)) THEN fc ELSE cat END AS category_id,
    CASE WHEN status = 'resolved' THEN fs WHEN fam = '' AND cat = 'connector' AND coalesce(sub NOT IN ('cn', 'mt'), true) THEN NULL ELSE sub END AS subcategory_id FROM st""")
def v9(spark, sf):
    return families.resolve_family(frame(spark, sf, "family_selections"))


SIGNATURE = ctes("class_tokens") + f""", s AS (SELECT doc_id, ord, text, lag(text) OVER w AS b1, lag(text, 2) OVER w AS b2 FROM class_tokens WHERE confidence >= 0.80 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  r AS (SELECT *, concat_ws(' ' || chr(10) || ' ', b2, b1, text) AS run, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS sym FROM s),
  g AS (SELECT doc_id, bool_or(regexp_matches(run, '{families.QFN_WORDS}')) AS qn, bool_or(regexp_matches(run, '{families.QUAD_WORDS}')) AS quad, bool_or(regexp_matches(run, '{families.GULLWING_WORDS}')) AS gullwing,
    max(list_max([CAST(x AS INT) for x in regexp_extract_all(run, '{families.COUNT_WORDS}', 1)])) AS largest_count, bool_or(regexp_matches(run, '{families.RESISTOR_WORDS}')) AS resistor, bool_or(regexp_matches(run, '{families.CAPACITOR_WORDS}')) AS capacitor,
    bool_or(sym = 'D2') AND bool_or(sym = 'E2') AND count(DISTINCT sym) FILTER (sym IN ('A3', 'B', 'L', 'L2')) >= 2 AS sy FROM r GROUP BY 1),
  sig AS (SELECT doc_id, qn OR sy AS qfn, quad, gullwing, largest_count, resistor, capacitor FROM g)"""


def _signature(spark, sf):
    return families.text_signature(frame(spark, sf, "class_tokens"), F.floor(F.col("ord") / 4096))


@query("v10_text_signatures", SIGNATURE + " SELECT * FROM sig")
def v10_signature(spark, sf):
    return _signature(spark, sf)


@query("v10_reconciled_families", SIGNATURE + ctes("classes").replace("WITH", ",", 1) + """, j AS (SELECT c.*, coalesce(qfn, false) AS qfn, coalesce(quad, false) AS quad, coalesce(gullwing, false) AS gullwing, coalesce(largest_count, 0) AS lc, coalesce(resistor, false) AS r, coalesce(capacitor, false) AS p
    FROM classes c LEFT JOIN sig USING (doc_id)),
  k AS (SELECT *, family_id = 'two_terminal_chip' AND lc > 2 AS many, CASE family_id WHEN 'two_terminal_chip' THEN CASE WHEN (category_id = 'resistor' OR r) AND NOT p THEN 'resistor/two_terminal_chip' WHEN p AND NOT (category_id = 'resistor' OR r) THEN 'capacitor/two_terminal_chip' END
    WHEN 'gullwing_ic' THEN 'ic/gullwing_ic' ELSE family_id END AS fam FROM j),
  l AS (SELECT *, CASE WHEN fam LIKE 'resistor%' THEN 'resistor' WHEN fam LIKE 'capacitor%' THEN 'capacitor' WHEN fam <> '' THEN 'ic' END AS fc FROM k),
  o AS (SELECT *, CASE WHEN qfn THEN 'qfn_text' WHEN quad THEN 'quad_text' WHEN many AND gullwing THEN 'gullwing_text' WHEN many THEN 'terminal_conflict' WHEN fam IS NULL THEN 'needs_human_follow_up'
    WHEN fam = '' THEN 'stopped_unsupported_template' WHEN category_id <> '' AND category_id <> fc THEN 'invalid_hierarchy' ELSE 'resolved' END AS outcome FROM l)
  SELECT doc_id, outcome, CASE outcome WHEN 'qfn_text' THEN 'ic/qfn_ufqfpn' WHEN 'quad_text' THEN 'ic/quad_gullwing_ic' WHEN 'gullwing_text' THEN 'ic/gullwing_ic' WHEN 'resolved' THEN fam ELSE '' END AS family_id,
    CASE WHEN outcome IN ('qfn_text', 'quad_text', 'gullwing_text') THEN 'ic' WHEN outcome = 'resolved' THEN fc ELSE category_id END AS category_id,
    CASE WHEN outcome IN ('qfn_text', 'quad_text') THEN least(overall_confidence, 0.95) WHEN outcome = 'gullwing_text' THEN least(overall_confidence, 0.90) WHEN outcome = 'resolved' THEN overall_confidence ELSE 0 END AS overall_confidence FROM o""")
def v10(spark, sf):
    return families.reconcile_family(frame(spark, sf, "classes"), _signature(spark, sf))


@query("v12_overridden_parameters", PARAMS + ctes("operator_values").replace("WITH", ",", 1) + """ SELECT doc_id, canonical_name, value, evidence_kind FROM params ANTI JOIN operator_values USING (doc_id, canonical_name)
  UNION ALL SELECT doc_id, canonical_name, value, 'human_input' FROM operator_values""")
def v12(spark, sf):
    out = families.override_parameters(*_frames(spark, sf, "params", "operator_values", "family_docs"))[0]
    return out.where("evidence_kind <> 'derived'").select("doc_id", "canonical_name", "value", "evidence_kind")


@query("v12_superseded_parameters", PARAMS + ctes("operator_values").replace("WITH", ",", 1) + " SELECT doc_id, canonical_name, value FROM params SEMI JOIN operator_values USING (doc_id, canonical_name)")
def v12_superseded(spark, sf):
    return families.override_parameters(*_frames(spark, sf, "params", "operator_values", "family_docs"))[1].select("doc_id", "canonical_name", "value")


PLAN = PARAMS + f""", {rows_of(families.REQUIRED, 'req', 'canonical_name')}, s AS (SELECT d.doc_id, d.family_id, canonical_name FROM family_docs d JOIN req USING (family_id)),
  j AS (SELECT s.*, p.value, p.unit, p.evidence_kind, p.has_boxes, p.doc_id IS NOT NULL AS known FROM s LEFT JOIN params p ON p.doc_id = s.doc_id AND p.canonical_name = s.canonical_name),
  issues AS (SELECT doc_id, family_id, canonical_name, 'missing' AS issue FROM j WHERE NOT known UNION ALL SELECT doc_id, family_id, canonical_name, 'untraceable' FROM j WHERE known AND NOT (has_boxes OR evidence_kind = 'human_input')
    UNION ALL SELECT doc_id, family_id, canonical_name, 'unit' FROM j WHERE known AND unit <> CASE WHEN canonical_name IN ('nominal_pin_count', 'circuit_count') THEN 'count' ELSE 'mm' END
    UNION ALL SELECT doc_id, family_id, canonical_name, 'count' FROM j WHERE known AND canonical_name = 'nominal_pin_count' AND ((family_id IN ('ic/quad_gullwing_ic', 'ic/qfn_ufqfpn') AND (value < 4 OR value % 4 <> 0)) OR (family_id = 'ic/gullwing_ic' AND value < 3))
    UNION ALL SELECT doc_id, family_id, canonical_name, 'not_positive' FROM j WHERE known AND family_id NOT LIKE 'connector%' AND value <= 0 AND NOT (canonical_name = 'body_standoff' AND family_id LIKE '%gullwing%' AND value = 0))"""


@query("v20_plan_issues", PLAN + " SELECT * FROM issues")
def v20(spark, sf):
    return families.plan_issues(*_frames(spark, sf, "params", "family_docs"))


@query("v20_expected_geometry", PLAN + """, g AS (SELECT w.* FROM w SEMI JOIN family_docs USING (doc_id, family_id) WHERE doc_id NOT IN (SELECT doc_id FROM issues)),
  k AS (SELECT *, CASE WHEN family_id LIKE '%gullwing%' THEN nominal_pin_count + 1 WHEN family_id = 'ic/qfn_ufqfpn' THEN nominal_pin_count + 1 + CASE WHEN exposed_pad_length IS NOT NULL AND exposed_pad_width IS NOT NULL THEN 1 ELSE 0 END END AS ex FROM g),
  l AS (SELECT *, CASE WHEN family_id LIKE 'resistor%' THEN 3 WHEN family_id LIKE 'connector%' THEN circuit_count + 7 ELSE ex END AS ms,
    CASE WHEN family_id = 'ic/quad_gullwing_ic' THEN overall_length WHEN family_id LIKE 'connector%' THEN overall_width ELSE body_length END / 2 AS hx, CASE WHEN family_id LIKE '%gullwing%' THEN overall_width ELSE body_width END / 2 AS hy FROM k)
  SELECT doc_id, family_id, CAST(ex AS INT) AS solid_count, CAST(ms AS INT) AS minimum_solid_count, CAST(CASE WHEN family_id LIKE 'resistor%' THEN 18 WHEN family_id LIKE 'connector%' THEN 50 WHEN family_id = 'ic/qfn_ufqfpn' THEN ms * 6 ELSE ms * 4 END AS INT) AS minimum_face_count,
    -hx AS xmin, hx AS xmax, CASE WHEN family_id LIKE 'connector%' THEN -front_projection_depth ELSE -hy END AS ymin, CASE WHEN family_id LIKE 'connector%' THEN rear_body_depth ELSE hy END AS ymax, CAST(0 AS DOUBLE) AS zmin,
    CASE WHEN family_id LIKE 'resistor%' THEN body_height WHEN family_id LIKE 'connector%' THEN overall_height WHEN family_id = 'ic/quad_gullwing_ic' THEN housing_height + body_standoff ELSE total_height END AS zmax FROM l""")
def v20_geometry(spark, sf):
    return families.expected_geometry(*_frames(spark, sf, "params", "family_docs"))


def _view_case(groups: dict) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(view_type), '{k}') THEN [{quoted(v)}]" for k, v in groups.items()) + " END"


@query("f8_view_fields", ctes("view_rows") + f""", {rows_of(families.REQUIRED, 'req', 'field')}, {rows_of(families.OPTIONAL, 'opt', 'field')}, con AS (SELECT *, 'required' AS kind FROM req UNION ALL SELECT *, 'optional' FROM opt),
  v AS (SELECT *, CASE WHEN contains(lower(view_type), 'dimension_table') THEN NULL WHEN family_id = 'ic/gullwing_ic' THEN {_view_case(families.GULLWING_VIEWS)} ELSE {_view_case(families.COMMON_VIEWS)} END AS f FROM view_rows)
  SELECT doc_id, view_type, family_id, field, kind FROM v JOIN con USING (family_id) WHERE f IS NULL OR list_contains(f, field)""")
def f8(spark, sf):
    return families.view_fields(frame(spark, sf, "view_rows"))


SYMBOLS = ", ".join(f"('{s}', '{n}')" for s, n in families.TABLE_SYMBOLS.items())


@query("j26_table_semantics", ctes("table_rows") + f""", sy(s, canonical_name) AS (VALUES {SYMBOLS}), r AS (SELECT *, CASE WHEN trim(label) IN ('b', 'e') THEN trim(label) ELSE upper(trim(label)) END AS s, coalesce(nullif(nom, ''), nullif(max, ''), nullif(min, '')) AS v FROM table_rows),
  k AS (SELECT doc_id, canonical_name, arg_max((label_token, v), (confidence, -ord)) AS b FROM r JOIN sy USING (s) WHERE v IS NOT NULL GROUP BY 1, 2)
  SELECT doc_id, canonical_name, b[1] AS label_token, b[2] AS value_token, CAST(0.99 AS DOUBLE) AS confidence FROM k""")
def j26(spark, sf):
    return families.table_semantics(frame(spark, sf, "table_rows"))


PACKAGE = ctes("table_rows", "identity_tokens") + f""", sy(s, canonical_name) AS (VALUES {SYMBOLS}), r AS (SELECT *, CASE WHEN trim(label) IN ('b', 'e') THEN trim(label) ELSE upper(trim(label)) END AS s, coalesce(nullif(nom, ''), nullif(max, ''), nullif(min, '')) AS v FROM table_rows),
  k AS (SELECT doc_id, canonical_name, arg_max(label_token, (confidence, -ord)) AS label_token, arg_max(v, (confidence, -ord)) AS value_token FROM r JOIN sy USING (s) WHERE v IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT DISTINCT ON (doc_id) doc_id, 'nominal_pin_count', token_id, NULL FROM (SELECT * FROM identity_tokens WHERE text LIKE 'UFQFPN, %' ORDER BY doc_id, ord))"""


def _package(spark, sf):
    return families.package_semantics(*_frames(spark, sf, "table_rows", "identity_tokens"))


@query("j26_package_semantics", PACKAGE + " SELECT *, CAST(0.99 AS DOUBLE) AS confidence FROM k")
def j26_package(spark, sf):
    return _package(spark, sf)


@query("j26_unresolved_fields", PACKAGE + f" SELECT doc_id, field FROM (SELECT DISTINCT doc_id, unnest({list(families.REQUIRED[families.QFN])}) AS field FROM table_rows) ANTI JOIN (SELECT doc_id, canonical_name AS field FROM k) USING (doc_id, field)")
def j26_unresolved(spark, sf):
    return families.unresolved_fields(frame(spark, sf, "table_rows").select("doc_id").distinct(), _package(spark, sf))


@query("j27_corner_counts", ctes("drawn_numbers") + """, k AS (SELECT DISTINCT * FROM drawn_numbers), c AS (SELECT doc_id, number AS n, unnest(list_distinct([1, number // 4, number // 4 + 1, number // 2, number // 2 + 1, 3 * number // 4, 3 * number // 4 + 1, number])) AS number FROM k WHERE number >= 4 AND number % 4 = 0),
  h AS (SELECT doc_id, n FROM c JOIN k USING (doc_id, number) GROUP BY 1, 2 HAVING count(*) >= 4) SELECT doc_id, max(n) AS nominal_pin_count FROM h GROUP BY 1""")
def j27(spark, sf):
    return families.corner_counts(frame(spark, sf, "drawn_numbers"))


@query("v12_cleared_issues", ctes("open_issues", "operator_values") + """ SELECT i.doc_id, kind, field FROM open_issues i LEFT JOIN operator_values v USING (doc_id)
  WHERE v.doc_id IS NULL OR NOT CASE kind WHEN 'conflict' THEN regexp_matches(field, '(^|[^A-Za-z0-9_])' || canonical_name || '([^A-Za-z0-9_]|$)') ELSE field = canonical_name END""")
def v12_cleared(spark, sf):
    return families.cleared_issues(*_frames(spark, sf, "open_issues", "operator_values", "params"))


@query("x3_worded_confidences", ctes("worded_confidences") + """ SELECT id, CASE lower(confidence) WHEN 'high' THEN CAST(0.95 AS DOUBLE) WHEN 'medium' THEN CAST(0.70 AS DOUBLE) WHEN 'low' THEN CAST(0.40 AS DOUBLE)
    ELSE TRY_CAST(confidence AS DOUBLE) END AS confidence FROM worded_confidences""")
def x3_confidences(spark, sf):
    return frame(spark, sf, "worded_confidences").select("id", D.confidence_number("confidence").alias("confidence"))
