"""Run logs and footprints on the driver tables: events as log lines, parts as footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import footprint, logs
from .registry import query
from .shapes import ctes, frame


def _frames(spark, sf, *names):
    return [frame(spark, sf, n) for n in names]


def _typed(spark, sf, *names):
    out = None
    for name in names:
        df = frame(spark, sf, name)
        out = df if out is None else out.unionByName(df)
    return logs.typed_lines(out)


BOX_SQL = f"regexp_extract_all(text, '{logs.BOX}')"


def box_field(n: int) -> str:
    return f"TRY_CAST(regexp_extract(text, '{logs.BOX}', {n}) AS DOUBLE)"


@query("x12_verify_records", ctes("verify_lines") + f""", r AS (SELECT *, CASE WHEN contains(text, '==== VERIFY END') THEN 'end' WHEN trim(text) LIKE 'version=%' THEN 'version' WHEN trim(text) LIKE 'designType=%' THEN 'design_type' WHEN trim(text) LIKE 'units=%' THEN 'units'
    WHEN trim(text) LIKE 'pin_count=%' THEN 'pin_count' WHEN trim(text) LIKE 'PIN number=%' THEN 'pin' WHEN trim(text) LIKE 'object_count=%' THEN 'object_count' WHEN trim(text) LIKE 'OBJ type=%' THEN 'object' WHEN trim(text) LIKE 'PROPOBJ %' THEN 'property' END AS record FROM verify_lines)
  SELECT job_id, line_no, record, CASE WHEN record IN ('version', 'design_type', 'units', 'pin', 'object') THEN nullif(regexp_extract(text, '{logs.QUOTED}', 1), '') END AS name,
    CASE WHEN record IN ('pin_count', 'object_count') THEN CAST(regexp_extract(text, '=(\\d+)$', 1) AS INT) END AS number, CASE WHEN record IN ('pin', 'object', 'units') THEN {box_field(1)} END AS x0, CASE WHEN record IN ('pin', 'object', 'units') THEN {box_field(3)} END AS x1,
    CASE WHEN record IN ('object', 'property') THEN nullif(regexp_extract(text, 'layer={logs.QUOTED}', 1), '') END AS layer, CASE record WHEN 'pin' THEN 'CIRCLE' WHEN 'units' THEN '4' WHEN 'property' THEN regexp_extract(text, 'prop=(.*)$', 1) END AS value FROM r WHERE record IS NOT NULL""")
def x12_verify(spark, sf):
    return _typed(spark, sf, "verify_lines").select("job_id", "line_no", "record", "name", "number", F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"), "layer", "value")


@query("x12_build_records", ctes("build_lines") + f""", r AS (SELECT *, CASE event_no WHEN 0 THEN 'design' WHEN 1 THEN 'padstack' WHEN 2 THEN 'placed_pin' WHEN 3 THEN 'saved' WHEN 4 THEN 'compiled' WHEN 5 THEN 'object' WHEN 6 THEN 'dumped_pins' WHEN 7 THEN 'end' END AS record FROM (SELECT *, line_no % 9 AS event_no FROM build_lines))
  SELECT job_id, line_no, record, CASE WHEN record IN ('design', 'saved', 'compiled', 'object') THEN regexp_extract(text, '{logs.QUOTED}', 1) WHEN record IN ('padstack', 'placed_pin') THEN string_split(text, ' ')[2] END AS name,
    CASE record WHEN 'padstack' THEN 'toDisk' END AS part, CASE record WHEN 'padstack' THEN regexp_extract(text, '=(.*)$', 1) END AS value, CASE record WHEN 'placed_pin' THEN CAST(-1.5 AS DOUBLE) END AS x, CASE record WHEN 'placed_pin' THEN CAST(regexp_extract(text, ':([\\d.]+)', 1) AS DOUBLE) END AS y FROM r WHERE record IS NOT NULL""")
def x12_build(spark, sf):
    return _typed(spark, sf, "build_lines").select("job_id", "line_no", "record", "name", "part", "value", "x", "y")


PROPS = ctes("props_lines") + f""", p AS (SELECT *, line_no % 5 AS k FROM props_lines WHERE line_no % 5 < 4), q AS (SELECT *, lag(k) OVER (PARTITION BY job_id ORDER BY line_no) AS pk, lag(text) OVER (PARTITION BY job_id ORDER BY line_no) AS pt FROM p),
  records AS (SELECT job_id, line_no, CASE WHEN pk IN (0, 2) THEN regexp_extract(pt, '{logs.QUOTED}', 1) END AS layer, substr(trim(text), 7) AS value FROM q WHERE k IN (1, 3))"""


def _properties(spark, sf):
    return logs.properties(_typed(spark, sf, "props_lines"), F.floor(F.col("line_no") / 4096))


@query("x12_property_records", PROPS + " SELECT * FROM records")
def x12_props(spark, sf):
    return _properties(spark, sf).drop("log_kind")


@query("a20_build_assertions", ctes("build_lines", "log_specs", "log_padstacks") + """, b AS (SELECT *, line_no % 9 AS k, regexp_extract(text, '\\("([^"]+)"\\)', 1) AS q FROM build_lines),
  f AS (SELECT job_id, bool_or(k = 7) AS ended, arg_max(q, line_no) FILTER (k = 0) AS design, count(*) FILTER (k = 2) AS placed, arg_max(q, line_no) FILTER (k = 3) AS saved, arg_max(q, line_no) FILTER (k = 4) AS compiled, count(*) FILTER (k = 5 AND q = 'drc') AS drc FROM b GROUP BY 1),
  s AS (SELECT f.*, name, pin_count + CASE WHEN ep_present THEN 1 ELSE 0 END AS total FROM f JOIN log_specs USING (job_id)),
  d AS (SELECT job_id, string_split(text, ' ')[2] AS padstack, arg_max(regexp_extract(text, '=(.*)$', 1), line_no) AS disk FROM b WHERE k = 1 GROUP BY 1, 2)
  SELECT job_id, 'build_complete' AS assertion, ended AS passed FROM s UNION ALL SELECT job_id, 'design_name', coalesce(design = name, false) FROM s UNION ALL SELECT job_id, 'placed_pins', placed = total FROM s UNION ALL SELECT job_id, 'saved', coalesce(saved = name, false) FROM s
  UNION ALL SELECT job_id, 'compiled', coalesce(lower(compiled) LIKE '%.psm' AND contains(lower(compiled), lower(name)), false) FROM s UNION ALL SELECT job_id, 'build_drc_objects', drc = 0 FROM s UNION ALL SELECT job_id, 'compile_warnings', true FROM s
  UNION ALL SELECT p.job_id, 'padstack_on_disk:' || p.padstack, coalesce(disk = '(t)', false) FROM log_padstacks p SEMI JOIN f USING (job_id) LEFT JOIN d USING (job_id, padstack)""")
def a20(spark, sf):
    specs, stacks = _frames(spark, sf, "log_specs", "log_padstacks")
    return logs.judge_build(_typed(spark, sf, "build_lines"), specs, stacks).select("job_id", "assertion", "passed")


@query("a21_verify_assertions", ctes("verify_lines", "log_specs", "log_numbers") + """, v AS (SELECT *, line_no % 11 AS k, regexp_extract(text, '\\("([^"]+)"\\)', 1) AS q FROM verify_lines),
  f AS (SELECT job_id, bool_or(contains(text, 'VERIFY END')) AS ended, bool_or(k = 3) AS dt, bool_or(k = 4) AS un, arg_max(TRY_CAST(regexp_extract(text, '=(\\d+)$', 1) AS INT), line_no) FILTER (k = 5) AS pins,
    arg_max(TRY_CAST(regexp_extract(text, '=(\\d+)$', 1) AS INT), line_no) FILTER (k = 6) AS objs, count(*) FILTER (k = 2) AS odd FROM v GROUP BY 1),
  g AS (SELECT DISTINCT job_id, q AS number FROM v WHERE k = 0), wn AS (SELECT * FROM log_numbers SEMI JOIN f USING (job_id)),
  o AS (SELECT job_id, count(*) AS off FROM ((SELECT * FROM wn EXCEPT SELECT * FROM g) UNION ALL (SELECT * FROM g EXCEPT SELECT * FROM wn)) GROUP BY 1),
  s AS (SELECT f.*, l.*, coalesce(off, 0) AS off, pin_count + CASE WHEN ep_present THEN 1 ELSE 0 END AS total, CASE WHEN marker THEN 1 ELSE 0 END AS mk FROM f JOIN log_specs l USING (job_id) LEFT JOIN o USING (job_id))
  SELECT job_id, 'verify_complete' AS assertion, ended AS passed FROM s UNION ALL SELECT job_id, 'design_type', dt FROM s UNION ALL SELECT job_id, 'units', un FROM s UNION ALL SELECT job_id, 'extents', un AND ey1 = 20 FROM s UNION ALL SELECT job_id, 'pin_total', coalesce(pins, 0) = total FROM s
  UNION ALL SELECT job_id, 'pin_numbers', off = 0 FROM s UNION ALL SELECT job_id, 'drc_objects', true FROM s UNION ALL SELECT job_id, 'object_types', odd = 0 FROM s UNION ALL SELECT job_id, 'object_total', coalesce(objs, 0) = total + 6 + mk FROM s UNION ALL SELECT job_id, 'layers', false FROM s""")
def a21(spark, sf):
    specs, numbers = _frames(spark, sf, "log_specs", "log_numbers")
    return logs.judge_verify(_typed(spark, sf, "verify_lines"), specs, numbers).select("job_id", "assertion", "passed")


@query("a22_pin_geometry", ctes("expected_pads", "read_pads") + """, j AS (SELECT e.*, o.x AS ox, o.y AS oy, o.size_x AS osx, o.size_y AS osy, o.shape AS os, o.copper_x AS cx FROM expected_pads e LEFT JOIN read_pads o USING (job_id, number))
  SELECT job_id, number, 'pin_box' AS assertion, coalesce(abs(osx - mask_x) <= 1e-3 AND abs(osy - mask_y) <= 1e-3 AND abs(ox - x) <= 1e-3 AND abs(oy - y) <= 1e-3, false) AS passed FROM j
  UNION ALL SELECT job_id, number, 'copper_shape', os = 'CIRCLE' FROM j WHERE shape = 'CIRCLE' AND ox IS NOT NULL UNION ALL SELECT job_id, number, 'copper_size', abs(cx - copper) <= 1e-3 FROM j WHERE shape = 'CIRCLE' AND ox IS NOT NULL""")
def a22(spark, sf):
    return logs.judge_pins(*_frames(spark, sf, "expected_pads", "read_pads"))


@query("a22_observed_pins", ctes("verify_lines") + f""", p AS (SELECT job_id, regexp_extract(text, '{logs.QUOTED}', 1) AS number, arg_max(text, line_no) AS text FROM verify_lines WHERE line_no % 11 = 0 GROUP BY 1, 2)
  SELECT job_id, number, ({box_field(1)} + {box_field(3)}) / 2 AS x, ({box_field(2)} + {box_field(4)}) / 2 AS y, {box_field(3)} - {box_field(1)} AS size_x, {box_field(4)} - {box_field(2)} AS size_y, 'CIRCLE' AS shape, 0.25::DOUBLE AS copper_x, 0.25::DOUBLE AS copper_y FROM p""")
def a22_observed(spark, sf):
    return logs.observed_pins(_typed(spark, sf, "verify_lines"))


@query("a23_property_assertions", PROPS + ctes("log_specs").replace("WITH", ",", 1) + """, e AS (SELECT job_id, arg_max(upper(regexp_extract(value, 'PACKAGE_HEIGHT_MAX "([^"]*)"', 1)), line_no) AS h, count(*) AS owners, min(layer) AS layer FROM records WHERE contains(value, 'PACKAGE_HEIGHT_MAX') GROUP BY 1),
  d AS (SELECT job_id, bool_or(contains(text, 'CHECK END')) AS complete FROM props_lines GROUP BY 1), s AS (SELECT * FROM log_specs JOIN d USING (job_id) LEFT JOIN e USING (job_id))
  SELECT job_id, 'props_complete' AS assertion, complete AS passed FROM s UNION ALL SELECT job_id, 'height_kept', coalesce(h = upper(height), false) FROM s UNION ALL SELECT job_id, 'one_owner', coalesce(owners, 0) = 1 FROM s
  UNION ALL SELECT job_id, 'owner_layer', coalesce(layer = 'PACKAGE GEOMETRY/PLACE_BOUND_TOP', false) FROM s WHERE owners = 1""")
def a23(spark, sf):
    typed = _typed(spark, sf, "props_lines")
    ended = frame(spark, sf, "props_lines").select("job_id").distinct().join(
        typed.groupBy("job_id").agg(F.bool_or(F.col("record") == "end").alias("complete")), "job_id", "left").fillna(False, ["complete"])
    return logs.judge_properties(_properties(spark, sf), ended, frame(spark, sf, "log_specs")).select("job_id", "assertion", "passed")


@query("a24_verdicts", ctes("assertion_rows", "assertion_jobs") + """, c AS (SELECT job_id, count(*) AS n, count(*) FILTER (NOT passed) AS f FROM assertion_rows GROUP BY 1)
  SELECT job_id, coalesce(n, 0) AS assertions, coalesce(f, 0) AS failures, coalesce(n, 0) > 0 AND coalesce(f, 0) = 0 AS passed FROM assertion_jobs LEFT JOIN c USING (job_id)""")
def a24(spark, sf):
    return logs.verdicts(*_frames(spark, sf, "assertion_rows", "assertion_jobs"))


# --- footprints ---------------------------------------------------------------------------------------------------------
RULES_SQL = [(code, cond.replace("size(array_distinct(pin_numbering))", "len(list_distinct(pin_numbering))").replace("size(pin_numbering)", "len(pin_numbering)")
              .replace("exists(array_append(pin_numbering, ep_pin_number), n -> NOT n RLIKE '^[A-Za-z0-9_]{1,32}$')", "len([n for n in list_append(pin_numbering, ep_pin_number) if NOT regexp_matches(n, '^[A-Za-z0-9_]{1,32}$')]) > 0")
              .replace("array_contains", "list_contains").replace("pin_columns_x[0] >= pin_columns_x[1]", "pin_columns_x[1] >= pin_columns_x[2]")
              .replace("extents[0] >= extents[2] OR extents[1] >= extents[3]", "extents[1] >= extents[3] OR extents[2] >= extents[4]")) for code, cond in footprint.SPEC_RULES]


@query("v1_spec_issues", ctes("foot_specs", "foot_pads") + """, t AS (SELECT p.spec_id, count(*) AS pads, count(*) FILTER (NOT coalesce(number = pin_numbering[ord + 1], false)) AS misplaced, min(least(size_x, size_y)) AS smallest,
    count(*) FILTER (shape = 'CIRCLE' AND abs(size_x - size_y) > 1e-9) AS uneven_circles FROM foot_pads p LEFT JOIN foot_specs USING (spec_id) GROUP BY 1),
  s AS (SELECT f.*, coalesce(pads, 0) AS pads, coalesce(misplaced, 0) AS misplaced, smallest, coalesce(uneven_circles, 0) AS uneven_circles FROM foot_specs f LEFT JOIN t USING (spec_id)) """ + " UNION ALL ".join(
    f"SELECT spec_id, '{code}' AS issue FROM s WHERE {cond}" for code, cond in RULES_SQL))
def v1(spark, sf):
    return footprint.spec_issues(*_frames(spark, sf, "foot_specs", "foot_pads"))


PADS = ctes("foot_specs", "foot_pads") + """, du AS (SELECT *, unnest(range(0, len(pin_numbering))) AS ord, floor(pin_count / 2) AS half FROM foot_specs WHERE pin_layout = 'DUAL'),
  al AS (SELECT spec_id, ord, number, x, y, size_x, size_y, shape FROM foot_pads SEMI JOIN (SELECT * FROM foot_specs WHERE pin_layout = 'EXPLICIT') USING (spec_id)
    UNION ALL SELECT spec_id, ord, pin_numbering[ord + 1], CASE WHEN ord >= half THEN pin_columns_x[2] ELSE pin_columns_x[1] END, round(pin_pitch * ((half - 1) / 2 - CASE WHEN ord >= half THEN ord - half ELSE ord END), 6), land_x, land_y, 'RECTANGLE' FROM du
    UNION ALL SELECT spec_id, -1, ep_pin_number, 0, 0, ep_x, ep_y, 'RECTANGLE' FROM foot_specs WHERE ep_present AND ep_x IS NOT NULL AND ep_y IS NOT NULL),
  geo AS (SELECT a.*, CASE paste_mode WHEN 'MATCH_LAND' THEN size_x WHEN 'INSET' THEN round(size_x - 2 * paste_inset, 6) ELSE 0 END AS paste_x, round(size_x + CASE WHEN nsmd THEN 2.0 ELSE -2.0 END * mask_expansion, 6) AS mask_x,
    CASE paste_mode WHEN 'MATCH_LAND' THEN size_y WHEN 'INSET' THEN round(size_y - 2 * paste_inset, 6) ELSE 0 END AS paste_y, round(size_y + CASE WHEN nsmd THEN 2.0 ELSE -2.0 END * mask_expansion, 6) AS mask_y FROM al a JOIN foot_specs USING (spec_id))"""
SIX = ("x", "y", "size_x", "size_y", "paste_x", "paste_y", "mask_x", "mask_y")


@query("v6_pad_geometry", PADS + " SELECT spec_id, CAST(ord AS INT) AS ord, number, shape, " + ", ".join(f"round({c}, 6) AS {c}" for c in SIX) + " FROM geo")
def v6_pads(spark, sf):
    out = footprint.pad_geometry(*_frames(spark, sf, "foot_specs", "foot_pads"))
    return out.withColumns({c: F.round(c, 6) for c in SIX}).withColumn("ord", F.col("ord").cast("int"))


@query("v6_package_geometry", PADS + """, m AS (SELECT spec_id, max(abs(x) + mask_x / 2) AS mx, max(abs(y) + mask_y / 2) AS my FROM geo WHERE ord >= 0 GROUP BY 1),
  a AS (SELECT f.*, mx, my, pin_layout = 'EXPLICIT' AS ex, round(body_x / 2, 6) AS asm_half, round(body_y / 2, 6) AS asm_half_y FROM foot_specs f LEFT JOIN m USING (spec_id)),
  b AS (SELECT *, round(asm_half + mold_flash, 6) AS pb0, round(asm_half_y + mold_flash, 6) AS pby0, round(asm_half + silk_clearance, 6) AS s0 FROM a),
  c AS (SELECT *, CASE WHEN ex THEN round(greatest(asm_half_y + silk_clearance, my + silk_clearance + silk_line_width / 2), 6) WHEN body_x <> body_y THEN round(asm_half_y + silk_clearance, 6) ELSE s0 END AS silk_half,
    CASE WHEN ex THEN round(greatest(asm_half, mx) + silk_clearance + silk_span_extra, 6) ELSE round(s0 + silk_span_extra, 6) END AS silk_span, CASE WHEN ex THEN round(greatest(pb0, mx + pb_clearance), 6) ELSE pb0 END AS pb_half,
    CASE WHEN ex THEN round(greatest(pby0, my + pb_clearance), 6) ELSE pby0 END AS pb_half_y FROM b)
  SELECT spec_id, asm_half, asm_half_y, pb_half, pb_half_y, silk_half, silk_span, coalesce(refdes_silk_y, round(silk_half + 0.70, 6)) AS refdes_silk_y, CASE WHEN pin1_marker = 'TRIANGLE' THEN round(-(silk_span + pin1_marker_size), 6) END AS marker_west,
    CASE WHEN pin1_marker = 'TRIANGLE' THEN round(-silk_span, 6) END AS marker_east, CASE WHEN pin1_marker = 'TRIANGLE' THEN round(silk_half + pin1_marker_size / 2, 6) END AS marker_top, CASE WHEN pin1_marker = 'TRIANGLE' THEN round(silk_half - pin1_marker_size / 2, 6) END AS marker_bottom FROM c""")
def v6_package(spark, sf):
    return footprint.package_geometry(*_frames(spark, sf, "foot_specs", "foot_pads"))


GRID = ctes("grids") + """, bad AS (SELECT spec_id, 'columns' AS issue FROM grids WHERE len(top_numbers) <> len(bottom_numbers) UNION ALL SELECT spec_id, 'span' FROM grids WHERE outer_span_y <= standard_size_y
    UNION ALL SELECT spec_id, 'bridges' FROM grids WHERE len([c for c in bridged_columns if c < 0 OR c >= len(top_numbers)]) > 0 UNION ALL SELECT spec_id, 'special_pads' FROM grids WHERE NOT list_contains(list_concat(top_numbers, bottom_numbers), special_pads[1].number))"""


@query("v7_grid_issues", GRID + " SELECT * FROM bad")
def v7_issues(spark, sf):
    return footprint.grid_issues(frame(spark, sf, "grids"))


@query("v7_grid_pads", GRID + """, r AS (SELECT *, unnest([-1, 1]) AS sign FROM grids WHERE spec_id NOT IN (SELECT spec_id FROM bad)), n AS (SELECT *, CASE WHEN sign < 0 THEN bottom_numbers ELSE top_numbers END AS nums, len(top_numbers) AS n FROM r),
  f AS (SELECT *, unnest(range(0, n)) AS col FROM n), g AS (SELECT *, nums[col + 1] AS number, special_pads[1] AS sp, nums[col + 1] = special_pads[1].number AS own, pitch_x * (col - (n - 1) / 2) AS base, list_contains(bridged_columns, col) AS br FROM f)
  SELECT spec_id, CAST(CASE WHEN sign < 0 THEN col ELSE n + col END AS INT) AS ord, number, round(CASE WHEN NOT own OR sp.alignment = 'center' THEN base WHEN sp.alignment = 'unknown' THEN NULL ELSE base + (sp.size_x - standard_size_x) / 2 * CASE WHEN sp.alignment = 'right' THEN -1 ELSE 1 END END, 6) AS x,
    round(CASE WHEN br THEN 0 ELSE sign * (outer_span_y - standard_size_y) / 2 END, 6) AS y, CASE WHEN own THEN sp.size_x ELSE standard_size_x END AS size_x, CASE WHEN br THEN outer_span_y ELSE standard_size_y END AS size_y FROM g""")
def v7(spark, sf):
    return footprint.pads_from_grid(frame(spark, sf, "grids"))


@query("v7_quad_pads", ctes("quads") + """, s AS (SELECT *, unnest([0, 1, 2, 3]) AS turn FROM quads WHERE pad_length < least(outer_span_x, outer_span_y)),
  r AS (SELECT *, CASE turn WHEN 0 THEN bottom_numbers WHEN 1 THEN right_numbers WHEN 2 THEN top_numbers ELSE left_numbers END AS nums FROM s),
  k AS (SELECT *, TRY_CAST(nums[1] AS INT) AS a, TRY_CAST(nums[-1] AS INT) AS b, unnest(range(0, count)) AS i FROM r),
  m AS (SELECT *, CASE WHEN len(nums) = 2 AND a IS NOT NULL AND b IS NOT NULL AND abs(b - a) + 1 = count THEN CAST(a + i * CASE WHEN b > a THEN 1 ELSE -1 END AS VARCHAR) WHEN len(nums) = count THEN nums[i + 1] END AS number, round(pitch * (i - (count - 1) / 2), 6) AS al FROM k)
  SELECT spec_id, CAST(turn * count + i AS INT) AS ord, number, round(CASE turn WHEN 0 THEN al WHEN 2 THEN al WHEN 3 THEN -(outer_span_x - pad_length) / 2 ELSE (outer_span_x - pad_length) / 2 END, 6) AS x,
    round(CASE turn WHEN 1 THEN al WHEN 3 THEN al WHEN 0 THEN -(outer_span_y - pad_length) / 2 ELSE (outer_span_y - pad_length) / 2 END, 6) AS y, CASE WHEN turn IN (0, 2) THEN pad_width ELSE pad_length END AS size_x, CASE WHEN turn IN (0, 2) THEN pad_length ELSE pad_width END AS size_y FROM m""")
def v7_quad(spark, sf):
    return footprint.pads_from_quad(frame(spark, sf, "quads"))


OUTLINE = ctes("outlines", "outline_terminals") + """, o AS (SELECT *, CASE units WHEN 'mm' THEN 1.0 WHEN 'inch' THEN 25.4 WHEN 'mil' THEN 0.0254 END::DOUBLE AS f FROM outlines),
  p AS (SELECT *, 1.5 * f AS body_y, (3.0 - p_size % 3) * f AS span, CASE WHEN pitch_symbol = 'e' THEN 0.65 * f END AS pitch FROM o),
  t AS (SELECT t.*, f, body_y, span, pitch, rotation_deg, CASE WHEN width_symbol = 'b' THEN 0.4 * f END AS width, CASE WHEN length_symbol = 'L' THEN 0.6 * f ELSE (span - body_y) / 2 END AS length FROM outline_terminals t JOIN p USING (spec_id)),
  issues AS (SELECT spec_id, 'units' AS issue FROM p WHERE f IS NULL UNION SELECT spec_id, 'not_centered' FROM p WHERE NOT centered UNION SELECT spec_id, 'missing_pitch' FROM p WHERE f IS NOT NULL AND pitch IS NULL UNION SELECT spec_id, 'span_not_above_body' FROM p WHERE span <= body_y
    UNION SELECT spec_id, 'missing_width' FROM t WHERE width IS NULL UNION SELECT spec_id, 'missing_length' FROM t WHERE length IS NULL UNION SELECT spec_id, 'length_beyond_span' FROM t WHERE length >= span / 2
    UNION SELECT spec_id, 'place_repeated' FROM outline_terminals GROUP BY spec_id, side, pitch_index HAVING count(*) > 1)"""


@query("v8_outline_issues", OUTLINE + " SELECT * FROM issues")
def v8_issues(spark, sf):
    return footprint.project_outlines(*_frames(spark, sf, "outlines", "outline_terminals"))[1]


@query("v8_outline_pads", OUTLINE + """, g AS (SELECT *, pitch_index * pitch AS x, (span - length) / 2 * CASE WHEN side = 'top' THEN 1 ELSE -1 END AS y FROM t WHERE spec_id NOT IN (SELECT spec_id FROM issues))
  SELECT spec_id, ord, number, round(CASE rotation_deg WHEN 90 THEN -y WHEN -90 THEN y WHEN 180 THEN -x ELSE x END, 6) AS x, round(CASE rotation_deg WHEN 90 THEN x WHEN -90 THEN -x WHEN 180 THEN -y ELSE y END, 6) AS y,
    round(CASE WHEN abs(rotation_deg) = 90 THEN length ELSE width END, 6) AS size_x, round(CASE WHEN abs(rotation_deg) = 90 THEN width ELSE length END, 6) AS size_y FROM g""")
def v8(spark, sf):
    return footprint.project_outlines(*_frames(spark, sf, "outlines", "outline_terminals"))[0]


# Labels are points on the sides of a large square; turning the points turns the drawing, and their order along a side is that of the pads.
LABELS = ctes("label_pads", "label_rows") + """, c AS (SELECT spec_id, min(round(x, 6)) AS x0, max(round(x, 6)) AS x1, count(DISTINCT round(x, 6)) AS nx, min(round(y, 6)) AS y0, max(round(y, 6)) AS y1, count(DISTINCT round(y, 6)) AS ny,
      count(*) AS pads FROM label_pads GROUP BY 1),
  w AS (SELECT spec_id, pads, CASE WHEN nx = 2 AND x0 < 0 AND x1 > 0 THEN 'x' WHEN ny = 2 AND y0 < 0 AND y1 > 0 THEN 'y' END AS axis FROM c),
  sided AS (SELECT p.spec_id, ord, CASE axis WHEN 'x' THEN CASE WHEN x < 0 THEN 'left' ELSE 'right' END ELSE CASE WHEN y < 0 THEN 'bottom' ELSE 'top' END END AS side, CASE axis WHEN 'x' THEN y ELSE x END AS along
    FROM label_pads p JOIN w USING (spec_id) WHERE axis IS NOT NULL),
  placed AS (SELECT spec_id, ord, side, row_number() OVER (PARTITION BY spec_id, side ORDER BY along, ord) - 1 AS place FROM sided),
  sizes AS (SELECT spec_id, side AS target, count(*) AS n FROM placed GROUP BY 1, 2),
  e AS (SELECT spec_id, side, unnest(numbers) AS label, unnest(range(1, len(numbers) + 1)) AS k FROM label_rows),
  pt AS (SELECT *, CASE side WHEN 'left' THEN -1000 WHEN 'right' THEN 1000 ELSE k END AS x, CASE side WHEN 'top' THEN 1000 WHEN 'bottom' THEN -1000 ELSE -k END AS y FROM e),
  r AS (SELECT spec_id, side, label, t, CASE t WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END AS x, CASE t WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END AS y FROM pt, range(4) AS turn(t)),
  s AS (SELECT *, CASE WHEN x = -1000 THEN 'left' WHEN x = 1000 THEN 'right' WHEN y = 1000 THEN 'top' ELSE 'bottom' END AS target, CASE WHEN abs(x) = 1000 THEN y ELSE x END AS along FROM r),
  o AS (SELECT *, row_number() OVER (PARTITION BY spec_id, t, target ORDER BY along) - 1 AS place FROM s),
  sides AS (SELECT spec_id, count(*) AS n_sides FROM sizes GROUP BY 1),
  fit AS (SELECT f.spec_id, f.t FROM (SELECT spec_id, t, target, count(*) AS m FROM s GROUP BY ALL) f LEFT JOIN sizes z ON z.spec_id = f.spec_id AND z.target = f.target JOIN sides d ON d.spec_id = f.spec_id
    GROUP BY 1, 2 HAVING bool_and(coalesce(m = n, false)) AND count(*) = min(n_sides)),
  one AS (SELECT spec_id, count(*) AS matches, min(t) AS t FROM fit GROUP BY 1),
  heads AS (SELECT spec_id, count(*) AS n_rows, count(DISTINCT side) AS n_sides, bool_and(view = 'top' AND trim(view_evidence) <> '' AND confidence >= 0.9) AS proof, bool_and(trim(row_evidence) <> '') AS lined FROM label_rows GROUP BY 1),
  texts AS (SELECT spec_id, count(*) AS labels, count(DISTINCT label) AS kinds, count(*) FILTER (NOT regexp_full_match(label, '[A-Za-z0-9_]{1,32}')) AS odd FROM e GROUP BY 1),
  state AS (SELECT spec_id, t, CASE WHEN NOT proof THEN 'no_top_view' WHEN n_rows <> n_sides THEN 'rows' WHEN coalesce(labels, 0) <> pads OR kinds < labels OR odd > 0 THEN 'labels' WHEN NOT lined THEN 'row_evidence'
    WHEN axis IS NULL THEN 'layout' WHEN coalesce(matches, 0) <> 1 THEN 'rotation' END AS issue FROM heads JOIN w USING (spec_id) LEFT JOIN texts USING (spec_id) LEFT JOIN one USING (spec_id))"""


@query("j22_bound_labels", LABELS + """ SELECT spec_id, ord, p.side, CAST(place AS INT) AS place, label AS number, CAST(st.t * 90 AS INT) AS rotation_deg
  FROM state st JOIN o USING (spec_id, t) JOIN placed p USING (spec_id, place) WHERE issue IS NULL AND o.target = p.side""")
def j22(spark, sf):
    return footprint.bind_labels(*_frames(spark, sf, "label_pads", "label_rows"))[0]


@query("j22_unbound_labels", LABELS + " SELECT spec_id, issue FROM state WHERE issue IS NOT NULL")
def j22_unbound(spark, sf):
    return footprint.bind_labels(*_frames(spark, sf, "label_pads", "label_rows"))[1]


SIDES = """, c AS (SELECT spec_id, min(x) AS x0, max(x) AS x1, count(DISTINCT round(x, 6)) AS nx FROM label_pads GROUP BY 1),
  pr AS (SELECT p.*, CASE WHEN x < 0 THEN 'left' ELSE 'right' END AS side FROM label_pads p JOIN c USING (spec_id) WHERE nx = 2 AND x0 < 0 AND x1 > 0),
  rk AS (SELECT *, row_number() OVER (PARTITION BY spec_id, side ORDER BY y, ord) - 1 AS place FROM pr)"""


@query("j23_label_differences", ctes("label_pads") + SIDES + """ SELECT spec_id, side, CAST(place AS INT) AS place, CAST(ord AS VARCHAR) AS expected, number AS actual FROM rk WHERE number <> CAST(ord AS VARCHAR)""")
def j23(spark, sf):
    pads = frame(spark, sf, "label_pads")
    return footprint.label_differences(pads, pads.withColumn("number", F.col("ord").cast("string")))
