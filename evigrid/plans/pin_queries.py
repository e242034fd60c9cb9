"""Channels, self-check and symbol layout on the driver tables: order lines as pins, orders as figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.packages import EXPOSED_PAD_TEXT, STYLE_COUNT, SUFFIX_COUNT
from ..operators import channels, findings, layout
from .registry import query
from .shapes import ctes, frame


def wide():
    """Bucket of the derived pin order (about 256 part keys each)."""
    return F.shiftright("ord", 28)


def plausible(v: str) -> str:
    return f"CASE WHEN {v} IN (3, 5) OR ({v} BETWEEN 4 AND 2000 AND {v} % 2 = 0) THEN {v} END"


def package_count_sql(p: str) -> str:
    def take(pattern, guard=""):
        text = f"TRY_CAST(regexp_extract(trim({p}), '{pattern}', 1) AS INT)"
        return plausible(text) if not guard else f"CASE WHEN {guard} THEN {plausible(text)} END"
    lone = (f"len(regexp_extract_all(trim({p}), '\\d+')) = 1 AND regexp_matches(trim({p}), '^[A-Za-z]')"
            f" AND length(trim({p})) <= 12")
    return f"coalesce({take(SUFFIX_COUNT)}, {take(STYLE_COUNT)}, {take('(\\d+)', lone)})"


def folded_sql(c: str) -> str:
    return f"lower(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'))"


PAD = "regexp_full_match(coalesce(name, ''), '(?i)(?:EP(?:AD)?|EXPOSED\\s*PAD)')"
DOCUMENTED = f"({PAD} AND regexp_matches(coalesce(description, ''), '{EXPOSED_PAD_TEXT}'))"

FIRST = """, firsts AS (SELECT doc_id, pin_number, min(ord) AS ord, arg_min(name, ord) AS name FROM pins GROUP BY 1, 2)"""
FIGURE = """, fig0 AS (SELECT *, CASE WHEN side IN ('left','right','top','bottom') THEN side ELSE 'unknown' END AS s
    FROM figure_pins),
  fig1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) - 1 AS o,
    min(pos) OVER (PARTITION BY doc_id, s) AS sp FROM fig0),
  fig AS (SELECT doc_id, pin_number, s AS side, o AS side_order FROM fig1
    QUALIFY row_number() OVER (PARTITION BY doc_id, pin_number ORDER BY sp, pos) = 1)"""
CHANNELS = ctes("pins", "figure_pins") + FIRST + FIGURE


@query("j1_merged_pins", CHANNELS + """ SELECT f.doc_id, f.pin_number, f.ord, f.name,
    coalesce(CASE WHEN h.doc_id IS NOT NULL THEN g.side END, 'unknown') AS side,
    CAST(coalesce(CASE WHEN h.doc_id IS NOT NULL THEN g.side_order END, 0) AS INT) AS side_order,
    CASE WHEN h.doc_id IS NOT NULL THEN g.side IS NOT NULL END AS agreement
  FROM firsts f LEFT JOIN figures h USING (doc_id) LEFT JOIN fig g ON f.doc_id = g.doc_id AND f.pin_number = g.pin_number""")
def j1_pins(spark, sf):
    return channels.merge_channels(frame(spark, sf, "pins"), frame(spark, sf, "figure_pins"), frame(spark, sf, "figures"), wide_pos())[0]


def wide_pos():
    return F.floor(F.col("pos") / 4096)


CONFLICTS = """, texts AS (SELECT DISTINCT doc_id FROM pins), conflicts AS (
  SELECT f.doc_id, f.pin_number, 'side' AS field, f.name AS text, NULL AS vision, NULL AS duplicate
    FROM firsts f JOIN figures h ON f.doc_id = h.doc_id
    WHERE NOT EXISTS (SELECT 1 FROM fig g WHERE f.doc_id = g.doc_id AND f.pin_number = g.pin_number)
  UNION ALL SELECT g.doc_id, g.pin_number, 'pin_number', NULL, g.side, NULL FROM fig g
    WHERE g.doc_id IN (SELECT doc_id FROM texts)
      AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.doc_id = g.doc_id AND f.pin_number = g.pin_number)
  UNION ALL SELECT p.doc_id, p.pin_number, 'pin_number', NULL, NULL, p.name FROM pins p
    JOIN firsts f ON p.doc_id = f.doc_id AND p.pin_number = f.pin_number AND p.ord > f.ord)"""


def _conflicts(spark, sf):
    return channels.merge_channels(frame(spark, sf, "pins"), frame(spark, sf, "figure_pins"), frame(spark, sf, "figures"), wide_pos())[1]


@query("j1_channel_conflicts", CHANNELS + CONFLICTS + " SELECT * FROM conflicts")
def j1_conflicts(spark, sf):
    values = F.col("values")
    return _conflicts(spark, sf).select("doc_id", "pin_number", "field", values["text"].alias("text"),
                                        values["vision"].alias("vision"), values["duplicate"].alias("duplicate"))


DIFFERENCES = f""", obs AS (SELECT doc_id, pin_number, trim(arg_max(name, pos)) AS name, lower(trim(arg_max(side, pos))) AS side
    FROM observed GROUP BY 1, 2),
  both_sides AS (SELECT p.*, o.name AS oname, o.side AS oside FROM pins p JOIN obs o USING (doc_id, pin_number)),
  differences AS (
  SELECT doc_id, pin_number, 'missing' AS kind, NULL AS expected, NULL AS observed FROM pins p
    WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.doc_id = p.doc_id AND o.pin_number = p.pin_number)
  UNION SELECT doc_id, pin_number, 'extra', NULL, NULL FROM obs o
    WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE o.doc_id = p.doc_id AND o.pin_number = p.pin_number)
  UNION SELECT doc_id, pin_number, 'name', name, oname FROM both_sides WHERE oname <> '' AND {folded_sql('oname')} <> {folded_sql('name')}
  UNION SELECT doc_id, pin_number, 'side', side, oside FROM both_sides
    WHERE oside NOT IN ('', 'unknown') AND side <> 'unknown' AND side <> oside)"""


@query("j2_review_differences", ctes("pins", "observed") + DIFFERENCES + " SELECT * FROM differences")
def j2(spark, sf):
    return channels.review_differences(frame(spark, sf, "pins"), frame(spark, sf, "observed"))


@query("u4_set_differences", ctes("pins", "observed") + """ SELECT doc_id, pin_number, 'missing' AS kind FROM
    (SELECT doc_id, pin_number FROM pins EXCEPT SELECT doc_id, pin_number FROM observed)
  UNION ALL SELECT doc_id, pin_number, 'extra' FROM
    (SELECT doc_id, pin_number FROM observed EXCEPT SELECT doc_id, pin_number FROM pins)""")
def u4(spark, sf):
    return channels.set_differences(frame(spark, sf, "pins"), frame(spark, sf, "observed"), ["doc_id", "pin_number"])


# Answers to the review: one row per order line, keyed like the differences of its order.
RESOLUTIONS = [
    "CAST(l_orderkey AS STRING) AS doc_id", "CAST(l_linenumber AS STRING) AS pin_number",
    "CASE WHEN l_partkey % 3 = 0 THEN 'name' ELSE 'side' END AS field",
    "CASE WHEN l_partkey % 3 = 0 THEN 'N' || CAST(l_suppkey AS STRING) WHEN l_suppkey % 13 = 0 THEN 'inside'"
    " WHEN l_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS value"]


def _register():
    from .shapes import shape
    shape("resolutions", "lineitem", RESOLUTIONS, "l_returnflag = 'R'")
    shape("open_items", "lineitem", ["CAST(l_orderkey AS STRING) AS doc_id", "CAST(l_linenumber AS STRING) AS pin_number",
                                     "CASE WHEN l_partkey % 3 = 0 THEN 'name' ELSE 'side' END AS field"],
          "l_returnflag = 'R' AND l_suppkey % 5 <> 0 OR l_partkey % 97 = 0")


_register()
ISSUES = """, answered AS (SELECT doc_id, pin_number, field, count(*) AS n, count(*) FILTER (trim(value) = ''
      OR (field = 'side' AND value NOT IN ('left','right','top','bottom','unknown'))) AS bad FROM resolutions GROUP BY ALL),
  opened AS (SELECT DISTINCT * FROM open_items WHERE doc_id IN (SELECT doc_id FROM resolutions)),
  j AS (SELECT doc_id, pin_number, field, n, bad, o.hit FROM answered a
        FULL JOIN (SELECT *, 1 AS hit FROM opened) o USING (doc_id, pin_number, field)),
  issues AS (SELECT doc_id, pin_number, field, 'unknown' AS issue FROM j WHERE hit IS NULL
    UNION ALL SELECT doc_id, pin_number, field, 'duplicate' FROM j WHERE n > 1
    UNION ALL SELECT doc_id, pin_number, field, 'invalid' FROM j WHERE bad > 0
    UNION ALL SELECT doc_id, pin_number, field, 'uncovered' FROM j WHERE n IS NULL)"""


@query("j13_resolution_issues", ctes("resolutions", "open_items") + ISSUES + " SELECT * FROM issues")
def j13_issues(spark, sf):
    return channels.resolution_issues(frame(spark, sf, "resolutions"), frame(spark, sf, "open_items"))


@query("j13_apply_resolutions", ctes("pins", "resolutions", "open_items") + ISSUES + """, chosen AS (
    SELECT doc_id, pin_number, max(value) FILTER (field = 'name') AS n, max(value) FILTER (field = 'side') AS s
    FROM resolutions WHERE doc_id NOT IN (SELECT doc_id FROM issues) GROUP BY 1, 2)
  SELECT doc_id, pin_number, ord, coalesce(n, name) AS name, coalesce(s, side) AS side
  FROM pins LEFT JOIN chosen USING (doc_id, pin_number)""")
def j13_apply(spark, sf):
    out = channels.apply_resolutions(frame(spark, sf, "pins"), frame(spark, sf, "resolutions"), frame(spark, sf, "open_items"))
    return out.select("doc_id", "pin_number", "ord", "name", "side")


def _register_pads():
    from .shapes import shape
    # Pads need dense documents: the part number decides the package, order lines of one part are its pins.
    shape("pad_pins", "lineitem", [
        "CAST(l_orderkey AS STRING) AS doc_id", "CAST(l_linenumber AS STRING) AS pin_number",
        "CASE WHEN l_linenumber >= 5 THEN 'EPAD' ELSE 'P' || l_returnflag END AS name",
        "CASE WHEN l_linenumber >= 5 THEN 'Exposed pad' ELSE 'Signal' END AS description"])


_register_pads()


@query("j16_verified_exposed_pads", ctes("pad_pins", "docs") + f""", c AS (
    SELECT doc_id, package, {package_count_sql('package')} AS count FROM docs),
  m AS (SELECT p.*, count, package, {DOCUMENTED} AS pad FROM pad_pins p JOIN c USING (doc_id) WHERE count IS NOT NULL),
  g AS (SELECT doc_id, package, count, count(*) AS n, count(*) FILTER (pad) AS pads, max(pin_number) FILTER (pad) AS pad_number,
    count(DISTINCT pin_number) FILTER (NOT pad) AS d,
    count(DISTINCT pin_number) FILTER (NOT pad AND TRY_CAST(pin_number AS INT) BETWEEN 1 AND count) AS good FROM m GROUP BY 1, 2, 3)
  SELECT doc_id, package, count, pad_number FROM g WHERE pads = 1 AND n = count + 1 AND d = count AND good = count
    AND pad_number = CAST(count + 1 AS VARCHAR)""")
def j16(spark, sf):
    return channels.verified_exposed_pads(frame(spark, sf, "pad_pins"), frame(spark, sf, "docs"))


def _register_banks():
    from .shapes import choice, series, shape
    shape("bank_docs", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "o_orderkey", "o_custkey",
                                  f"{choice('o_custkey % 4', 'DFN4', 'UDFN-6', 'QFN6', 'DFN8')} AS package"])
    shape("bank_rows", "bank_docs", ["doc_id", "o_orderkey", "o_custkey", series(
        "1", "CAST(4 + 2 * (o_custkey % 4) - CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS INT)", "i")])
    shape("banks", "bank_rows", [
        "doc_id", "CAST(i AS STRING) AS pin_number", "i AS pos",
        "CASE WHEN i <= 2 + (o_custkey % 4) THEN 'top' WHEN o_orderkey % 7 = 0 THEN 'left' ELSE 'bottom' END AS side"])


_register_banks()


@query("v18_dual_row_rotation", ctes("banks", "bank_docs") + f""", c AS (
    SELECT doc_id, CASE WHEN regexp_matches(package, '(?i)^[XUV]?DFN(?:[\\s_\\-]|\\d)') THEN {package_count_sql('package')} END AS count
    FROM bank_docs),
  g AS (SELECT doc_id, count, count(*) AS n, count(DISTINCT pin_number) FILTER (CAST(pin_number AS INT) BETWEEN 1 AND count) AS good,
    list_sort(list(DISTINCT side)) AS sides, count(DISTINCT side) FILTER (CAST(pin_number AS INT) <= count / 2) AS lo,
    count(DISTINCT side) FILTER (CAST(pin_number AS INT) > count / 2) AS hi FROM banks JOIN c USING (doc_id) GROUP BY 1, 2),
  ok AS (SELECT doc_id, count FROM g WHERE count % 2 = 0 AND n = count AND good = count AND lo = 1 AND hi = 1
    AND (sides = ['left','right'] OR sides = ['bottom','top']))
  SELECT doc_id, pin_number, CASE WHEN count IS NULL THEN side WHEN CAST(pin_number AS INT) <= count / 2 THEN 'left' ELSE 'right' END AS side,
    CAST(CASE WHEN count IS NULL THEN pos WHEN CAST(pin_number AS INT) <= count / 2 THEN CAST(pin_number AS INT) - 1
      ELSE count + count / 2 - CAST(pin_number AS INT) END AS BIGINT) AS pos, count IS NOT NULL AS rotated
  FROM banks LEFT JOIN ok USING (doc_id)""")
def v18(spark, sf):
    return channels.dual_row_rotation(frame(spark, sf, "banks"), frame(spark, sf, "bank_docs"))


# --- self-check ----------------------------------------------------------------------------------------------
STATS = ctes("pins", "docs") + f""", s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (trim(name) = '') AS empty,
    count(*) FILTER ({folded_sql('name')} = {folded_sql('pin_number')}) AS same,
    count(*) FILTER (regexp_matches(name, '[一-鿿]')) AS dirty, count(*) FILTER (length(name) > 24) AS long,
    count(*) FILTER (side = 'unknown') AS unknown, min(side) AS s0, max(side) AS s1,
    count(*) FILTER (NOT regexp_matches(trim(pin_number), '^[0-9]+$')) AS not_numeric FROM pins GROUP BY 1),
  st AS (SELECT d.*, coalesce(n, 0) AS n, empty, same, dirty, long, unknown, s0, s1, not_numeric FROM docs d LEFT JOIN s USING (doc_id)),
  dup AS (SELECT doc_id, pin_number FROM pins GROUP BY 1, 2 HAVING count(*) > 1),
  gap AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM st WHERE n > 0 AND not_numeric = 0) g
    WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.doc_id = g.doc_id AND TRY_CAST(p.pin_number AS BIGINT) = g.i)),
  items AS (
    SELECT doc_id, 'pin_numbers_duplicated' AS code, 0 AS rank, pin_number AS item FROM dup
    UNION ALL SELECT doc_id, 'pin_numbers_not_contiguous', i, CAST(i AS VARCHAR) FROM gap
    UNION ALL SELECT doc_id, 'empty_pin_names', ord, pin_number FROM pins WHERE trim(name) = ''
    UNION ALL SELECT doc_id, 'name_has_non_ascii', ord, pin_number FROM pins WHERE regexp_matches(name, '[一-鿿]')
    UNION ALL SELECT doc_id, 'name_too_long', ord, pin_number FROM pins WHERE length(name) > 24
    UNION ALL SELECT doc_id, 'sides_unknown', ord, pin_number FROM pins WHERE side = 'unknown'),
  top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY rank, item) AS rn, count(*) OVER (PARTITION BY doc_id, code) AS c FROM items),
  detail AS (SELECT doc_id, code, string_agg(item, '、' ORDER BY rn) || CASE WHEN max(c) > 20 THEN '…' ELSE '' END AS detail
    FROM top WHERE rn <= 20 GROUP BY 1, 2),
  f AS (
    SELECT doc_id, 'device_suspicious' AS code, 'warn' AS severity, 0 AS items FROM st WHERE device = ''
      OR (regexp_matches(lower(device), '^[0-9a-f]{{8,}}$') AND regexp_matches(device, '[^A-Za-z]')) OR (file_stem <> '' AND device = file_stem)
    UNION ALL SELECT doc_id, 'no_pins', 'error', 0 FROM st WHERE n = 0
    UNION ALL SELECT doc_id, 'too_few_pins', 'error', n FROM st WHERE n = 1
    UNION ALL SELECT doc_id, 'pin_numbers_duplicated', 'error', count(*) FROM dup GROUP BY 1
    UNION ALL SELECT doc_id, 'pin_numbers_not_contiguous', 'warn', count(*) FROM gap GROUP BY 1
    UNION ALL SELECT doc_id, 'empty_pin_names', CASE WHEN empty = n THEN 'error' ELSE 'warn' END, CASE WHEN empty < n THEN empty ELSE 0 END FROM st WHERE n > 0 AND empty > 0
    UNION ALL SELECT doc_id, 'name_looks_like_number', 'warn', 0 FROM st WHERE n >= 4 AND same >= n * 0.6
    UNION ALL SELECT doc_id, 'name_has_non_ascii', 'warn', dirty FROM st WHERE dirty > 0
    UNION ALL SELECT doc_id, 'name_too_long', 'info', long FROM st WHERE long > 0
    UNION ALL SELECT doc_id, 'sides_unknown', CASE WHEN unknown = n THEN 'error' ELSE 'warn' END, CASE WHEN unknown < n THEN unknown ELSE 0 END FROM st WHERE n > 0 AND unknown > 0
    UNION ALL SELECT doc_id, 'all_pins_one_side', 'error', 0 FROM st WHERE n >= 8 AND unknown = 0 AND s0 = s1),
  findings AS (SELECT doc_id, code, severity, CAST(items AS BIGINT) AS items, CASE WHEN items > 0 THEN coalesce(detail, '') ELSE '' END AS detail
    FROM f LEFT JOIN detail USING (doc_id, code))"""


def _codes(*codes: str) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return STATS + f" SELECT * FROM findings WHERE code IN ({listed})"


def _check(spark, sf, *groups, layout_known=False):
    return findings.check_pins(frame(spark, sf, "pins"), frame(spark, sf, "docs"), groups, layout_known)


@query("a1_number_findings", _codes("no_pins", "too_few_pins", "pin_numbers_duplicated", "pin_numbers_not_contiguous"))
def a1(spark, sf):
    return _check(spark, sf, "numbers")


@query("a2_name_findings", _codes("empty_pin_names", "name_looks_like_number", "name_has_non_ascii", "name_too_long"))
def a2(spark, sf):
    return _check(spark, sf, "names")


@query("a4_device_findings", _codes("device_suspicious"))
def a4(spark, sf):
    return _check(spark, sf, "device")


@query("a5_side_findings", _codes("sides_unknown", "all_pins_one_side"))
def a5(spark, sf):
    return _check(spark, sf, "sides", layout_known=True)


PACKAGE = ctes("pins", "docs", "hint_counts", "name_candidates") + f""", m AS (SELECT *, {PAD} AS pad, {DOCUMENTED} AS doc FROM pins),
  e AS (SELECT doc_id, package, {package_count_sql('package')} AS expected FROM docs),
  s AS (SELECT doc_id, package, expected, count(m.pin_number) AS n, count(*) FILTER (pad) AS pads,
    max(pin_number) FILTER (pad AND doc) AS pad_number, count(*) FILTER (NOT pad) AS peripheral,
    count(DISTINCT pin_number) FILTER (NOT pad) AS d,
    count(DISTINCT pin_number) FILTER (NOT pad AND regexp_matches(pin_number, '^[1-9][0-9]*$') AND TRY_CAST(pin_number AS INT) BETWEEN 1 AND expected) AS good
    FROM e LEFT JOIN m USING (doc_id) GROUP BY 1, 2, 3),
  t AS (SELECT *, coalesce(pads = 1 AND pad_number = CAST(expected + 1 AS VARCHAR), false) AS documented,
    coalesce(peripheral = expected AND d = expected AND good = expected, false) AS exact FROM s),
  u AS (SELECT *, CASE WHEN documented THEN peripheral ELSE n END AS observed,
    doc_id IN (SELECT doc_id FROM hint_counts) AS hinted, (doc_id, n) IN (SELECT (doc_id, CAST(pin_count AS BIGINT)) FROM hint_counts) AS hit,
    (doc_id, package) IN (SELECT (doc_id, label) FROM name_candidates WHERE label <> '') AS listed FROM t)
  SELECT doc_id, 'exposed_pad' AS code, 'info' AS severity, CAST(0 AS BIGINT) AS items FROM u WHERE n > 0 AND expected IS NOT NULL AND documented AND exact
  UNION ALL SELECT doc_id, 'peripheral_numbers_mismatch', 'error', 0 FROM u WHERE n > 0 AND documented AND NOT exact AND expected = observed
  UNION ALL SELECT doc_id, 'pin_count_mismatch', 'error', CASE WHEN expected IS NULL THEN 0 ELSE abs(expected - observed) END FROM u WHERE n > 0
    AND ((expected IS NOT NULL AND NOT (documented AND exact) AND expected <> observed) OR (expected IS NULL AND hinted AND NOT hit))
  UNION ALL SELECT doc_id, 'package_unknown', 'warn', 0 FROM u WHERE package = ''
  UNION ALL SELECT doc_id, 'package_ambiguous', 'info', 0 FROM u WHERE package <> '' AND NOT listed"""


@query("a3_package_findings", PACKAGE)
def a3(spark, sf):
    return findings.package_findings(frame(spark, sf, "pins"), frame(spark, sf, "docs"), frame(spark, sf, "hint_counts"),
                                     frame(spark, sf, "name_candidates")).drop("detail")


REVIEW = ctes("pins", "observed", "figure_pins") + DIFFERENCES + FIRST + FIGURE + CONFLICTS + f""",
  cur AS (SELECT doc_id, pin_number, arg_max(name, ord) AS cname, arg_max(side, ord) AS cside FROM pins GROUP BY 1, 2),
  r AS (SELECT doc_id, CASE kind WHEN 'missing' THEN 'review_missing' WHEN 'extra' THEN 'review_extra' WHEN 'name' THEN 'review_name_mismatch'
      ELSE 'review_side_mismatch' END AS code, CASE kind WHEN 'side' THEN 'info' ELSE 'warn' END AS severity
    FROM differences LEFT JOIN cur USING (doc_id, pin_number)
    WHERE kind IN ('missing', 'extra') OR cname IS NULL OR (kind = 'name' AND {folded_sql('cname')} <> {folded_sql('observed')})
      OR (kind = 'side' AND cside <> observed))
  SELECT doc_id, code, severity, count(*) AS items FROM r GROUP BY ALL
  UNION ALL SELECT doc_id, 'conflicts_unresolved', 'warn', count(*) FROM conflicts GROUP BY 1"""


@query("a6_review_findings", REVIEW)
def a6(spark, sf):
    pins = frame(spark, sf, "pins")
    conflicts = _conflicts(spark, sf).withColumn("resolved", F.lit(None).cast("string"))
    return findings.review_findings(pins, channels.review_differences(pins, frame(spark, sf, "observed")), conflicts)


@query("a7_check_rollup", STATS + """, c AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS n_error,
    count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info
    FROM findings WHERE code <> 'all_pins_one_side' GROUP BY 1),
  z AS (SELECT doc_id, coalesce(n_error, 0) AS n_error, coalesce(n_warn, 0) AS n_warn, coalesce(n_info, 0) AS n_info FROM docs LEFT JOIN c USING (doc_id))
  SELECT *, greatest(0, 100 - 25 * n_error - 5 * n_warn) AS score,
    CASE WHEN n_error > 0 THEN 'broken' WHEN n_warn > 0 THEN 'suspect' ELSE 'ok' END AS verdict FROM z""")
def a7(spark, sf):
    docs = frame(spark, sf, "docs")
    return findings.report(findings.check_severities(frame(spark, sf, "pins"), docs), docs)


# --- layout --------------------------------------------------------------------------------------------------
@query("w1_order_within_side", ctes("pins") + """ SELECT doc_id, ord, side,
    CAST(row_number() OVER (PARTITION BY doc_id, side ORDER BY ord, pin_number) - 1 AS INT) AS side_order FROM pins""")
def w1(spark, sf):
    pins = frame(spark, sf, "pins").select("doc_id", "ord", "side", "pin_number")
    return layout.order_within_side(pins, [F.col("ord"), F.col("pin_number")], wide()).drop("pin_number")


@query("w2_symbol_layout", ctes("pins") + """, p AS (SELECT *, CASE WHEN side = 'unknown' THEN 'left' ELSE side END AS s FROM pins),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY side_order, ord) - 1 AS i, count(*) OVER (PARTITION BY doc_id, s) AS c,
    count(*) FILTER (s = 'left') OVER (PARTITION BY doc_id) AS l, count(*) FILTER (s = 'right') OVER (PARTITION BY doc_id) AS r,
    count(*) FILTER (s = 'top') OVER (PARTITION BY doc_id) AS t, count(*) FILTER (s = 'bottom') OVER (PARTITION BY doc_id) AS b FROM p),
  h AS (SELECT *, greatest(l, r) * 10 AS hh, greatest(50, greatest(t, b) * 10 + 10) AS hw, i * 20 - (c * 10 - 10) AS a FROM r)
  SELECT doc_id, pin_number, name, s AS side, CASE s WHEN 'left' THEN -hw WHEN 'right' THEN hw ELSE a END AS x,
    CASE s WHEN 'top' THEN -hh WHEN 'bottom' THEN hh ELSE a END AS y,
    CASE s WHEN 'left' THEN -hw - 10 WHEN 'right' THEN hw + 10 ELSE a END AS hx,
    CASE s WHEN 'top' THEN -hh - 10 WHEN 'bottom' THEN hh + 10 ELSE a END AS hy, hw * 2 AS body_width, hh * 2 AS body_height FROM h""")
def w2(spark, sf):
    return layout.symbol_layout(frame(spark, sf, "pins"), F.floor(F.col("side_order") / 4096))


@query("t2_natural_pin_order", ctes("pins") + """ SELECT doc_id, pin_number, ord, row_number() OVER (PARTITION BY doc_id
    ORDER BY TRY_CAST(pin_number AS BIGINT) IS NULL, TRY_CAST(pin_number AS BIGINT), pin_number, ord) AS position FROM pins""")
def t2(spark, sf):
    pins = frame(spark, sf, "pins").select("doc_id", "pin_number", "ord")
    number = F.col("pin_number").try_cast("bigint")
    bucket = F.when(number.isNotNull(), F.struct(F.lit(False).alias("text"), F.floor(number / 4096).alias("block"), F.lit("").alias("head"))).otherwise(
        F.struct(F.lit(True).alias("text"), F.lit(0).cast("bigint").alias("block"), F.substring("pin_number", 1, 2).alias("head")))
    return layout.natural_rank(pins, bucket)
