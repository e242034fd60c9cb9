"""Dimension groups, stacked ranges, review candidates and name verdicts on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import channels, fusion, groups
from .registry import query
from .shapes import ctes, frame


def _frames(spark, sf, *names):
    return [frame(spark, sf, n) for n in names]


def joined(df, *arrays):
    return df.withColumns({a: F.array_join(a, "|") for a in arrays})


CENTRES = ctes("region_tokens_base") + ", t AS (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, greatest(1, y2 - y1) AS h FROM region_tokens_base)"


@query("w9_key_value_rows", CENTRES + """, r AS (SELECT doc_id, source_region_id, greatest(8.0, median(h) * 0.8) AS tol FROM t GROUP BY 1, 2),
  p AS (SELECT l.doc_id, l.source_region_id, l.id AS label_id, v.id AS value_id, v.text, least(l.confidence, v.confidence) AS confidence, row_number() OVER (PARTITION BY l.doc_id, l.id ORDER BY abs(v.cy - l.cy), v.x1, v.ord) AS rn
    FROM t l JOIN r USING (doc_id, source_region_id) JOIN t v ON v.doc_id = l.doc_id AND v.source_region_id = l.source_region_id AND v.id <> l.id AND v.x1 > l.x2 AND abs(v.cy - l.cy) <= tol AND regexp_matches(v.text, '\\d') WHERE regexp_matches(trim(l.text), '(?i)^dimension\\s+\\S+'))
  SELECT doc_id, source_region_id, label_id, value_id, 'nom' AS column, CASE WHEN regexp_matches(text, '(?i)\\bmm\\b') THEN 'mm' ELSE 'unknown' END AS unit, confidence FROM p WHERE rn = 1""".replace("AS column", 'AS "column"'))
def w9_key_value(spark, sf):
    return groups.key_value_rows(frame(spark, sf, "region_tokens_base"))


@query("w9_pin_matrix_rows", CENTRES + """, n AS (SELECT doc_id, arg_max(CAST(regexp_extract(text, '(\\d+)', 1) AS INT), (confidence, -ord)) AS n FROM t WHERE confidence >= 0.8 AND text LIKE '%PINS' GROUP BY 1),
  hd AS (SELECT doc_id, source_region_id, arg_min(id, ord) AS hid, arg_min(cx, ord) AS hx FROM t JOIN n USING (doc_id) WHERE confidence >= 0.8 AND trim(text) = CAST(n AS VARCHAR) GROUP BY 1, 2),
  lb AS (SELECT doc_id, source_region_id, lower(split_part(text, ' ', 2)) AS col, arg_min(id, ord) AS lid, arg_min(cy, ord) AS ly, arg_min(h, ord) AS lh, arg_min(confidence, ord) AS lc FROM t WHERE text IN ('A MAX', 'A MIN') GROUP BY 1, 2, 3),
  p AS (SELECT v.doc_id, v.source_region_id, lid AS label_id, v.id AS value_id, col, least(lc, v.confidence) AS confidence, hid AS context_id, row_number() OVER (PARTITION BY v.doc_id, v.source_region_id, col ORDER BY abs(v.cx - hx), v.confidence DESC, v.ord) AS rn
    FROM t v JOIN lb USING (doc_id, source_region_id) JOIN hd USING (doc_id, source_region_id) WHERE regexp_matches(trim(v.text), '^\\d+(?:[.,]\\d+)?$') AND v.id <> hid AND abs(v.cy - ly) <= greatest(10, lh) * 1.2)
  SELECT doc_id, source_region_id, label_id, value_id, col AS "column", 'mm' AS unit, confidence, context_id FROM p WHERE rn = 1""")
def w9_matrix(spark, sf):
    return groups.pin_matrix_rows(frame(spark, sf, "region_tokens_base"))


# Token after token from the top, against the row before
W8 = ctes("crowded_cells").replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT doc_id, source_region_id, id, ord, (y1 + y2) / 2.0 AS cy, greatest(1, y2 - y1) AS h FROM crowded_cells),
  r AS (SELECT doc_id, source_region_id, greatest(6.0, median(h) * 0.65) AS reach FROM t WHERE cy > 44 GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_region_id ORDER BY cy, ord) AS rn FROM t JOIN r USING (doc_id, source_region_id) WHERE cy > 44),
  s AS (SELECT DISTINCT doc_id, source_region_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS id FROM o
    UNION ALL SELECT doc_id, source_region_id, rn, CASE WHEN fits THEN total + cy ELSE cy END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN place ELSE place + 1 END, id
    FROM (SELECT o.doc_id, o.source_region_id, o.rn, o.id, CAST(o.cy AS DOUBLE) AS cy, s.total, s.n, s.place, s.n > 0 AND abs(o.cy - s.total / s.n) <= o.reach AS fits
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.source_region_id = s.source_region_id AND o.rn = s.rn + 1))
  SELECT doc_id, source_region_id, id, place FROM s WHERE rn > 0"""


@query("w8_clustered_cells", W8)
def w8_cells(spark, sf):
    cells = frame(spark, sf, "crowded_cells")
    places = groups.cluster_rows(cells, cells.select(*groups.REGION).distinct().withColumn("head_y", F.lit(40)))
    rank = F.dense_rank().over(Window.partitionBy(*groups.REGION).orderBy("chain", "row_no"))
    return places.select(*groups.REGION, "id", rank.cast("long").alias("place"))


# The columns from the head words, the rows token after token from the top, then what stands in each row
W8_ROWS = ctes("grid_tokens", "head_tokens").replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, greatest(1, y2 - y1) AS h, lower(trim(text)) AS raw, regexp_replace(lower(trim(text)), '[^a-z]', '', 'g') AS w
      FROM (SELECT * FROM grid_tokens UNION ALL BY NAME SELECT * FROM head_tokens)),
  tops AS (SELECT doc_id, source_region_id, min(y1) AS top FROM t WHERE w IN ('min', 'nom', 'typ', 'max') GROUP BY ALL HAVING count(*) >= 3),
  units AS (SELECT doc_id, source_region_id, avg(cx) FILTER (raw LIKE '%millimet%' OR raw LIKE 'miimet%' OR raw LIKE 'milimet%') AS mx, avg(cx) FILTER (raw LIKE '%inch%') AS ix FROM t JOIN tops USING (doc_id, source_region_id) WHERE y1 < top GROUP BY ALL),
  heads AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id, source_region_id ORDER BY cx, ord) AS place, CASE w WHEN 'typ' THEN 'nom' ELSE w END AS name FROM t JOIN tops USING (doc_id, source_region_id) LEFT JOIN units USING (doc_id, source_region_id)
    WHERE w IN ('min', 'nom', 'typ', 'max') AND (mx IS NULL OR ix IS NULL OR (cx < (mx + ix) / 2) = (mx < ix)) QUALIFY place <= 3),
  spread AS (SELECT doc_id, source_region_id, arg_max(cx, place) FILTER (name = 'min') AS xmin, arg_max(cx, place) FILTER (name = 'nom') AS xnom, arg_max(cx, place) FILTER (name = 'max') AS xmax, max(y2) AS head_y, min(cx) AS c1,
    max(cx) FILTER (place = 2) - c1 AS a, max(cx) - max(cx) FILTER (place = 2) AS b, CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 WHEN a > 0 THEN a WHEN b > 0 THEN b END AS step FROM heads GROUP BY ALL),
  layout AS (SELECT *, greatest(12.0, step * 0.48) AS reach, CAST(trunc(c1 - step * 0.55) AS INT) AS label_right FROM spread WHERE step IS NOT NULL AND xmin IS NOT NULL AND xnom IS NOT NULL AND xmax IS NOT NULL),
  d AS (SELECT t.*, xmin, xnom, xmax, reach, label_right FROM t JOIN layout USING (doc_id, source_region_id) WHERE cy > head_y + 4),
  tol AS (SELECT doc_id, source_region_id, greatest(6.0, median(h) * 0.65) AS tol FROM d GROUP BY ALL),
  o AS (SELECT d.*, tol, row_number() OVER v AS rn, cy - lag(cy) OVER v > tol AS gap FROM d JOIN tol USING (doc_id, source_region_id) WINDOW v AS (PARTITION BY d.doc_id, d.source_region_id ORDER BY cy, ord)),
  s AS (SELECT DISTINCT doc_id, source_region_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chain, CAST(-1 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS id FROM o
    UNION ALL SELECT doc_id, source_region_id, rn, CASE WHEN fits THEN total + cy ELSE cy END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN gap THEN chain + 1 ELSE chain END, CASE WHEN fits THEN place WHEN gap THEN 0 ELSE place + 1 END, id
    FROM (SELECT o.doc_id, o.source_region_id, o.rn, o.id, CAST(o.cy AS DOUBLE) AS cy, coalesce(o.gap, false) AS gap, s.total, s.n, s.chain, s.place, s.n > 0 AND abs(o.cy - s.total / s.n) <= o.tol AS fits
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.source_region_id = s.source_region_id AND o.rn = s.rn + 1)),
  r AS (SELECT o.*, s.chain, CAST(s.place AS INT) AS row_no, length(regexp_replace(text, '[^A-Za-zΑ-ωα-ω]', '', 'g')) AS letters FROM o JOIN s USING (doc_id, source_region_id, rn)),
  l AS (SELECT doc_id, source_region_id, chain, row_no, string_agg(text, ' ' ORDER BY x1, ord, id) AS label, string_agg(id, '|' ORDER BY x1, ord, id) AS label_ids, max(confidence) AS lc FROM r
    WHERE cx < label_right AND letters > 0 AND (letters >= 3 OR regexp_matches(trim(text), '^[A-Za-zΑ-ωα-ω][A-Za-z0-9Α-ωα-ω]*$')) GROUP BY ALL),
  c AS (SELECT doc_id, source_region_id, chain, row_no, id, confidence, ord, cx, reach, unnest(['min', 'nom', 'max']) AS name, unnest([xmin, xnom, xmax]) AS hx FROM r WHERE regexp_matches(text, '[0-9]')),
  v AS (SELECT doc_id, source_region_id, chain, row_no, name, arg_min(id, (abs(cx - hx), -confidence, ord)) AS id, arg_min(confidence, (abs(cx - hx), -confidence, ord)) AS confidence FROM c WHERE abs(cx - hx) <= reach GROUP BY ALL),
  g AS (SELECT doc_id, source_region_id, chain, row_no, max(id) FILTER (name = 'min') AS min_id, max(id) FILTER (name = 'nom') AS nom_id, max(id) FILTER (name = 'max') AS max_id, max(confidence) FILTER (name = 'nom') AS nc, max(confidence) FILTER (name = 'max') AS mc FROM v GROUP BY ALL)
  SELECT doc_id, source_region_id, chain, row_no, label, label_ids, min_id, nom_id, max_id, CASE WHEN nom_id IS NOT NULL THEN 'nom' ELSE 'max' END AS "column",
    CASE WHEN lower(label) LIKE '%number of%' THEN 'count' WHEN lower(label) LIKE '%angle%' THEN 'deg' ELSE 'mm' END AS unit, least(lc, CASE WHEN nom_id IS NOT NULL THEN nc ELSE mc END) AS confidence
  FROM l JOIN g USING (doc_id, source_region_id, chain, row_no) WHERE nom_id IS NOT NULL OR max_id IS NOT NULL"""


@query("w8_table_rows", W8_ROWS)
def w8(spark, sf):
    return joined(groups.table_rows(frame(spark, sf, "grid_tokens").unionByName(frame(spark, sf, "head_tokens"))), "label_ids")


# Group after group of a view, against all stacks so far with the same lines
W10 = ctes("line_stacks").replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, view_id, line ORDER BY ord) AS rn FROM line_stacks),
  s AS (SELECT DISTINCT doc_id, view_id, line, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)[]) AS held, CAST(0 AS BIGINT) AS home FROM o
    UNION ALL SELECT doc_id, view_id, line, rn, CASE WHEN hit IS NULL THEN list_append(held, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) ELSE list_transform(held, lambda d, i: CASE WHEN i = hit
        THEN {'x1': least(d.x1, x1), 'y1': least(d.y1, y1), 'x2': greatest(d.x2, x2), 'y2': greatest(d.y2, y2)} ELSE d END) END, coalesce(hit, len(held) + 1)
    FROM (SELECT o.doc_id, o.view_id, o.line, o.rn, CAST(o.x1 AS INT) AS x1, CAST(o.y1 AS INT) AS y1, CAST(o.x2 AS INT) AS x2, CAST(o.y2 AS INT) AS y2, s.held,
        list_min(list_filter(list_transform(s.held, lambda d, i: CASE WHEN greatest(o.x1, d.x1) <= least(o.x2, d.x2) + 20 AND abs((o.y1 + o.y2) / 2.0 - (d.y1 + d.y2) / 2.0) <= 90 THEN i END), lambda i: i IS NOT NULL)) AS hit
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.view_id = s.view_id AND o.line = s.line AND o.rn = s.rn + 1))
  SELECT doc_id, view_id, line AS dimension_line_ids, min(o.ord) AS ord, CAST(min(x1) AS INT) AS x1, CAST(min(y1) AS INT) AS y1, CAST(max(x2) AS INT) AS x2, CAST(max(y2) AS INT) AS y2, min(confidence) AS confidence, string_agg(token, '|' ORDER BY o.rn) AS token_ids
  FROM o JOIN s USING (doc_id, view_id, line, rn) GROUP BY doc_id, view_id, line, home"""


@query("w10_stacked_groups", W10)
def w10_stacks(spark, sf):
    rows = frame(spark, sf, "line_stacks").withColumns({"token_ids": F.array("token"), "dimension_line_ids": F.array("line"), "extension_line_ids": F.array().cast("array<string>"),
                                                        "arrow_ids": F.array().cast("array<string>")})
    out = groups.merge_stacked(rows.drop("token", "line"))
    return joined(out, "token_ids", "dimension_line_ids").select("doc_id", "view_id", "dimension_line_ids", "ord", *groups.BOX, "confidence", "token_ids")


def _once(items: str) -> str:
    return f"array_to_string(list_filter({items}, lambda x, i: list_position({items}, x) = i), '|')"


# Texts without fragments and crossings, their nearest lines over all pairs of a document, then group after group against the stacks of its lines
W10_GROUPS = ctes("region_tokens_base", "region_lines").replace("WITH", "WITH RECURSIVE", 1) + f""", t AS (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, regexp_matches(text, '(?i)\\b[0-9]{{1,3}}\\s*[-–—]?\\s*(lead|pin|circuit)s?\\b') AS counts FROM region_tokens_base),
  wanted AS (SELECT * FROM t WHERE confidence >= 0.55 AND (counts OR regexp_matches(text, '(?i)[ØΦ±]|REF|UNC|\\([^)]*[0-9][^)]*\\)|(^|[^0-9])[.]?[0-9]+([.][0-9]+)?'))),
  met AS (SELECT a.doc_id, a.id, a.rotation_deg AS ar, b.rotation_deg AS br, b.text, b.confidence AS bc, length(trim(b.text)) > length(trim(a.text)) AS longer, greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) AS own,
      greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS area
    FROM wanted a JOIN t b ON a.doc_id = b.doc_id AND a.source_region_id = b.source_region_id AND a.id <> b.id AND NOT a.counts),
  bad AS (SELECT doc_id, id FROM met GROUP BY ALL HAVING count(*) FILTER (bc >= 0.8 AND longer AND area / own >= 0.6) > 0 OR count(*) FILTER (ar <> 0 AND br = 0 AND area > 0 AND regexp_matches(text, '[0-9]')) >= 2),
  used AS (SELECT w.* FROM wanted w ANTI JOIN bad b ON b.doc_id = w.doc_id AND b.id = w.id),
  reach AS (SELECT doc_id, greatest(35.0, median(greatest(1, y2 - y1)) * 3.0) AS reach FROM t GROUP BY 1),
  ln AS (SELECT *, (lx1 + lx2) / 2.0 AS lx, (ly1 + ly2) / 2.0 AS ly, CASE WHEN abs(ly2 - ly1) <= greatest(4.0, abs(lx2 - lx1) * 0.05) THEN 'horizontal' WHEN abs(lx2 - lx1) <= greatest(4.0, abs(ly2 - ly1) * 0.05) THEN 'vertical' ELSE 'oblique' END AS dir FROM region_lines),
  links AS (SELECT t.doc_id, t.id, line_id, row_number() OVER (PARTITION BY t.doc_id, t.id ORDER BY sqrt((cx - lx) ** 2 + (cy - ly) ** 2), ln.ord) AS rank FROM t JOIN reach USING (doc_id) JOIN ln ON ln.doc_id = t.doc_id
    WHERE sqrt((cx - lx) ** 2 + (cy - ly) ** 2) <= reach QUALIFY rank <= 6),
  dims AS (SELECT * FROM used WHERE NOT counts),
  near AS (SELECT d.doc_id, d.id, ln.line_id, row_number() OVER (PARTITION BY d.doc_id, d.id ORDER BY sqrt((cx - lx) ** 2 + (cy - ly) ** 2), ln.ord) AS rank FROM dims d JOIN ln ON ln.doc_id = d.doc_id AND ln.source_region_id = d.source_region_id ANTI JOIN links k ON k.doc_id = d.doc_id AND k.id = d.id
    WHERE regexp_matches(translate(d.text, ',−', '.-'), '(?i)^\\s*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)\\s*[-–—]\\s*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)\\s*$') AND sqrt((cx - lx) ** 2 + (cy - ly) ** 2) <= 140 QUALIFY rank = 1),
  linked AS (SELECT *, CAST(0.9 AS DOUBLE) AS lc FROM links UNION ALL SELECT *, CAST(0.75 AS DOUBLE) FROM near),
  placed AS (SELECT k.doc_id, k.id, k.rank, k.lc, ln.*, ln.type = 'dimension_line' AS is_dim, row_number() OVER (PARTITION BY k.doc_id, k.id, ln.type = 'dimension_line' ORDER BY rank) AS p FROM linked k JOIN dims d ON d.doc_id = k.doc_id AND d.id = k.id JOIN ln ON ln.doc_id = k.doc_id AND ln.line_id = k.line_id
    QUALIFY p <= CASE WHEN is_dim THEN 2 ELSE 3 END),
  picked AS (SELECT doc_id, id, coalesce(list(line_id ORDER BY rank) FILTER (is_dim), []) AS dl, coalesce(list(line_id ORDER BY rank) FILTER (NOT is_dim), []) AS el, flatten(list(arrow_ids ORDER BY NOT is_dim, rank)) AS al, arg_min(dir, (NOT is_dim, rank)) AS dir,
    min(least(lx1, lx2)) AS bx1, min(least(ly1, ly2)) AS by1, max(greatest(lx1, lx2)) AS bx2, max(greatest(ly1, ly2)) AS by2, max(lc) AS lc FROM placed GROUP BY ALL),
  g AS (SELECT d.doc_id, d.source_region_id AS view_id, d.ord, d.id, CAST(least(x1, bx1) AS INT) AS x1, CAST(least(y1, by1) AS INT) AS y1, CAST(greatest(x2, bx2) AS INT) AS x2, CAST(greatest(y2, by2) AS INT) AS y2, dl, el, al, dir, least(confidence, lc) AS confidence, array_to_string(list_sort(dl), '|') AS lines
    FROM dims d JOIN picked p USING (doc_id, id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, view_id, lines ORDER BY ord, id) AS rn FROM g WHERE lines <> ''),
  s AS (SELECT DISTINCT doc_id, view_id, lines, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)[]) AS held, CAST(0 AS BIGINT) AS home FROM o
    UNION ALL SELECT doc_id, view_id, lines, rn, CASE WHEN hit IS NULL THEN list_append(held, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE list_transform(held, lambda d, i: CASE WHEN i = hit
        THEN {{'x1': least(d.x1, x1), 'y1': least(d.y1, y1), 'x2': greatest(d.x2, x2), 'y2': greatest(d.y2, y2)}} ELSE d END) END, coalesce(hit, len(held) + 1)
    FROM (SELECT o.doc_id, o.view_id, o.lines, o.rn, o.x1, o.y1, o.x2, o.y2, s.held,
        list_min(list_filter(list_transform(s.held, lambda d, i: CASE WHEN greatest(o.x1, d.x1) <= least(o.x2, d.x2) + 20 AND abs((o.y1 + o.y2) / 2.0 - (d.y1 + d.y2) / 2.0) <= 90 THEN i END), lambda i: i IS NOT NULL)) AS hit
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.view_id = s.view_id AND o.lines = s.lines AND o.rn = s.rn + 1)),
  m AS (SELECT o.doc_id, o.view_id, s.home, min(o.ord) AS ord, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, list(o.id ORDER BY o.rn) AS ids, arg_min(dl, o.rn) AS dl, flatten(list(el ORDER BY o.rn)) AS el, flatten(list(al ORDER BY o.rn)) AS al, arg_min(dir, o.rn) AS dir, min(confidence) AS confidence
    FROM o JOIN s USING (doc_id, view_id, lines, rn) GROUP BY o.doc_id, o.view_id, lines, s.home),
  every AS (SELECT doc_id, view_id, ord, x1, y1, x2, y2, ids, dl, el, al, dir, confidence FROM m UNION ALL SELECT doc_id, view_id, ord, x1, y1, x2, y2, [id], dl, el, al, dir, confidence FROM g WHERE lines = '')
  SELECT doc_id, view_id, 'dimension_line' AS evidence_type, ord, x1, y1, x2, y2, {_once('ids')} AS token_ids, array_to_string(dl, '|') AS dimension_line_ids, {_once('el')} AS extension_line_ids, {_once('al')} AS arrow_ids, dir AS orientation, confidence FROM every
  UNION ALL SELECT doc_id, source_region_id, 'identity_text', ord, x1, y1, x2, y2, id, '', '', '', 'horizontal', confidence FROM used WHERE counts"""


@query("w10_dimension_groups", W10_GROUPS)
def w10(spark, sf):
    out = groups.dimension_groups(*_frames(spark, sf, "region_tokens_base", "region_lines"))
    return joined(out, "token_ids", "dimension_line_ids", "extension_line_ids", "arrow_ids")


@query("t4_selected_groups")
def t4(spark, sf):
    tokens, lines, grid, heads = _frames(spark, sf, "region_tokens_base", "region_lines", "grid_tokens", "head_tokens")
    rows = groups.table_groups(tokens.unionByName(grid).unionByName(heads))
    return groups.select_groups(groups.dimension_groups(tokens, lines).unionByName(rows, allowMissingColumns=True))


# Every two values of a view against the rules, and every line of the view against the slot between them
STACKED = """, v AS (SELECT *, CAST(replace(text, ',', '.') AS DOUBLE) AS value FROM stack_tokens WHERE unit_context = 'mm' AND source_region_id <> 'unassigned' AND value_role NOT LIKE 'table\\_%' ESCAPE '\\'
    AND regexp_matches(trim(text), '^[0-9]+(?:[.,][0-9]+)?$') AND x2 > x1),
  slots AS (SELECT a.doc_id, a.source_region_id, a.id AS upper, b.id AS lower, a.value AS high, b.value AS low, least(a.x2 - a.x1, b.x2 - b.x1) AS w, greatest(a.y2 - a.y1, b.y2 - b.y1) AS h, b.y1 - a.y2 AS gap, a.y2 AS top, b.y1 AS bottom,
      greatest(a.x1, b.x1) AS ix1, least(a.x2, b.x2) AS ix2, least(a.x1, b.x1) AS ox1, greatest(a.x2, b.x2) AS ox2, abs((a.x1 + a.x2) - (b.x1 + b.x2)) / 2.0 AS shift
    FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.source_region_id = b.source_region_id AND a.id <> b.id AND a.value > b.value),
  stacked AS (SELECT s.doc_id, s.source_region_id, upper, lower, arg_min(line_id, ord) AS line_id, any_value(high) AS high, any_value(low) AS low FROM slots s JOIN stack_lines l ON l.doc_id = s.doc_id AND l.source_region_id = s.source_region_id
    WHERE h > 0 AND gap BETWEEN 0 AND h * 0.65 AND shift <= w * 0.2 AND ix2 - ix1 >= w * 0.8 AND abs(ly2 - ly1) <= h * 0.1 AND (ly1 + ly2) / 2.0 BETWEEN top AND bottom
      AND least(greatest(lx1, lx2), ix2) - greatest(least(lx1, lx2), ix1) >= w * 0.6 AND least(lx1, lx2) >= ox1 - w * 0.2 AND greatest(lx1, lx2) <= ox2 + w * 0.2 GROUP BY ALL)"""


@query("j21_stacked_pairs", ctes("stack_tokens", "stack_lines") + STACKED + " SELECT doc_id, source_region_id, upper, lower, line_id FROM stacked")
def j21_pairs(spark, sf):
    return groups.stacked_pairs(*_frames(spark, sf, "stack_tokens", "stack_lines"))


# Assignments of the fixture with their tokens; pairs of a view are then decided one upper assignment after the other
RECONCILED = ctes("stack_slots", "stack_tokens", "stack_lines").replace("WITH", "WITH RECURSIVE", 1) + STACKED + """, g AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey * 4 + k AS aid, CASE WHEN k = 0 OR o_orderkey % 3 = 0 THEN 'body_length' ELSE 'body_width' END AS name,
      CASE WHEN k = 2 THEN [CAST(o_orderkey AS VARCHAR) || '_2', CAST(o_orderkey AS VARCHAR) || '_3'] ELSE [CAST(o_orderkey AS VARCHAR) || '_' || CAST(k AS VARCHAR)] END AS tokens, 'l' || CAST(o_orderkey AS VARCHAR) || '_0' AS line FROM stack_slots WHERE k < 3),
  one AS (SELECT doc_id, aid, name, tokens[1] AS id, line FROM g WHERE len(tokens) = 1 AND NOT regexp_matches(name, '(_deg|_count)$')),
  outer_ AS (SELECT o.doc_id, o.aid, list(DISTINCT o.line) AS outs FROM one o JOIN stack_lines l ON l.doc_id = o.doc_id AND l.line_id = o.line AND l.type = 'dimension_line' JOIN stack_tokens t ON t.doc_id = o.doc_id AND t.id = o.id
    WHERE NOT (l.lx1 BETWEEN t.x1 - greatest(1, (t.y2 - t.y1) * 0.1) AND t.x2 + greatest(1, (t.y2 - t.y1) * 0.1) AND l.ly1 BETWEEN t.y1 - greatest(1, (t.y2 - t.y1) * 0.1) AND t.y2 + greatest(1, (t.y2 - t.y1) * 0.1))
      OR NOT (l.lx2 BETWEEN t.x1 - greatest(1, (t.y2 - t.y1) * 0.1) AND t.x2 + greatest(1, (t.y2 - t.y1) * 0.1) AND l.ly2 BETWEEN t.y1 - greatest(1, (t.y2 - t.y1) * 0.1) AND t.y2 + greatest(1, (t.y2 - t.y1) * 0.1)) GROUP BY ALL),
  a AS (SELECT one.*, coalesce(outs, []) AS outs FROM one LEFT JOIN outer_ USING (doc_id, aid)),
  labels AS (SELECT doc_id, id FROM stack_tokens t WHERE EXISTS (SELECT 1 FROM stack_tokens b WHERE b.doc_id = t.doc_id AND b.source_region_id = t.source_region_id AND regexp_matches(b.text, '[A-Za-zΑ-ω]'))),
  p AS (SELECT s.*, u.aid AS ua, l.aid AS la, u.name AS un, l.name AS ln, list_filter(u.outs, lambda x: x <> s.line_id) AS uo, list_filter(l.outs, lambda x: x <> s.line_id) AS lo FROM stacked s JOIN a u ON u.doc_id = s.doc_id AND u.id = s.upper
    JOIN a l ON l.doc_id = s.doc_id AND l.id = s.lower AND l.aid <> u.aid),
  ranges AS (SELECT g.doc_id, g.name, s.source_region_id AS region, s.low, s.high FROM g JOIN stacked s ON s.doc_id = g.doc_id AND len(g.tokens) = 2 AND list_contains(g.tokens, s.upper) AND list_contains(g.tokens, s.lower)),
  j AS (SELECT doc_id, source_region_id, ua, la, line_id, NOT (upper IN (SELECT id FROM labels) OR lower IN (SELECT id FROM labels) OR (len(uo) > 0 AND len(lo) > 0 AND list_sort(uo) <> list_sort(lo)))
      AND (un = ln OR (len(list_filter(lo, lambda x: NOT list_contains(uo, x))) = 0 AND EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = p.doc_id AND r.name = p.ln AND r.region <> p.source_region_id AND r.low <= p.low AND p.low <= r.high AND r.high < p.high))) AS ok FROM p),
  offered AS (SELECT doc_id, source_region_id, ua, list({'la': la, 'ok': ok, 'line': line_id} ORDER BY la) AS offers FROM j GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_region_id ORDER BY ua) AS rn FROM offered),
  s AS (SELECT DISTINCT doc_id, source_region_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS ua, CAST(NULL AS BIGINT) AS la, CAST(NULL AS VARCHAR) AS line FROM o
    UNION ALL SELECT doc_id, source_region_id, rn, CASE WHEN takes THEN list_concat(used, [ua, left_[1].la]) ELSE used END, ua, CASE WHEN takes THEN left_[1].la END, CASE WHEN takes THEN left_[1].line END
    FROM (SELECT *, len(left_) = 1 AND left_[1].ok AND NOT list_contains(used, ua) AS takes FROM (SELECT o.doc_id, o.source_region_id, o.rn, CAST(o.ua AS BIGINT) AS ua, s.used, list_filter(o.offers, lambda x: NOT list_contains(s.used, x.la)) AS left_
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.source_region_id = s.source_region_id AND o.rn = s.rn + 1)))
  SELECT doc_id, ua AS upper_assignment, la AS lower_assignment, line AS line_id FROM s WHERE la IS NOT NULL"""


@query("j21_reconciled_ranges", RECONCILED)
def j21(spark, sf):
    return groups.reconcile_stacked(*_frames(spark, sf, "stack_assignments", "stack_tokens", "stack_lines"))


# By the four kinds of pins in the fixture: a channel's 0 read as O, a pad by another name, a blank inside a name, a review that is out of date
J15 = """WITH k AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, CAST(c_custkey AS VARCHAR) AS pin_number, c_custkey % 4 AS kind,
    0.85 + (c_custkey % 15) / CAST(100 AS DOUBLE) BETWEEN 0.9 AND 1.0 AND c_custkey % 13 <> 0 AS sure, c_custkey % 3 <> 0 AND c_custkey % 5 <> 3 AS seen FROM customer)
  SELECT doc_id, pin_number, CASE WHEN kind = 0 AND sure AND seen THEN 'IN0' WHEN kind = 1 AND sure THEN 'EP' WHEN kind = 2 THEN 'VDD' END AS value,
    CASE WHEN kind = 0 AND sure AND seen THEN 'channel_number' WHEN kind = 1 AND sure THEN 'pad_alias' WHEN kind = 2 THEN 'already_equal' END AS reason FROM k"""


@query("j15_name_verdicts", J15)
def j15(spark, sf):
    return channels.name_resolution(*_frames(spark, sf, "name_pins", "name_mismatches", "name_observations"))


# By the six kinds of token texts in the fixture: a label and a pin count hold no measure, the others do
REVIEWED = ctes("review_docs", "ev_assignments", "ev_token_rows", "ev_lines") + """, a AS (SELECT a.*, region_id FROM ev_assignments a JOIN review_docs USING (doc_id)),
  tk AS (SELECT t.doc_id, region_id, token_id, text = '8 PINS' AS counted, text NOT IN ('A1', '8 PINS') AS numeric_, value_role = 'table_nom' AS tabled, source_region_id <> region_id AS strange,
      value_role <> 'table_nom' AND token_id = min(token_id) OVER (PARTITION BY t.doc_id, value_role) AS context, min(token_id) OVER (PARTITION BY t.doc_id, value_role) AS t0, max(token_id) OVER (PARTITION BY t.doc_id, value_role) AS t1
    FROM ev_token_rows t JOIN review_docs USING (doc_id)),
  tr AS (SELECT DISTINCT doc_id, region_id, assignment_id, canonical_name, unnest(token_ids) AS token_id FROM a),
  lr AS (SELECT DISTINCT doc_id, region_id, assignment_id, unnest(line_ids) AS line_id FROM a),
  t AS (SELECT tr.*, numeric_, counted, tabled, strange, context, t0, t1, k.token_id IS NOT NULL AS known FROM tr LEFT JOIN tk k USING (doc_id, region_id, token_id)),
  g AS (SELECT doc_id, region_id, assignment_id, canonical_name, count(*) FILTER (numeric_) AS numbers, count(*) FILTER (numeric_ AND tabled) AS cells, bool_or(canonical_name = 'nominal_pin_count' AND coalesce(counted, false)) AS counted FROM t GROUP BY ALL),
  per AS (SELECT a.doc_id, a.region_id, a.assignment_id, len(line_ids) AS lines, coalesce(numbers, 0) AS numbers, coalesce(cells, 0) AS cells, coalesce(counted, false) AS counted FROM a LEFT JOIN g USING (doc_id, region_id, assignment_id)),
  pr AS (SELECT *, numbers > 0 AND cells = numbers AS table_value, counted AND numbers = 0 AS own_count FROM per),
  rw AS (SELECT DISTINCT doc_id, region_id, assignment_id, t0, t1 FROM t SEMI JOIN (SELECT * FROM pr WHERE table_value) USING (doc_id, region_id, assignment_id) WHERE numeric_ AND tabled AND token_id = t1),
  misfit AS (SELECT doc_id, region_id, assignment_id FROM rw JOIN a USING (doc_id, region_id, assignment_id) GROUP BY ALL HAVING NOT bool_or(len(line_ids) = 0 AND len([x for x in token_ids if x <> t0 AND x <> t1]) = 0)),
  found AS (SELECT doc_id, region_id, NULL::BIGINT AS assignment_id, 'region_mismatch' AS issue FROM review_docs WHERE answered_region_id <> region_id
    UNION ALL SELECT doc_id, region_id, NULL, 'view_mismatch' FROM review_docs WHERE answered_view_type <> view_type
    UNION ALL SELECT DISTINCT doc_id, region_id, assignment_id, 'field_outside_contract' FROM a WHERE canonical_name NOT IN ('total_height', 'pin_span', 'nominal_pin_count', 'overall_width')
    UNION ALL SELECT DISTINCT doc_id, region_id, assignment_id, 'unknown_token' FROM t WHERE NOT known
    UNION ALL SELECT DISTINCT doc_id, region_id, assignment_id, 'unknown_line' FROM lr ANTI JOIN ev_lines USING (doc_id, line_id)
    UNION ALL SELECT DISTINCT doc_id, region_id, assignment_id, 'foreign_view' FROM t WHERE strange
    UNION ALL SELECT DISTINCT doc_id, region_id, assignment_id, 'context_token' FROM t WHERE context
    UNION ALL SELECT doc_id, region_id, assignment_id, 'no_number' FROM pr WHERE numbers = 0 AND NOT counted
    UNION ALL SELECT doc_id, region_id, assignment_id, 'line_required' FROM pr WHERE lines = 0 AND NOT table_value AND NOT own_count
    UNION ALL SELECT doc_id, region_id, assignment_id, 'more_than_one_cell' FROM pr WHERE table_value AND cells <> 1
    UNION ALL SELECT doc_id, region_id, assignment_id, 'row_mismatch' FROM misfit)"""


@query("j25_review_issues", REVIEWED + " SELECT doc_id, region_id, CAST(assignment_id AS BIGINT) AS assignment_id, issue FROM found")
def j25(spark, sf):
    docs = frame(spark, sf, "review_docs")
    view = docs.select("doc_id", "region_id")
    assignments = frame(spark, sf, "ev_assignments").join(view, "doc_id")
    tokens = frame(spark, sf, "ev_token_rows").join(view, "doc_id")
    lines = frame(spark, sf, "ev_lines").join(view, "doc_id").withColumn("source_region_id", F.lit("unassigned"))
    allowed = view.select("doc_id", F.explode(F.array(*[F.lit(n) for n in ("total_height", "pin_span", "nominal_pin_count", "overall_width")])).alias("field"))
    shown = tokens.groupBy("doc_id", "region_id", F.col("value_role").alias("evidence_type")).agg(F.min("token_id").alias("t0"), F.max("token_id").alias("t1"))
    none = F.array().cast("array<string>")
    rows = shown.select("doc_id", "region_id", F.concat("evidence_type", "t0").alias("dimension_id"),
                        F.when(F.col("evidence_type") == "table_nom", "table_row").otherwise("dimension_line").alias("evidence_type"), F.array("t0", "t1").alias("member_ids"),
                        F.when(F.col("evidence_type") == "table_nom", none).otherwise(F.array("t0")).alias("context_token_ids"),
                        F.when(F.col("evidence_type") == "table_nom", F.array("t1")).otherwise(none).alias("value_token_ids"), none.alias("group_line_ids"))
    return fusion.review_candidate_issues(docs, assignments, tokens, lines, rows, allowed)
