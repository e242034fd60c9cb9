"""Geometry on the driver tables: vectors as boxes, lines, pads and measured models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from .registry import query, table
from .shapes import ctes, frame

ASSIGNED = """ctr AS (SELECT *, (x1 + x2) / 2.0 AS px, (y1 + y2) / 2.0 AS py FROM boxes),
  inr AS (SELECT c.doc_id, c.id, arg_min(r.region_id, (r.area_ratio, r.ord)) AS region_id FROM ctr c JOIN regions r ON c.doc_id = r.doc_id
    AND px BETWEEN r.x1 AND r.x2 AND py BETWEEN r.y1 AND r.y2 GROUP BY 1, 2),
  assigned AS (SELECT b.*, coalesce(region_id, 'unassigned') AS region_id FROM boxes b LEFT JOIN inr USING (doc_id, id))"""
GROWN = """grown AS (SELECT r.doc_id, region_id, greatest(0, x1 - 36) AS gx1, greatest(0, y1 - 36) AS gy1, least(width, x2 + 36) AS gx2, least(height, y2 + 36) AS gy2
    FROM regions r JOIN images USING (doc_id)),
  near AS (SELECT g.doc_id, g.region_id, b.id, b.ord, b.text, b.confidence, b.x1, b.y1, b.source_region_id = g.region_id AS own FROM grown g JOIN boxes b ON g.doc_id = b.doc_id
    AND (b.source_region_id = g.region_id OR NOT (b.x2 < gx1 OR b.x1 > gx2 OR b.y2 < gy1 OR b.y1 > gy2)))"""


def _frames(spark, sf, *names):
    return [frame(spark, sf, n) for n in names]


@query("f3_sure_evidence", """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS confidence FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) >= 0.05""")
def f3(spark, sf):
    confidence = F.col("embedding")[0].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", confidence.alias("confidence")).where(F.col("confidence") >= 0.05)


@query("j4_assigned_regions", ctes("boxes", "regions") + ", " + ASSIGNED + " SELECT doc_id, id, region_id FROM assigned")
def j4(spark, sf):
    return geometry.assign_regions(*_frames(spark, sf, "boxes", "regions")).select("doc_id", "id", "region_id")


@query("a16_covered_documents", ctes("boxes", "regions", "images") + ", " + ASSIGNED + """, cov AS (SELECT doc_id, count(*) FILTER (region_id <> 'unassigned') / count(*) AS s FROM assigned WHERE confidence >= 0.55 GROUP BY 1)
  SELECT doc_id, region_id, area_ratio, x1, y1, x2, y2 FROM regions UNION ALL SELECT doc_id, 'region_document', 1.0, 0, 0, width, height FROM images JOIN cov USING (doc_id)
  WHERE s < 0.65 AND doc_id NOT IN (SELECT doc_id FROM regions WHERE area_ratio >= 0.75)""")
def a16(spark, sf):
    regions, boxes, images = _frames(spark, sf, "regions", "boxes", "images")
    return geometry.cover_documents(regions, boxes, images).drop("ord")


@query("j5_nearest_lines", ctes("boxes", "drawn_lines") + """, reach AS (SELECT doc_id, greatest(35.0, median(greatest(1, y2 - y1)) * 3) AS r FROM boxes GROUP BY 1),
  d AS (SELECT b.doc_id, b.id, line_id, l.ord, sqrt(((b.x1 + b.x2) / 2.0 - (lx1 + lx2) / 2.0) ** 2 + ((b.y1 + b.y2) / 2.0 - (ly1 + ly2) / 2.0) ** 2) AS distance FROM boxes b JOIN drawn_lines l ON b.doc_id = l.doc_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY distance, ord) AS rank FROM d QUALIFY rank <= 6)
  SELECT doc_id, id, line_id, rank, round(distance, 6) AS distance FROM k JOIN reach USING (doc_id) WHERE distance <= r""")
def j5(spark, sf):
    return geometry.link_lines(*_frames(spark, sf, "boxes", "drawn_lines")).withColumn("distance", F.round("distance", 6))


def _summaries(spark, sf):
    return geometry.region_summaries(*_frames(spark, sf, "regions", "boxes", "drawn_lines", "images"))


@query("j6_region_token_counts", ctes("boxes", "regions", "images") + ", " + GROWN + """ SELECT doc_id, region_id, count(n.id) AS tokens FROM regions LEFT JOIN near n USING (doc_id, region_id) GROUP BY 1, 2""")
def j6(spark, sf):
    return _summaries(spark, sf)[0]


@query("j6_region_line_counts", ctes("boxes", "regions", "images", "drawn_lines") + ", " + GROWN + """ SELECT g.doc_id, g.region_id, l.type, count(*) AS lines FROM grown g JOIN drawn_lines l ON g.doc_id = l.doc_id
    AND (l.source_region_id = g.region_id OR ((lx1 + lx2) / 2 BETWEEN gx1 AND gx2 AND (ly1 + ly2) / 2 BETWEEN gy1 AND gy2)) GROUP BY ALL""")
def j6_lines(spark, sf):
    return _summaries(spark, sf)[1]


@query("j6_region_texts", ctes("boxes", "regions", "images") + ", " + GROWN + """ SELECT doc_id, region_id, text, row_number() OVER (PARTITION BY doc_id, region_id ORDER BY confidence DESC, ord) AS place FROM near
  WHERE regexp_matches(text, '[A-Za-z]{3,}|[一-鿿]') QUALIFY place <= 8""")
def j6_texts(spark, sf):
    return geometry.region_texts(*_frames(spark, sf, "regions", "boxes", "images"))


@query("t3_view_evidence", ctes("boxes", "regions", "images") + ", " + GROWN + f""" SELECT doc_id, region_id, id, own, row_number() OVER (PARTITION BY doc_id, region_id ORDER BY own DESC, confidence DESC, y1, x1, ord) AS place FROM near
  WHERE confidence >= 0.55 AND regexp_matches(text, '{geometry.ENGINEERING}') QUALIFY place <= 36""")
def t3(spark, sf):
    return geometry.view_evidence(*_frames(spark, sf, "regions", "boxes", "images"))


@query("t3_view_links", ctes("boxes", "regions", "images", "drawn_lines") + ", " + GROWN + f""", kept AS (SELECT doc_id, region_id, id FROM near
    WHERE confidence >= 0.55 AND regexp_matches(text, '{geometry.ENGINEERING}') QUALIFY row_number() OVER (PARTITION BY doc_id, region_id ORDER BY own DESC, confidence DESC, y1, x1, ord) <= 36),
  reach AS (SELECT doc_id, greatest(35.0, median(greatest(1, y2 - y1)) * 3) AS r FROM boxes GROUP BY 1),
  d AS (SELECT b.doc_id, b.id, line_id, l.ord, sqrt(((b.x1 + b.x2) / 2.0 - (lx1 + lx2) / 2.0) ** 2 + ((b.y1 + b.y2) / 2.0 - (ly1 + ly2) / 2.0) ** 2) AS distance FROM boxes b JOIN drawn_lines l ON b.doc_id = l.doc_id),
  links AS (SELECT doc_id, id, line_id, row_number() OVER (PARTITION BY doc_id, id ORDER BY distance, ord) AS rank FROM d JOIN reach USING (doc_id) WHERE distance <= r QUALIFY rank <= 6),
  shown AS (SELECT * FROM kept JOIN links USING (doc_id, id))
  SELECT doc_id, region_id, id, line_id, rank FROM shown SEMI JOIN (SELECT * FROM shown WHERE rank <= 2) USING (doc_id, region_id, line_id)""")
def t3_links(spark, sf):
    kept = geometry.view_evidence(*_frames(spark, sf, "regions", "boxes", "images"))
    return geometry.view_links(kept, geometry.link_lines(*_frames(spark, sf, "boxes", "drawn_lines")))


@query("j7_pad_clearances", ctes("pads", "pad_specs") + """, al AS (SELECT spec_id, ord, number, x, y, size_x, size_y, shape FROM pads
    UNION ALL SELECT spec_id, 2147483647, ep_pin_number, 0.0, 0.0, ep_x, ep_y, 'RECTANGLE' FROM pad_specs WHERE ep_present),
  p AS (SELECT spec_id, a.number AS first, b.number AS second, CAST(min_clearance AS DOUBLE) AS min_clearance, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, a.shape AS s, b.shape AS t,
      a.size_x AS w, a.size_y AS h, b.size_x AS bw, b.size_y AS bh FROM al a JOIN al b USING (spec_id) JOIN pad_specs USING (spec_id) WHERE a.ord < b.ord),
  g AS (SELECT spec_id, first, second, min_clearance, round(greatest(0, CASE WHEN s = 'CIRCLE' AND t = 'CIRCLE' THEN sqrt(dx * dx + dy * dy) - (w + bw) / 2
      WHEN s = 'CIRCLE' THEN sqrt(greatest(0, dx - bw / 2) ** 2 + greatest(0, dy - bh / 2) ** 2) - w / 2
      WHEN t = 'CIRCLE' THEN sqrt(greatest(0, dx - w / 2) ** 2 + greatest(0, dy - h / 2) ** 2) - bw / 2
      ELSE sqrt(greatest(0, dx - (w + bw) / 2) ** 2 + greatest(0, dy - (h + bh) / 2) ** 2) END), 6) AS gap FROM p)
  SELECT * FROM g WHERE gap < min_clearance - 1e-6""")
def j7(spark, sf):
    specs = frame(spark, sf, "pad_specs").withColumn("min_clearance", F.col("min_clearance").cast("double"))
    return geometry.pad_clearances(frame(spark, sf, "pads"), specs)


@query("j8_uniform_clearances", ctes("dual_specs") + """ SELECT spec_id, min_clearance, 'pin' AS kind, round(pin_pitch - land_y, 9) AS gap FROM dual_specs WHERE round(pin_pitch - land_y, 9) < min_clearance
  UNION ALL SELECT spec_id, min_clearance, 'thermal', round(1.4 - land_x / 2 - ep_x / 2, 9) FROM dual_specs WHERE ep_present AND round(1.4 - land_x / 2 - ep_x / 2, 9) < min_clearance""")
def j8(spark, sf):
    return geometry.uniform_clearances(frame(spark, sf, "dual_specs"))


@query("j9_overlapping_duplicates", ctes("dense_boxes") + """, p AS (SELECT a.doc_id, a.id AS kept_id, b.id AS dropped_id,
      (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
    FROM dense_boxes a JOIN dense_boxes b ON a.doc_id = b.doc_id AND lower(a.text) = lower(b.text) AND (-a.confidence, a.ord) < (-b.confidence, b.ord)
      AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))
  SELECT doc_id, kept_id, dropped_id, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.45""")
def j9(spark, sf):
    return geometry.overlapping_duplicates(frame(spark, sf, "dense_boxes")).withColumn("iou", F.round("iou", 6))


# Token after token, the surest first, against the boxes that stayed: no pairs, no stacks, no cuts
J9_KEPT = ctes("dense_boxes").replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT *, lower(text) AS folded, x2 > x1 AND y2 > y1 AS solid FROM dense_boxes),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, folded ORDER BY confidence DESC, ord) AS rn FROM o WHERE solid),
  s AS (SELECT DISTINCT doc_id, folded, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)[]) AS held, CAST(NULL AS VARCHAR) AS id, false AS stays FROM r
    UNION ALL SELECT doc_id, folded, rn, CASE WHEN free THEN list_append(held, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) ELSE held END, id, free
    FROM (SELECT r.doc_id, r.folded, r.rn, r.id, s.held, CAST(r.x1 AS INT) AS x1, CAST(r.y1 AS INT) AS y1, CAST(r.x2 AS INT) AS x2, CAST(r.y2 AS INT) AS y2, len(list_filter(s.held, lambda k: least(k.x2, r.x2) > greatest(k.x1, r.x1) AND least(k.y2, r.y2) > greatest(k.y1, r.y1)
        AND ((least(k.x2, r.x2) - greatest(k.x1, r.x1)) * (least(k.y2, r.y2) - greatest(k.y1, r.y1))) / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
          - (least(k.x2, r.x2) - greatest(k.x1, r.x1)) * (least(k.y2, r.y2) - greatest(k.y1, r.y1))) >= 0.45)) = 0 AS free
      FROM s JOIN r ON r.doc_id = s.doc_id AND r.folded = s.folded AND r.rn = s.rn + 1)),
  kept AS (SELECT o.* FROM o JOIN s ON s.doc_id = o.doc_id AND s.id = o.id AND s.stays UNION ALL SELECT * FROM o WHERE NOT solid)
  SELECT doc_id, id, format('ocr_{:04d}', row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, confidence DESC, ord)) AS token_id FROM kept"""


@query("j9_deduplicated_tokens", J9_KEPT)
def j9_kept(spark, sf):
    kept = geometry.suppress_duplicates(frame(spark, sf, "dense_boxes"))
    return geometry.renumber_tokens(kept, F.floor(F.col("y1") / 256)).select("doc_id", "id", "token_id")


MODELS = ctes("built_models", "reference_models") + """, m AS (SELECT a.*, a.xmax - a.xmin AS sx, a.ymax - a.ymin AS sy, a.zmax - a.zmin AS sz, b.xmax - b.xmin AS rx, b.ymax - b.ymin AS ry, b.zmax - b.zmin AS rz,
    b.volume_mm3 AS rv, b.solid_count AS rs, b.face_count AS rf, b.edge_count AS re, b.minimum_face_count AS rmf, b.minimum_solid_count AS rms,
    greatest(abs(a.xmin - b.xmin), abs(a.xmax - b.xmax), abs(a.ymin - b.ymin), abs(a.ymax - b.ymax), abs(a.zmin - b.zmin), abs(a.zmax - b.zmax)) AS corners FROM built_models a JOIN reference_models b USING (doc_id)),
  w AS (SELECT *, list_sort([sx, sy, sz]) AS ls, list_sort([rx, ry, rz]) AS lr FROM m),
  v AS (SELECT *, greatest(abs(ls[1] - lr[1]), abs(ls[2] - lr[2]), abs(ls[3] - lr[3])) AS worst FROM w)"""


@query("j11_model_comparison", MODELS + """ SELECT doc_id, round(sx - rx, 6) AS dx, round(sy - ry, 6) AS dy, round(sz - rz, 6) AS dz, round(volume_mm3 - rv, 6) AS volume_delta, solid_count - rs AS solid_delta,
    face_count - rf AS face_delta, edge_count - re AS edge_delta, CASE WHEN greatest(abs(sx - rx), abs(sy - ry), abs(sz - rz)) <= 0.05 AND abs(volume_mm3 - rv) <= 0.05 AND coalesce(solid_count = rs, false) AND missing_structures = 0
    THEN 'matched' ELSE 'review_required' END AS status FROM v""")
def j11(spark, sf):
    out = geometry.compare_models(*_frames(spark, sf, "built_models", "reference_models"))
    return out.withColumns({c: F.round(c, 6) for c in ("dx", "dy", "dz", "volume_delta")})


@query("j11_volume_comparison", MODELS + """ SELECT doc_id, round(greatest(abs(sx - rx), abs(sy - ry), abs(sz - rz)), 6) AS size_error, round(volume_mm3 / rv, 6) AS volume_ratio,
    greatest(abs(sx - rx), abs(sy - ry), abs(sz - rz)) <= 0.5 AND volume_mm3 / rv BETWEEN 0.6 AND 1.4 AS passed FROM v""")
def j11_volume(spark, sf):
    out = geometry.compare_volumes(*_frames(spark, sf, "built_models", "reference_models"))
    return out.withColumns({c: F.round(c, 6) for c in ("size_error", "volume_ratio")})


@query("j12_candidate_compatibility", MODELS + """, t AS (SELECT *, CASE WHEN rs IS NOT NULL THEN solid_count = rs ELSE solid_count >= rms END AS topology FROM v),
  s AS (SELECT *, CASE WHEN NOT is_valid THEN 'invalid_step' WHEN match_type = 'exact' AND worst <= 0.05 THEN 'exact'
    WHEN topology AND rx / sx BETWEEN 0.8 AND 1.25 AND ry / sy BETWEEN 0.8 AND 1.25 AND rz / sz BETWEEN 0.8 AND 1.25 THEN 'similar' ELSE 'incompatible_geometry' END AS status FROM t)
  SELECT doc_id, round(worst, 6) AS worst_delta, topology AS topology_compatible, status, status IN ('exact', 'similar') AS compatible FROM s""")
def j12(spark, sf):
    return geometry.candidate_compatibility(*_frames(spark, sf, "built_models", "reference_models")).withColumn("worst_delta", F.round("worst_delta", 6))


@query("v15_verified_models", MODELS + """, t AS (SELECT *, CASE WHEN model_source = 'web_exact' THEN worst ELSE corners END AS e,
    CASE WHEN model_source = 'web_exact' THEN solid_count >= 1 WHEN rs IS NOT NULL THEN solid_count = rs ELSE solid_count >= rms END AS ok FROM v)
  SELECT doc_id, round(e, 6) AS error, ok AS solids_match, is_valid AND ok AND face_count >= rmf AND e <= 0.05 AS passed FROM t""")
def v15(spark, sf):
    return geometry.verify_models(*_frames(spark, sf, "built_models", "reference_models")).withColumn("error", F.round("error", 6))


@query("j24_mutual_nearest", ctes("side_points") + """, d AS (SELECT a.doc_id, a.id AS first_id, b.id AS second_id, a.at_y AS fa, b.at_y AS sa, a.span, a.ord AS ao, b.ord AS bo, abs(a.at_y - b.at_y) AS d
    FROM side_points a JOIN side_points b ON a.doc_id = b.doc_id AND a.side = 'left' AND b.side = 'right'),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, first_id ORDER BY d, bo) AS r1, row_number() OVER (PARTITION BY doc_id, second_id ORDER BY d, ao) AS r2 FROM d)
  SELECT doc_id, first_id, second_id, round((fa + sa) / 2, 6) AS mid FROM n WHERE r1 = 1 AND r2 = 1 AND d <= span * 0.03""")
def j24(spark, sf):
    points = frame(spark, sf, "side_points").withColumnRenamed("at_y", "at")
    pairs = geometry.mutual_nearest(points, "left", "right", bucket_width=0.1)
    return pairs.select("doc_id", "first_id", "second_id", F.round("at", 6).alias("mid"))


@query("w7_line_clusters", ctes("drawn_lines") + """, o AS (SELECT *, CASE WHEN abs(ly2 - ly1) <= greatest(4.0, abs(lx2 - lx1) * 0.05) THEN 'horizontal' WHEN abs(lx2 - lx1) <= greatest(4.0, abs(ly2 - ly1) * 0.05) THEN 'vertical' ELSE 'oblique' END AS orientation FROM drawn_lines),
  f AS (SELECT doc_id, line_id, ord, orientation, CASE orientation WHEN 'horizontal' THEN (ly1 + ly2) / 2.0 ELSE (lx1 + lx2) / 2.0 END AS axis,
    CASE orientation WHEN 'horizontal' THEN least(lx1, lx2) ELSE least(ly1, ly2) END AS low, CASE orientation WHEN 'horizontal' THEN greatest(lx1, lx2) ELSE greatest(ly1, ly2) END AS high FROM o WHERE orientation <> 'oblique'),
  a AS (SELECT *, axis > lag(axis) OVER (PARTITION BY doc_id, orientation ORDER BY axis, ord) + 6 AS nf FROM f),
  b AS (SELECT *, sum(CASE WHEN nf THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, orientation ORDER BY axis, ord) AS axis_island FROM a),
  c AS (SELECT *, low > max(high) OVER (PARTITION BY doc_id, orientation, axis_island ORDER BY low, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12 AS nf2 FROM b)
  SELECT doc_id, line_id, orientation, CAST(axis_island AS BIGINT) AS axis_island, CAST(sum(CASE WHEN nf2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, orientation, axis_island ORDER BY low, ord) AS BIGINT) AS interval_island FROM c""")
def w7_clusters(spark, sf):
    return geometry.line_clusters(frame(spark, sf, "drawn_lines")).select("doc_id", "line_id", "orientation", "axis_island", "interval_island")


# Line after line of a page and direction, the longest first, against all merged lines so far: no clusters
W7 = ctes("drawn_lines").replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT *, CASE WHEN abs(ly2 - ly1) <= greatest(4.0, abs(lx2 - lx1) * 0.05) THEN 'horizontal' WHEN abs(lx2 - lx1) <= greatest(4.0, abs(ly2 - ly1) * 0.05) THEN 'vertical' ELSE 'oblique' END AS orientation FROM drawn_lines),
  f AS (SELECT *, orientation = 'horizontal' AS flat, CAST(CASE WHEN flat THEN (ly1 + ly2) / 2.0 ELSE (lx1 + lx2) / 2.0 END AS DOUBLE) AS axis, CAST(CASE WHEN flat THEN least(lx1, lx2) ELSE least(ly1, ly2) END AS DOUBLE) AS low,
    CAST(CASE WHEN flat THEN greatest(lx1, lx2) ELSE greatest(ly1, ly2) END AS DOUBLE) AS high, row_number() OVER (PARTITION BY doc_id, orientation ORDER BY (lx2 - lx1) ** 2 + (ly2 - ly1) ** 2 DESC, ord) AS rn FROM o WHERE orientation <> 'oblique'),
  s AS (SELECT DISTINCT doc_id, orientation, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(axis DOUBLE, low DOUBLE, high DOUBLE)[]) AS held, CAST(0 AS BIGINT) AS home FROM f
    UNION ALL SELECT doc_id, orientation, rn, CASE WHEN hit IS NULL THEN list_append(held, {'axis': axis, 'low': low, 'high': high}) ELSE list_transform(held, lambda d, i: CASE WHEN i = hit
        THEN {'axis': round_even((d.axis + axis) / 2, 0), 'low': least(d.low, low), 'high': greatest(d.high, high)} ELSE d END) END, coalesce(hit, len(held) + 1)
    FROM (SELECT f.*, s.held, list_min(list_filter(list_transform(s.held, lambda d, i: CASE WHEN abs(d.axis - f.axis) <= 5 AND f.low <= d.high + 12 AND f.high >= d.low - 12 THEN i END), lambda i: i IS NOT NULL)) AS hit
      FROM s JOIN f ON f.doc_id = s.doc_id AND f.orientation = s.orientation AND f.rn = s.rn + 1)),
  last AS (SELECT doc_id, orientation, arg_max(held, rn) AS held FROM s GROUP BY ALL),
  g AS (SELECT f.*, s.home FROM f JOIN s USING (doc_id, orientation, rn)),
  m AS (SELECT doc_id, orientation, home, arg_min(line_id, rn) AS line_id, arg_min(type, rn) AS kind, arg_min(source_region_id, rn) AS source_region_id, max(confidence) AS confidence, count(*) AS n,
    bool_or(len(arrow_ids) > 0) AS arrows, bool_or(type = 'extension_line') AS extends, arg_min({'a': lx1, 'b': ly1, 'c': lx2, 'd': ly2}, rn) AS own FROM g GROUP BY ALL),
  w AS (SELECT m.*, held[home] AS line FROM m JOIN last USING (doc_id, orientation))
  SELECT doc_id, line_id, CASE WHEN n = 1 THEN kind WHEN arrows THEN 'dimension_line' WHEN extends THEN 'extension_line' ELSE kind END AS type,
    CAST(CASE WHEN n = 1 THEN own.a WHEN orientation = 'horizontal' THEN line.low ELSE line.axis END AS INT) AS lx1, CAST(CASE WHEN n = 1 THEN own.b WHEN orientation = 'horizontal' THEN line.axis ELSE line.low END AS INT) AS ly1,
    CAST(CASE WHEN n = 1 THEN own.c WHEN orientation = 'horizontal' THEN line.high ELSE line.axis END AS INT) AS lx2, CAST(CASE WHEN n = 1 THEN own.d WHEN orientation = 'horizontal' THEN line.axis ELSE line.high END AS INT) AS ly2,
    confidence, source_region_id, CAST(n AS INT) AS merged FROM w
  UNION ALL SELECT doc_id, line_id, type, lx1, ly1, lx2, ly2, confidence, source_region_id, 1 FROM o WHERE orientation = 'oblique'"""


@query("w7_merged_lines", W7)
def w7(spark, sf):
    return geometry.merge_lines(frame(spark, sf, "drawn_lines")).drop("arrow_ids")


ISSUES = ctes("read_docs", "read_pins") + """, n AS (SELECT doc_id, count(*) AS n FROM read_pins GROUP BY 1),
  p AS (SELECT *, x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AS placed FROM read_pins JOIN read_docs USING (doc_id))
  SELECT doc_id, NULL AS pin_number, 'body_coordinates' AS issue FROM read_docs WHERE bx2 > 1 UNION ALL SELECT doc_id, NULL, 'body_size' FROM read_docs WHERE bx2 <= 1 AND bx2 - bx1 < 0.01
  UNION ALL SELECT doc_id, NULL, 'pin_total' FROM read_docs LEFT JOIN n USING (doc_id) WHERE coalesce(n, 0) NOT BETWEEN 2 AND 1000
  UNION ALL SELECT doc_id, NULL, 'stated_count' FROM read_docs WHERE pin_count NOT BETWEEN 2 AND 1000
  UNION ALL SELECT doc_id, pin_number, 'number_shape' FROM p WHERE NOT regexp_matches(trim(pin_number), '^[0-9]+$|^[A-Za-z]{1,3}[0-9]{1,3}$')
  UNION ALL SELECT doc_id, pin_number, 'coordinates' FROM p WHERE NOT placed
  UNION ALL SELECT doc_id, pin_number, 'off_body' FROM p WHERE placed AND NOT (x BETWEEN bx1 - 0.05 AND bx2 + 0.05 AND y BETWEEN by1 - 0.05 AND by2 + 0.05)
  UNION ALL SELECT doc_id, pin_number, 'number_repeated' FROM read_pins GROUP BY doc_id, pin_number HAVING count(*) > 1"""


@query("v16_image_reading_issues", ISSUES)
def v16(spark, sf):
    docs = frame(spark, sf, "read_docs").drop("width", "height")
    return geometry.image_reading_issues(docs, frame(spark, sf, "read_pins"))[0]


@query("v16_reading_questions", ctes("read_pins") + """ SELECT doc_id, pin_number, ord, 'side' AS field FROM read_pins WHERE side = 'unknown'
  UNION ALL SELECT doc_id, pin_number, ord, 'name' FROM read_pins WHERE trim(name) = '' OR confidence NOT BETWEEN 0.9 AND 1.0 OR uncertain""")
def v16_questions(spark, sf):
    docs = frame(spark, sf, "read_docs").drop("width", "height")
    return geometry.image_reading_issues(docs, frame(spark, sf, "read_pins"))[1]


# Pin after pin of the left or upper side in their order, against positions as they are by then; then the grid
V17 = ctes("placed_pins", "read_docs").replace("WITH", "WITH RECURSIVE", 1) + """, b AS (SELECT p.doc_id, pin_number, name, side, ord, bx1, by1, bx2, by2, width, height, side IN ('left', 'right') AS across, side IN ('left', 'top') AS low,
    CAST(CASE WHEN across THEN y ELSE x END AS DOUBLE) AS raw, CASE WHEN across THEN by2 - by1 ELSE bx2 - bx1 END AS span, CASE WHEN across THEN by1 ELSE bx1 END AS start FROM placed_pins p JOIN read_docs USING (doc_id)),
  g AS (SELECT doc_id, across, max(span) AS span, coalesce(list(pin_number ORDER BY ord) FILTER (low), []) AS li, coalesce(list(raw ORDER BY ord) FILTER (low), []) AS lo,
    coalesce(list(pin_number ORDER BY ord) FILTER (NOT low), []) AS hi_ids, coalesce(list(raw ORDER BY ord) FILTER (NOT low), []) AS hi FROM b GROUP BY ALL),
  s AS (SELECT doc_id, across, span, CAST(0 AS BIGINT) AS i, lo, hi FROM g
    UNION ALL SELECT doc_id, across, span, i, CASE WHEN meets THEN list_transform(lo, lambda v, n: CASE WHEN n = i THEN middle ELSE v END) ELSE lo END,
      CASE WHEN meets THEN list_transform(hi, lambda v, n: CASE WHEN n = j THEN middle ELSE v END) ELSE hi END
    FROM (SELECT *, coalesce(abs(hi[j] - lo[i]) <= span * 0.03 AND list_position(back, list_min(back)) = i, false) AS meets, (lo[i] + hi[j]) / 2 AS middle
      FROM (SELECT *, list_transform(lo, lambda v: abs(v - hi[j])) AS back FROM (SELECT *, list_position(away, list_min(away)) AS j
        FROM (SELECT doc_id, across, span, i + 1 AS i, lo, hi, list_transform(hi, lambda h: abs(h - lo[i + 1])) AS away FROM s WHERE i < len(lo)))))),
  e AS (SELECT s.doc_id, s.across, li, hi_ids, s.lo, s.hi FROM s JOIN g USING (doc_id, across) WHERE i = len(s.lo)),
  p AS (SELECT doc_id, unnest(li) AS pin_number, unnest(lo) AS at_ FROM e UNION ALL SELECT doc_id, unnest(hi_ids), unnest(hi) FROM e),
  q AS (SELECT b.*, at_ FROM b JOIN p USING (doc_id, pin_number)),
  z AS (SELECT doc_id, coalesce(max(length(name)) FILTER (side = 'left'), 0) AS l, coalesce(max(length(name)) FILTER (side = 'right'), 0) AS r, any_value(height * (by2 - by1) / (width * (bx2 - bx1))) AS aspect FROM q GROUP BY 1),
  w AS (SELECT *, ceil(greatest(100, (l + r) * 6 + 30) / CAST(20 AS DOUBLE)) * 20 AS w0, ceil(greatest(40, w0 * aspect) / 20) * 20 AS h0 FROM z),
  gaps AS (SELECT doc_id, side, min(gap) AS gap, any_value(span) AS span FROM (SELECT *, at_ - lag(at_) OVER (PARTITION BY doc_id, side ORDER BY at_) AS gap FROM q) WHERE gap IS NOT NULL GROUP BY 1, 2),
  need AS (SELECT doc_id, bool_or(gap < 1e-6) AS touch, max(CASE WHEN gap >= 1e-6 THEN 20 * span / (gap * CASE WHEN side IN ('left', 'right') THEN h0 ELSE w0 END) END) AS need FROM gaps JOIN w USING (doc_id) GROUP BY 1),
  f AS (SELECT doc_id, ceil(w0 * greatest(1, coalesce(need, 1)) / 20) * 20 AS bw, ceil(h0 * greatest(1, coalesce(need, 1)) / 20) * 20 AS bh,
    CASE WHEN coalesce(touch, false) THEN 'overlap' WHEN bw > 10000 OR bh > 10000 THEN 'size' END AS reason FROM w LEFT JOIN need USING (doc_id)),
  o AS (SELECT q.*, bw, bh, floor(bw / 2) AS hw, floor(bh / 2) AS hh, CASE WHEN across THEN hh ELSE hw END AS half,
    greatest(10 - half, least(half - 10, round_even(((at_ - start) / span - 0.5) * CASE WHEN across THEN bh ELSE bw END / 10, 0) * 10)) AS axis FROM q JOIN f USING (doc_id) WHERE reason IS NULL),
  clash AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM o GROUP BY doc_id, side, axis HAVING count(*) > 1))"""


@query("v17_image_layout", V17 + """, k AS (SELECT *, CASE WHEN side IN ('left', 'top') THEN -1 ELSE 1 END AS sign, CASE WHEN across THEN sign * hw ELSE axis END AS px, CASE WHEN across THEN axis ELSE sign * hh END AS py
    FROM o WHERE doc_id NOT IN (SELECT doc_id FROM clash))
  SELECT doc_id, pin_number, side, CAST(px AS INT) AS x, CAST(py AS INT) AS y, CAST(CASE WHEN across THEN px + sign * 10 ELSE px END AS INT) AS hx, CAST(CASE WHEN across THEN py ELSE py + sign * 10 END AS INT) AS hy,
    CAST(bw AS INT) AS body_width, CAST(bh AS INT) AS body_height FROM k""")
def v17(spark, sf):
    pins, docs = _frames(spark, sf, "placed_pins", "read_docs")
    return geometry.image_layout(pins, docs.drop("pin_count"))[0]


@query("v17_layout_rejects", V17 + " SELECT doc_id, reason FROM f WHERE reason IS NOT NULL UNION ALL SELECT doc_id, 'same_place' FROM clash")
def v17_rejects(spark, sf):
    pins, docs = _frames(spark, sf, "placed_pins", "read_docs")
    return geometry.image_layout(pins, docs.drop("pin_count"))[1]
