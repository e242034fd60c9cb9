"""Text operators on the driver tables: document lines as blocks, tokens and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions.packages import pin_count_from_package
from ..operators import text
from .pin_queries import package_count_sql
from .registry import query, table
from .shapes import ctes, frame


def tr(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


SKIP = ", ".join(f"'{t}'" for t in text.SKIPPED_TYPES)
TEXTS = ctes("blocks") + f""", entries AS (
    SELECT doc_id, seq, page_idx + 1 AS page, unnest(list_concat([{{'part': 0, 'source': 'text', 'text': text}}, {{'part': 1, 'source': 'text', 'text': aside_text}}],
      [{{'part': 1 + i, 'source': 'caption', 'text': list_concat(coalesce(image_caption, []), coalesce(table_caption, []))[i]}}
       for i in range(1, 1 + len(list_concat(coalesce(image_caption, []), coalesce(table_caption, []))))])) AS e
    FROM blocks WHERE lower(type) NOT IN ({SKIP})),
  texts AS (SELECT doc_id, seq, e.part AS part, page, {tr('e.text')} AS text, e.source AS source FROM entries WHERE {tr('e.text')} <> '')"""
# What a reader finds in the phrases the fixture adds to its lines, by the phrase's number
HINTS = TEXTS + """, phrases AS (SELECT * FROM (VALUES
    (0, [{'style': 'TSSOP', 'n': 16}]), (1, [{'style': 'LQFP', 'n': 64}]), (2, [{'style': 'SSOP', 'n': NULL}]),
    (5, [{'style': 'SOIC', 'n': 14}, {'style': 'QFN', 'n': 20}]), (6, [{'style': 'MSOP', 'n': 10}]), (7, [{'style': 'DFN', 'n': NULL}]),
    (8, [{'style': 'BGA', 'n': 100}, {'style': 'LQFP', 'n': 100}]), (9, [{'style': 'SOT', 'n': 5}, {'style': 'BGA', 'n': NULL}, {'style': 'QFN', 'n': NULL}]),
    (20, [{'style': 'SOIC', 'n': 8}]), (21, [{'style': 'DFN', 'n': 8}]), (22, [{'style': 'LQFP', 'n': 64}])) v(phrase, h)),
  found AS (SELECT doc_id, seq, part, page, source, text, h FROM texts JOIN phrases ON phrase = CASE WHEN text = 'Figure DFN-8' THEN 21 WHEN text = 'Table 5 LQFP64' THEN 22
    WHEN part = 1 AND source = 'text' THEN 20 ELSE (CAST(doc_id AS BIGINT) * 7 + seq) % 10 END),
  hints AS (SELECT doc_id, seq, part, page, source, text, CAST(i - 1 AS INT) AS ordinal, h[i].style AS style, CAST(h[i].n AS INT) AS pin_count,
    h[i].style || coalesce(CAST(h[i].n AS VARCHAR), '') AS label FROM (SELECT *, unnest(range(1, 1 + len(h))) AS i FROM found)),
  clipped AS (SELECT *, CASE WHEN text = 'Figure DFN-8' THEN 'DFN-8' WHEN text = 'Table 5 LQFP64' THEN 'LQFP64' WHEN part = 1 AND source = 'text' THEN '8-lead soic'
    ELSE (['16-lead TSSOP', 'LQFP64', 'SSOP', '', '', CASE ordinal WHEN 0 THEN '14 pins SOIC' ELSE 'QFN-20' END, 'msop 10', 'DFN', CASE ordinal WHEN 0 THEN 'BGA100' ELSE 'LQFP100' END,
      CASE ordinal WHEN 0 THEN '5-lead SOT' WHEN 1 THEN 'BGA' ELSE 'QFN' END])[1 + (CAST(doc_id AS BIGINT) * 7 + seq) % 10] END AS hit FROM hints),
  around AS (SELECT *, length(text) - CASE WHEN hit = 'SSOP' THEN length(hit) + 18 WHEN hit IN ('14 pins SOIC') THEN length(hit) + 11 WHEN hit = '16-lead TSSOP' THEN length(hit) + 8 WHEN hit = 'BGA100' THEN length(hit) + 8
    WHEN hit = 'BGA' THEN 30 WHEN hit = 'QFN' THEN 15 ELSE length(hit) END AS low FROM clipped),
  snippets AS (SELECT *, left(CASE WHEN low > 24 THEN '…' ELSE '' END || regexp_replace(trim(substr(text, greatest(0, low - 24) + 1, least(length(text), low + length(hit) + 24) - greatest(0, low - 24)),
      ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '\\s+', ' ', 'g') || CASE WHEN low + length(hit) + 24 < length(text) THEN '…' ELSE '' END, 120) AS evidence FROM around)"""


def _texts(spark, sf):
    return text.block_texts(frame(spark, sf, "blocks"))


@query("f4_block_texts", TEXTS + " SELECT * FROM texts")
def f4(spark, sf):
    return _texts(spark, sf)


@query("f5_filled_pages", "SELECT doc_id, text FROM documents WHERE length(" + tr("text") + ") > 20")
def f5(spark, sf):
    return text.filled_pages(table(spark, sf, "documents")).select("doc_id", "text")


@query("x1_package_hints", HINTS + " SELECT * EXCLUDE (text) FROM hints")
def x1(spark, sf):
    return text.package_hints(_texts(spark, sf))


@query("x1_hint_snippets", HINTS + " SELECT doc_id, seq, CAST(part AS INT) AS part, page, source, ordinal, style, pin_count, evidence FROM snippets")
def x1_snippets(spark, sf):
    return text.hint_snippets(_texts(spark, sf))


@query("x1_hint_pages", HINTS + " SELECT DISTINCT doc_id, page FROM hints")
def x1_pages(spark, sf):
    return text.hint_pages(text.package_hints(_texts(spark, sf)))


@query("a8_package_candidates", HINTS + """, g AS (SELECT doc_id, label, count(*) FILTER (source = 'caption') AS caption_hits, count(*) AS hits,
    min((seq, part, ordinal)) AS first_seen FROM hints GROUP BY 1, 2)
  SELECT doc_id, label, caption_hits, hits, row_number() OVER (PARTITION BY doc_id ORDER BY caption_hits DESC, hits DESC, first_seen) AS place,
    row_number() OVER (PARTITION BY doc_id ORDER BY first_seen) AS seen_place FROM g""")
def a8(spark, sf):
    from pyspark.sql import Window
    out = text.package_candidates(text.package_hints(_texts(spark, sf)))
    seen = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_seen"))
    return out.select("doc_id", "label", "caption_hits", "hits", "place", seen.alias("seen_place"))


@query("a8_described_hints", HINTS + """, f AS (SELECT doc_id, style, pin_count, min((seq, part, ordinal)) AS o, arg_min(page, (seq, part, ordinal)) AS page, arg_min(evidence, (seq, part, ordinal)) AS evidence
    FROM snippets GROUP BY 1, 2, 3)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INT) AS place, style, pin_count, page, evidence FROM f QUALIFY place <= 6""")
def a8_described(spark, sf):
    return text.described_hints(text.hint_snippets(_texts(spark, sf)))


@query("a8_hinted_counts", HINTS + " SELECT DISTINCT doc_id, pin_count FROM hints WHERE pin_count IS NOT NULL")
def a8_counts(spark, sf):
    return text.hinted_counts(text.package_hints(_texts(spark, sf)))


# --- identities ------------------------------------------------------------------------------------------------------
GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC_FILE_WORDS)
DEVICE = f"""upper(coalesce(list_reduce([t for t in string_split_regex(regexp_replace(string_split(file, '/')[-1], '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9]+')
    if regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND lower(t) NOT IN ({GENERIC}) AND NOT regexp_matches(lower(t), '^[0-9a-f]{{8,}}$')],
    lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, ''), ''))"""
MAKER_CASES = " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS maker FROM pairs WHERE regexp_matches(concat_ws(chr(10), before, text), '{p}')" for m, p in text.MAKERS.items())
MAKER_CTE = f""", pairs AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM tokens WHERE confidence >= 0.70),
  makers AS (SELECT DISTINCT * FROM ({MAKER_CASES}))"""


def _makers(spark, sf):
    return text.makers(frame(spark, sf, "tokens"), [F.col("ord")], F.floor(F.col("ord") / 4096))


@query("x2_pin_counts", ctes("named_packages") + f" SELECT doc_id, package, {package_count_sql('package')} AS pin_count FROM named_packages")
def x2_counts(spark, sf):
    return frame(spark, sf, "named_packages").select("doc_id", "package", pin_count_from_package("package").alias("pin_count"))


@query("x2_makers", ctes("tokens") + MAKER_CTE + " SELECT doc_id, maker FROM makers")
def x2_makers(spark, sf):
    return _makers(spark, sf)


@query("x2_order_stems", ctes("ordering_codes") + """, u AS (SELECT doc_id, ord, identifier, upper(trim(identifier)) AS u, upper(package_code) AS c FROM ordering_codes),
  s AS (SELECT *, CASE WHEN c = '' THEN u WHEN suffix(u, c || 'R') THEN left(u, length(u) - length(c) - 1) WHEN suffix(u, c || 'T') THEN left(u, length(u) - length(c) - 1)
    WHEN suffix(u, c) THEN left(u, length(u) - length(c)) ELSE u END AS stem FROM u),
  l AS (SELECT doc_id, ord, 0 AS step, left(stem, length(stem) - 1) AS candidate FROM s WHERE stem <> '' AND stem <> u AND length(stem) > 1 AND regexp_matches(stem, '[A-Za-z]$')
    UNION ALL SELECT doc_id, ord, 1, stem FROM s WHERE stem <> '' AND stem <> u UNION ALL SELECT doc_id, ord, 2, trim(identifier) FROM s)
  SELECT doc_id, candidate, min(ord) AS first_ord FROM l GROUP BY 1, 2""")
def x2_stems(spark, sf):
    return text.order_stems(frame(spark, sf, "ordering_codes")).select("doc_id", "candidate", F.col("place.ord").alias("first_ord"))


@query("x2_document_identity", ctes("named_packages", "tokens") + MAKER_CTE + f""", m AS (SELECT doc_id, string_agg(maker, '|' ORDER BY maker) AS makers FROM makers GROUP BY 1)
  SELECT doc_id, {DEVICE} AS device, {package_count_sql('package')} AS pin_count, makers FROM named_packages LEFT JOIN m USING (doc_id)""")
def x2_identity(spark, sf):
    out = text.document_identity(frame(spark, sf, "named_packages"), _makers(spark, sf))
    return out.withColumn("makers", F.array_join("makers", "|"))


@query("t10_identifier_candidates", ctes("tokens") + f""", p AS (SELECT doc_id, confidence, top, unnest(string_split_regex({tr('text')}, '[/,;\\s]+')) AS p FROM tokens WHERE confidence >= 0.80),
  v AS (SELECT *, regexp_replace(p, '^[()\\[\\]{{}}:，；]+|[()\\[\\]{{}}:，；]+$', '', 'g') AS value FROM p),
  k AS (SELECT *, upper(value) AS u, regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') AS c FROM v
    WHERE regexp_matches(value, '^[A-Za-z0-9][A-Za-z0-9._+\\-]{{3,39}}$') AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '\\d')
      AND NOT regexp_matches(upper(value), '^(?:{"|".join(text.GENERIC_PREFIXES)})') AND NOT regexp_matches(upper(value), '^\\d+(?:[.,]\\d+)?(?:MM)?$')),
  s AS (SELECT *, CASE WHEN regexp_matches(u, '^[A-Z]{{2,}}[A-Z0-9._+\\-]*\\d') THEN 6 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(c, '[A-Z]')) >= 2 THEN 2 ELSE 0 END + CASE WHEN len(regexp_extract_all(c, '\\d')) >= 2 THEN 2 ELSE 0 END
      + CASE WHEN length(c) >= 8 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(value, '[\\-.+]') THEN 1 ELSE 0 END
      - CASE WHEN regexp_matches(u, '{"|".join(text.GENERIC_TERMS)}') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(u, '^\\d+[A-Z]-[A-Z0-9]+$') THEN 5 ELSE 0 END AS score FROM k),
  b AS (SELECT doc_id, value, min((-score, -confidence, top, -length(value))) AS b, max(score) AS score FROM s WHERE score >= 4 GROUP BY 1, 2)
  SELECT doc_id, value, score, row_number() OVER (PARTITION BY doc_id ORDER BY b, value) AS place FROM b QUALIFY place <= 4""")
def t10(spark, sf):
    return text.identifier_candidates(frame(spark, sf, "tokens"))


@query("a28_identity_rows", ctes("tokens") + f""", s AS (SELECT doc_id, ord, {tr('text')} AS t FROM tokens WHERE confidence >= 0.80),
  f AS (SELECT doc_id, t, min(ord) AS o FROM s WHERE t <> '' AND regexp_matches(t, '[A-Za-z一-鿿]') AND length(t) <= 120 GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, t) AS rn FROM f QUALIFY rn <= 24),
  l AS (SELECT doc_id, string_agg(t, '|' ORDER BY rn) AS drawing_text FROM k GROUP BY 1),
  c AS (SELECT doc_id, string_agg(CAST(n AS VARCHAR), '|' ORDER BY n) AS pin_counts FROM (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(t, '{D.COUNT_WORD}', 1)) AS INT) AS n FROM s) GROUP BY 1)
  SELECT doc_id, drawing_text, pin_counts FROM (SELECT DISTINCT doc_id FROM tokens) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""")
def a28(spark, sf):
    out = text.identity_rows(frame(spark, sf, "tokens"))
    return out.select("doc_id", F.array_join("drawing_text", "|").alias("drawing_text"),
                      F.array_join(F.col("pin_counts").cast("array<string>"), "|").alias("pin_counts"))


@query("a28_identity_state", ctes("identity_classes", "identity_views", "identity_features") + """ SELECT doc_id, coalesce(package_type, '') AS package_type,
    coalesce((SELECT string_agg(DISTINCT view_type, '|' ORDER BY view_type) FROM identity_views v WHERE v.doc_id = c.doc_id), '') AS identified_views,
    coalesce((SELECT string_agg(name, '|' ORDER BY pos) FROM (SELECT * FROM identity_features ORDER BY pos) f WHERE f.doc_id = c.doc_id AND pos <
      (SELECT min(pos) + 20 FROM identity_features g WHERE g.doc_id = c.doc_id)), '') AS detected_features FROM identity_classes c""")
def a28_state(spark, sf):
    out = text.identity_state(frame(spark, sf, "identity_classes"), text.identity_rows(frame(spark, sf, "tokens")), frame(spark, sf, "identity_views"), frame(spark, sf, "identity_features"))
    return out.select("doc_id", "package_type", F.array_join("identified_views", "|").alias("identified_views"), F.array_join("detected_features", "|").alias("detected_features"))


# --- dimensions and cells -----------------------------------------------------------------------------------------------
def _num(pattern: str, group: int, source: str = "v") -> str:
    return f"TRY_CAST(regexp_extract({source}, '{pattern}', {group}) AS DOUBLE)"


DIMS = ctes("dimension_tokens") + f""", n0 AS (SELECT *, translate({tr('text')}, '{D.FOLD_FROM}', '{D.FOLD_TO}') AS t FROM dimension_tokens),
  n1 AS (SELECT *, regexp_matches(regexp_replace(regexp_replace(t, '{D.WORDS}', '', 'g'), '{D.RADIUS}', '\\1', 'g'), '[A-Za-z]') AS words,
    regexp_extract_all(t, '\\(([^()]*)\\)', 1) AS groups FROM n0),
  n2 AS (SELECT *, {tr("regexp_replace(CASE WHEN len(groups) > 0 THEN groups[-1] ELSE t END, '(?i)\\bREF\\b', '', 'g')")} AS v FROM n1),
  n3 AS (SELECT *, CASE WHEN words OR len(groups) > 1 THEN 'none' WHEN regexp_matches(v, '{D.SYMMETRIC}') THEN 'symmetric'
    WHEN regexp_matches(v, '{D.ASYMMETRIC}') THEN 'asymmetric' WHEN regexp_matches(v, '{D.RANGE}') THEN 'range'
    WHEN len(regexp_extract_all(v, '{D.NUMBER}')) = 1 THEN 'single' ELSE 'none' END AS kind FROM n2),
  n4 AS (SELECT *, CASE kind WHEN 'symmetric' THEN {_num(D.SYMMETRIC, 1)} WHEN 'asymmetric' THEN {_num(D.ASYMMETRIC, 1)} WHEN 'single' THEN {_num(D.NUMBER, 0)} END AS n,
    CASE kind WHEN 'symmetric' THEN abs({_num(D.SYMMETRIC, 2)}) WHEN 'asymmetric' THEN abs({_num(D.ASYMMETRIC, 2)}) END AS p,
    CASE kind WHEN 'symmetric' THEN -abs({_num(D.SYMMETRIC, 2)}) WHEN 'asymmetric' THEN -abs({_num(D.ASYMMETRIC, 3)}) END AS m,
    CASE kind WHEN 'range' THEN {_num(D.RANGE, 1)} END AS a, CASE kind WHEN 'range' THEN {_num(D.RANGE, 2)} END AS b,
    translate({tr('text')}, '−－', '--') AS raw FROM n3),
  n5 AS (SELECT *, value_role LIKE 'table%' AND n IS NULL AND regexp_matches(raw, '{D.TABLE_CELL}') AS hit, lower(regexp_extract(raw, '{D.TABLE_CELL}', 3)) AS tail,
    CASE WHEN regexp_matches({tr('text')}, '{D.COUNT_WORD}') THEN TRY_CAST(regexp_extract({tr('text')}, '{D.COUNT_WORD}', 1) AS INT)
      ELSE TRY_CAST(regexp_extract({tr('text')}, '{D.COUNT_CODE}', 1) AS INT) END AS c FROM n4),
  typed AS (SELECT doc_id, token_id, text, CASE WHEN hit THEN {_num(D.TABLE_CELL, 1, 'raw')} ELSE n END AS nominal,
    CASE WHEN NOT hit THEN coalesce(least(a, b), n + m) END AS minimum, CASE WHEN NOT hit THEN coalesce(greatest(a, b), n + p) END AS maximum,
    CASE WHEN NOT hit THEN p END AS tolerance_plus, CASE WHEN NOT hit THEN m END AS tolerance_minus,
    CASE WHEN hit THEN CASE WHEN tail = 'mm' THEN 'mm' ELSE 'unknown' END WHEN words THEN 'unknown' WHEN kind = 'range' AND contains(t, '°') THEN 'deg'
      WHEN len(groups) > 0 OR regexp_matches(t, '(?i)\\bmm\\b') THEN 'mm' ELSE 'unknown' END AS unit,
    CASE WHEN NOT hit AND NOT words THEN TRY_CAST(regexp_extract(t, '{D.QUANTITY}', 1) AS INT) END AS quantity,
    CASE WHEN hit OR words THEN '' WHEN contains(t, 'Ø') THEN 'Ø' WHEN regexp_matches(t, '(?i)\\bR\\s*\\d') THEN 'R' ELSE '' END AS symbol,
    CASE WHEN hit THEN tail = 'ref' ELSE NOT words AND regexp_matches(t, '(?i)\\bREF\\b') END AS is_reference,
    CASE WHEN c BETWEEN 1 AND 512 THEN c END AS count FROM n5)"""


@query("x3_dimensions", DIMS + " SELECT *, nominal IS NOT NULL OR maximum IS NOT NULL OR count IS NOT NULL AS readable FROM typed")
def x3(spark, sf):
    return text.normalise_dimensions(frame(spark, sf, "dimension_tokens")).drop("value_role")


@query("x3_dimension_yield", DIMS + """ SELECT doc_id, count(*) AS tokens, count(*) FILTER (nominal IS NOT NULL OR maximum IS NOT NULL OR count IS NOT NULL) AS readable,
    count(nominal) AS nominal, count(tolerance_plus) AS toleranced, count(count) AS counts FROM typed GROUP BY 1""")
def x3_yield(spark, sf):
    return text.dimension_yield(text.normalise_dimensions(frame(spark, sf, "dimension_tokens")))


@query("x3_restored_boxes", """WITH p AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE -90 END AS rot,
    [500.0 + 1000 * CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
  q AS (SELECT vec_id, unnest(range(0, 4)) AS k, rot, e FROM p),
  r AS (SELECT vec_id, CASE rot WHEN 90 THEN e[2 * k + 2] WHEN -90 THEN 1199.0 - e[2 * k + 2] ELSE e[2 * k + 1] END AS x,
    CASE rot WHEN 90 THEN 899.0 - e[2 * k + 1] WHEN -90 THEN e[2 * k + 1] ELSE e[2 * k + 2] END AS y FROM q)
  SELECT vec_id, CAST(trunc(min(x)) AS INT) AS x1, CAST(trunc(min(y)) AS INT) AS y1, CAST(trunc(max(x)) AS INT) AS x2, CAST(trunc(max(y)) AS INT) AS y2 FROM r GROUP BY 1""")
def x3_boxes(spark, sf):
    pixel = F.transform("embedding", lambda x: 500.0 + 1000 * x.cast("double"))
    polygon = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(
        F.element_at("_e", 2 * k + 1).alias("x"), F.element_at("_e", 2 * k + 2).alias("y")))
    rotation = F.when(F.col("label") % 3 == 0, 0).when(F.col("label") % 3 == 1, 90).otherwise(-90)
    polygons = table(spark, sf, "embeddings").withColumn("_e", pixel).select(
        "vec_id", polygon.alias("polygon"), rotation.alias("rotation"), F.lit(1200).alias("width"), F.lit(900).alias("height"))
    return polygons.select("vec_id", D.restored_box("polygon", "rotation", "width", "height").alias("_b")).select("vec_id", "_b.*")


CELLS = ctes("pin_cells") + f""", c AS (SELECT *, [trim(x) for x in string_split(numbers, ',')] AS parts FROM pin_cells),
  r AS (SELECT *, CASE WHEN len([x for x in parts if NOT regexp_matches(x, '{text.PIN_NUMBER}')]) = 0 THEN list_distinct(parts) ELSE [] END AS good,
    lower(type) AS t FROM c)"""


@query("x5_pin_rows", CELLS + """ SELECT doc_id, seq, unnest(good) AS pin_number, name, CASE WHEN upper(trim(name)) = 'NC' THEN 'PAS'
    WHEN t LIKE '%i/o%' OR t LIKE '%input/output%' OR t LIKE '%bidir%' OR regexp_matches(trim(t), '^[i1l|]\\s*/\\s*[o0]$') THEN 'IO'
    WHEN t LIKE '%output%' OR trim(t) IN ('do', 'ao') THEN 'OUT' WHEN t LIKE '%input%' OR trim(t) IN ('di', 'ai') THEN 'IN' ELSE 'PAS' END AS type FROM r""")
def x5(spark, sf):
    return text.normalise_pins(frame(spark, sf, "pin_cells"))[0]


@query("x5_pin_rejects", CELLS + " SELECT doc_id, seq, numbers FROM r WHERE len(good) = 0")
def x5_rejects(spark, sf):
    return text.normalise_pins(frame(spark, sf, "pin_cells"))[1]


ALIKE = ", ".join(f"'{a + b}'" for g in ("O0", "I1l|", "S5", "B8", "Z2", "G6", "D0") for a in g for b in g if a != b)


@query("x5_confusable_names", ctes("left_names", "right_names") + f""" SELECT doc_id, pin_number, l.name AS left_name, r.name AS right_name
  FROM left_names l JOIN right_names r USING (doc_id, pin_number) WHERE length(l.name) = length(r.name) AND l.name <> r.name
    AND len([i for i in range(1, 1 + length(l.name)) if l.name[i] <> r.name[i] AND (l.name[i] || r.name[i]) NOT IN ({ALIKE})]) = 0""")
def x5_confusable(spark, sf):
    return text.confusable_names(frame(spark, sf, "left_names"), frame(spark, sf, "right_names"))


@query("a15_inferred_units", ctes("tokens") + """, s AS (SELECT doc_id, bool_or(regexp_matches(text, '(?i)\\bmm\\b|millimeter')) AS m,
    bool_or(regexp_matches(text, '(?i)\\binch(?:es)?\\b|\\bIN\\.?\\b')) AS i, count(*) FILTER (regexp_matches(text, '\\d+,\\d+')) AS c FROM tokens WHERE confidence >= 0.80 GROUP BY 1),
  ok AS (SELECT doc_id FROM s WHERE m OR (NOT i AND c >= 3))
  SELECT doc_id, ord, CASE WHEN doc_id IN (SELECT doc_id FROM ok) AND unit_context = 'unknown' AND regexp_matches(text, '\\d') THEN 'mm' ELSE unit_context END AS unit_context FROM tokens""")
def a15(spark, sf):
    return text.infer_units(frame(spark, sf, "tokens")).select("doc_id", "ord", "unit_context")


# --- headings and pages ---------------------------------------------------------------------------------------------------
def heading_key_sql(c: str) -> str:
    return tr(f"regexp_replace(lower({tr(c)}), '{text.HEADING_PUNCTUATION}', ' ', 'g')")


def anchored_sql(c: str, key: str) -> str:
    return f"regexp_matches({heading_key_sql(c)}, '(^|[^a-z0-9])(?:{'|'.join(text.ANCHORS[key])})s?([^a-z0-9]|$)')"


def heading_sql(c: str) -> str:
    s = tr(c)
    body = tr(f"regexp_replace({s}, '{text.NUMBERED_PREFIX}', '')")
    letters = f"regexp_replace({s}, '[^A-Za-z]', '', 'g')"
    return f"""({s} <> '' AND length({s}) <= 72 AND NOT regexp_matches({s}, '{text.SENTENCE_END}') AND NOT regexp_matches({s}, '^[•\\-·*(（【]') AND (
      regexp_matches({s}, '^\\d+(\\.\\d+)*\\s+\\S') OR ({letters} <> '' AND upper({letters}) = {letters})
      OR ({body} <> {s} AND length({body}) BETWEEN 1 AND 40 AND NOT regexp_matches({body}, '{text.SENTENCE_END}') AND len(string_split_regex({body}, '\\s+')) <= 6)
      OR regexp_matches({s}, '^[一-鿿A-Za-z0-9\\s]{{2,20}}$')))"""


@query("x13_heading_matches", ctes("headed_lines") + f""" SELECT doc_id, line_no, {heading_sql('line')} AS heading, {anchored_sql('line', 'pins')} AS pins,
    {anchored_sql('line', 'package')} AS package FROM headed_lines""")
def x13(spark, sf):
    return frame(spark, sf, "headed_lines").select(
        "doc_id", "line_no", text.heading_like("line").alias("heading"), text.anchored("line", "pins").alias("pins"),
        text.anchored("line", "package").alias("package"))


@query("w4_section_pages", ctes("entry_pages", "entry_counts") + """, p AS (SELECT doc_id, page, bool_or(hit) AS hit FROM entry_pages GROUP BY 1, 2),
  n AS (SELECT *, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS later FROM p),
  e AS (SELECT doc_id, page, page_count, least(coalesce(later - 1, page_count), page + 23, page_count) AS e FROM n JOIN entry_counts USING (doc_id) WHERE hit)
  SELECT DISTINCT doc_id, CAST(unnest(range(page, greatest(least(e + 1, page_count), page) + 1)) AS INT) AS page FROM e""")
def w4(spark, sf):
    return text.section_pages(frame(spark, sf, "entry_pages"), frame(spark, sf, "entry_counts"))


@query("w5_contents_entries", ctes("toc_lines", "page_counts") + f""", h AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, page ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, instr(lower(line), 'contents') AS found_at FROM toc_lines WHERE page <= 12),
  pg AS (SELECT doc_id, page FROM h GROUP BY 1, 2 HAVING bool_or(found_at > 0 AND s + found_at + 7 <= 400) OR sum(len(regexp_extract_all(line, '\\.\\.\\.\\.'))) >= 3),
  t AS (SELECT doc_id, page, line_no, {tr('line')} AS line FROM h SEMI JOIN pg USING (doc_id, page) WHERE {tr('line')} <> ''),
  l AS (SELECT *, regexp_matches(line, '{text.TOC_LINE}') AS entry, {tr(f"regexp_extract(line, '{text.TOC_LINE}', 1)")} AS title FROM t),
  g AS (SELECT *, lag(line) OVER w AS pl, lag(entry) OVER w AS pe FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
  e AS (SELECT doc_id, page, line_no, CASE WHEN pl IS NOT NULL AND NOT pe AND len(string_split_regex(title, '\\s+')) <= 2 AND NOT regexp_matches(title, '^\\d') THEN pl || ' ' || title ELSE title END AS title,
    CAST(regexp_extract(line, '{text.TOC_LINE}', 2) AS INT) AS target FROM g WHERE entry)
  SELECT doc_id, page, line_no, title, target FROM e JOIN page_counts USING (doc_id) WHERE target BETWEEN 1 AND page_count
  QUALIFY page = min(page) OVER (PARTITION BY doc_id)""")
def w5(spark, sf):
    return text.contents_entries(frame(spark, sf, "toc_lines"), frame(spark, sf, "page_counts"))


def _window_sql(key: str, low: str, high: str, edge_from: str, edge_to: str) -> str:
    return ctes("rare_headed_lines", "page_counts") + f""", hit AS (SELECT DISTINCT doc_id, page FROM rare_headed_lines WHERE {heading_sql('line')} AND {anchored_sql('line', key)}),
  f AS (SELECT doc_id, min(page) FILTER (page BETWEEN {low} AND {high}) AS i, min(page) AS a FROM hit JOIN page_counts USING (doc_id) GROUP BY 1),
  d AS (SELECT doc_id, page_count, coalesce(i, a) AS hit, greatest(1, floor(page_count * 0.15)) AS w FROM page_counts LEFT JOIN f USING (doc_id))
  SELECT doc_id, CASE WHEN hit IS NOT NULL THEN 'keyword-window' ELSE 'ratio' END AS how,
    CAST(CASE WHEN hit IS NOT NULL THEN greatest(1, hit - 2) ELSE {edge_from} END AS INT) AS first_page,
    CAST(CASE WHEN hit IS NOT NULL THEN least(page_count, hit + 2) ELSE {edge_to} END AS INT) AS last_page FROM d"""


@query("w6_pin_window", _window_sql("pins", "1", "greatest(1, floor(page_count * 0.6))", "1", "w"))
def w6_pins(spark, sf):
    return text.anchor_window(frame(spark, sf, "rare_headed_lines"), frame(spark, sf, "page_counts"), "pins")


@query("w6_package_window", _window_sql("package", "greatest(1, floor(page_count * 0.5))", "page_count", "greatest(1, page_count - w + 1)", "page_count"))
def w6_package(spark, sf):
    return text.anchor_window(frame(spark, sf, "rare_headed_lines"), frame(spark, sf, "page_counts"), "package")


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("t6_figure_pages", ctes("scored_pages", "source_packages") + f""", s AS (SELECT doc_id, page, lower(text) AS t, lower(trim(coalesce(package, ''))) AS w FROM scored_pages LEFT JOIN source_packages USING (doc_id)),
  m AS (SELECT *, regexp_matches(w, '^(.+?)[\\s_-]*(\\d+)$') AS numbered, CASE WHEN regexp_matches(w, '^(.+?)[\\s_-]*(\\d+)$')
      THEN regexp_matches(t, '(^|[^a-z0-9_])' || regexp_extract(w, '^(.+?)[\\s_-]*(\\d+)$', 1) || '[\\s_-]*' || regexp_extract(w, '^(.+?)[\\s_-]*(\\d+)$', 2) || '([^0-9]|$)')
      ELSE w <> '' AND contains(t, w) END AS hit, {any_sql('t', ('package dimensions', 'package outline'))} AS outline FROM s),
  z AS (SELECT doc_id, page, CASE WHEN hit THEN 2 + CASE WHEN outline AND {any_sql('t', text.VIEW_WORDS)} THEN 5 ELSE 0 END ELSE 0 END
    + CASE WHEN {any_sql('t', text.FIGURE_WORDS)} THEN 1 ELSE 0 END - CASE WHEN {any_sql('t', text.TABLE_WORDS)} THEN 3 ELSE 0 END AS score
    FROM m WHERE NOT (outline AND numbered AND NOT hit))
  SELECT * FROM z WHERE score > 0""")
def t6(spark, sf):
    return text.figure_pages(frame(spark, sf, "scored_pages"), frame(spark, sf, "source_packages"))


SLIM = ctes("pin_pages", "hint_page_rows", "package_pages", "entry_counts") + """, parts AS (SELECT doc_id, 0 AS pri, page FROM pin_pages
    UNION ALL SELECT doc_id, 1, unnest(range(page - 2, page + 3)) FROM pin_pages UNION ALL SELECT doc_id, 2, page FROM hint_page_rows
    UNION ALL SELECT doc_id, 3, unnest([1, 2, 3]) FROM entry_counts UNION ALL SELECT doc_id, 4, page FROM package_pages),
  placed AS (SELECT doc_id, CAST(page AS INT) AS page, min(pri) AS pri FROM parts JOIN entry_counts USING (doc_id) WHERE page BETWEEN 1 AND page_count GROUP BY 1, 2),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pri, page) AS place FROM placed)"""


def _slim(spark, sf):
    return text.slim_pages(*[frame(spark, sf, n) for n in ("pin_pages", "hint_page_rows", "package_pages", "entry_counts")])


@query("t7_slim_pages", SLIM + " SELECT doc_id, page, place FROM ranks WHERE place <= 190")
def t7(spark, sf):
    return _slim(spark, sf)[0]


@query("t7_dropped_pages", SLIM + """ SELECT doc_id, count(*) AS dropped, arg_min(page, place) AS first_dropped, arg_max(page, place) AS last_dropped
  FROM ranks WHERE place > 190 GROUP BY 1""")
def t7_dropped(spark, sf):
    return _slim(spark, sf)[1]


@query("x19_remapped_pages", ctes("subset_pages", "subset_blocks") + """ SELECT b.doc_id, seq, coalesce(s.page - 1, b.page_idx) AS page_idx,
    s.page IS NULL AND b.page_idx IS NOT NULL AS out_of_range FROM subset_blocks b LEFT JOIN subset_pages s ON b.doc_id = s.doc_id AND b.page_idx = s.place""")
def x19(spark, sf):
    return text.remap_pages(frame(spark, sf, "subset_blocks"), frame(spark, sf, "subset_pages"))
