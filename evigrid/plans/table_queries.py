"""Tables on the driver tables: parts as HTML tables, events as table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..session import settled
from .registry import query
from .shapes import ctes, frame


# What stands in the places of the fixture's tables: five columns and six rows, the third reaching into the fourth
X7_CELLS = """WITH t AS (SELECT p_brand AS doc_id, CAST(p_partkey AS BIGINT) AS table_id, p_size % 8 + 1 AS a, p_size % 4 = 0 AS numbered, p_size % 3 = 0 AS quiet, * FROM part),
  g AS (SELECT *, CASE WHEN numbered THEN 'Pin No.' ELSE 'LQFP' || (a + 1) || ' pin' END AS head FROM t),
  v AS (SELECT *, [[head, head, 'Name', 'Type', 'Description'], [CASE WHEN numbered THEN '' ELSE 'main' END, '', '', '', ''], [a || ',' || (a + 1), 'x', p_name, 'Digital I/O', p_type || ' & more(1)'],
    [a || ',' || (a + 1), 'y', 'SHIFT', 'in', 'z'], [CASE WHEN quiet THEN '' ELSE 'bad cell' END, '', 'LATE', '', 'wrapped text'], ['B' || p_size, '', 'NC', 'Power', '-']] AS cells FROM g)
  SELECT doc_id, table_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, cells[r + 1][c + 1] AS text FROM v, range(6) y(r), range(5) x(c)"""


@query("x7_table_cells", X7_CELLS)
def x7_cells(spark, sf):
    return tables.table_cells(frame(spark, sf, "html_tables"))


# The two numbers of the third row and the ball of the last one; the fourth row repeats the numbers, the fifth is a wrapped or a bad one
X7_PINS = """WITH t AS (SELECT p_brand AS doc_id, CAST(p_partkey AS BIGINT) AS table_id, p_size % 8 + 1 AS a, * FROM part)
  SELECT doc_id, table_id, CAST(2 AS INT) AS r, CAST(i AS INT) AS pos, CAST(a + i AS VARCHAR) AS pin_number, p_name AS name, 'IO' AS type, p_type || ' & more' AS description FROM t, range(2) y(i)
  UNION ALL SELECT doc_id, table_id, 5, 0, 'B' || p_size, 'NC', 'PAS', '-' FROM t"""
X7_UNREAD = """WITH t AS (SELECT p_brand AS doc_id, CAST(p_partkey AS BIGINT) AS table_id, p_size % 8 + 1 AS a, * FROM part)
  SELECT doc_id, table_id, CAST(3 AS INT) AS r, 'repeated_number:' || (a + i) AS issue FROM t, range(2) y(i)
  UNION ALL SELECT doc_id, table_id, 4, 'no_valid_number' FROM t WHERE p_size % 3 <> 0"""


@query("x7_table_pins", X7_PINS)
def x7(spark, sf):
    return tables.extract_pins(tables.table_cells(frame(spark, sf, "html_tables")), frame(spark, sf, "table_targets"))[0]


@query("x7_unread_rows", X7_UNREAD)
def x7_unread(spark, sf):
    return tables.extract_pins(tables.table_cells(frame(spark, sf, "html_tables")), frame(spark, sf, "table_targets"))[1]


# The first column in all tables; where the package stands in the spanned header, both columns below it
A18 = """SELECT p_brand AS doc_id, CAST(p_partkey AS BIGINT) AS table_id, CAST(c AS INT) AS c FROM part, range(2) y(c) WHERE c = 0 OR p_size % 4 = 2"""


@query("a18_number_columns", A18)
def a18(spark, sf):
    cells = settled(tables.table_cells(frame(spark, sf, "html_tables")))
    split = tables.header_split(cells)
    targets = frame(spark, sf, "table_targets").select("doc_id", "table_id", F.col("package").alias("target"))
    return tables.number_columns(tables.headers(cells, split), tables.data_cells(cells, split), targets)


@query("w3_folded_rows", ctes("fold_input") + """, m AS (SELECT *, len(numbers) > 0 AS pin, len(numbers) = 0 AND blank AND description <> '' AS wrap FROM fold_input),
  h AS (SELECT *, last_value(CASE WHEN NOT wrap THEN r END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r) AS hr, last_value(CASE WHEN NOT wrap THEN pin END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r) AS hp FROM m),
  o AS (SELECT *, CASE WHEN pin THEN r WHEN wrap AND hp THEN hr END AS own FROM h)
  SELECT doc_id, own AS r, max(numbers[1]) FILTER (pin) AS number, max(name) FILTER (pin) AS name, arg_min(name, r) FILTER (wrap AND name <> '') AS late_name, string_agg(description, ' ' ORDER BY r) FILTER (description <> '') AS description FROM o WHERE own IS NOT NULL GROUP BY 1, 2""")
def w3(spark, sf):
    return tables.fold_rows(frame(spark, sf, "fold_input")).select("doc_id", "r", F.col("numbers")[0].alias("number"), "name", "late_name", "description")


ISLANDS = ctes("page_tables") + """, s AS (SELECT *, regexp_extract(caption, '(?i)\\bTable\\s+(\\d+)\\b', 1) AS no FROM page_tables),
  l AS (SELECT *, lag(no) OVER w AS pno, lag(page) OVER w AS pp, lag(header_tails) OVER w AS pt FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY table_id)),
  isl AS (SELECT doc_id, table_id, CAST(sum(CASE WHEN coalesce(no <> '' AND no = pno AND contains(caption, 'Continued') AND page <= pp + 1 AND header_tails = pt, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY table_id) AS BIGINT) AS island FROM l)"""


@query("j17_continued_tables", ISLANDS + " SELECT * FROM isl")
def j17(spark, sf):
    return tables.continued_tables(frame(spark, sf, "page_tables"), F.floor(F.col("table_id") / 4096)).select("doc_id", "table_id", "island")


@query("j17_merged_pins", ISLANDS + ctes("page_table_pins").replace("WITH", ",", 1) + """, p AS (SELECT x.*, island, row_number() OVER (PARTITION BY doc_id, island, pin_number ORDER BY table_id) AS rn, first_value(name || '|' || description) OVER (PARTITION BY doc_id, island, pin_number ORDER BY table_id) AS f
    FROM page_table_pins x JOIN isl USING (doc_id, table_id))
  SELECT doc_id, island, table_id, pin_number, name, description, rn > 1 AS conflicting FROM p WHERE rn = 1 OR name || '|' || description <> f""")
def j17_pins(spark, sf):
    islands = tables.continued_tables(frame(spark, sf, "page_tables"), F.floor(F.col("table_id") / 4096))
    return tables.merge_continued_pins(frame(spark, sf, "page_table_pins"), islands).drop("r", "type")


@query("t8_first_fit", ctes("page_tables", "table_pages", "table_packages") + """, r AS (SELECT t.*, package, regexp_matches(upper(caption || ' ' || header_text), '\\bTSSOP\\b') AS ts, CASE WHEN upper(package) LIKE 'TSSOP%' THEN 'T' WHEN upper(package) LIKE 'LQFP%' THEN 'L' END AS own FROM page_tables t LEFT JOIN table_packages USING (doc_id)),
  f AS (SELECT r.*, p.page IS NULL AS far FROM r LEFT JOIN table_pages p ON p.doc_id = r.doc_id AND p.page = r.page WHERE pins >= 2 AND (own IS NULL OR NOT ts OR own = 'T'))
  SELECT doc_id, arg_min(table_id, (far, table_id)) AS table_id, arg_min(page, (far, table_id)) AS page, min(far) AS retried FROM f GROUP BY 1""")
def t8(spark, sf):
    return tables.first_fit(*[frame(spark, sf, n) for n in ("page_tables", "table_pages", "table_packages")])
