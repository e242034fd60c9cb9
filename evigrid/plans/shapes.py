"""Operator inputs derived from the driver tables.

Each shape is a select list that Spark and DuckDB both read, so the query and its SQL start from the same
rows. Where the dialects differ an entry is a pair (spark, duckdb).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import table

SHAPES: dict[str, tuple[str, list, str | None]] = {}


def shape(name: str, source: str, columns: list, where: str | None = None) -> None:
    SHAPES[name] = (source, columns, where)


def _pick(entry, side: int) -> str:
    return entry if isinstance(entry, str) else entry[side]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, where = SHAPES[name]
    df = frame(spark, sf_dir, source) if source in SHAPES else table(spark, sf_dir, source)
    df = df.where(_pick(where, 0)) if where else df
    return df.selectExpr(*[_pick(c, 0) for c in columns])


def _cte(name: str) -> str:
    source, columns, where = SHAPES[name]
    tail = f" WHERE {_pick(where, 1)}" if where else ""
    return f"{name} AS (SELECT {', '.join(_pick(c, 1) for c in columns)} FROM {source}{tail})"


def ctes(*names: str) -> str:
    """WITH clause for the shapes a query reads, nested sources first."""
    wanted: list[str] = []

    def add(name: str) -> None:
        source = SHAPES[name][0]
        if source in SHAPES:
            add(source)
        if name not in wanted:
            wanted.append(name)
    for name in names:
        add(name)
    return "WITH " + ", ".join(_cte(n) for n in wanted)


def series(start: str, stop: str, alias: str) -> tuple[str, str]:
    """One row per integer start..stop, none when stop < start."""
    return (f"explode(CASE WHEN {stop} >= {start} THEN sequence({start}, {stop}) ELSE array() END) AS {alias}",
            f"unnest(range({start}, {stop} + 1)) AS {alias}")


def choice(expr: str, *values: str) -> str:
    """values[expr], as a CASE both dialects read."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {whens} ELSE '{values[-1]}' END"


# --- jobs, accounts, events -------------------------------------------------------------------------------
_NINE = ("pending", "ai_processing", "awaiting_input", "pending_review", "reviewed", "completed", "rejected",
         "stopped", "archived")

shape("symbol_jobs", "orders", [
    "CAST(o_orderkey AS STRING) AS id", "CAST(o_custkey % 7 AS STRING) AS tenant_id",
    f"{choice('o_orderkey % 9', *_NINE)} AS status",
    "'{\"spec_name\":\"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END"
    " || '\",\"device\":\"' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'D' || CAST(o_custkey AS STRING) END"
    " || CASE WHEN o_orderkey % 5 = 0 THEN '\",\"projection_sync_failed\":\"true' ELSE '' END || '\"}' AS package_params",
    "o_orderdate AS created_at",
    "CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at"])
shape("pcb_jobs", "lineitem", [
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
    " || '-' || CAST(l_suppkey AS STRING) AS id",
    "CAST(l_suppkey % 7 AS STRING) AS tenant_id", f"{choice('l_orderkey % 9', *_NINE)} AS status",
    "'{\"original_filename\":\"' || CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag || '.pdf' END || '\"}'"
    " AS package_params",
    "l_shipdate AS created_at", "CAST(NULL AS TIMESTAMP) AS deleted_at"])
shape("step_jobs", "events", [
    "CAST(event_id AS STRING) AS id", "CAST(user_id % 7 AS STRING) AS tenant_id",
    f"{choice('event_id % 9', *_NINE)} AS status", "props AS package_params", "ts AS created_at",
    "CAST(NULL AS TIMESTAMP) AS deleted_at"])
shape("users", "customer", [
    "c_custkey AS id", "'User' || CAST(c_custkey % 400 AS STRING) AS username",
    "CASE WHEN c_nationkey % 3 = 0 THEN 'USER' ELSE 'mail' END || CAST(c_custkey % 700 AS STRING) AS email"])
shape("invites", "supplier", [
    "CAST(s_suppkey AS STRING) AS token_hash", "CAST(s_suppkey % 40 + 5 AS INT) AS max_uses",
    "CAST(s_suppkey % 6 AS INT) AS used_count",
    "CASE WHEN s_suppkey % 5 = 0 THEN CAST('2024-01-12 00:00:00' AS TIMESTAMP)"
    " ELSE CAST('2025-01-01 00:00:00' AS TIMESTAMP) END AS expires_at",
    "CASE WHEN s_suppkey % 11 = 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) END AS revoked_at"])
shape("redemptions", "events", [
    "CAST(user_id AS STRING) AS token_hash", "ts AS redeemed_at", "event_id AS attempt_id", "user_id % 10 AS user_id"])
shape("job_log", "events", [
    "CAST(user_id % 8 AS STRING) AS job_id", "event_id AS ordinal", "event_type AS message", "value"])
shape("progress", "events", [
    "CAST(user_id % 10 AS STRING) AS job_id", "CAST(user_id AS STRING) AS task_id", "event_id AS id", "ts",
    f"{choice('user_id % 4', 'ocr', 'merge', 'failed', 'stopped_review')} AS node",
    "event_type IN ('signup', 'view') AS is_start", "event_type = 'click' AND value < 5 AS interrupted",
    "event_type = 'error' AND value > 10 AS has_error",
    "CASE WHEN event_type = 'purchase' AND value > 20 THEN 'stopped_by_rule' WHEN event_type = 'purchase' THEN"
    " 'failed' END AS result_status"])
shape("attempts", "events", [
    "CASE WHEN event_type = 'signup' THEN 'register' ELSE 'login' END AS operation",
    "CAST(user_id % 3 AS STRING) AS client", "event_id AS attempt_id", "ts"])
shape("hot_attempts", "events", [
    "CASE WHEN event_type = 'signup' THEN 'register' ELSE 'login' END AS operation",
    "CASE WHEN user_id % 10 = 0 THEN CAST(user_id % 3 AS STRING) ELSE 'hot' END AS client", "event_id AS attempt_id", "ts"])
shape("messages", "conversations", ["conv_id", "turn", "role", "text"])

# --- pins, figures, reviews ---------------------------------------------------------------------------------
_SIDES = ("left", "right", "top", "bottom", "unknown")

shape("pins", "lineitem", [
    "CAST(l_orderkey AS STRING) AS doc_id", "l_partkey * 1000000 + l_suppkey AS ord",
    "CASE WHEN l_suppkey % 17 = 0 THEN 'A' ELSE '' END || CAST(l_linenumber AS STRING) AS pin_number",
    "CASE WHEN l_tax = 0.0 THEN '' WHEN l_discount = 0.05 THEN CAST(l_linenumber AS STRING)"
    " WHEN l_suppkey % 7 = 0 THEN 'EPAD' WHEN l_partkey % 31 = 0 THEN '复位' || l_returnflag"
    " WHEN l_partkey % 37 = 0 THEN 'VERY_LONG_SIGNAL_NAME_NO_' || CAST(l_linenumber AS STRING)"
    " ELSE l_returnflag || l_linestatus || CAST(l_linenumber AS STRING) END AS name",
    f"{choice('l_suppkey % 3', 'IN', 'OUT', 'IO')} AS type", f"{choice('l_partkey % 5', *_SIDES)} AS side",
    "CAST(l_suppkey AS INT) AS side_order",
    "CASE WHEN l_suppkey % 2 = 1 THEN 'Exposed pad, solder to ground' ELSE 'Signal' END AS description"])
shape("figures", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "o_custkey", "o_orderkey"], "o_orderstatus <> 'P'")
shape("figure_rows", "figures", ["doc_id", "o_custkey", "o_orderkey", series("1", "CAST(o_custkey % 8 AS INT)", "i")])
shape("figure_pins", "figure_rows", [
    "doc_id", "i AS pos", "CAST(CASE WHEN i = 5 THEN 2 ELSE i END AS STRING) AS pin_number",
    f"{choice('(o_orderkey + i) % 5', *_SIDES)} AS side"])
shape("review_rows", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "o_custkey", "o_orderstatus",
                                series("1", "CAST(o_custkey % 6 AS INT)", "i")])
shape("observed", "review_rows", [
    "doc_id", "i AS pos", "CAST(i AS STRING) AS pin_number",
    "CASE WHEN i % 3 = 0 THEN '' WHEN i % 2 = 0 THEN 'A ' || o_orderstatus || CAST(i AS STRING)"
    " ELSE 'n' || o_orderstatus || CAST(i AS STRING) END AS name", f"{choice('(o_custkey + i) % 5', *_SIDES)} AS side"])
shape("docs", "orders", [
    "CAST(o_orderkey AS STRING) AS doc_id",
    f"{choice('o_custkey % 9', 'LQFP4', 'SOT23-5', 'DGS0006A', 'QFN-6', '', 'STM32F105VCT6', 'DFN4', 'SOT23', 'MSOP-8')}"
    " AS package",
    f"{choice('o_orderkey % 4', '', '9b88e7418e27', 'deadbeef', 'ADS1115')} AS device",
    f"{choice('o_custkey % 3', 'ADS1115', '', 'sheet')} AS file_stem"])
shape("hint_counts", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "CAST(4 + 2 * (o_custkey % 3) AS INT) AS pin_count"],
      "o_orderstatus = 'O'")
shape("name_candidates", "orders", [
    "CAST(o_orderkey AS STRING) AS doc_id", "CAST(0 AS INT) AS pos",
    f"{choice('o_orderkey % 5', 'LQFP4', 'DFN4', '', 'QFN-6', 'MSOP-8')} AS label"])

# --- document text ------------------------------------------------------------------------------------------------
_WORDS = ("The 16-lead TSSOP package", "LQFP64", "SSOP PACKAGE(TOP VIEW)", "SOT23", "", "14 pins SOIC and QFN-20",
          "msop 10", "7-Lead DFN", "BGA100 LQFP100", "113-lead BGA and 25-pin QFN, 5-lead SOT")

shape("lines", "documents", [
    "CAST(doc_id AS STRING) AS doc_id", "doc_id AS d", "source",
    ("posexplode(split(text, '\\n')) AS (line_no, line)",
     "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line")])
shape("blocks", "lines", [
    "doc_id", "CAST(line_no AS BIGINT) AS seq",
    f"{choice('(d + line_no) % 7', 'text', 'header', 'text', 'page_number', 'table', 'image', 'Footer')} AS type",
    "CAST(floor(line_no / 5) AS INT) AS page_idx",
    f"line || ' ' || {choice('(d * 7 + line_no) % 10', *_WORDS)} AS text",
    "CASE WHEN (d + line_no) % 5 = 0 THEN 'note 8-lead soic' ELSE ' ' END AS aside_text",
    ("CASE WHEN (d + line_no) % 4 = 1 THEN array('Figure DFN-8', ' ') ELSE array() END AS image_caption",
     "CASE WHEN (d + line_no) % 4 = 1 THEN ['Figure DFN-8', ' '] ELSE [] END AS image_caption"),
    ("CASE WHEN (d + line_no) % 6 = 1 THEN array('Table 5 LQFP64') END AS table_caption",
     "CASE WHEN (d + line_no) % 6 = 1 THEN ['Table 5 LQFP64'] END AS table_caption"),
    ("CAST(NULL AS array<string>) AS chart_caption", "CAST(NULL AS VARCHAR[]) AS chart_caption")])
shape("page_counts", "documents", [
    "CAST(doc_id AS STRING) AS doc_id",
    "CAST(floor((length(text) - length(replace(text, chr(10), ''))) / 6) AS INT) + 1 AS page_count"])
shape("headed_lines", "lines", [
    "doc_id", "CAST(floor(line_no / 6) AS INT) + 1 AS page", "CAST(line_no AS BIGINT) AS line_no",
    f"""CASE (d + line_no) % 9 WHEN 0 THEN 'Pin Configurations' WHEN 1 THEN '14 Mechanical, Packaging, and Orderable Information'
      WHEN 2 THEN 'Figure 5. Pin Configuration' WHEN 3 THEN 'PINOUT DIAGRAM' WHEN 4 THEN 'The pin functions are listed.'
      WHEN 5 THEN '引脚配置' WHEN 6 THEN line || ' land pattern' ELSE line END AS line"""])
shape("rare_headed_lines", "lines", [
    "doc_id", "CAST(floor(line_no / 6) AS INT) + 1 AS page", "CAST(line_no AS BIGINT) AS line_no",
    "CASE WHEN (d * 31 + line_no * 17) % 23 = 0 THEN 'PINOUT DIAGRAM' ELSE line END AS line"])
shape("toc_lines", "lines", [
    "doc_id", "CAST(floor(line_no / 6) AS INT) + 1 AS page", "CAST(line_no AS BIGINT) AS line_no",
    """CASE WHEN (d + line_no) % 5 = 0 THEN line || ' ........ ' || CAST((line_no * 3) % 9 + 1 AS STRING)
      WHEN (d + line_no) % 5 = 1 THEN 'Information........ ' || CAST(line_no % 4 + 1 AS STRING)
      WHEN line_no = 2 THEN 'Table of Contents' ELSE line END AS line"""])
shape("tokens", "lines", [
    "doc_id", "CAST(line_no AS BIGINT) AS ord", "CAST(line_no AS INT) AS top",
    "CAST((d * 13 + line_no * 7) % 100 AS DOUBLE) / 100 AS confidence",
    """CASE (d + line_no) % 11 WHEN 0 THEN 'TEXAS' WHEN 1 THEN 'INSTRUMENTS 12,70 mm' WHEN 2 THEN '28 PINS SHOWN'
      WHEN 3 THEN 'ADS1115IDGSR, (STM32F105VCT6)' WHEN 4 THEN '3,5' WHEN 5 THEN 'on Semiconductor' WHEN 6 THEN '0,25'
      WHEN 7 THEN 'R-PDSO-G16/FDB09-MALE' WHEN 8 THEN '1.5 inches 14-lead' ELSE line END AS text""",
    "CASE WHEN line_no % 4 = 0 THEN 'inch' ELSE 'unknown' END AS unit_context"])

_ONE = "CAST(p_size % 10 AS STRING) || '.' || CAST(p_partkey % 90 + 10 AS STRING)"
_TWO = "'0.' || CAST(p_size % 9 + 1 AS STRING)"
shape("dimension_tokens", "part", [
    "p_brand AS doc_id", "CAST(p_partkey AS STRING) AS token_id",
    "CASE WHEN p_partkey % 3 = 0 THEN 'table_nom' ELSE 'unknown' END AS value_role",
    f"""CASE p_partkey % 17 WHEN 0 THEN replace({_ONE}, '.', ',') WHEN 1 THEN {_ONE} || '±' || {_TWO}
      WHEN 2 THEN '.500(' || {_ONE} || '±' || {_TWO} || ')' WHEN 3 THEN '2-Ø' || {_ONE} WHEN 4 THEN {_ONE} || ' REF'
      WHEN 5 THEN 'A' || CAST(p_size AS STRING) WHEN 6 THEN {_ONE} || '-12.5' WHEN 7 THEN {_ONE} || ' MAX'
      WHEN 8 THEN {_ONE} || ' +' || {_TWO} || '/-0.05' WHEN 9 THEN '(' || {_ONE} || ')(' || {_TWO} || ')'
      WHEN 10 THEN {_ONE} || ' ' || {_TWO} WHEN 11 THEN 'R' || {_ONE} WHEN 12 THEN {_ONE} || ' mm'
      WHEN 13 THEN CAST(p_size AS STRING) || ' PINS SHOWN' WHEN 14 THEN 'R-PDSO-G' || CAST(p_size AS STRING)
      WHEN 15 THEN '0°-' || CAST(p_size AS STRING) || '°' ELSE '.5' END AS text"""])
shape("named_packages", "part", [
    "CAST(p_partkey AS STRING) AS doc_id",
    f"""CASE p_partkey % 7 WHEN 0 THEN {choice('p_size % 4', 'LQFP', 'tssop ', 'BGA-', 'QFN_')} || CAST(p_size AS STRING)
      WHEN 1 THEN 'SOT23-' || CAST(p_size AS STRING) WHEN 2 THEN 'DGS00' || CAST(p_size AS STRING) || 'A'
      WHEN 3 THEN p_name || ' ' || CAST(p_size AS STRING) WHEN 4 THEN 'STM32F105VCT6' WHEN 5 THEN 'PW'
      ELSE CAST(p_size AS STRING) END AS package""",
    "'dir/C' || CAST(p_size AS STRING) || '_' || p_type || '(MCU)_' || CASE WHEN p_partkey % 2 = 0 THEN 'STM32F' ELSE 'ads' END"
    " || CAST(p_partkey AS STRING) || '_datasheet_9b88e7418e27.v2.pdf' AS file"])
shape("ordering_codes", "part", [
    "p_brand AS doc_id", "p_partkey AS ord",
    "'ADS' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'I' ELSE '' END || 'DGS'"
    " || CASE WHEN p_partkey % 3 = 0 THEN 'R' WHEN p_partkey % 3 = 1 THEN 'T' ELSE '' END AS identifier",
    "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'dgs' END AS package_code"])
shape("pin_cells", "customer", [
    "CAST(c_nationkey AS STRING) AS doc_id", "c_custkey AS seq",
    """CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN '1, ' || CAST(c_custkey % 50 AS STRING) || ',1'
      WHEN 2 THEN 'B6, ' || 'A' || CAST(c_custkey % 20 AS STRING) WHEN 3 THEN '3, x' WHEN 4 THEN '' ELSE 'ABCD1' END AS numbers""",
    "CASE WHEN c_custkey % 13 = 0 THEN ' nc' ELSE c_mktsegment END AS name",
    f"{choice('c_custkey % 7', 'Digital I/O', 'Output', 'analog input', 'DO', '1/0', 'Power', 'ai')} AS type"])
shape("left_names", "customer", ["CAST(c_nationkey AS STRING) AS doc_id", "CAST(c_custkey AS STRING) AS pin_number",
                                 f"{choice('c_custkey % 5', 'AIN0', 'RESET', 'SB8', 'IN1', 'GND')} AS name"])
shape("right_names", "customer", ["CAST(c_nationkey AS STRING) AS doc_id", "CAST(c_custkey AS STRING) AS pin_number",
                                  f"{choice('c_custkey % 7', 'AINO', 'RE5ET', '588', 'INl', 'GND', 'AIN0', 'S8B')} AS name"])
shape("scored_pages", "documents", [
    "source AS doc_id", "doc_id AS page",
    f"""text || ' ' || {choice('doc_id % 8', 'Top View LQFP 100', 'pin functions', 'Package Outline TOP VIEW LQFP100',
                              'package dimensions SSOP', '', 'PINOUT of SSOP', 'lqfp1000', 'pin assignment pin definitions')} AS text"""])
shape("source_packages", "supplier", ["'src' || CAST(s_suppkey AS STRING) AS doc_id",
                                      f"{choice('s_suppkey % 3', 'LQFP100', 'ssop', '')} AS package"])
shape("entry_pages", "events", ["CAST(user_id AS STRING) AS doc_id", "CAST(event_id % 300 AS INT) + 1 AS page",
                                "event_type = 'purchase' AS hit"])
shape("entry_counts", "customer", ["CAST(c_custkey AS STRING) AS doc_id", "CAST(c_custkey % 50 AS INT) + 260 AS page_count"])
for _kind, _event in (("pin_pages", "purchase"), ("hint_page_rows", "view"), ("package_pages", "click")):
    shape(_kind, "entry_rows", ["doc_id", "page"], f"event_type = '{_event}'")
shape("entry_rows", "events", ["CAST(user_id % 12 AS STRING) AS doc_id", "CAST(event_id % 400 AS INT) + 1 AS page", "event_type"])
shape("subset_docs", "customer", ["CAST(c_custkey AS STRING) AS doc_id", series("0", "19", "place")])
shape("subset_pages", "subset_docs", ["doc_id", "CAST(place AS INT) AS place", "CAST(place * 2 + 1 AS INT) AS page"])
shape("subset_blocks", "events", ["CAST(user_id AS STRING) AS doc_id", "event_id AS seq",
                                  "CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS INT) END AS page_idx"])

# --- search and chunks ---------------------------------------------------------------------------------------------
shape("result_rows", "pages", ["page_id", "url", "html", series("1", "2", "i")])
shape("results", "result_rows", [
    "page_id % 40 AS task_id", "page_id * 2 + i AS ord",
    "CASE WHEN i = 1 THEN url ELSE ' ' || upper(url) || '/' END AS url",
    ("array('q' || CAST((page_id + i) % 3 AS STRING), 'q' || CAST(i AS STRING)) AS source_queries",
     "['q' || CAST((page_id + i) % 3 AS STRING), 'q' || CAST(i AS STRING)] AS source_queries"),
    "regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title", "'' AS snippet", "regexp_extract(html, '<p>(.*?)</p>', 1) AS content"])
shape("search_tasks", "benchmark", [
    "item_id AS task_id", "text AS task",
    ("array('Example.com', 'thther.example.org') AS target_domains", "['Example.com', 'thther.example.org'] AS target_domains")])
shape("search_products", "benchmark", [
    "item_id AS task_id",
    ("CASE item_id % 4 WHEN 0 THEN array('exa-xxle', 'q') WHEN 1 THEN array('cheap.pills') WHEN 2 THEN array('ADS1115', 'th/th') ELSE array('zz9') END AS identifiers",
     "CASE item_id % 4 WHEN 0 THEN ['exa-xxle', 'q'] WHEN 1 THEN ['cheap.pills'] WHEN 2 THEN ['ADS1115', 'th/th'] ELSE ['zz9'] END AS identifiers"),
    "CASE WHEN item_id % 3 = 0 THEN 'net, QFN-20' ELSE 'VQFN 20' END AS package_type"])
shape("citations", "pages", ["page_id % 40 AS task_id", "page_id AS ord",
                             "CASE WHEN page_id % 5 = 0 THEN url ELSE 'http://elsewhere.example/' || CAST(page_id AS STRING) END AS url"])
shape("chunk_texts", "documents", ["doc_id AS id", "doc_id % 3 AS tenant_id", "doc_id % 2 AS course_id", "text"])
shape("query_texts", "benchmark", ["item_id AS query_id", "item_id % 3 AS tenant_id",
                                   "CASE WHEN item_id % 4 = 0 THEN item_id % 2 END AS course_id", "text"])
shape("markdown_lines", "lines", [
    "doc_id", "CAST(line_no AS BIGINT) AS line_no",
    """CASE (d * 3 + line_no * 5) % 13 WHEN 0 THEN '# ' || line WHEN 4 THEN '## Part ' || CAST(line_no AS STRING) WHEN 7 THEN '### Sub'
      WHEN 9 THEN '#### Deep' WHEN 11 THEN '```' WHEN 12 THEN '##### five' ELSE line END AS line"""])
shape("old_chunks", "documents", ["'c' || CAST(doc_id AS STRING) AS id", "CAST(doc_id % 50 AS STRING) AS document_id",
                                  "text AS content", "CAST(doc_id AS INT) AS chunk_index", "CAST(1 AS BIGINT) AS updated_at"])
shape("new_chunks", "documents", ["'c' || CAST(doc_id + 400 AS STRING) AS id", "CAST(doc_id % 30 AS STRING) AS document_id",
                                  "source || text AS content", "CAST(doc_id AS INT) AS chunk_index", "CAST(2 AS BIGINT) AS updated_at"])
shape("typed_values", "part", [
    "p_partkey AS doc_id", f"{choice('p_partkey % 4', 'nominal_pin_count', 'terminal_pitch', 'lead_angle', 'negative_side_pin_span')} AS field",
    "CASE WHEN p_partkey % 10 = 0 THEN 0.0 WHEN p_partkey % 7 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice / 10 END AS value",
    f"{choice('p_partkey % 9', 'mm', 'cm', 'Mil', 'inch', '', 'pins', 'deg', 'um', '英寸')} AS unit"])

shape("answer_texts", "part", [
    "CAST(p_partkey AS STRING) AS doc_id", f"{choice('p_partkey % 17', 'cancel', 'drop', ' Provide ')} AS action",
    f"{choice('p_size % 11', 'pitch: 0.65 mm, overall height = 1.2', 'Body height 45 mil; body width is 3', '引脚间距为0.5毫米', 'pin count 16 pins, total height -1 mm', 'nothing here', 'terminal_pitch=20 mil lead spacing 0.8 cm', 'OVERALL WIDTH 2 inch, pitch 3 deg', 'subpitch 4 mm', 'lead span 2. lead length .5 um', '引脚数 7.5 个', 'pitch 1 mm pitch 2 mm')} || CASE WHEN p_partkey % 97 = 0 THEN repeat(' ', 4000) ELSE '' END AS text",
    ("CASE WHEN p_partkey % 5 = 0 THEN map('terminal_pitch', named_struct('value', CAST(p_size AS DOUBLE), 'unit', 'mil')) WHEN p_partkey % 7 = 0 THEN map('body_width', named_struct('value', CAST(2 AS DOUBLE), 'unit', CAST(NULL AS STRING))) END AS slots",
     "CASE WHEN p_partkey % 5 = 0 THEN MAP {'terminal_pitch': {'value': CAST(p_size AS DOUBLE), 'unit': 'mil'}} WHEN p_partkey % 7 = 0 THEN MAP {'body_width': {'value': CAST(2 AS DOUBLE), 'unit': CAST(NULL AS VARCHAR)}} END AS slots")])
shape("request_slots", "part", ["p_partkey", series("0", "2", "i")], "p_partkey % 23 <> 0")
shape("answer_requests", "request_slots", [
    "CAST(p_partkey AS STRING) AS doc_id", f"{choice('(p_partkey + i * 3) % 9', 'terminal_pitch', 'lead_spacing', 'body_height', 'housing_height', 'nominal_pin_count', 'pin_span', 'total_height', 'overall_width', 'body_width')} AS field"])

# --- geometry -----------------------------------------------------------------------------------------------------------


def vector(text: str) -> tuple[str, str]:
    """E1..E64 as the elements of the embedding in both dialects."""
    return (re.sub(r"\bE(\d+)\b", lambda m: f"CAST(embedding[{int(m[1]) - 1}] AS DOUBLE)", text),
            re.sub(r"\bE(\d+)\b", lambda m: f"CAST(embedding[{m[1]}] AS DOUBLE)", text))


def _px(expr: str, name: str) -> tuple[str, str]:
    return vector(f"CAST(floor({expr}) AS INT) AS {name}")


shape("box_base", "embeddings", [
    "CAST(label AS STRING) AS doc_id", "CAST(vec_id AS STRING) AS id", "vec_id AS ord",
    _px("(E1 + 0.5) * 800", "x1"), _px("(E2 + 0.5) * 600", "y1"), _px("20 + abs(E3) * 200", "w"), _px("8 + abs(E4) * 60", "h"),
    vector("round(least(1.0, 0.5 + abs(E5) * 3), 4) AS confidence"),
    f"{choice('vec_id % 7', '12.5', 'SOT-23 view', '1,5', '3.0-3.2', '28 PINS', 'Top View', '2-Ø1.5')} AS text",
    "CASE WHEN vec_id % 9 = 0 THEN 90 ELSE 0 END AS rotation_deg", "'r' || CAST(vec_id % 60 AS STRING) AS source_region_id"])
shape("boxes", "box_base", ["doc_id", "id", "ord", "x1", "y1", "x1 + w AS x2", "y1 + h AS y2", "confidence", "text", "rotation_deg", "source_region_id"])
shape("dense_boxes", "boxes", ["doc_id", "id", "ord", "CAST(floor(x1 / 120) * 30 AS INT) AS x1", "CAST(floor(y1 / 120) * 12 AS INT) AS y1",
                               "CAST(floor(x1 / 120) * 30 AS INT) + 45 + ord % 8 AS x2", "CAST(floor(y1 / 120) * 12 AS INT) + 20 + ord % 4 AS y2",
                               "confidence", "CASE WHEN ord % 2 = 0 THEN 'A1' ELSE 'a1' END AS text"])
shape("regions", "supplier", [
    "CAST(s_suppkey % 10 AS STRING) AS doc_id", "'r' || CAST(s_suppkey AS STRING) AS region_id", "s_suppkey AS ord",
    "CAST((s_suppkey * 37) % 500 AS INT) AS x1", "CAST((s_suppkey * 53) % 400 AS INT) AS y1",
    "CAST((s_suppkey * 37) % 500 + 60 + s_nationkey * 12 AS INT) AS x2", "CAST((s_suppkey * 53) % 400 + 50 + s_nationkey * 9 AS INT) AS y2",
    "CAST((60 + s_nationkey * 12) * (50 + s_nationkey * 9) AS DOUBLE) / 480000 AS area_ratio"])
shape("images", "nation", ["CAST(n_nationkey AS STRING) AS doc_id", "800 AS width", "600 AS height"])
shape("drawn_lines", "embeddings", [
    "CAST(label AS STRING) AS doc_id", "'l' || CAST(vec_id AS STRING) AS line_id", "vec_id AS ord",
    f"{choice('vec_id % 3', 'dimension_line', 'extension_line', 'contour')} AS type",
    _px("(E9 + 0.5) * 800", "lx1"), _px("(E10 + 0.5) * 600", "ly1"),
    _px("(E9 + 0.5) * 800 + CASE WHEN vec_id % 2 = 0 THEN 40 + abs(E11) * 300 ELSE 2 END", "lx2"),
    _px("(E10 + 0.5) * 600 + CASE WHEN vec_id % 2 = 0 THEN 1 WHEN vec_id % 5 = 0 THEN 70 ELSE 40 + abs(E12) * 300 END", "ly2"),
    ("CASE WHEN vec_id % 4 = 0 THEN array('a' || CAST(vec_id AS STRING)) ELSE array() END AS arrow_ids",
     "CASE WHEN vec_id % 4 = 0 THEN ['a' || CAST(vec_id AS STRING)] ELSE [] END AS arrow_ids"),
    vector("round(least(1.0, 0.5 + abs(E13) * 3), 4) AS confidence"), "'r' || CAST(vec_id % 60 AS STRING) AS source_region_id"])
shape("pads", "embeddings", [
    "CAST(label AS STRING) AS spec_id", "vec_id AS ord", "'P' || CAST(vec_id AS STRING) AS number",
    vector("round(E1 * 14, 4) AS x"), vector("round(E2 * 14, 4) AS y"), vector("round(0.15 + abs(E3), 4) AS size_x"),
    vector("round(0.15 + abs(CASE WHEN vec_id % 3 = 0 THEN E3 ELSE E4 END), 4) AS size_y"),
    "CASE WHEN vec_id % 3 = 0 THEN 'CIRCLE' ELSE 'RECTANGLE' END AS shape"])
shape("pad_specs", "nation", ["CAST(n_nationkey AS STRING) AS spec_id", "0.15 AS min_clearance", "n_nationkey % 2 = 0 AS ep_present",
                              "CAST(1.5 AS DOUBLE) AS ep_x", "CAST(1.0 AS DOUBLE) AS ep_y", "'EP' AS ep_pin_number"])
shape("dual_specs", "part", [
    "CAST(p_partkey AS STRING) AS spec_id", "CAST(0.15 AS DOUBLE) AS min_clearance", "CAST(0.4 + p_size / CAST(100 AS DOUBLE) AS DOUBLE) AS pin_pitch",
    "CAST(0.3 + (p_partkey % 7) / CAST(50 AS DOUBLE) AS DOUBLE) AS land_y", "CAST(0.8 AS DOUBLE) AS land_x", "p_partkey % 3 = 0 AS ep_present",
    "CASE WHEN p_partkey % 6 = 0 THEN CAST(1.0 + (p_partkey % 20) / CAST(10 AS DOUBLE) AS DOUBLE) END AS ep_x",
    ("array(CAST(-1.5 AS DOUBLE), CAST(1.4 AS DOUBLE)) AS pin_columns_x", "[CAST(-1.5 AS DOUBLE), CAST(1.4 AS DOUBLE)] AS pin_columns_x")])
_BOX3 = [vector("round(-1 + E1 / 9, 4) AS xmin"), vector("round(1 + E2 / 9, 4) AS xmax"), vector("round(-2 + E3 / 9, 4) AS ymin"),
         vector("round(2 + E4 / 9, 4) AS ymax"), "0.0 AS zmin", vector("round(1 + E5 / 9, 4) AS zmax")]
_BOX3R = [vector("round(-1 + E6 / 9, 4) AS xmin"), vector("round(1 + E7 / 9, 4) AS xmax"), vector("round(-2 + E8 / 9, 4) AS ymin"),
          vector("round(2 + E9 / 9, 4) AS ymax"), "0.0 AS zmin", vector("round(1 + E10 / 9, 4) AS zmax")]
shape("built_models", "embeddings", [
    "CAST(vec_id AS STRING) AS doc_id", *_BOX3, vector("round(8 + E11 / 2, 4) AS volume_mm3"), "CAST(vec_id % 3 + 1 AS INT) AS solid_count",
    "CAST(vec_id % 20 + 5 AS INT) AS face_count", "CAST(vec_id % 30 + 9 AS INT) AS edge_count", "vec_id % 17 <> 0 AS is_valid",
    "CASE WHEN vec_id % 4 = 0 THEN 'exact' ELSE 'similar' END AS match_type",
    "CASE WHEN vec_id % 5 = 0 THEN 'web_exact' ELSE 'local_feature_ir' END AS model_source", "CAST(vec_id % 2 AS INT) AS missing_structures"])
shape("reference_models", "embeddings", [
    "CAST(vec_id AS STRING) AS doc_id", *_BOX3R, vector("round(8 + E12 / 2, 4) AS volume_mm3"),
    "CASE WHEN vec_id % 7 <> 0 THEN CAST(vec_id % 2 + 1 AS INT) END AS solid_count", "CAST(2 AS INT) AS minimum_solid_count",
    "CAST(vec_id % 18 + 5 AS INT) AS face_count", "CAST(vec_id % 29 + 9 AS INT) AS edge_count", "CAST(vec_id % 12 AS INT) AS minimum_face_count"])
shape("read_docs", "customer", [
    "CAST(c_custkey AS STRING) AS doc_id", "CAST(CASE WHEN c_custkey % 31 = 0 THEN 0.895 ELSE 0.1 END AS DOUBLE) AS bx1", "CAST(0.2 AS DOUBLE) AS by1",
    "CAST(CASE WHEN c_custkey % 37 = 0 THEN 1.2 ELSE 0.9 END AS DOUBLE) AS bx2", "CAST(0.8 AS DOUBLE) AS by2", "640 AS width", "480 AS height",
    "CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 3 AS INT) END AS pin_count"])
shape("read_pins", "embeddings", [
    "CAST(vec_id % 60 AS STRING) AS doc_id", "vec_id AS ord", "CASE WHEN vec_id % 41 = 0 THEN 'x' ELSE CAST(CAST(floor(vec_id / 60) AS INT) % 7 AS STRING) END AS pin_number",
    "CASE WHEN vec_id % 11 = 0 THEN '' ELSE 'NAME' || CAST(vec_id AS STRING) END AS name",
    f"{choice('CAST(floor(vec_id / 60) AS INT) % 5', 'left', 'right', 'top', 'bottom', 'unknown')} AS side",
    vector("round(0.5 + E1 * 1.5, 4) AS x"), vector("round(0.5 + E2 * 1.5, 4) AS y"), vector("round(0.8 + abs(E3), 4) AS confidence"), "vec_id % 13 = 0 AS uncertain"])
shape("placed_pins", "read_pins", ["doc_id", "ord", "CAST(ord AS STRING) AS pin_number", "name",
                                   f"{choice('CAST(floor(ord / 60) AS INT) % 4', 'left', 'right', 'top', 'bottom')} AS side", "x", "y"])
shape("side_points", "embeddings", [
    "CAST(label AS STRING) AS doc_id", f"{choice('vec_id % 2', 'left', 'right')} AS side", "CAST(vec_id AS STRING) AS id", "vec_id AS ord",
    vector("round(E1, 2) AS at_y"), "CAST(1.0 AS DOUBLE) AS span"])
shape("observed_pads", "embeddings", [
    "CAST(label AS STRING) AS job_id", "CASE WHEN vec_id % 23 = 0 THEN 'extra' ELSE 'P' END || CAST(vec_id AS STRING) AS number",
    vector("round(E1 * 14, 4) + CASE WHEN vec_id % 5 = 0 THEN 0.0009 WHEN vec_id % 7 = 0 THEN 0.002 ELSE 0 END AS x"), vector("round(E2 * 14, 4) AS y"),
    vector("round(0.15 + abs(E3), 4) + CASE WHEN vec_id % 11 = 0 THEN 0.01 ELSE 0 END AS size_x"),
    vector("round(0.15 + abs(CASE WHEN vec_id % 3 = 0 THEN E3 ELSE E4 END), 4) AS size_y"),
    "CASE WHEN vec_id % 3 = 0 THEN 'circle' ELSE 'RECTANGLE' END AS shape"])

# --- evidence and families ----------------------------------------------------------------------------------------------
_ONE_P = "CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey % 3 + 1 AS STRING)"
shape("ev_tokens", "lineitem", [
    "CAST(l_orderkey AS STRING) AS doc_id", "'t' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey % 4 AS STRING) AS token_id",
    "l_partkey AS p", "l_suppkey AS s"])
shape("tokens_a", "ev_tokens", ["doc_id", "token_id", "p", "s", "row_number() OVER (PARTITION BY doc_id, token_id ORDER BY p, s) AS rn"])
shape("ev_token_rows", "tokens_a", [
    "doc_id", "token_id",
    f"CASE WHEN s % 9 = 0 THEN 'A1' WHEN s % 9 = 1 THEN '8 PINS' WHEN s % 9 = 2 THEN CAST(s % 5 AS STRING) || ' mm' WHEN s % 9 = 3 THEN '1.0-2.0'"
    " WHEN s % 9 = 4 THEN '2.5' ELSE CAST(p % 3 + 1 AS STRING) || '.5' END AS text",
    "CASE WHEN s % 4 = 0 THEN 'table_nom' ELSE 'unknown' END AS value_role", "CASE WHEN s % 7 = 0 THEN 'unknown' ELSE 'mm' END AS unit_context",
    "'r' || CAST(s % 3 AS STRING) AS source_region_id", "CAST(0.7 + (p % 30) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence",
    "CAST(p % 200 AS INT) AS x1", "CAST(s % 100 AS INT) AS y1", "CAST(p % 200 + 20 AS INT) AS x2", "CAST(s % 100 + 10 AS INT) AS y2"], "rn = 1")
shape("ev_lines", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "'l' || CAST(o_custkey % 3 AS STRING) AS line_id"])
_FIELDS = ("total_height", "terminal_length", "body_standoff", "nominal_pin_count", "pin_span", "lead_angle_deg", "overall_width", "terminal_thickness")
shape("ev_assignments", "lineitem", [
    "CAST(l_orderkey AS STRING) AS doc_id", "l_partkey * 1000 + l_suppkey % 1000 AS assignment_id", f"{choice('l_partkey % 8', *_FIELDS)} AS canonical_name",
    *[(f"CASE WHEN l_quantity < 20 THEN array(t1) WHEN l_quantity < 45 THEN array(t1, t2) ELSE array(t1, t2, t3) END AS token_ids".replace("t1", a).replace("t2", b).replace("t3", c),
       f"CASE WHEN l_quantity < 20 THEN [t1] WHEN l_quantity < 45 THEN [t1, t2] ELSE [t1, t2, t3] END AS token_ids".replace("t1", a).replace("t2", b).replace("t3", c))
      for a, b, c in [("'t' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey % 4 AS STRING)", "'t' || CAST(l_linenumber % 7 + 1 AS STRING) || '_' || CAST(l_partkey % 4 AS STRING)",
                       "'t' || CAST(l_linenumber AS STRING) || '_1'")]],
    ("CASE WHEN l_suppkey % 3 = 0 THEN array() ELSE array('l' || CAST(l_suppkey % 3 AS STRING)) END AS line_ids",
     "CASE WHEN l_suppkey % 3 = 0 THEN [] ELSE ['l' || CAST(l_suppkey % 3 AS STRING)] END AS line_ids"),
    "l_returnflag AS target_feature", "CAST(0.7 + l_discount * 2 + l_tax AS DOUBLE) AS confidence"])
_FAMILIES = ("ic/gullwing_ic", "ic/quad_gullwing_ic", "ic/qfn_ufqfpn", "resistor/two_terminal_chip", "connector/cn/dsub_connector")
shape("ev_docs", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", f"{choice('o_custkey % 5', *_FAMILIES)} AS family_id",
                            f"{choice('o_custkey % 4', 'SOT-23', 'SOIC8', 'QFN', 'LQFP')} AS package_type"])
shape("ev_features", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", f"{choice('o_orderkey % 4', 'molded_body', 'gullwing_lead', 'chip_body', 'two_side_lead_array')} AS feature"])
shape("ev_unresolved", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "'unresolved' AS kind", f"{choice('o_custkey % 8', *_FIELDS)} AS field"], "o_orderstatus = 'P'")

_VALUES = [
    ("nominal_pin_count", "4 * (p_size % 6 + 1) + CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END"), ("terminal_pitch", "0.5"),
    ("pin_span", "(2 * (p_size % 6 + 1) - 1) * 0.5"), ("total_height", "1.2"), ("housing_height", "1.1"), ("body_standoff", "0.1"),
    ("overall_width", "6.4"), ("body_width", "4.4"), ("body_length", "4.4 + p_size % 3"), ("terminal_length", "0.6"), ("terminal_thickness", "0.15"),
    ("terminal_width", "0.25"), ("overall_length", "6.4 + p_size % 3"), ("terminal_span", "(p_size % 6) * 0.5"), ("lead_projection", "1.0"),
    ("terminal_height", "0.2"), ("exposed_pad_length", "3.0"), ("exposed_pad_width", "4.5 - p_size % 2"), ("body_height", "0.5"),
    ("circuit_count", "9"), ("contact_pitch", "2.77"), ("contact_column_span", "11.08"), ("rear_housing_width", "30.0"),
    ("contact_inner_diameter", "1.0"), ("contact_outer_diameter", "1.6"), ("negative_side_pin_count", "2 * (p_size % 6 + 1)"),
    ("positive_side_pin_count", "2 * (p_size % 6 + 1)"), ("negative_side_pin_span", "(2 * (p_size % 6 + 1) - 1) * 0.5"),
    ("positive_side_pin_span", "(2 * (p_size % 6 + 1) - 1) * 0.5"), ("overall_height", "12.5"), ("front_projection_depth", "6.0"), ("rear_body_depth", "9.0"),
    ("front_plate_height", "12.4"), ("plate_thickness", "1.0"), ("front_shell_top_width", "17.0"), ("front_shell_bottom_width", "16.0"),
    ("front_shell_height", "8.3"), ("shell_wall_thickness", "0.4"), ("mounting_center_span", "25.0"), ("mounting_hole_diameter", "3.1"),
    ("mounting_outer_diameter", "5.0"), ("rear_housing_height", "11.0"), ("contact_row_spacing", "2.84"), ("signal_pin_width", "0.6"), ("pin_tail_length", "3.2")]
shape("family_docs", "part", ["CAST(p_partkey AS STRING) AS doc_id", f"{choice('p_partkey % 5', *_FAMILIES)} AS family_id",
                              f"{choice('p_size % 4', 'SOT-23', 'SOIC8', 'QFN', 'LQFP')} AS package_type"])
shape("param_slots", "part", ["p_partkey", "p_size", f"{choice('p_partkey % 5', *_FAMILIES)} AS family_id", series("0", str(len(_VALUES) - 1), "i")])
_ROWISH = "i BETWEEN 25 AND 28"
shape("params", "param_slots", [
    "CAST(p_partkey AS STRING) AS doc_id", "family_id", f"CASE i {' '.join(f'WHEN {k} THEN ' + repr(n) for k, (n, _) in enumerate(_VALUES))} END AS canonical_name",
    f"CAST(CASE i {' '.join(f'WHEN {k} THEN {v}' for k, (_, v) in enumerate(_VALUES))} END AS DOUBLE) + CASE WHEN i <> 0 AND (p_partkey + i * 7) % 61 = 0 THEN 0.3 ELSE 0 END AS value",
    "CASE WHEN i IN (0, 19, 25, 26) THEN 'count' WHEN (p_partkey + i) % 97 = 0 THEN 'unknown' ELSE 'mm' END AS unit",
    "CAST(0.78 + ((p_partkey * 3 + i) % 22) / CAST(100 AS DOUBLE) AS DOUBLE) AS ocr_confidence", "CAST(0.8 + ((p_partkey + i * 5) % 20) / CAST(100 AS DOUBLE) AS DOUBLE) AS semantic_confidence",
    "CASE WHEN (p_partkey + i) % 19 = 0 THEN 'human_input' WHEN (p_partkey + i) % 5 = 0 THEN 'table_row' ELSE 'dimension_line' END AS evidence_kind",
    ("CASE WHEN (p_partkey + i) % 19 = 0 THEN array('human_input:q1:' || CAST(i AS STRING)) ELSE array('t' || CAST(i AS STRING), 'l' || CAST(i % 3 AS STRING)) END AS evidence_ids",
     "CASE WHEN (p_partkey + i) % 19 = 0 THEN ['human_input:q1:' || CAST(i AS STRING)] ELSE ['t' || CAST(i AS STRING), 'l' || CAST(i % 3 AS STRING)] END AS evidence_ids"),
    ("array('t' || CAST(i AS STRING)) AS token_ids", "['t' || CAST(i AS STRING)] AS token_ids"),
    ("CASE WHEN i = 0 AND p_size % 5 = 0 THEN array('28 pin 5.0 x 6 mm', '0.65 mm pitch') ELSE array('v' || CAST(i AS STRING)) END AS raw_texts",
     "CASE WHEN i = 0 AND p_size % 5 = 0 THEN ['28 pin 5.0 x 6 mm', '0.65 mm pitch'] ELSE ['v' || CAST(i AS STRING)] END AS raw_texts"),
    "(p_partkey + i) % 19 <> 0 AND (p_partkey + i) % 83 <> 0 AS has_boxes"],
    f"NOT ({_ROWISH} AND p_size > 8) AND NOT (p_size BETWEEN i AND i + 2 AND i > 0)")
shape("operator_values", "part", [
    "CAST(p_partkey AS STRING) AS doc_id", f"{choice('p_partkey % 5', *_FAMILIES)} AS family_id",
    f"{choice('p_size % 3', 'total_height', 'terminal_span', 'body_width')} AS canonical_name", "CAST(1.3 AS DOUBLE) AS value", "'mm' AS unit", "'q9' AS question_id"],
    "p_type = 'SMALL'")
shape("family_selections", "part", [
    "CAST(p_partkey AS STRING) AS doc_id", f"{choice('p_partkey % 9', 'two_terminal_chip', 'gullwing_ic', 'ic/ufqfpn', 'connector/mt', '', 'nothing', 'dsub_connector', ' misc ', 'ic/qfn_ufqfpn')} AS family_id",
    f"{choice('p_size % 6', 'Resistor', '', 'ic', 'connector', 'capacitor', 'other')} AS category_id",
    f"{choice('p_size % 5', 'CN', '', 'mt', 'xx', '')} AS subcategory_id", f"{choice('p_size % 4', 'MLCC part', 'a resistor', '电阻 capacitor', '')} AS identity_text"])
shape("class_tokens", "lines", [
    "doc_id", "CAST(line_no AS BIGINT) AS ord", "CAST((d * 13 + line_no * 7) % 100 AS DOUBLE) / 100 AS confidence",
    """CASE (d * 5 + line_no) % 23 WHEN 0 THEN 'D2' WHEN 1 THEN 'E2' WHEN 2 THEN 'A3' WHEN 3 THEN 'b' WHEN 4 THEN '8-lead' WHEN 5 THEN 'small outline' WHEN 6 THEN 'transistor'
      WHEN 7 THEN CASE WHEN d % 7 = 0 THEN 'LQFP 64' ELSE 'x' END WHEN 8 THEN CASE WHEN d % 9 = 0 THEN 'QFN-20' ELSE 'y' END WHEN 9 THEN 'resistors' ELSE line END AS text"""])
shape("classes", "documents", ["CAST(doc_id AS STRING) AS doc_id", f"{choice('doc_id % 4', 'two_terminal_chip', 'gullwing_ic', 'ic/qfn_ufqfpn', '')} AS family_id",
                               f"{choice('doc_id % 3', 'ic', '', 'resistor')} AS category_id", "'' AS subcategory_id", "CAST(0.85 + (doc_id % 15) / CAST(100 AS DOUBLE) AS DOUBLE) AS overall_confidence"])
shape("view_rows", "part", ["CAST(p_partkey AS STRING) AS doc_id", f"{choice('p_size % 6', 'Top View', 'front', 'dimension_table_1', 'detail', 'PCB layout', 'other')} AS view_type",
                            f"{choice('p_partkey % 5', *_FAMILIES)} AS family_id"])
shape("table_rows", "part", ["p_brand AS doc_id", "p_partkey AS ord", "'k' || CAST(p_partkey AS STRING) AS label_token", f"{choice('p_size % 9', 'A', 'a1', 'b', 'e', ' E ', 'L2', 'B', 'zz', 'd2')} AS label",
                             "CAST(0.5 + (p_partkey % 40) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence", "CASE WHEN p_size % 2 = 0 THEN 'n' || CAST(p_partkey AS STRING) ELSE '' END AS nom",
                             "CASE WHEN p_size % 3 = 0 THEN 'x' || CAST(p_partkey AS STRING) END AS max", "CASE WHEN p_size % 5 = 0 THEN 'm' || CAST(p_partkey AS STRING) END AS min"])
shape("drawn_numbers", "lineitem", ["CAST(l_partkey AS STRING) AS doc_id", "CAST(l_linenumber * 4 - l_suppkey % 5 AS INT) AS number"])
shape("layouts", "part", [
    "CAST(p_partkey AS STRING) AS doc_id", "CAST(4 + 2 * (p_size % 10) + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS nominal_pin_count", "CAST(0.5 AS DOUBLE) AS terminal_pitch",
    "CAST((1 + p_size % 10) * 0.5 + CASE WHEN p_partkey % 9 = 0 THEN 0.2 ELSE 0 END AS DOUBLE) AS pin_span",
    "CASE WHEN p_partkey % 4 = 0 THEN CAST(2 + p_size % 10 AS DOUBLE) END AS negative_side_pin_count", "CASE WHEN p_partkey % 4 = 0 THEN CAST(2 + p_size % 10 + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS positive_side_pin_count",
    "CASE WHEN p_partkey % 4 = 0 THEN CAST((1 + p_size % 10) * 0.5 AS DOUBLE) END AS negative_side_pin_span", "CASE WHEN p_partkey % 8 = 0 THEN CAST((1 + p_size % 10) * 0.5 AS DOUBLE) END AS positive_side_pin_span",
    "CASE WHEN p_partkey % 6 = 0 THEN CAST(0.3 AS DOUBLE) END AS negative_side_terminal_width", "CASE WHEN p_partkey % 12 = 0 THEN CAST(0.6 AS DOUBLE) WHEN p_partkey % 6 = 0 THEN 0.2 END AS positive_side_terminal_width",
    "CAST(0.25 AS DOUBLE) AS terminal_width", "CAST((p_partkey % 11) * 0.6 + 1 AS DOUBLE) AS body_length"])
shape("golden_cases", "part", ["CAST(p_partkey AS STRING) AS case_id", "p_size % 4 = 0 AS blind_mode", "CAST(0.7 + (p_size % 30) / CAST(100 AS DOUBLE) AS DOUBLE) AS overall_confidence"])
shape("golden_expected", "part", ["CAST(p_partkey AS STRING) AS case_id", "'f' || CAST(p_size % 7 + 1 AS STRING) AS field", "CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS nominal", "CAST(8 AS DOUBLE) AS tolerance"])
shape("golden_rows", "lineitem", ["CAST(l_partkey AS STRING) AS case_id", "'f' || CAST(l_linenumber AS STRING) AS field", "l_quantity", "l_returnflag", "l_discount", "row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey) AS rn"])
shape("golden_extracted", "golden_rows", ["case_id", "field", "CASE WHEN l_quantity > 3 THEN l_quantity END AS nominal_value", "CASE WHEN l_returnflag = 'A' THEN 'visual_reference' ELSE 'dimension' END AS evidence_type", "CAST(0.8 + l_discount AS DOUBLE) AS confidence"], "rn = 1")
shape("golden_missing", "part", ["CAST(p_partkey AS STRING) AS case_id", "'f' || CAST(p_size % 3 + 1 AS STRING) AS field"], "p_type = 'PROMO'")
shape("decisions", "events", ["event_id AS decision_id", f"{choice('event_id % 5', 'ic', 'resistor', 'unknown', 'ic', 'misc')} AS choice", "CAST(0.4 + (event_id % 60) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence", "value"])
shape("decision_slots", "decisions", ["decision_id", "value", "choice", series("0", "3", "i")])
shape("decision_options", "decision_slots", ["decision_id", f"{choice('i', 'ic', 'resistor', 'unknown', 'misc')} AS name",
    "CAST(CASE WHEN choice = CASE i WHEN 0 THEN 'ic' WHEN 1 THEN 'resistor' WHEN 2 THEN 'unknown' ELSE 'misc' END THEN 0.4 + (decision_id % 50) / CAST(100 AS DOUBLE) ELSE (0.6 - (decision_id % 50) / CAST(100 AS DOUBLE)) / 3 END"
    " + CASE WHEN decision_id % 13 = 0 THEN 0.05 ELSE 0 END AS DOUBLE) AS probability"])
shape("view_assignments", "lineitem", ["CAST(l_orderkey AS STRING) AS doc_id", "l_linenumber AS view_no", f"{choice('l_partkey % 8', *_FIELDS)} AS canonical_name"], "l_returnflag <> 'N'")
shape("placed_assignments", "lineitem", ["CAST(l_orderkey AS STRING) AS doc_id", "l_linenumber % 3 AS view_no", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos", f"{choice('l_partkey % 8', *_FIELDS)} AS canonical_name"], "l_returnflag <> 'N'")
shape("identity_classes", "documents", ["CAST(doc_id AS STRING) AS doc_id", f"{choice('doc_id % 3', 'SOIC', 'QFN')} AS package_type"])
shape("identity_slots", "documents", ["doc_id", series("1", "CAST(doc_id % 27 AS INT)", "i")])
shape("identity_views", "identity_slots", ["CAST(doc_id AS STRING) AS doc_id", f"{choice('(doc_id + i) % 4', 'top', 'side', 'bottom')} AS view_type"])
shape("identity_features", "identity_slots", ["CAST(doc_id AS STRING) AS doc_id", "CAST(40 - i AS INT) AS pos", "'f' || CAST(i % 5 AS STRING) AS name"])
shape("identity_tokens", "part", ["p_brand AS doc_id", "p_partkey AS ord", "'i' || CAST(p_partkey AS STRING) AS token_id", f"{choice('p_size % 5', 'QFN outline', '8 mm pins', 'drawing A1234-lead', 'UFQFPN, 48 - Leads', '7x7')} AS text"], "p_size % 3 = 0")
shape("view_confidences", "lineitem", ["CAST(l_orderkey AS STRING) AS doc_id", "l_linenumber AS view_no", "CAST(0.5 + l_tax + l_discount AS DOUBLE) AS confidence"])
shape("view_classes", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "CAST(0.6 + (o_custkey % 40) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence"])
shape("view_features", "lineitem", ["CAST(l_orderkey AS STRING) AS doc_id", "l_linenumber AS view_no", "CAST(l_partkey AS INT) AS pos", f"{choice('l_suppkey % 6', *_FIELDS[:6])} AS name"], "l_linestatus = 'F'")
shape("view_unresolved", "lineitem", ["CAST(l_orderkey AS STRING) AS doc_id", "l_linenumber AS view_no", "CAST(l_partkey AS INT) AS pos", f"{choice('l_suppkey % 8', *_FIELDS)} AS name"], "l_linestatus = 'O'")
shape("first_reading", "orders", ["CAST(o_custkey AS STRING) AS doc_id", "CAST(o_orderkey AS STRING) AS canonical_name", "o_totalprice AS value"])
shape("second_reading", "orders", ["CAST(o_custkey AS STRING) AS doc_id", "CAST(o_orderkey AS STRING) AS canonical_name", "o_totalprice * 2 AS value"], "o_orderstatus <> 'F'")
shape("reading_issues", "orders", ["CAST(o_custkey AS STRING) AS doc_id", "CAST(o_orderkey AS STRING) AS canonical_name"], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
shape("read_values", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "CASE WHEN o_orderstatus = 'P' THEN 'inch' ELSE 'mm' END AS unit",
    ("map('body_x', CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END, 'pitch', CAST(o_custkey AS DOUBLE)) AS values",
     "map {'body_x': CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END, 'pitch': CAST(o_custkey AS DOUBLE)} AS values")])
shape("read_evidence", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "CASE WHEN o_custkey % 2 = 0 THEN 'body_x' ELSE 'pitch' END AS field", "CAST(0.8 + (o_custkey % 20) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence", "o_custkey % 11 = 0 AS uncertain"])
shape("required_slots", "region", ["CASE r_regionkey WHEN 0 THEN 'body_x' WHEN 1 THEN 'pitch' WHEN 2 THEN 'pad_count' END AS field"], "r_regionkey < 3")
shape("header_tokens", "lines", ["source AS doc_id", "doc_id AS source_region_id",
    """CASE (d * 3 + line_no) % 17 WHEN 0 THEN 'MILLIMETERS' WHEN 1 THEN 'Min.' WHEN 2 THEN 'NOM' WHEN 3 THEN 'max' WHEN 4 THEN 'Dimensions' WHEN 5 THEN 'DIMENSION A1' WHEN 6 THEN 'Dimension B 2'
       WHEN 7 THEN CAST(line_no AS STRING) WHEN 8 THEN 'PINS **' WHEN 9 THEN 'DIM' WHEN 10 THEN '7.5' ELSE line END AS text"""])

# --- logs and footprints ----------------------------------------------------------------------------------------------
shape("verify_lines", "events", [
    "CAST(user_id AS STRING) AS job_id", "'verify' AS log_kind", "event_id AS line_no",
    """CASE event_id % 11 WHEN 0 THEN '  PIN number=("A' || CAST(event_id % 7 AS STRING) || '") padstack=(nil) location=(nil) bbox=(((-1.25 0.25) (' || CAST(user_id % 5 AS STRING) || '.5 0.75))) rot=(0.0) shape=("CIRCLE") copper_bbox=(((-0.125 -0.125) (0.125 0.125)))'
      WHEN 1 THEN 'OBJ type=("path") layer=("PACKAGE GEOMETRY/SILKSCREEN_TOP") bbox=(((-1.5 0.5) (1.5 0.75)))' WHEN 2 THEN 'OBJ type=("' || event_type || '") layer=(nil) bbox=(nil)'
      WHEN 3 THEN 'designType=("PACKAGE")' WHEN 4 THEN 'units=("millimeters") accuracy=(4) extents=(((-20.0 -20.0) (20.0 20.0)))' WHEN 5 THEN 'pin_count=' || CAST(user_id % 20 AS STRING)
      WHEN 6 THEN 'object_count=' || CAST(event_id % 30 AS STRING) WHEN 7 THEN 'PROPOBJ layer=("PACKAGE GEOMETRY/PLACE_BOUND_TOP") fill=(nil) prop=(((PACKAGE_HEIGHT_MAX "0.64 mm")))'
      WHEN 8 THEN CASE WHEN user_id % 3 = 0 THEN '==== VERIFY END ====' ELSE 'noise' END WHEN 9 THEN 'OBJ type=("text") layer=("REF DES/ASSEMBLY_TOP") bbox=(((-1.5 0.5) (1.5 0.75)))' ELSE 'version="17.2"' END AS text"""])
shape("props_lines", "events", [
    "CAST(user_id AS STRING) AS job_id", "'props' AS log_kind", "event_id AS line_no",
    """CASE event_id % 5 WHEN 0 THEN 'OBJ layer=("PACKAGE GEOMETRY/PLACE_BOUND_TOP")' WHEN 1 THEN '  props=(((PACKAGE_HEIGHT_MAX "0.' || CAST(event_id % 9 AS STRING) || ' mm") (Other "x y")))'
      WHEN 2 THEN 'OBJ layer=("REF DES/ASSEMBLY_TOP")' WHEN 3 THEN 'props=(nil)' ELSE CASE WHEN user_id % 4 = 0 THEN '==== PROPERTY CHECK END ====' ELSE 'object_count=4' END END AS text"""])
shape("build_lines", "events", [
    "CAST(user_id AS STRING) AS job_id", "'build' AS log_kind", "event_id AS line_no",
    """CASE event_id % 9 WHEN 0 THEN 'rename X -> ("PART' || CAST(user_id AS STRING) || '")' WHEN 1 THEN 'PADSTACK P' || CAST(event_id % 2 AS STRING) || ' toDisk=(' || CASE WHEN value < 30 THEN 't' ELSE 'nil' END || ')'
      WHEN 2 THEN 'PIN A' || CAST(event_id % 5 AS STRING) || ' xy=-1.5:' || CAST(user_id % 9 AS STRING) || '.25 result=(x)' WHEN 3 THEN 'SAVE dra =("PART' || CAST(user_id % 100 AS STRING) || '")'
      WHEN 4 THEN 'COMPILE psm =("part' || CAST(user_id AS STRING) || '.psm")' WHEN 5 THEN 'OBJ type=("' || CASE WHEN value > 100 THEN 'drc' ELSE 'pin' END || '") layer=(nil) bbox=(nil)'
      WHEN 6 THEN 'DUMP pin_count=12' WHEN 7 THEN '==== BUILD END ====' ELSE 'CLEAR pass=1 found=0' END AS text"""])
shape("log_specs", "customer", [
    "CAST(c_custkey AS STRING) AS job_id", "'PART' || CAST(c_custkey AS STRING) AS name", "'millimeters' AS units", "4 AS accuracy", "CAST(c_custkey % 20 AS INT) AS pin_count",
    "c_custkey % 2 = 0 AS ep_present", "c_custkey % 3 = 0 AS marker", "CAST(-20 AS DOUBLE) AS ex0", "CAST(-20 AS DOUBLE) AS ey0", "CAST(20 AS DOUBLE) AS ex1",
    "CAST(CASE WHEN c_custkey % 7 = 0 THEN 25 ELSE 20 END AS DOUBLE) AS ey1", "'0.' || CAST(c_custkey % 9 AS STRING) || ' Mm' AS height"])
shape("log_number_docs", "customer", ["CAST(c_custkey AS STRING) AS job_id", series("0", "CAST(c_custkey % 2 + 5 AS INT)", "i")])
shape("log_numbers", "log_number_docs", ["job_id", "'A' || CAST(i AS STRING) AS number"])
shape("log_padstacks", "log_number_docs", ["job_id", "'P' || CAST(i AS STRING) AS padstack"], "i < 3")
shape("expected_pads", "pads", ["spec_id AS job_id", "number", "x", "y", "size_x AS mask_x", "size_y AS mask_y", "shape", "size_x AS copper"])
shape("read_pads", "observed_pads", ["job_id", "number", "x", "y", "size_x", "size_y", "upper(shape) AS shape", "size_x AS copper_x", "size_x AS copper_y"])
shape("assertion_rows", "events", ["CAST(user_id % 200 AS STRING) AS job_id", "value < 300 AS passed"], "event_type <> 'error'")
shape("assertion_jobs", "customer", ["CAST(c_custkey AS STRING) AS job_id"])

_NUMS = [(f"transform(sequence(1, CAST({n} AS INT)), i -> CAST(i AS STRING))", f"[CAST(i AS VARCHAR) for i in range(1, CAST({n} AS INT) + 1)]") for n in ("p_size % 6 * 2 + 2 + CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END",)]
_D = "CAST({} AS DOUBLE)".format
shape("foot_specs", "part", [
    "CAST(p_partkey AS STRING) AS spec_id", f"{choice('p_partkey % 3', 'DUAL', 'EXPLICIT', 'DUAL')} AS pin_layout", "CAST(p_size % 6 * 2 + 2 + CASE WHEN p_size % 13 = 0 THEN 2 ELSE 0 END AS INT) AS pin_count",
    (_NUMS[0][0] + " AS pin_numbering", _NUMS[0][1] + " AS pin_numbering"),
    *[f"CASE WHEN p_partkey % 3 <> 1 AND p_size <> 17 THEN {_D(v)} END AS {n}" for n, v in (("pin_pitch", "0.5"), ("land_x", "0.8"), ("land_y", "0.25 + (p_partkey % 4) / CAST(100 AS DOUBLE)"))],
    ("CASE WHEN p_partkey % 3 <> 1 THEN array(CAST(-1.5 AS DOUBLE), CAST(1.5 - p_size % 5 AS DOUBLE)) END AS pin_columns_x", "CASE WHEN p_partkey % 3 <> 1 THEN [CAST(-1.5 AS DOUBLE), CAST(1.5 - p_size % 5 AS DOUBLE)] END AS pin_columns_x"),
    "p_partkey % 5 <> 0 AS nsmd", f"{_D('0.05 + (p_size % 3) * 0.04')} AS mask_expansion", f"{choice('p_partkey % 4', 'MATCH_LAND', 'INSET', 'NONE', 'MATCH_LAND')} AS paste_mode", f"{_D('(p_size % 4) * 0.05')} AS paste_inset",
    "p_partkey % 2 = 0 AS ep_present", f"CASE WHEN p_partkey % 6 <> 0 THEN {_D('1.6')} END AS ep_x", f"{_D('2.0')} AS ep_y", "CASE WHEN p_size % 7 = 0 THEN '2' WHEN p_size % 7 = 1 THEN 'E-P' ELSE 'EP' END AS ep_pin_number",
    "CASE WHEN p_size = 29 THEN 'inch' ELSE 'millimeters' END AS units", ("array(CAST(-20 AS DOUBLE), CAST(-20 AS DOUBLE), CAST(20 AS DOUBLE), CAST(p_size - 21 AS DOUBLE)) AS extents", "[CAST(-20 AS DOUBLE), CAST(-20 AS DOUBLE), CAST(20 AS DOUBLE), CAST(p_size - 21 AS DOUBLE)] AS extents"),
    f"{_D('3.0')} AS body_x", f"{_D('3.0 + p_size % 2')} AS body_y", f"{_D('0.05')} AS mold_flash", f"{_D('0.10')} AS silk_clearance", f"{_D('0.05')} AS silk_span_extra", f"{_D('0.12')} AS silk_line_width", f"{_D('0.05')} AS pb_clearance",
    f"CASE WHEN p_size % 3 = 0 THEN {_D('2.9')} END AS refdes_silk_y", f"{choice('p_partkey % 3', 'TRIANGLE', 'NONE', 'NONE')} AS pin1_marker", f"{_D('0.30')} AS pin1_marker_size"])
shape("foot_pad_slots", "part", ["p_partkey", "p_size", series("0", "CAST(p_size % 6 * 2 + 1 AS INT)", "i")], "p_partkey % 3 = 1")
shape("foot_pads", "foot_pad_slots", [
    "CAST(p_partkey AS STRING) AS spec_id", "CAST(i AS INT) AS ord", "CASE WHEN p_size % 10 = 3 AND i = 1 THEN 'Z' ELSE CAST(i + 1 AS STRING) END AS number", f"{_D('i * 0.5 - 1')} AS x", f"{_D('CASE WHEN i % 2 = 0 THEN 0.75 ELSE -0.75 END')} AS y",
    f"{_D('0.2 + (p_partkey % 5) * 0.05')} AS size_x", f"{_D('CASE WHEN p_size % 9 = 0 THEN 0.4 ELSE 0.2 + (p_partkey % 5) * 0.05 END')} AS size_y", "CASE WHEN i % 3 = 0 THEN 'CIRCLE' ELSE 'RECTANGLE' END AS shape"])
shape("grids", "part", [
    "CAST(p_partkey AS STRING) AS spec_id", f"{_D('0.5')} AS pitch_x", f"{_D('0.3')} AS standard_size_x", f"{_D('0.8')} AS standard_size_y", f"{_D('CASE WHEN p_size = 33 THEN 0.5 ELSE 2.4 END')} AS outer_span_y",
    ("transform(sequence(1, CAST(p_size % 5 + 2 AS INT)), i -> 'T' || CAST(i AS STRING)) AS top_numbers", "['T' || CAST(i AS VARCHAR) for i in range(1, CAST(p_size % 5 + 3 AS INT))] AS top_numbers"),
    ("transform(sequence(1, CAST(p_size % 5 + CASE WHEN p_size = 41 THEN 3 ELSE 2 END AS INT)), i -> 'B' || CAST(i AS STRING)) AS bottom_numbers", "['B' || CAST(i AS VARCHAR) for i in range(1, CAST(p_size % 5 + CASE WHEN p_size = 41 THEN 4 ELSE 3 END AS INT))] AS bottom_numbers"),
    (f"array(named_struct('number', CASE WHEN p_size = 21 THEN 'X' ELSE 'T1' END, 'size_x', {_D('0.5')}, 'alignment', {choice('p_partkey % 4', 'left', 'right', 'center', 'unknown')})) AS special_pads",
     f"[{{'number': CASE WHEN p_size = 21 THEN 'X' ELSE 'T1' END, 'size_x': {_D('0.5')}, 'alignment': {choice('p_partkey % 4', 'left', 'right', 'center', 'unknown')}}}] AS special_pads"),
    ("CASE WHEN p_size % 3 = 0 THEN array(1) WHEN p_size = 7 THEN array(99) ELSE array() END AS bridged_columns", "CASE WHEN p_size % 3 = 0 THEN [1] WHEN p_size = 7 THEN [99] ELSE [] END AS bridged_columns")])
shape("quads", "part", [
    "CAST(p_partkey AS STRING) AS spec_id", "CAST(p_size % 4 + 2 AS INT) AS count", f"{_D('0.5')} AS pitch", f"{_D('CASE WHEN p_size = 50 THEN 9 ELSE 0.8 END')} AS pad_length", f"{_D('0.3')} AS pad_width", f"{_D('5.0')} AS outer_span_x", f"{_D('6.0')} AS outer_span_y",
    *[(f"array('{a}', CAST(p_size % 4 + {b} AS STRING)) AS {s}_numbers", f"['{a}', CAST(p_size % 4 + {b} AS VARCHAR)] AS {s}_numbers") for s, a, b in (("bottom", "1", 2), ("right", "3", 4), ("top", "x", 1))],
    ("CASE WHEN p_size % 2 = 0 THEN array('9') ELSE array(CAST(20 + p_size % 4 + 1 AS STRING), '20') END AS left_numbers", "CASE WHEN p_size % 2 = 0 THEN ['9'] ELSE [CAST(20 + p_size % 4 + 1 AS VARCHAR), '20'] END AS left_numbers")])
shape("outlines", "part", [
    "CAST(p_partkey AS STRING) AS spec_id", f"{choice('p_size % 4', 'mm', 'mil', 'inch', 'unknown')} AS units", "p_size % 10 <> 3 AS centered", "CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN -90 ELSE 180 END AS INT) AS rotation_deg",
    "'D' AS body_x_symbol", "'E1' AS body_y_symbol", "'E' AS overall_symbol", "'A' AS height_symbol", "CASE WHEN p_size % 9 = 0 THEN 'q' ELSE 'e' END AS pitch_symbol",
    (f"map('D', named_struct('maximum', {_D('3')}, 'typical', CAST(NULL AS DOUBLE)), 'E1', named_struct('maximum', {_D('1.5')}, 'typical', {_D('1.4')}), 'E', named_struct('maximum', {_D('3.0 - p_size % 3')}, 'typical', {_D('2.8')}), 'A', named_struct('maximum', {_D('1.1')}, 'typical', {_D('1')}), 'e', named_struct('maximum', CAST(NULL AS DOUBLE), 'typical', {_D('0.65')}), 'b', named_struct('maximum', {_D('0.4')}, 'typical', {_D('0.3')}), 'L', named_struct('maximum', {_D('0.6')}, 'typical', {_D('0.5')})) AS dimensions",
     "p_size AS dimensions"), "p_size"])
shape("outline_slots", "part", ["p_partkey", "p_size", series("0", "CAST(p_size % 4 + 1 AS INT)", "i")])
shape("outline_terminals", "outline_slots", [
    "CAST(p_partkey AS STRING) AS spec_id", "CAST(i AS INT) AS ord", "CASE WHEN i % 2 = 0 THEN 'top' ELSE 'bottom' END AS side", f"{_D('floor(i / 2) - CASE WHEN p_size = 12 THEN floor(i / 2) ELSE 0 END')} AS pitch_index",
    "CAST(i + 1 AS STRING) AS number", "CASE WHEN p_size % 19 = 0 THEN 'zz' ELSE 'b' END AS width_symbol", "CASE WHEN p_partkey % 2 = 0 THEN 'L' END AS length_symbol"])
shape("label_slots", "part", ["p_partkey", "p_size", series("0", "CAST(2 * (p_size % 4) + 2 AS INT)", "i")])
# An odd number of pads on two sides, so that one rotation fits; equal rows are ambiguous.
shape("label_pads", "label_slots", [
    "CAST(p_partkey AS STRING) AS spec_id", "CAST(i AS INT) AS ord", "CAST((i * 3) % 11 AS STRING) AS number",
    f"{_D('CASE WHEN p_size % 5 = 0 THEN i ELSE CASE WHEN i <= p_size % 4 + 1 THEN -1.5 ELSE 1.5 END END')} AS x",
    f"{_D('CASE WHEN p_size % 5 = 0 THEN i % 3 ELSE CASE WHEN i <= p_size % 4 + 1 THEN i ELSE i - p_size % 4 - 1.5 END * 0.5 END')} AS y"])
shape("source_rows", "part", ["p_partkey", "p_size", series("0", "1", "r")])
shape("label_rows", "source_rows", [
    "CAST(p_partkey AS STRING) AS spec_id", "CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN r = 0 THEN 'top' ELSE 'bottom' END ELSE CASE WHEN r = 0 THEN 'left' ELSE 'right' END END AS side",
    ("transform(sequence(1, CAST(p_size % 4 + CASE WHEN r = 0 THEN 2 ELSE 1 END AS INT)), i -> CAST(i + r * 20 AS STRING)) AS numbers", "[CAST(i + r * 20 AS VARCHAR) for i in range(1, CAST(p_size % 4 + CASE WHEN r = 0 THEN 3 ELSE 2 END AS INT))] AS numbers"),
    "CASE WHEN p_size % 11 = 0 THEN 'bottom' ELSE 'top' END AS view", "'TOP VIEW' AS view_evidence", f"{_D('0.95')} AS confidence", "CASE WHEN p_size % 13 = 0 THEN '' ELSE 'row' END AS row_evidence"])

# --- tables ---------------------------------------------------------------------------------------------------------------
shape("html_tables", "part", [
    "p_brand AS doc_id", "p_partkey AS table_id",
    """'<table><tr><td colspan="2">' || CASE WHEN p_size % 4 = 0 THEN 'Pin No.' ELSE 'LQFP' || CAST(p_size % 8 + 2 AS STRING) || ' pin' END || '</td><td>Name</td><td>Type</td><td>Description</td></tr><tr><td>' || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'main' END || '</td><td></td><td>&nbsp;</td><td/><td></td></tr>'
      || '<tr><td rowspan="2">' || CAST(p_size % 8 + 1 AS STRING) || ',' || CAST(p_size % 8 + 2 AS STRING) || '</td><td>x</td><td>' || p_name || '</td><td>Digital I/O</td><td>' || p_type || ' &amp; more(1)</td></tr>'
      || '<tr><td>y</td><td>SHIFT</td><td>in</td><td>z</td></tr><tr><td>' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'bad cell' END || '</td><td></td><td>LATE</td><td></td><td>wrapped text</td></tr>'
      || '<tr><td>B' || CAST(p_size AS STRING) || '</td><td></td><td>NC</td><td>Power</td><td>-</td></tr></table>' AS html"""])
shape("table_targets", "part", ["p_brand AS doc_id", "p_partkey AS table_id", "CASE WHEN p_size % 2 = 0 THEN 'LQFP' || CAST(p_size % 8 + 2 AS STRING) ELSE '' END AS package", "'ADS1115IDGSR' AS device"])
shape("fold_input", "events", [
    "CAST(user_id AS STRING) AS doc_id", "CAST(0 AS BIGINT) AS table_id", "CAST(event_id AS INT) AS r",
    ("CASE WHEN event_type = 'view' THEN array(CAST(event_id AS STRING)) ELSE array() END AS numbers", "CASE WHEN event_type = 'view' THEN [CAST(event_id AS VARCHAR)] ELSE [] END AS numbers"),
    "event_type <> 'error' AND event_type <> 'view' AS blank", "CASE WHEN value > 20 THEN 'n' || CAST(event_id AS STRING) ELSE '' END AS name", "event_type AS type",
    "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'd' || CAST(event_id AS STRING) ELSE '' END AS description"])
shape("page_tables", "events", [
    "CAST(user_id AS STRING) AS doc_id", "event_id AS table_id", "CAST(floor(event_id / 600) AS INT) AS page",
    "CASE WHEN event_type = 'error' THEN 'Figure 1' ELSE 'Table ' || CAST(floor(event_id / 900) AS STRING) || CASE WHEN event_type IN ('click', 'view', 'signup') THEN ' (Continued)' ELSE '' END END AS caption",
    "CASE WHEN value < 40 THEN 'pin|name' ELSE 'pin|type' END AS header_tails", "CASE WHEN value < 15 THEN 'TSSOP' ELSE 'LQFP64 pin' END AS header_text", "CAST(floor(value / 10) AS INT) AS pins"])
shape("page_table_pins", "events", ["CAST(user_id AS STRING) AS doc_id", "event_id AS table_id", "0 AS r", "CAST(event_id % 3 AS STRING) AS pin_number", "event_type AS name", "'IO' AS type",
                                    "CASE WHEN value < 30 THEN 'a' ELSE 'b' END AS description"])
shape("table_pages", "customer", ["CAST(c_custkey AS STRING) AS doc_id", "CAST(c_custkey % 17 AS INT) AS page"])
shape("table_packages", "customer", ["CAST(c_custkey AS STRING) AS doc_id", f"{choice('c_custkey % 3', 'TSSOP20', 'lqfp64', '')} AS package"])

# --- dimension groups -------------------------------------------------------------------------------------------------------
shape("region_tokens_base", "boxes", [
    "doc_id", "id", "ord", "x1", "y1", "x2", "y2", "confidence", "rotation_deg", "'r' || CAST(ord % 3 AS STRING) AS source_region_id", "'mm' AS unit_context", "'unknown' AS value_role",
    f"{choice('ord % 12', 'Dimension L', '3.2 mm', 'A MAX', 'A MIN', '8 PINS', '8', '12,5', 'Dimension W2', '1.0-2.0', '2-Ø1.5', 'abc', '4.5')} AS text"])
shape("region_lines", "drawn_lines", ["doc_id", "line_id", "ord", "type", "lx1", "ly1", "lx2", "ly2", "arrow_ids", "confidence", "'r' || CAST(ord % 3 AS STRING) AS source_region_id"])
# Tables of MIN/NOM/MAX rows: parts as their cells, brand as document, nations as the headers.
_CELL = ["'table' AS source_region_id", "0 AS rotation_deg", "'unknown' AS unit_context", "'unknown' AS value_role"]
shape("grid_slots", "part", ["p_partkey", "p_brand", "p_size", series("0", "3", "c")])
shape("grid_tokens", "grid_slots", [
    "p_brand AS doc_id", "CAST(p_partkey AS STRING) || '_' || CAST(c AS STRING) AS id", "p_partkey * 4 + c AS ord", *_CELL,
    "CASE WHEN c = 0 THEN CASE WHEN p_size % 5 = 0 THEN 'Number of leads' WHEN p_size % 5 = 1 THEN 'lead angle' ELSE 'A' || CAST(p_size AS STRING) END"
    " WHEN p_size % 7 = c THEN '' ELSE CAST(p_size AS STRING) || '.' || CAST(c AS STRING) END AS text",
    "CAST(0.8 + (p_partkey % 20) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence", "CAST(20 + c * 100 AS INT) AS x1", "CAST(40 + p_size * 30 + p_partkey % 4 AS INT) AS y1",
    "CAST(60 + c * 100 AS INT) AS x2", "CAST(52 + p_size * 30 + p_partkey % 4 AS INT) AS y2"])
shape("head_slots", "nation", ["n_nationkey", series("0", "4", "c")])
shape("head_tokens", "head_slots", [
    "'Brand#' || CAST(n_nationkey + 1 AS STRING) AS doc_id", "'h' || CAST(c AS STRING) AS id", "CAST(-10 + c AS BIGINT) AS ord", *_CELL,
    f"{choice('c', 'Symbol', 'MIN', 'TYP', 'MAX', 'MILLIMETERS')} AS text", "CAST(0.9 AS DOUBLE) AS confidence",
    "CAST(CASE WHEN c = 4 THEN 220 ELSE 20 + c * 100 END AS INT) AS x1", "CAST(CASE WHEN c = 4 THEN 1 ELSE 12 END AS INT) AS y1",
    "CAST(CASE WHEN c = 4 THEN 300 ELSE 60 + c * 100 END AS INT) AS x2", "CAST(CASE WHEN c = 4 THEN 10 ELSE 24 END AS INT) AS y2"])
# Dense places: cells close in height, and groups with few lines close to each other.
shape("crowded_cells", "lineitem", [
    "CAST(l_suppkey % 10 AS STRING) AS doc_id", "'r' || CAST(l_linenumber % 2 AS STRING) AS source_region_id",
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id",
    "l_orderkey * 8 + l_linenumber AS ord", "'1' AS text", "CAST(0.9 AS DOUBLE) AS confidence", "0 AS x1", "10 AS x2",
    "CAST(l_partkey % 97 * 23 + l_orderkey % 7 * 3 AS INT) AS y1", "CAST(l_partkey % 97 * 23 + l_orderkey % 7 * 3 + 8 + l_linenumber AS INT) AS y2"])
shape("line_stacks", "boxes", [
    "doc_id", "'v' || CAST(ord % 2 AS STRING) AS view_id", "ord", "'d' || CAST(ord % 3 AS STRING) AS line", "id AS token", "'dimension_line' AS evidence_type", "'horizontal' AS orientation",
    "CAST(x1 AS INT) AS x1", "CAST(y1 AS INT) AS y1", "CAST(x2 AS INT) AS x2", "CAST(y2 AS INT) AS y2", "confidence"])
# Stacked values: two texts over each other with a line between, one pair per order.
shape("stack_slots", "orders", ["o_orderkey", "o_custkey", series("0", "3", "k")])
shape("stack_tokens", "stack_slots", [
    "CAST(o_custkey AS STRING) AS doc_id", "CAST(o_orderkey AS STRING) || '_' || CAST(k AS STRING) AS id", "o_orderkey * 4 + k AS ord", "'v' || CAST(o_orderkey % 5 AS STRING) || CASE WHEN k > 1 THEN 'b' ELSE 'a' END AS source_region_id",
    "CASE k WHEN 0 THEN '5.6' WHEN 1 THEN '5.0' WHEN 2 THEN '5,2' ELSE '4.9' END AS text", "0 AS rotation_deg", "'mm' AS unit_context", "'unknown' AS value_role", "CAST(0.95 AS DOUBLE) AS confidence",
    "CAST(o_orderkey % 50 * 80 AS INT) AS x1", "CAST(o_orderkey % 40 * 60 + k % 2 * 14 AS INT) AS y1", "CAST(o_orderkey % 50 * 80 + 24 AS INT) AS x2", "CAST(o_orderkey % 40 * 60 + k % 2 * 14 + 10 AS INT) AS y2"])
shape("stack_lines", "stack_slots", [
    "CAST(o_custkey AS STRING) AS doc_id", "'l' || CAST(o_orderkey AS STRING) || '_' || CAST(k AS STRING) AS line_id", "o_orderkey * 4 + k AS ord", "'v' || CAST(o_orderkey % 5 AS STRING) || CASE WHEN k > 1 THEN 'b' ELSE 'a' END AS source_region_id",
    "'dimension_line' AS type", "CAST(o_orderkey % 50 * 80 - 1 AS INT) AS lx1", "CAST(o_orderkey % 40 * 60 + 12 AS INT) AS ly1", "CAST(o_orderkey % 50 * 80 + 25 AS INT) AS lx2", "CAST(o_orderkey % 40 * 60 + 12 AS INT) AS ly2"], "k <> 1")
shape("stack_assignments", "stack_slots", [
    "CAST(o_custkey AS STRING) AS doc_id", "o_orderkey * 4 + k AS assignment_id", "CASE WHEN k = 0 THEN 'body_length' WHEN o_orderkey % 3 = 0 THEN 'body_length' ELSE 'body_width' END AS canonical_name",
    ("CASE WHEN k = 2 THEN array(CAST(o_orderkey AS STRING) || '_2', CAST(o_orderkey AS STRING) || '_3') ELSE array(CAST(o_orderkey AS STRING) || '_' || CAST(k AS STRING)) END AS token_ids", "[] AS token_ids"),
    ("array('l' || CAST(o_orderkey AS STRING) || '_0') AS line_ids", "[] AS line_ids")], "k < 3")
shape("name_pins", "customer", [
    "CAST(c_nationkey AS STRING) AS doc_id", "CAST(c_custkey AS STRING) AS pin_number", f"{choice('c_custkey % 4', 'INO', 'EPAD', 'VDD', 'RESET')} AS name", f"{choice('c_custkey % 5', 'left', 'right', 'top', 'unknown', 'left')} AS side",
    f"{choice('c_custkey % 4', 'Analog input channel 0', 'exposed pad', '', '')} AS description",
    ("array(named_struct('page', 1, 'source', 'vision', 'bbox', CAST(NULL AS array<double>), 'agreement', c_custkey % 3 <> 0)) AS evidence", "NULL AS evidence")])
shape("name_mismatches", "customer", ["CAST(c_nationkey AS STRING) AS doc_id", "CAST(c_custkey AS STRING) AS pin_number", f"{choice('c_custkey % 4', 'INO', 'EPAD', 'VDD', 'OTHER')} AS expected",
                                      f"{choice('c_custkey % 4', 'IN0', 'EP', 'V DD', '/RESET')} AS observed"])
shape("name_observations", "customer", ["CAST(c_nationkey AS STRING) AS doc_id", "CAST(c_custkey AS STRING) AS pin_number", "CAST(0.85 + (c_custkey % 15) / CAST(100 AS DOUBLE) AS DOUBLE) AS confidence", "c_custkey % 13 = 0 AS uncertain"])
shape("review_docs", "orders", ["CAST(o_orderkey AS STRING) AS doc_id", "'r' || CAST(o_custkey % 3 AS STRING) AS region_id", "'r' || CAST(o_custkey % 3 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS STRING) AS answered_region_id",
                                "'top' AS view_type", "CASE WHEN o_orderkey % 19 = 0 THEN 'side' ELSE 'top' END AS answered_view_type"])
shape("open_issues", "part", [
    "CAST(p_partkey AS STRING) AS doc_id", "CASE WHEN p_partkey % 2 = 0 THEN 'conflict' ELSE 'missing' END AS kind",
    f"{choice('p_size % 5', 'total_height!=housing_height+body_standoff', 'terminal_span', 'body_width>=overall_width', 'total_height', 'sub_body_width')} AS field"])
shape("worded_confidences", "customer", ["c_custkey AS id", f"{choice('c_custkey % 6', 'High', 'medium', 'LOW', '0.8', 'sure', '1')} AS confidence"])
