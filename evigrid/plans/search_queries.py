"""Search results, stored pages, chunks and hybrid search on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, retrieval, search
from .registry import query, table
from .shapes import ctes, frame
from .text_queries import tr

KEY = f"lower(regexp_replace({tr('url')}, '/+$', ''))"


@query("u2_deduplicated_results", ctes("results") + f""" SELECT task_id, {KEY} AS key, arg_min(ord, ord) AS ord, arg_min(url, ord) AS url, arg_min(title, ord) AS title
  FROM results WHERE {tr('url')} <> '' GROUP BY 1, 2""")
def u2(spark, sf):
    return search.deduplicate_results(frame(spark, sf, "results"))[0].select("task_id", "key", "ord", "url", "title")


@query("u2_result_provenance", ctes("results") + f""", f AS (SELECT task_id, {KEY} AS key, ord, i - 1 AS pos, source_queries[i] AS query
    FROM (SELECT *, unnest([1, 2]) AS i FROM results WHERE {tr('url')} <> ''))
  SELECT task_id, key, query, CAST(min(ord * 10 + pos) AS BIGINT) AS place FROM f GROUP BY 1, 2, 3""")
def u2_provenance(spark, sf):
    found = search.deduplicate_results(frame(spark, sf, "results"))[1]
    return found.select("task_id", "key", "query", (F.col("place.ord") * 10 + F.col("place._pos")).alias("place"))


FRAGMENTLESS = f"""regexp_replace(lower(regexp_extract({tr('url')}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1))
   || regexp_replace(substr({tr('url')}, length(regexp_extract({tr('url')}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)) + 1), '#.*$', ''), '/+$', '')"""


@query("u2_fragmentless_results", ctes("results") + f""" SELECT task_id, {FRAGMENTLESS} AS key, min(ord) AS ord FROM results WHERE {tr('url')} <> '' GROUP BY 1, 2""")
def u2_fragmentless(spark, sf):
    return search.deduplicate_results(frame(spark, sf, "results"), search.fragmentless_key())[0].select("task_id", "key", "ord")


def cleaned(c: str) -> str:
    for tag in ("script", "style", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    return f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"


def unescaped(c: str) -> str:
    for entity, char in search.ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def visible(c: str) -> str:
    return tr(f"regexp_replace({unescaped(f'''regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')''')}, '\\s+', ' ', 'g')")


PAGE_TEXT = f"""m AS (SELECT page_id, url, {cleaned('html')} AS m FROM pages), page_text AS (SELECT page_id, url,
    {visible("regexp_extract(m, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")} AS title, {visible('m')} AS text FROM m)"""


@query("x8_page_texts", "WITH " + PAGE_TEXT + " SELECT * FROM page_text")
def x8(spark, sf):
    return search.page_texts(table(spark, sf, "pages"))


HREF = "(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*[\"'']([^\"'']+)[\"'']"
# The pages hold absolute and root-relative links only, so the SQL covers those two.
LINKS = f"""h AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '{HREF}', 1) AS hrefs FROM pages),
  l AS (SELECT page_id, url, i, {unescaped('hrefs[i]')} AS h FROM (SELECT *, unnest(range(1, 1 + len(hrefs))) AS i FROM h)),
  r AS (SELECT page_id, url, i, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN h ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h END AS link FROM l),
  links AS (SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS ord,
    regexp_matches(lower(regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '\\.(?:{'|'.join(search.FILE_EXTENSIONS)})$') AS is_file FROM r GROUP BY 1, 2, 3)"""


@query("x8_page_links", "WITH " + LINKS + " SELECT page_id, ord, link, is_file FROM links")
def x8_links(spark, sf):
    return search.page_links(table(spark, sf, "pages")).select("page_id", "ord", "link", "is_file")


EVIDENCE = ctes("results", "search_tasks") + ", " + PAGE_TEXT + ", " + LINKS + f""", pg AS (SELECT url, text, (SELECT count(*) FROM links k WHERE k.page_id = p.page_id AND is_file) AS files FROM page_text p),
  tk AS (SELECT task_id, target_domains, list_distinct([lower(t) for t in regexp_extract_all(task, '{search.TERM}') if length(t) >= 3]) AS terms FROM search_tasks),
  j AS (SELECT r.task_id, r.ord, r.url, lower(concat_ws(' ', r.title, r.snippet, coalesce(g.text, ''))) AS body, lower(regexp_extract(r.url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
    g.url IS NOT NULL AS fetched, coalesce(files, 0) AS files, terms, target_domains FROM results r LEFT JOIN pg g ON r.url = g.url JOIN tk ON r.task_id = tk.task_id),
  s AS (SELECT *, len([t for t in terms if contains(body, t)]) AS matched_terms, len([d for d in target_domains if host = lower(d) OR suffix(host, '.' || lower(d))]) > 0 AS domain_match FROM j),
  evidence AS (SELECT task_id, ord, url, CAST(matched_terms AS INT) AS matched_terms, domain_match, CASE WHEN fetched THEN 'fetched' ELSE 'not_fetched' END AS page_status,
    least(matched_terms, 8) * 1.5 + CASE WHEN domain_match THEN 4.0 ELSE 0.0 END + CASE WHEN files > 0 THEN 5.0 ELSE 0.0 END + CASE WHEN fetched THEN 2.0 ELSE 0.0 END AS score FROM s)"""


def _evidence(spark, sf):
    pages = table(spark, sf, "pages")
    files = search.page_links(pages).where("is_file").groupBy("page_id").agg(F.count("*").alias("file_count"))
    stored = search.page_texts(pages).join(files, "page_id", "left").withColumn("status", F.lit("fetched"))
    return search.rank_evidence(frame(spark, sf, "search_tasks"), frame(spark, sf, "results"), stored)


@query("t5_ranked_evidence", EVIDENCE + " SELECT task_id, ord, url, matched_terms, domain_match, page_status, CAST(score AS DOUBLE) AS score FROM evidence")
def t5(spark, sf):
    return _evidence(spark, sf)


@query("j18_allowed_citations", EVIDENCE + ctes("citations").replace("WITH", ",", 1) + """, known AS (SELECT * FROM citations SEMI JOIN evidence USING (task_id, url)),
  best AS (SELECT task_id, url, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, url) AS rn FROM evidence QUALIFY rn <= 5)
  SELECT task_id, ord, url, false AS fallback FROM known UNION ALL SELECT task_id, rn, url, true FROM best ANTI JOIN known USING (task_id)""")
def j18(spark, sf):
    return search.allowed_citations(frame(spark, sf, "citations"), _evidence(spark, sf))


def compact(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


MATCH = ctes("results", "search_products") + f""", c AS (SELECT task_id, ord, url, {compact("concat_ws(' ', title, url, snippet, content)")} AS c, identifiers, package_type, {compact('identifiers[1]')} AS p
    FROM results JOIN search_products USING (task_id)),
  e AS (SELECT *, CASE WHEN contains(p, 'xx') THEN regexp_matches(c, replace(p, 'x', '[a-z0-9]')) ELSE len([i for i in identifiers if contains(c, {compact('i')})]) > 0 END AS exact FROM c),
  matched AS (SELECT task_id, ord, url, CASE WHEN exact THEN 'exact' WHEN len([t for t in regexp_extract_all(package_type, '[A-Za-z]+(?:-?\\d+)?') if length(t) >= 3 AND contains(c, {compact('t')})]) > 0
    THEN 'similar' ELSE 'none' END AS match FROM e)"""


@query("x16_result_match", MATCH + " SELECT task_id, ord, url, match FROM matched")
def x16(spark, sf):
    return search.result_match(frame(spark, sf, "results"), frame(spark, sf, "search_products")).select("task_id", "ord", "url", "match")


@query("t11_candidate_order", MATCH + """ SELECT task_id, ord, match, row_number() OVER (PARTITION BY task_id ORDER BY match <> 'exact', ord) AS place
  FROM matched WHERE match <> 'none' QUALIFY place <= 10""")
def t11(spark, sf):
    matched = search.result_match(frame(spark, sf, "results"), frame(spark, sf, "search_products"))
    return search.candidate_order(matched).select("task_id", "ord", "match", "place")


# --- chunks ------------------------------------------------------------------------------------------------------
CHUNKS = """c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 100) / 412.0) - 1) AS INT) + 1)) AS chunk_index FROM documents WHERE length(text) > 0),
  chunks AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, substr(text, chunk_index * 412 + 1, 512) AS content FROM c)"""


@query("x9_stride_chunks", "WITH " + CHUNKS + " SELECT * FROM chunks")
def x9(spark, sf):
    return retrieval.stride_chunks(table(spark, sf, "documents"))


@query("x9_recursive_chunks")
def x9_recursive(spark, sf):
    return retrieval.recursive_chunks(table(spark, sf, "documents"))


HEAD = " ".join(f"""h{n} AS (SELECT *, last_value(CASE WHEN level = {n} THEN line_no END IGNORE NULLS) OVER w AS n{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}
    FROM {'lv' if n == 1 else f'h{n - 1}'} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),""" for n in (1, 2, 3, 4))
SECTIONS = ctes("markdown_lines") + f""", f AS (SELECT *, trim(line) AS t, sum(CASE WHEN regexp_matches(trim(line), '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM markdown_lines),
  lv AS (SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(t, '^#{{1,4}} +\\S') THEN length(regexp_extract(t, '^(#+)', 1)) END AS level, trim(regexp_extract(t, '^#+ +(.*)$', 1)) AS title FROM f),
  {HEAD} s AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h4)
  SELECT doc_id, line_no, line, CAST(section AS INT) AS section, concat_ws(' > ', t1, CASE WHEN n2 > coalesce(n1, -1) THEN t2 END,
    CASE WHEN n3 > greatest(coalesce(n1, -1), coalesce(n2, -1)) THEN t3 END, CASE WHEN n4 > greatest(coalesce(n1, -1), coalesce(n2, -1), coalesce(n3, -1)) THEN t4 END) AS path FROM s"""


@query("x10_markdown_sections", SECTIONS)
def x10(spark, sf):
    return retrieval.markdown_sections(frame(spark, sf, "markdown_lines"))


@query("x10_section_chunks")
def x10_chunks(spark, sf):
    return retrieval.section_chunks(retrieval.markdown_sections(frame(spark, sf, "markdown_lines")))


@query("x11_context_prefix", "WITH " + CHUNKS + """ SELECT c.doc_id, chunk_index, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'toxic ' || CAST(toxic AS VARCHAR) || chr(10) || chr(10) || content ELSE content END AS content,
    coalesce(quality = 1, false) AS enriched FROM chunks c LEFT JOIN labels l USING (doc_id)""")
def x11(spark, sf):
    chunks = retrieval.stride_chunks(table(spark, sf, "documents"))
    contexts = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("toxic "), F.col("toxic").cast("string"))).alias("context"))
    return retrieval.add_context(chunks, contexts, ["doc_id"])


@query("s5_upsert_chunks", ctes("old_chunks", "new_chunks") + " SELECT * FROM old_chunks WHERE id NOT IN (SELECT id FROM new_chunks) UNION ALL SELECT * FROM new_chunks")
def s5(spark, sf):
    return retrieval.upsert_chunks(frame(spark, sf, "old_chunks"), frame(spark, sf, "new_chunks"))


@query("s5_replace_documents", ctes("old_chunks", "new_chunks") + " SELECT * FROM old_chunks WHERE document_id NOT IN (SELECT document_id FROM new_chunks) UNION ALL SELECT * FROM new_chunks")
def s5_replace(spark, sf):
    return retrieval.upsert_chunks(frame(spark, sf, "old_chunks"), frame(spark, sf, "new_chunks"), replace_documents=True)


def _words(table_: str, key: str) -> str:
    return f"SELECT {key}, tenant_id, course_id, w, count(*) AS n FROM (SELECT *, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM {table_}) WHERE w <> '' GROUP BY ALL"


@query("t9_hybrid_search", ctes("chunk_texts", "query_texts") + f""", qv AS (SELECT q.*, [CAST(x AS DOUBLE) for x in embedding] AS e FROM query_texts q JOIN embeddings ON query_id = vec_id),
  cv AS (SELECT c.*, [CAST(x AS DOUBLE) for x in embedding] AS e FROM chunk_texts c JOIN embeddings ON id = vec_id),
  d AS (SELECT query_id, id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS dense
    FROM qv q JOIN cv c ON q.tenant_id = c.tenant_id AND (q.course_id IS NULL OR q.course_id = c.course_id)),
  qw AS ({_words('query_texts', 'query_id')}), cw AS ({_words('chunk_texts', 'id')}),
  s AS (SELECT query_id, id, sum(q.n * c.n) AS sparse FROM qw q JOIN cw c ON q.tenant_id = c.tenant_id AND q.w = c.w AND (q.course_id IS NULL OR q.course_id = c.course_id) GROUP BY 1, 2),
  f AS (SELECT query_id, id, round(0.7 * dense + 0.001 * coalesce(sparse, 0), 6) AS score FROM d LEFT JOIN s USING (query_id, id)),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM f QUALIFY place <= 3)
  SELECT query_id, id, score, place, round(max(score) OVER (PARTITION BY query_id), 4) AS confidence, max(score) OVER (PARTITION BY query_id) >= 0.75 AS is_high_confidence FROM t""")
def t9(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")

    def side(name, key):
        rows = frame(spark, sf, name)
        sparse = retrieval.term_vectors(rows, [key])
        return rows.join(vectors, F.col(key) == F.col("_v")).join(sparse, key, "left")
    return retrieval.hybrid_search(side("query_texts", "query_id"), side("chunk_texts", "id"), 3, 0.7, 0.001)


@query("u3_ordered_distinct_ids", """SELECT o_orderkey, array_to_string(list_concat([x for x in [o_custkey % 3, o_orderkey % 3, 1]][1:1],
    CASE WHEN o_orderkey % 3 <> o_custkey % 3 THEN [o_orderkey % 3] ELSE [] END, CASE WHEN 1 <> o_custkey % 3 AND 1 <> o_orderkey % 3 THEN [1] ELSE [] END), '|') AS ids FROM orders""")
def u3(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.array((F.col("o_custkey") % 3).cast("string")).alias("a"),
        F.array((F.col("o_orderkey") % 3).cast("string"), F.lit("1")).alias("b"))
    return rows.select("o_orderkey", F.array_join(retrieval.merged_ids("a", "b"), "|").alias("ids"))


@query("x18_normalised_values", ctes("typed_values") + """, t AS (SELECT *, CASE WHEN suffix(field, '_count') THEN 'count' WHEN suffix(field, '_angle') THEN 'deg' ELSE 'mm' END AS target FROM typed_values),
  u AS (SELECT *, lower(CASE WHEN unit = '' THEN target ELSE unit END) AS u FROM t),
  m AS (SELECT *, value * CASE u WHEN 'mm' THEN 1.0 WHEN 'cm' THEN 10.0 WHEN 'mil' THEN 0.0254 WHEN 'inch' THEN 25.4 WHEN '英寸' THEN 25.4 WHEN 'um' THEN 0.001 END AS mm FROM u),
  i AS (SELECT *, CASE target WHEN 'count' THEN CASE WHEN u NOT IN ('count', 'pin', 'pins') THEN 'unit' WHEN value NOT BETWEEN 1 AND 1000 OR value <> floor(value) THEN 'bounds' END
    WHEN 'deg' THEN CASE WHEN u <> 'deg' THEN 'unit' WHEN value < 0 OR value >= 90 THEN 'bounds' END
    ELSE CASE WHEN mm IS NULL THEN 'unit' WHEN NOT (mm = 0 AND field = 'negative_side_pin_span') AND (mm <= 0 OR mm > 1000) THEN 'bounds' END END AS issue FROM m)
  SELECT doc_id, field, round(CASE WHEN issue IS NULL THEN CASE target WHEN 'mm' THEN mm ELSE value END END, 6) AS value, target AS unit, issue FROM i""")
def x18(spark, sf):
    return answers.normalise_values(frame(spark, sf, "typed_values")).withColumn("value", F.round("value", 6))


ALIASES = ", ".join(f"('{f}', '{a}')" for f, names in answers.LABELS.items() for a in (*names, f))
FACTORS = " ".join(f"WHEN '{u}' THEN {f}" for u, f in answers.TO_MM.items() if u)
ANSWERS = ctes("answer_texts", "answer_requests") + f""", labels(field, alias) AS (VALUES {ALIASES}),
  asked AS (SELECT DISTINCT doc_id, field FROM answer_requests),
  foreign_ AS (SELECT doc_id FROM (SELECT doc_id, unnest(map_keys(slots)) AS field FROM answer_texts) ANTI JOIN asked USING (doc_id, field)),
  head AS (SELECT *, CASE WHEN doc_id NOT IN (SELECT doc_id FROM asked) THEN 'nothing_asked' WHEN lower(trim(coalesce(nullif(action, ''), 'provide'))) NOT IN ('provide', 'cancel') THEN 'action'
    WHEN lower(trim(action)) = 'cancel' THEN 'cancelled' WHEN doc_id IN (SELECT doc_id FROM foreign_) THEN 'unknown_field' WHEN length(text) > 4000 THEN 'text_too_long' END AS refused FROM answer_texts),
  given AS (SELECT doc_id, e.key AS field, NULL AS alias, e.value.value AS value, e.value.unit AS unit, false AS shared FROM (SELECT doc_id, unnest(map_entries(slots)) AS e FROM head WHERE refused IS NULL)),
  named AS (SELECT doc_id, field, alias FROM asked JOIN labels USING (field)),
  found AS (SELECT doc_id, field, alias, (SELECT count(DISTINCT field) FROM named o WHERE o.doc_id = n.doc_id AND o.alias = n.alias) > 1 AS shared,
      '(?:^|[^A-Za-z0-9_])' || alias || '{answers.LINK}{answers.NUMBER}\\s*{answers.UNIT}' AS p, text FROM named n JOIN head USING (doc_id) WHERE refused IS NULL),
  hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY length(alias) DESC, alias DESC) AS rn FROM (SELECT * FROM found ANTI JOIN given USING (doc_id, field)) WHERE regexp_matches(text, p, 'i')),
  raw AS (SELECT * FROM given UNION ALL SELECT doc_id, field, alias, TRY_CAST(regexp_extract(text, p, 1, 'i') AS DOUBLE), regexp_extract(text, p, 2, 'i'), shared FROM hit WHERE rn = 1),
  t AS (SELECT *, CASE WHEN suffix(field, '_count') THEN 'count' ELSE 'mm' END AS target FROM raw),
  u AS (SELECT *, lower(CASE WHEN coalesce(unit, '') = '' THEN target ELSE unit END) AS u FROM t), m AS (SELECT *, value * CASE u {FACTORS} END AS mm FROM u),
  slots AS (SELECT doc_id, field, alias, mm, value AS v, target, CASE WHEN shared THEN 'ambiguous' WHEN value IS NULL THEN 'not_a_number' WHEN target = 'count' THEN CASE WHEN u NOT IN ('count', 'pin', 'pins', '个') THEN 'unit' WHEN value NOT BETWEEN 1 AND 1000 OR value <> floor(value) THEN 'bounds' END
    ELSE CASE WHEN mm IS NULL THEN 'unit' WHEN mm <= 0 OR mm > 1000 THEN 'bounds' END END AS issue FROM m)"""


def _answers(spark, sf):
    return answers.answered_slots(frame(spark, sf, "answer_texts"), frame(spark, sf, "answer_requests"))


@query("x18_answered_slots", ANSWERS + " SELECT doc_id, field, alias, round(CASE WHEN issue IS NULL THEN CASE target WHEN 'mm' THEN mm ELSE v END END, 6) AS value, target AS unit, issue FROM slots")
def x18_slots(spark, sf):
    return _answers(spark, sf)[0].withColumn("value", F.round("value", 6))


@query("x18_answer_status", ANSWERS + """, b AS (SELECT doc_id, count(issue) AS bad FROM slots GROUP BY 1)
  SELECT doc_id, coalesce(refused, CASE WHEN bad IS NULL THEN 'no_slot' WHEN bad > 0 THEN 'values' ELSE 'accepted' END) AS status FROM head LEFT JOIN b USING (doc_id)""")
def x18_status(spark, sf):
    return _answers(spark, sf)[1]
