"""Search results and stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import strip
from .ordering import top_per_key

# Extensions of files, term pattern, ranking weights
FILE_EXTENSIONS = ("step", "stp", "iges", "igs", "pdf", "zip", "dxf", "dwg")
TERM = r"[A-Za-z0-9][A-Za-z0-9._+\-]{1,}"
TERM_WEIGHT, TERM_CAP, DOMAIN_WEIGHT, FILE_WEIGHT, FETCHED_WEIGHT = 1.5, 8, 4.0, 5.0, 2.0
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# An attribute with its value in quotes, in apostrophes or bare; the quantifiers never give back, so a tag is read once and without recursion.
ATTRIBUTE = r"""[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
LINK_TAG = rf"(?i)<a(?=[\s/])((?:[\s/]*+{ATTRIBUTE})*+)[\s/]*+>"
# One library answers every part number with the geometry of its package.
PACKAGE_LIBRARY = ("webench.ti.com", "/cad/cad.cgi")


def url_key(url: str = "url") -> Column:
    """Trimmed, without closing slashes, case folded."""
    return F.lower(F.regexp_replace(strip(url), "/+$", ""))


def fragmentless_key(url: str = "url") -> Column:
    """Scheme and host folded, fragment dropped, no closing slashes; path and query keep their case."""
    clean = strip(url)
    head = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
    start = F.regexp_extract(clean, f"({head})", 1)
    rest = F.regexp_replace(F.substr(clean, F.length(start) + 1), "#.*$", "")
    return F.regexp_replace(F.concat(F.lower(start), rest), "/+$", "")


def deduplicate_results(results: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """First result per URL, and (task_id, key, query, place) for every query that found it, in order.

    results(task_id, ord, url, source_queries, ...). Queries stay rows, so a URL found by very many
    queries needs no single array.
    """
    keyed = results.withColumn("key", key if key is not None else url_key()).where(strip("url") != "")
    kept = top_per_key(keyed, ["task_id", "key"], [F.col("ord")], 1).drop("_rank", "source_queries")
    found = keyed.select("task_id", "key", "ord", F.posexplode("source_queries").alias("_pos", "query"))
    return kept, found.groupBy("task_id", "key", "query").agg(F.min(F.struct("ord", "_pos")).alias("place"))


def clean_html(html: str | Column) -> Column:
    """Markup without comments and without script, style and noscript elements."""
    col = F.col(html) if isinstance(html, str) else html
    for tag in ("script", "style", "noscript"):
        col = F.regexp_replace(col, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return F.regexp_replace(col, r"(?s)<!--.*?-->", " ")


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible_text(markup: Column) -> Column:
    return strip(F.regexp_replace(unescape(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def page_texts(pages: DataFrame) -> DataFrame:
    """Title and whole visible text of stored pages."""
    staged = pages.withColumn("_m", clean_html("html"))
    title = F.regexp_extract("_m", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return staged.withColumns({"title": visible_text(title), "text": visible_text(F.col("_m"))}).drop("_m", "html")


def _path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1))


def resolved_url(base: Column, link: Column) -> Column:
    """Absolute form of a link on a page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    link_path, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    joined = F.when(F.startswith(link, F.lit("/")), link_path).otherwise(
        F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), link_path))
    segments = F.split(F.substr(joined, F.lit(2)), "/")
    last = F.element_at(segments, -1)
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    closing = F.when(last.isin(".", ".."), "/").otherwise("")
    relative = F.concat(origin, F.lit("/"), F.array_join(walked, "/"), closing, tail)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
            .when(link == "", base).when(F.startswith(link, F.lit("#")), F.concat(no_fragment, link))
            .when(F.startswith(link, F.lit("?")), F.concat(no_query, link)).otherwise(relative))


def page_links(pages: DataFrame, extensions: tuple[str, ...] = FILE_EXTENSIONS) -> DataFrame:
    """Distinct absolute links of a page in page order; `is_file` marks downloads by extension."""
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", " "), F.lit(LINK_TAG), 1)

    def href(tag: Column) -> Column:
        """The last href counts; one whose quote is never closed is none."""
        given = F.filter(F.regexp_extract_all(tag, F.lit(f"({ATTRIBUTE})"), 1), lambda a: a.rlike(r"(?i)^href\s*="))
        value = F.regexp_replace(F.try_element_at(given, F.lit(-1)), r"(?i)^href\s*=+\s*", "")
        return F.regexp_replace(value, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")
    hrefs = F.filter(F.transform(tags, href), lambda h: (h != "") & ~h.rlike("^[\"']"))
    links = F.array_distinct(F.transform(hrefs, lambda h: resolved_url(F.col("url"), unescape(h))))
    rows = pages.select("page_id", "url", F.posexplode(links).alias("ord", "link"))
    return rows.withColumn("is_file", _path_of(F.col("link")).rlike(rf"\.(?:{'|'.join(extensions)})$"))


def task_terms(task: str = "task") -> Column:
    found = F.regexp_extract_all(task, F.lit(f"({TERM})"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) >= 3), lambda t: F.lower(t)))


def rank_evidence(tasks: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """Score every result of a task: matched terms, wanted domain, files on the page, page fetched.

    tasks(task_id, task, target_domains), results(task_id, ord, title, url, snippet),
    pages(url, status, text, file_count). Read in the order (task_id, score desc, url).
    """
    wanted = tasks.select("task_id", task_terms().alias("_terms"), "target_domains")
    rows = results.join(pages.select("url", "status", "text", "file_count"), "url", "left").join(wanted, "task_id")
    body = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("text", F.lit(""))))
    rows = rows.withColumns({"_body": body, "_host": F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))})
    host = F.col("_host")
    domain = F.exists("target_domains", lambda d: (host == F.lower(d)) | F.endswith(host, F.concat(F.lit("."), F.lower(d))))
    matched = F.filter("_terms", lambda t: F.contains(F.col("_body"), t))
    rows = rows.withColumns({"matched_terms": F.size(matched), "domain_match": F.coalesce(domain, F.lit(False)),
                             "page_status": F.coalesce("status", F.lit("not_fetched"))})
    score = (F.least("matched_terms", F.lit(TERM_CAP)) * TERM_WEIGHT + F.when(F.col("domain_match"), DOMAIN_WEIGHT).otherwise(0.0)
             + F.when(F.coalesce("file_count", F.lit(0)) > 0, FILE_WEIGHT).otherwise(0.0)
             + F.when(F.col("page_status") == "fetched", FETCHED_WEIGHT).otherwise(0.0))
    return rows.select("task_id", "ord", "url", "matched_terms", "domain_match", "page_status", F.round(score, 3).alias("score"))


def allowed_citations(cited: DataFrame, evidence: DataFrame, fallback: int = 5) -> DataFrame:
    """Cited URLs that occur in the evidence; a task left with none cites its best evidence.

    cited(task_id, ord, url), evidence(task_id, url, score).
    """
    known = cited.join(evidence.select("task_id", "url").distinct(), ["task_id", "url"], "left_semi")
    best = top_per_key(evidence, ["task_id"], [F.desc("score"), F.asc("url")], fallback, "ord")
    instead = best.join(known.select("task_id").distinct(), "task_id", "left_anti").select(
        "task_id", F.col("ord").cast("bigint").alias("ord"), "url", F.lit(True).alias("fallback"))
    return known.select("task_id", F.col("ord").cast("bigint").alias("ord"), "url", F.lit(False).alias("fallback")).unionByName(instead)


def _compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def result_match(results: DataFrame, products: DataFrame) -> DataFrame:
    """Class of each result: exact, similar or none.

    results(task_id, ord, title, url, snippet, content), products(task_id, identifiers, package_type). In
    the first identifier a double x stands for any character.
    """
    rows = results.join(products, "task_id")
    fields = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "url", "snippet", "content")])
    primary = _compact(F.coalesce(F.try_element_at("identifiers", F.lit(1)), F.lit("")))
    rows = rows.withColumns({"_c": _compact(fields), "_p": primary})
    c, p = F.col("_c"), F.col("_p")
    exact = F.when(F.contains(p, F.lit("xx")), F.regexp_like(c, F.regexp_replace(p, "x", "[a-z0-9]"))).otherwise(
        F.exists("identifiers", lambda i: F.contains(c, _compact(i))))
    terms = F.filter(F.regexp_extract_all("package_type", F.lit(r"([A-Za-z]+(?:-?\d+)?)"), 1), lambda t: F.length(t) >= 3)
    library = (F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))) == PACKAGE_LIBRARY[0]) & (_path_of(F.col("url")) == PACKAGE_LIBRARY[1])
    kind = (F.when(exact & ~library, "exact").when(exact, "similar")
            .when(F.exists(terms, lambda t: F.contains(c, _compact(t))), "similar").otherwise("none"))
    return rows.withColumn("match", kind).drop("_c", "_p", "identifiers", "package_type")


def candidate_order(matched: DataFrame, wanted: int = 5) -> DataFrame:
    """Exact results before similar ones, then input order; at most max(6, min(2 * wanted, 12)) per task."""
    keep = max(6, min(wanted * 2, 12))
    rows = matched.where(F.col("match") != "none")
    return top_per_key(rows, ["task_id"], [(F.col("match") != "exact").asc(), F.col("ord")], keep, "place")
