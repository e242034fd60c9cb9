"""Text, dimensions, tables, chunks and search."""

import re

import pytest
from pyspark.sql import functions as F

from evigrid.functions.dimensions import DIMENSION, explicit_count, with_dimensions
from evigrid.functions.packages import pin_count_from_package
from evigrid.operators import answers, retrieval, search, tables, text


def plain_hints(line):
    """Pass after pass over the text, a match at a time."""
    closed, out = [], []
    for pattern, style, number in text.HINT_PASSES:
        for m in re.finditer(pattern, line):
            count = int(m[number]) if number else None
            if count is not None and not (count in (3, 5) or 4 <= count <= 2000 and count % 2 == 0):
                continue
            if not any(low < m.end() and m.start() < high for low, high in closed):
                out.append((len(out), m[style].upper(), count))
                closed.append(m.span())
    return out


def test_thousands_of_hints_in_one_text(spark):
    lines = [" ".join(f"the {k}-pin LQFP or TSSOP{k} or QFN," for k in range(4, 3704, 2)), "a \ue000 SOIC8 \ue001 7-lead DFN, lqfp 64", "\ue001\ue000", "no style"]
    df = spark.createDataFrame([("d", i, 0, 1, line, "text") for i, line in enumerate(lines)], "doc_id string, seq int, part int, page int, text string, source string")
    got = {}
    for r in text.package_hints(df).orderBy("seq", "ordinal").collect():
        got.setdefault(r.seq, []).append((r.ordinal, r["style"], r.pin_count))
    assert got == {i: plain_hints(line) for i, line in enumerate(lines) if plain_hints(line)} and len(got[0]) > 4000


@pytest.mark.parametrize("value, want", [
    ("12,70±0,10", (12.7, 12.6, 12.8, 0.1, -0.1, "unknown")), (".500(12.70±0.10)", (12.7, 12.6, 12.8, 0.1, -0.1, "mm")),
    ("3.2 +0.1/-0.05", (3.2, 3.15, 3.3, 0.1, -0.05, "unknown")), ("1.0-2.0", (None, 1.0, 2.0, None, None, "unknown")),
    ("8°-0°", (None, 0.0, 8.0, None, None, "deg")), ("(1)(2)", (None, None, None, None, None, "mm")), ("1.5 2.5", (None, None, None, None, None, "unknown")),
    ("A1", (None, None, None, None, None, "unknown")), ("5.0 mm", (5.0, None, None, None, None, "mm")), ("R0.5", (0.5, None, None, None, None, "unknown"))])
def test_dimension_texts(spark, value, want):
    row = with_dimensions(spark.createDataFrame([(value,)], "text string")).select(*DIMENSION).first()
    got = tuple(row[:6])
    assert [None if g is None else round(g, 6) if isinstance(g, float) else g for g in got] == list(want)


def test_table_cell_and_counts(spark):
    df = spark.createDataFrame([("3.2 0.20 mm",), ("28 PINS SHOWN",), ("R-PDSO-G16",), ("REV 12",)], "text string")
    out = with_dimensions(df, "text", F.lit(True)).select("nominal", "unit", explicit_count("text").alias("n")).collect()
    assert (out[0]["nominal"], out[0]["unit"]) == (3.2, "mm")
    assert [r["n"] for r in out] == [None, 28, 16, None]


@pytest.mark.parametrize("package, count", [("SOT23-5", 5), ("SOT23", None), ("LQFP100", 100), ("DGS0010A", 10), ("STM32F105VCT6", None), ("MSOP-10", 10), ("PW", None)])
def test_package_counts(spark, package, count):
    assert spark.createDataFrame([(package,)], "p string").select(pin_count_from_package("p")).first()[0] == count


def test_hints_native_equals_scan(spark, rows):
    lines = ["The 16-Lead TSSOP and TSSOP16, LQFP64", "SSOP PACKAGE(TOP VIEW)", "7-lead DFN", "SOT23 in 14 pins SOIC / QFN-20"]
    texts = spark.createDataFrame([("d", i, 0, 1, "text", v) for i, v in enumerate(lines)], "doc_id string, seq bigint, part int, page int, source string, text string")
    key = ["seq", "style", "pin_count"]
    assert rows(text.package_hints(texts), *key) == rows(text.hint_snippets(texts), *key)
    assert {(r.seq, r.ordinal): r.evidence for r in text.hint_snippets(texts).collect()}[0, 0] == "The 16-Lead TSSOP and TSSOP16, LQFP64"


@pytest.mark.parametrize("line, want", [
    ("15-lead TSSOP", [("TSSOP", None)]), ("25-pin QFN", [("QFN", None)]), ("113-lead BGA", [("BGA", None)]), ("3-lead SOT", [("SOT", 3)]), ("1000-pin BGA", [("BGA", None)]),
    ("16-Lead TSSOP, TSSOP16", [("TSSOP", 16), ("TSSOP", 16)]), ("SOT23", []), ("LQFP64 and 7 pins SOIC", [("LQFP", 64), ("SOIC", None)])])
def test_hint_counts_are_whole_numbers(spark, line, want):
    texts = spark.createDataFrame([("d", 0, 0, 1, "text", line)], "doc_id string, seq bigint, part int, page int, source string, text string")
    got = [(r["style"], r.pin_count) for r in text.package_hints(texts).orderBy("ordinal").collect()]
    assert got == want


def test_tables_to_pins(spark, rows):
    html = ("<table><tr><td>Pin No.</td><td>Mnemonic</td><td>Type</td><td>Description</td></tr><tr><td>1,20</td><td>VDD</td><td>P</td><td>Supply(1)</td></tr>"
            "<tr><td></td><td></td><td></td><td>continued</td></tr><tr><td>Pin No.</td><td>Mnemonic</td><td>Type</td><td>Description</td></tr>"
            "<tr><td>3</td><td>NC</td><td>Input</td><td>-</td></tr><tr><td>x y</td><td>Z</td><td></td><td></td></tr></table>")
    t = spark.createDataFrame([("d", 1, html)], "doc_id string, table_id bigint, html string")
    aim = spark.createDataFrame([("d", 1, "", "AD7682")], "doc_id string, table_id bigint, package string, device string")
    pins, unread = tables.extract_pins(tables.table_cells(t), aim)
    assert rows(pins, "pin_number", "name", "type", "description") == [
        ("1", "VDD", "PAS", "Supply continued"), ("20", "VDD", "PAS", "Supply continued"), ("3", "NC", "PAS", "-")]
    assert [r["issue"] for r in unread.collect()] == ["no_valid_number"]


@pytest.mark.parametrize("html, want", [
    ('<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>', ["a b b", "a c d"]),
    ("<TABLE><tr><th>x &amp;&nbsp; y</th><td/></tr><tr></tr><tr><td><b>p</b><!-- q -->\n r</td></tr></table>", ["x_&_y .", "p_r ."]),
    ("<tr><td rowspan=3>a</td><td rowspan=2>b</td><td>c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td></tr>", ["a b c", "a b d", "a e f"]),
    ("<tr><td>lost</td><tr><td>a<td>b</td></tr><tr><td>open", ["b"]), ("<tr><td colspan='x'>a</td></tr>", None), ("<tr><td colspan=100000>a</td></tr>", None), ("none", [])])
def test_spans_fill_the_grid(spark, html, want):
    t = spark.createDataFrame([("d", 1, html), ("d", 2, None)], "doc_id string, table_id bigint, html string")
    lines = {}
    for r in sorted(tables.table_cells(t).collect()):
        lines.setdefault(r.r, []).append(r.text.replace(" ", "_") or ".")
    assert [" ".join(v) for v in lines.values()] == (want or [])
    assert [r.issue for r in tables.refused_tables(t).collect()] == ([] if want is not None else ["bad_span"])


def test_number_column_priority(spark):
    def cols(header, target, cells):
        heads = spark.createDataFrame([("d", 0, i, h) for i, h in enumerate(header)], "doc_id string, table_id bigint, c int, header string")
        data = spark.createDataFrame([("d", 0, r, c, v) for r, row in enumerate(cells) for c, v in enumerate(row)], "doc_id string, table_id bigint, r int, c int, text string")
        aims = spark.createDataFrame([("d", 0, target)], "doc_id string, table_id bigint, target string")
        return [r["c"] for r in tables.number_columns(heads, data, aims).collect()]
    assert cols(["Pin No.", "LQFP64"], "LQFP64", [["1", "2"]]) == [0]
    assert cols(["A", "LQFP64"], "LQFP64", [["1", "2"]]) == [1]
    assert cols(["A", "B"], "LQFP9", [["1", "9"], ["2", "3"]]) == [1]
    assert cols(["A", "B"], "", [["x", "9"], ["2", "3"]]) == [1]


def test_recursive_chunks_cover_the_text():
    source = "\n\n".join(f"para {i} " + "word " * 60 for i in range(9))
    chunks = retrieval.split_recursively(source, 200, 40)
    assert all(len(c) <= 200 for c in chunks)
    assert all(any(w in c for c in chunks) for w in ("para 0", "para 8"))


def test_links_resolve(spark):
    base = "http://h.example/a/b.html?q=1#f"
    cases = {"/x": "http://h.example/x", "c.pdf": "http://h.example/a/c.pdf", "../d": "http://h.example/d", "//e/f": "http://e/f", "?z": "http://h.example/a/b.html?z",
             "#k": "http://h.example/a/b.html?q=1#k", "https://o/p": "https://o/p", "./": "http://h.example/a/"}
    df = spark.createDataFrame([(base, k) for k in cases], "b string, l string")
    got = {r[0]: r[1] for r in df.select("l", search.resolved_url(F.col("b"), F.col("l"))).collect()}
    assert got == cases


def test_slots_take_the_longest_label(spark, rows):
    a = spark.createDataFrame([("d", "引脚间距=0.5mm, overall width: 6.4 mm, body width 1 inch, N-Lead 8")], "doc_id string, text string")
    asked = spark.createDataFrame([("d", f) for f in ("terminal_pitch", "overall_width", "body_width", "nominal_pin_count", "total_height")], "doc_id string, field string")
    assert rows(answers.labelled_slots(a, asked), "field", "value", "unit", "issue") == [
        ("body_width", 25.4, "mm", None), ("nominal_pin_count", 8.0, "count", None), ("overall_width", 6.4, "mm", None), ("terminal_pitch", 0.5, "mm", None)]
    both = asked.unionByName(spark.createDataFrame([("d", "lead_spacing")], "doc_id string, field string"))
    issues = {r["field"]: r["issue"] for r in answers.labelled_slots(a, both).collect()}
    assert issues["terminal_pitch"] == "ambiguous" and issues["lead_spacing"] == "ambiguous"


def test_markdown_is_cut_at_its_marks():
    text = "intro words\n##### Deep\nfirst part here\n***\nsecond part\n```\ncode\n```\nlast part"
    assert retrieval.split_recursively(text, 30, 0, retrieval.MARKDOWN_SEPARATORS) == [
        "intro words", "##### Deep\nfirst part here", "***\nsecond part", "```\ncode\n```\nlast part"]
    assert retrieval.split_recursively("ab cd。ef", 4, 0) == ["ab", "cd", "。ef"]


def test_links_in_all_forms_of_attributes(spark):
    from evigrid.operators.search import page_links
    pages = {
        "<a href=/x>t</a>": ["/x"], "<a href=\"/it's\">t</a>": ["/it's"], "<a title=\"a > b\" href='/y'>t</a>": ["/y"], "<A\nHREF = '/say\"'>": ["/say\""],
        "<a title='<a href=/no>' href=/z/>": ["/z/"], "<a data-href=/no title=' href=/no'>": [], "<a/href=/q?a=1&amp;b=2>": ["/q?a=1&b=2"], "<abbr href=/no>": [],
        "<a href>": [], "<a href=''>": [], "<a href=\"/no>": [], "<a href=/one href=/two>": ["/two"], "<!-- <a href=/no> --><a class=k href=/a.pdf id=\"i\"><a href='/b'>": ["/a.pdf", "/b"],
        "<a " + "k='v' w " * 20000 + "href=/far>": ["/far"],
    }
    rows = spark.createDataFrame([(k, "http://h.x/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {}
    for r in sorted(page_links(rows).collect(), key=lambda r: (r.page_id, r.ord)):
        got.setdefault(r.page_id, []).append(r.link.removeprefix("http://h.x"))
    assert [got.get(k, []) for k in range(len(pages))] == list(pages.values())


def test_hybrid_search_by_blocks_equals_all_pairs(spark):
    import random
    pick = random.Random(7)
    words = ["the"] + [f"w{k}" for k in range(12)]

    def row(k, tenant, course):
        v = [pick.gauss(0, 1) + (2 if k % 3 else -2) for _ in range(6)] if k % 17 else [0.0] * 6
        return (k, tenant, course, v, {w: float(pick.randrange(1, 4)) for w in pick.sample(words, 4)} if k % 11 else None)

    schema = "%s long, tenant_id string, course_id string, embedding array<double>, sparse map<string,double>"
    chunks = [row(k, "big" if k % 10 else "small", pick.choice(["a", "b"])) for k in range(600)] + [row(900, None, "a")]
    queries = [row(k, pick.choice(["big", "small"]), pick.choice([None, "a", "b"])) for k in range(40)] + [row(50, "none", None), row(51, None, None)]
    found = []
    for direct in (0, 10**6):
        df = retrieval.hybrid_search(spark.createDataFrame(queries, schema % "query_id"), spark.createDataFrame(chunks, schema % "id"), 5, 0.7, 0.05, block=16, direct=direct)
        found.append({})
        for r in df.orderBy("query_id", "place").collect():
            found[-1].setdefault(r.query_id, []).append((r.id, r.score))
    want = {}
    for q, tenant, course, v, sparse in queries:
        scores = []
        for c, t2, c2, v2, s2 in chunks:
            if tenant is not None and tenant == t2 and course in (None, c2):
                length = sum(x * x for x in v) ** 0.5 * sum(x * x for x in v2) ** 0.5
                dense = sum(x * y for x, y in zip(v, v2, strict=True)) / length if length else 0.0
                scores.append((-round(0.7 * dense + 0.05 * sum(w * (s2 or {}).get(t, 0.0) for t, w in (sparse or {}).items()), 6), c))
        if scores:
            want[q] = [(c, -s) for s, c in sorted(scores)[:5]]
    for got in found:
        assert {q: [c for c, _ in hits] for q, hits in got.items()} == {q: [c for c, _ in hits] for q, hits in want.items()}
        assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))
