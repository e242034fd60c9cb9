"""Spatial operators against brute force, and invariance under partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators import footprint, geometry, groups, limits

BOX = "doc_id string, id string, ord bigint, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def some_boxes(n=150, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(0, 150, 5), r.randrange(0, 60, 5)
        out.append(("d" + str(i % 2), str(i), i, r.choice(["A", "a", "B"]), round(r.random(), 2), x, y, x + r.choice([20, 25, 30]), y + r.choice([10, 12])))
    return out


def ratio(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    if w <= 0 or h <= 0:
        return 0.0
    area = sum((t[7] - t[5]) * (t[8] - t[6]) for t in (a, b))
    return w * h / (area - w * h)


@pytest.mark.parametrize("parts", [1, 8])
def test_suppression_is_the_greedy_one(spark, parts):
    data = some_boxes()
    kept = []
    for t in sorted(data, key=lambda t: -t[4]):
        if not any(k[0] == t[0] and k[3].lower() == t[3].lower() and ratio(k, t) >= 0.45 for k in kept):
            kept.append(t)
    got = geometry.suppress_duplicates(spark.createDataFrame(data, BOX).repartition(parts), cell=16.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(t[1] for t in kept)


def test_box_pairs_once_each(spark):
    data = some_boxes(80)
    df = spark.createDataFrame(data, BOX)
    got = sorted((r[0], r[1]) for r in geometry.box_pairs(df, df, ["doc_id"], 7.0).select("a.id", "b.id").collect())
    want = sorted((a[1], b[1]) for a in data for b in data if a[0] == b[0] and min(a[7], b[7]) >= max(a[5], b[5]) and min(a[8], b[8]) >= max(a[6], b[6]))
    assert got == want


def test_merged_lines_follow_the_longest(spark):
    schema = "doc_id string, line_id string, ord bigint, type string, lx1 int, ly1 int, lx2 int, ly2 int, arrow_ids array<string>, confidence double, source_region_id string"
    df = spark.createDataFrame([
        ("d", "a", 0, "contour", 0, 10, 100, 10, [], 0.5, "r"), ("d", "b", 1, "extension_line", 105, 13, 140, 13, [], 0.9, "r"),
        ("d", "c", 2, "contour", 300, 10, 340, 10, ["x"], 0.4, "r"), ("d", "e", 3, "contour", 0, 0, 50, 50, [], 0.4, "r")], schema)
    got = {r["line_id"]: (r["type"], r["lx1"], r["ly1"], r["lx2"], r["ly2"], r["merged"]) for r in geometry.merge_lines(df).collect()}
    assert got == {"a": ("extension_line", 0, 12, 140, 12, 2), "c": ("contour", 300, 10, 340, 10, 1), "e": ("contour", 0, 0, 50, 50, 1)}


def test_mutual_nearest_by_brute_force(spark):
    r = random.Random(3)
    pts = [("d", r.choice(["left", "right"]), str(i), i, round(r.random(), 2), 1.0) for i in range(120)]
    df = spark.createDataFrame(pts, "doc_id string, side string, id string, ord bigint, at double, span double")
    a, b = [p for p in pts if p[1] == "left"], [p for p in pts if p[1] == "right"]
    want = set()
    for p in a:
        q = min(b, key=lambda q: abs(q[4] - p[4]))
        if min(a, key=lambda s: abs(s[4] - q[4])) is p and abs(q[4] - p[4]) <= 0.03:
            want.add((p[2], q[2]))
    for width in (0.05, None):
        got = {(x["first_id"], x["second_id"]) for x in geometry.mutual_nearest(df, "left", "right", bucket_width=width).collect()}
        assert got == want


def test_limits_count_accepted_attempts_only(spark):
    r = random.Random(5)
    now, data = 0, []
    for i in range(400):
        now += r.choice([0, 1, 2, 5, 200])
        data.append(("login" if i % 3 else "register", "c", i, now))
    df = spark.createDataFrame(data, "operation string, client string, attempt_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    rules = {"register": (60, 3), "login": (30, 4)}
    want = {}
    for op, (window, most) in rules.items():
        held = []
        for o, _, i, s in data:
            if o == op:
                held = [h for h in held if h > s - window]
                want[i] = len(held) < most
                if want[i]:
                    held.append(s)
    got = {x["attempt_id"]: x["accepted"] for x in limits.limit_attempts(df, rules, F.floor(F.unix_timestamp("ts") / 300)).collect()}
    assert got == want and False in got.values()


def test_sixty_first_login_is_refused(spark):
    df = spark.range(61).select(F.lit("login").alias("operation"), F.lit("c").alias("client"), F.col("id").alias("attempt_id"), F.timestamp_millis(F.col("id") * 900).alias("ts"))
    out = {r["attempt_id"]: (r["accepted"], r["retry_after"]) for r in limits.limit_attempts(df).collect()}
    assert out[59] == (True, 0) and out[60][0] is False and out[60][1] == 7


def test_labels_bind_to_the_only_rotation(spark, rows):
    pads = [("s", i, None, -1.0 if i < 3 else 1.0, float(i if i < 3 else i - 2.5)) for i in range(5)]
    pads = spark.createDataFrame(pads, "spec_id string, ord int, number string, x double, y double")
    refs = spark.createDataFrame([("s", "top", ["1", "2", "3"], "top", "TOP VIEW", 0.95, "row"), ("s", "bottom", ["5", "4"], "top", "TOP VIEW", 0.95, "row")],
                                 "spec_id string, side string, numbers array<string>, view string, view_evidence string, confidence double, row_evidence string")
    bound, refused = footprint.bind_labels(pads, refs)
    # A quarter turn to the left puts the top row on the left side, read downwards from the first number.
    assert rows(bound, "side", "place", "number", "rotation_deg") == [
        ("left", 0, "1", 90), ("left", 1, "2", 90), ("left", 2, "3", 90), ("right", 0, "5", 90), ("right", 1, "4", 90)] and refused.isEmpty()


TOKEN = "doc_id string, id string, ord bigint, text string, confidence double, rotation_deg int, source_region_id string, unit_context string, value_role string, x1 int, y1 int, x2 int, y2 int"
LINE = "doc_id string, line_id string, ord bigint, type string, lx1 int, ly1 int, lx2 int, ly2 int, arrow_ids array<string>, source_region_id string"
ASSIGN = "doc_id string, assignment_id bigint, canonical_name string, token_ids array<string>, line_ids array<string>"


def stack(spark, lower="1.0", label=None, separator=True, names=("body_length", "body_length"), scale=1):
    tokens = [("d", "u", 0, "1.5", 0.99, 0, "side", "mm", "unknown", 95, 10, 115, 20), ("d", "l", 1, lower, 0.99, 0, "side", "mm", "unknown", 95, 24, 115, 34)]
    if label:
        tokens.append(("d", "t", 2, label, 0.99, 0, "side", "mm", "unknown", 80, 10, 92, 20))
    lines = [("d", "s", 0, "contour", 94, 22, 116, 22, [], "side")] if separator else [("d", "z", 0, "contour", 0, 90, 50, 90, [], "side")]
    tokens = [(*t[:9], *[v * scale for v in t[9:]]) for t in tokens]
    lines = [(*x[:4], *[v * scale for v in x[4:8]], *x[8:]) for x in lines]
    assigned = [("d", 1, names[0], ["u"], []), ("d", 2, names[1], ["l"], [])]
    return spark.createDataFrame(assigned, ASSIGN), spark.createDataFrame(tokens, TOKEN), spark.createDataFrame(lines, LINE)


@pytest.mark.parametrize("change, merges", [
    ({}, 1), ({"scale": 7}, 1), ({"lower": "2.0"}, 0), ({"label": "A1"}, 0), ({"label": "MAX"}, 1), ({"separator": False}, 0), ({"names": ("body_length", "body_width")}, 0)])
def test_stacked_ranges(spark, change, merges):
    assert groups.reconcile_stacked(*stack(spark, **change)).count() == merges


def test_a_merged_assignment_is_in_no_other_merge(spark):
    boxes = [("u", "2.0", 10), ("m", "1.5", 24), ("l", "1.0", 38)]
    tokens = spark.createDataFrame([("d", k, i, t, 0.99, 0, "side", "mm", "unknown", 95, y, 115, y + 10) for i, (k, t, y) in enumerate(boxes)], TOKEN)
    lines = spark.createDataFrame([("d", f"s{y}", i, "contour", 94, y, 116, y, [], "side") for i, y in enumerate((22, 36))], LINE)
    assigned = spark.createDataFrame([("d", n, "body_length", [k], []) for n, k in ((1, "m"), (2, "u"), (3, "l"))], ASSIGN)
    got = [(r.upper_assignment, r.lower_assignment) for r in groups.reconcile_stacked(assigned, tokens, lines).collect()]
    assert got == [(1, 3)]


def test_budgeted_selection_passes_over(spark, rows):
    data = [("d", "v", "dimension_line", i, 0, i, 1, i + 1, tokens, ["l"], [], [], "horizontal", 0.9) for i, tokens in enumerate((["a", "b"], ["c", "e", "f"], ["a", "g"], ["h"]))]
    df = spark.createDataFrame(data, "doc_id string, view_id string, evidence_type string, ord bigint, x1 int, y1 int, x2 int, y2 int, token_ids array<string>, dimension_line_ids array<string>, extension_line_ids array<string>, arrow_ids array<string>, orientation string, confidence double")
    assert rows(groups.select_groups(df, 3, 4), "ord", "place") == [(0, 1), (2, 2), (3, 3)]


def test_budget_counts_what_a_prompt_holds(spark, rows):
    shape = ("doc_id string, view_id string, evidence_type string, ord bigint, x1 int, y1 int, x2 int, y2 int, token_ids array<string>, dimension_line_ids array<string>, "
             "arrow_ids array<string>, confidence double, context_token_ids array<string>, prompt_token_ids array<string>")
    data = [("d", "v", "dimension_line", 0, 0, 0, 1, 1, ["a", "b"], ["l"], [], 0.9, ["c"], None), ("d", "v", "dimension_line", 1, 0, 1, 1, 2, ["e"], ["l"], [], 0.9, ["f", "g"], None),
            ("d", "v", "table_row", 2, 0, 2, 1, 3, ["h", "i", "j", "k", "m"], [], [], 0.9, [], ["h", "m"])]
    assert rows(groups.select_groups(spark.createDataFrame(data, shape), 3, 5), "ord", "place") == [(0, 1), (2, 2)]


def test_table_rows_are_reduced(spark):
    def token(k, i, text, x, y):
        return ("d", k, i, text, 0.9, 0, "v", "mm", "unknown", x, y, x + 20, y + 10)
    texts = [token("n", 0, "8 PINS", 0, 200), token("h", 1, "8", 100, 0), token("amax", 2, "A MAX", 0, 50), token("v1", 3, "12,5", 100, 50), token("amin", 4, "A MIN", 0, 90),
             token("v2", 5, "11,5", 100, 90), token("kv", 6, "Dimension L", 0, 140), token("v3", 7, "3.2 mm", 100, 140)]
    got = {tuple(r.token_ids): (r.prompt_token_ids, r.x1, r.y1, r.x2, r.y2) for r in groups.table_groups(spark.createDataFrame(texts, TOKEN)).collect()}
    assert got == {("amax", "v1"): (["amax", "h", "v1"], 0, 50, 120, 60), ("amin", "v2"): (["amin", "h"], 0, 90, 120, 100), ("kv", "v3"): (["kv", "v3"], 0, 140, 120, 150)}
    heads = [token(n, i, n.upper(), 100 * (i + 1), 0) for i, n in enumerate(("min", "nom", "max"))]
    cells = [token(f"c{i}", 10 + i, f"{i + 1}.5", 100 * (i + 1), 60) for i in range(3)]
    labels = [token("body", 20, "Body", -80, 60), token("width", 21, "width", -50, 60), token("e", 22, "E", -20, 60)]
    got = [r.prompt_token_ids for r in groups.table_groups(spark.createDataFrame(heads + cells + labels, TOKEN)).collect() if "c1" in r.token_ids]
    assert got == [["body", "e", "c1"]]


def test_later_pins_see_moved_positions(spark):
    import random
    pick = random.Random(3)
    rows, want = [], {}
    for doc in range(40):
        sides = {s: [round(pick.random(), 3 if doc % 2 else 1) for _ in range(pick.randrange(0, 12))] for s in ("low", "high")}
        rows += [(str(doc), True, side, f"{side}{k}", k, at, 1.0) for side, places in sides.items() for k, at in enumerate(places)]
        low, high = [list(sides[s]) for s in ("low", "high")]
        for i in range(len(low)):
            if high:
                j = min(range(len(high)), key=lambda j: abs(high[j] - low[i]))
                if min(range(len(low)), key=lambda k: abs(low[k] - high[j])) == i and abs(high[j] - low[i]) <= 0.1:
                    low[i] = high[j] = (low[i] + high[j]) / 2
        want |= {(str(doc), f"{s}{k}"): at for s, places in (("low", low), ("high", high)) for k, at in enumerate(places)}
    df = spark.createDataFrame(rows, "doc_id string, axis boolean, side string, id string, ord int, at double, span double")
    assert {(r.doc_id, r.id): r["at"] for r in geometry.snapped_sides(df, 0.1).collect()} == want


PAGE = "doc_id string, width int, height int"
REGIONS = "doc_id string, region_id string, ord bigint, x1 int, y1 int, x2 int, y2 int, area_ratio double"
TOKENS = "doc_id string, id string, ord bigint, text string, confidence double, x1 double, y1 double, x2 double, y2 double, source_region_id string"
LINES = "doc_id string, line_id string, ord bigint, type string, lx1 int, ly1 int, lx2 int, ly2 int, source_region_id string"


def some_page(n=400, regions=60, seed=5):
    """A page with regions that lie over each other, also beyond its edges and equal ones, and boxes with fractions of pixels."""
    r = random.Random(seed)
    areas = []
    for i in range(regions):
        x, y, w, h = r.randrange(-10, 190), r.randrange(-10, 90), r.randrange(0, 80), r.randrange(0, 50)
        areas.append(("d", f"r{i}", i, x, y, x + w, y + h, round(r.random(), 1)))
    areas += [("d", f"r{regions + i}", regions + i, *a[3:7], 0.5) for i, a in enumerate(areas[:5])]
    tokens = []
    for i in range(n):
        x, y = r.randrange(-60, 880) / 4, r.randrange(-60, 480) / 4
        tokens.append(("d", str(i), i, "1.5" if i % 3 else "Wide view", round(r.random(), 1), x, y, x + r.choice([0.25, 4, 9.5]), y + r.choice([0.25, 3, 6.5]), r.choice(["r1", "r2", "r7", None])))
    lines = []
    for i in range(n):
        x, y = r.randrange(0, 200), r.randrange(0, 100)
        lines.append(("d", f"l{i}", i, "ab"[i % 2], x, y, x + r.randrange(0, 20), y + r.randrange(0, 9), r.choice(["r1", "r3", None])))
    return areas, tokens, lines


def grown(a, width=200, height=100):
    return max(0, a[3] - 24), max(0, a[4] - 24), min(width, a[5] + 24), min(height, a[6] + 24)


def meets(box, area):
    return box[0] <= box[2] and area[0] <= area[2] and area[1] <= area[3] and box[0] <= area[2] and area[0] <= box[2] and box[1] <= area[3] and area[1] <= box[3]


@pytest.mark.parametrize("parts", [1, 8])
def test_regions_by_brute_force(spark, parts):
    areas, tokens, lines = some_page()
    regions, boxes = spark.createDataFrame(areas, REGIONS).repartition(parts), spark.createDataFrame(tokens, TOKENS).repartition(parts)
    page, drawn = spark.createDataFrame([("d", 200, 100)], PAGE), spark.createDataFrame(lines, LINES).repartition(parts)

    def home(t):
        px, py = (t[5] + t[7]) / 2, (t[6] + t[8]) / 2
        inside = [a for a in areas if a[3] <= px <= a[5] and a[4] <= py <= a[6]]
        return min(inside, key=lambda a: (a[7], a[2]))[1] if inside else "unassigned"
    assert {r["id"]: r["region_id"] for r in geometry.assign_regions(boxes, regions).collect()} == {t[1]: home(t) for t in tokens}

    near = {a[1]: [t for t in tokens if t[9] == a[1] or meets(t[5:9], grown(a))] for a in areas}
    counts, kinds = geometry.region_summaries(regions, boxes, drawn, page)
    assert {r["region_id"]: r["tokens"] for r in counts.collect()} == {k: len(v) for k, v in near.items()}
    middles = {ln[1]: ((ln[4] + ln[6]) / 2, (ln[5] + ln[7]) / 2) * 2 for ln in lines}
    want = {(a[1], kind): sum(ln[3] == kind and (ln[8] == a[1] or meets(middles[ln[1]], grown(a))) for ln in lines) for a in areas for kind in "ab"}
    assert {(r["region_id"], r["type"]): r["lines"] for r in kinds.collect()} == {k: n for k, n in want.items() if n}

    # two texts a region: the slices of the order end before the tokens do
    texts = {(a[1], i + 1): t[3] for a in areas for i, t in enumerate(sorted((t for t in near[a[1]] if t[3] != "1.5"), key=lambda t: (-t[4], t[2]))[:2])}
    assert {(r["region_id"], r["place"]): r["text"] for r in geometry.region_texts(regions, boxes, page, 2).collect()} == texts
    best = {}
    for a in areas:
        usable = [t for t in near[a[1]] if t[3] == "1.5" and t[4] >= 0.55]
        for i, t in enumerate(sorted(usable, key=lambda t: (t[9] is None, t[9] != a[1], -t[4], t[6], t[5], t[2]))[:3]):
            best[a[1], i + 1] = t[1], t[9] and t[9] == a[1]
    assert {(r["region_id"], r["place"]): (r["id"], r["own"]) for r in geometry.view_evidence(regions, boxes, page, 3).collect()} == best


def test_a_fraction_in_a_region_is_refused(spark):
    boxes = spark.createDataFrame([("d", "1", 0, "1", 1.0, 1.0, 1.0, 2.0, 2.0, None)], TOKENS)
    regions = spark.createDataFrame([("d", "r", 0, 0.5, 0.0, 9.0, 9.0, 0.1)], REGIONS.replace("x1 int", "x1 double").replace("y1 int, x2 int, y2 int", "y1 double, x2 double, y2 double"))
    with pytest.raises(Exception, match="whole pixels"):
        geometry.assign_regions(boxes, regions).collect()


@pytest.mark.parametrize("spread", [3, 40, 400])
def test_nearest_lines_by_brute_force(spark, spread):
    r = random.Random(spread)
    tokens = [("d", str(i), i, "1", 1.0, *(float(v) for v in (x, y, x + 4, y + 8)), None) for i in range(40) for x, y in [(r.randrange(spread), r.randrange(spread))]]
    lines = [("d", f"l{i}", i, "a", x, y, x + 1, y + 3, None) for i in range(900) for x, y in [(r.randrange(spread), r.randrange(spread))]]
    got = {(a["id"], a["rank"]): a["line_id"] for a in geometry.link_lines(spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(lines, LINES)).collect()}
    want = {}
    for t in tokens:
        away = sorted((((t[5] + 2 - ln[4] - 0.5) ** 2 + (t[6] + 4 - ln[5] - 1.5) ** 2) ** 0.5, ln[2], ln[1]) for ln in lines)
        want |= {(t[1], i + 1): x[2] for i, x in enumerate(away[:6]) if x[0] <= 35.0}
    assert got == want


def rows_out(df, tmp_path):
    """Rows that all steps of a plan give, from the finished plan."""
    import re
    df.write.mode("overwrite").parquet(str(tmp_path / "out"))
    store = df.sparkSession._jsparkSession.sharedState().statusStore()
    runs = store.executionsList(0, 10**6)
    last = runs.apply(runs.size() - 1)
    values = store.executionMetrics(last.executionId())
    names = {m.accumulatorId(): m.name() for m in (last.metrics().apply(i) for i in range(last.metrics().size()))}
    total = 0
    for k, name in names.items():
        if name == "number of output rows" and values.contains(k):
            total += int(re.sub(r"\D", "", values.apply(k)))
    return total


def test_pairs_of_a_page_are_not_formed(spark, tmp_path):
    """Four times the regions and tokens of one page: the rows of all steps follow them, not their pairs."""
    def rows(n):
        areas, tokens, _ = some_page(20 * n, 10 * n, n)
        regions = spark.createDataFrame(areas, REGIONS)
        boxes = spark.createDataFrame(tokens, TOKENS)
        return rows_out(geometry.assign_regions(boxes, regions), tmp_path)
    assert rows(400) < 6 * rows(100)
