"""Dimension groups: table rows, dimension texts with their lines, stacked ranges, budgeted selection.

tokens(doc_id, id, ord, text, confidence, rotation_deg, source_region_id, unit_context, value_role, x1..y2),
lines(doc_id, line_id, ord, type, lx1..ly2, arrow_ids, source_region_id).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import thresholds as T
from ..functions.dimensions import RANGE, explicit_count, with_dimensions
from ..functions.names import strip
from ..session import settled
from .geometry import BOX, DESCRIPTIVE, _islands, box_pairs, link_lines, orientation, overlap_area
from .ordering import fold_in_order, top_per_key

REGION = ["doc_id", "source_region_id"]
DIMENSION_TEXT = r"(?i)[ØΦ±]|REF|UNC|\([^)]*\d[^)]*\)|(?:^|\D)[.]?\d+(?:\.\d+)?"
LETTERS = "A-Za-zΑ-ωα-ω"
ROLES = {"min": "table_minimum", "nom": "table_nominal", "max": "table_maximum"}


def _mid(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2.0


def _centred(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns({"cx": _mid("x1", "x2"), "cy": _mid("y1", "y2"), "height": F.greatest(F.lit(1), F.col("y2") - F.col("y1"))})


# --- table rows --------------------------------------------------------------------------------------------------------
def key_value_rows(tokens: DataFrame) -> DataFrame:
    """`Dimension X` labels with the digit token right of them on the same line: nearest in height, then leftmost."""
    t = _centred(tokens)
    reach = t.groupBy(*REGION).agg(F.greatest(F.lit(8.0), F.percentile("height", 0.5) * 0.8).alias("_tol"))
    t = t.join(reach, REGION)
    labels = t.where(strip("text").rlike(r"(?i)^dimension\s+\S+")).select(
        *REGION, F.col("id").alias("label_id"), F.col("cy").alias("_ly"), F.col("x2").alias("_lx"), F.col("confidence").alias("_lc"), "_tol",
        F.explode(F.sequence(F.floor(F.col("cy") / F.col("_tol")) - 1, F.floor(F.col("cy") / F.col("_tol")) + 1)).alias("_cell"))
    values = t.where(F.col("text").rlike(r"\d")).select(
        *REGION, F.col("id").alias("value_id"), "text", "x1", "cy", "confidence", "ord", F.floor(F.col("cy") / F.col("_tol")).alias("_cell"))
    pairs = labels.join(values, [*REGION, "_cell"]).where(
        (F.col("label_id") != F.col("value_id")) & (F.col("x1") > F.col("_lx")) & (F.abs(F.col("cy") - F.col("_ly")) <= F.col("_tol")))
    best = top_per_key(pairs, [*REGION, "label_id"], [F.abs(F.col("cy") - F.col("_ly")), F.col("x1"), F.col("ord")], 1)
    return best.select(*REGION, "label_id", "value_id", F.lit("nom").alias("column"), F.when(F.col("text").rlike(r"(?i)\bmm\b"), "mm").otherwise("unknown").alias("unit"),
                       F.least("_lc", "confidence").alias("confidence"))


def pin_matrix_rows(tokens: DataFrame) -> DataFrame:
    """`A MAX` / `A MIN` rows of a pin-count matrix: the number nearest the column of the stated pin count."""
    t = _centred(tokens)
    sure = t.where(F.col("confidence") >= 0.80)
    stated = sure.withColumn("_n", F.regexp_extract("text", r"(?i)\b(\d{1,3})\s*PINS?\b", 1).try_cast("int")).where(F.col("_n").isNotNull())
    counts = stated.groupBy("doc_id").agg(F.max_by("_n", F.struct("confidence", (-F.col("ord")).alias("o"))).alias("_n"))
    heads = sure.join(counts, "doc_id").where(strip("text") == F.col("_n").cast("string")).groupBy(*REGION).agg(
        F.min_by(F.struct("id", "cx"), "ord").alias("_h"))
    role = F.when(strip("text").rlike(r"(?i)^A\s*MAX$"), "max").when(strip("text").rlike(r"(?i)^A\s*MIN$"), "min")
    labels = t.withColumn("column", role).where(F.col("column").isNotNull()).groupBy(*REGION, "column").agg(
        F.min_by(F.struct("id", "cy", "height", "confidence"), "ord").alias("_l"))
    rows = labels.join(heads, REGION)
    numbers = t.where(strip("text").rlike(r"^\d+(?:[.,]\d+)?$")).select(*REGION, F.col("id").alias("value_id"), "cx", "cy", "confidence", "ord")
    pairs = numbers.join(rows, REGION).where(
        (F.col("value_id") != F.col("_l.id")) & (F.col("value_id") != F.col("_h.id"))
        & (F.abs(F.col("cy") - F.col("_l.cy")) <= F.greatest(F.lit(10), F.col("_l.height")) * 1.2))
    order = [F.abs(F.col("cx") - F.col("_h.cx")), F.desc("confidence"), F.col("ord")]
    best = top_per_key(pairs, [*REGION, "column"], order, 1)
    return best.select(*REGION, F.col("_l.id").alias("label_id"), "value_id", "column", F.lit("mm").alias("unit"),
                       F.least("_l.confidence", "confidence").alias("confidence"), F.col("_h.id").alias("context_id"))


def table_layout(tokens: DataFrame) -> DataFrame:
    """Columns of every table region: centres of MIN, NOM and MAX in the metric half, tolerances, label edge."""
    t = _centred(tokens)
    word = F.regexp_replace(F.lower(strip("text")), "[^a-z]", "")
    raw = F.lower(strip("text"))
    heads = t.withColumn("_w", word).where(F.col("_w").isin("min", "nom", "typ", "max"))
    tops = heads.groupBy(*REGION).agg(F.min("y1").alias("_top"), F.count("*").alias("_n")).where("_n >= 3")
    above = t.join(tops, REGION).where(F.col("y1") < F.col("_top"))
    metric = raw.contains("millimet") | raw.startswith("miimet") | raw.startswith("milimet")
    units = above.groupBy(*REGION).agg(F.avg(F.when(metric, F.col("cx"))).alias("_mx"), F.avg(F.when(raw.contains("inch"), F.col("cx"))).alias("_ix"))
    rows = heads.join(tops.select(*REGION), REGION).join(units, REGION, "left")
    both = F.col("_mx").isNotNull() & F.col("_ix").isNotNull()
    rows = rows.where(~both | ((F.col("cx") < (F.col("_mx") + F.col("_ix")) / 2) == (F.col("_mx") < F.col("_ix"))))
    three = top_per_key(rows, REGION, [F.col("cx"), F.col("ord")], 3, "_place")
    name = F.when(F.col("_w") == "typ", "nom").otherwise(F.col("_w"))
    spread = three.groupBy(*REGION).agg(
        *[F.max_by("cx", F.when(name == n, F.col("_place"))).alias(f"x_{n}") for n in ROLES], F.max("y2").alias("head_y"),
        F.min("cx").alias("_c1"), F.max("cx").alias("_c3"), F.max(F.when(F.col("_place") == 2, F.col("cx"))).alias("_c2"))
    a, b = F.col("_c2") - F.col("_c1"), F.col("_c3") - F.col("_c2")
    step = F.when((a > 0) & (b > 0), (a + b) / 2).when(a > 0, a).when(b > 0, b)
    out = spread.withColumn("step", step).where(F.col("step").isNotNull() & F.col("x_min").isNotNull() & F.col("x_nom").isNotNull() & F.col("x_max").isNotNull())
    return out.select(*REGION, "x_min", "x_nom", "x_max", "head_y", "step", F.greatest(F.lit(12.0), F.col("step") * 0.48).alias("column_tolerance"),
                      (F.col("_c1") - F.col("step") * 0.55).cast("int").alias("label_right"))


def cluster_rows(tokens: DataFrame, layout: DataFrame) -> DataFrame:
    """Data tokens with the table row they fall in, by the running mean height of the row.

    A mean stays between the heights of its tokens, so tokens further apart than the tolerance never share a row, and what is decided in
    order is a scan over the distinct heights of a chain with their weights.
    """
    t = _centred(tokens).join(layout.select(*REGION, "head_y"), REGION).where(F.col("cy") > F.col("head_y") + 4)
    reach = t.groupBy(*REGION).agg(F.greatest(F.lit(6.0), F.percentile("height", 0.5) * 0.65).alias("row_tolerance"))
    # Distinct half-pixel heights of a page bound this window and the stream.
    heights = t.groupBy(*REGION, "cy").agg(F.count(F.lit(1)).alias("n")).join(reach, REGION)
    order = Window.partitionBy(*REGION).orderBy("cy")
    fresh = (F.col("cy") - F.lag("cy").over(order) > F.col("row_tolerance")).cast("int")
    chains = heights.withColumn("_f", F.coalesce(fresh, F.lit(0))).withColumn("chain", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = fold_in_order(chains.drop("_f"), [*REGION, "chain"], [F.col("cy")], lambda: [-1, 0.0, 0], _row_numbers, {"row_no": "int"})
    return t.join(rows.drop("n", "row_tolerance"), [*REGION, "cy"]).select(*REGION, "id", "chain", "row_no")


def _row_numbers(state: list, rows: dict):
    """Heights in order, each with its number of tokens: a height joins the row before it if it is within reach of that row's mean.

    Rows further up are out of reach for good, since the height that opened the next row was. Tokens of one height stay together: after the first
    the mean is only closer. The state is the row's number, sum and count.
    """
    places = []
    for cy, n, reach in zip(rows["cy"].tolist(), rows["n"].tolist(), rows["row_tolerance"].tolist(), strict=True):
        if not state[2] or abs(cy - state[1] / state[2]) > reach:
            state[:] = state[0] + 1, 0.0, 0
        state[1] += cy * n
        state[2] += n
        places.append(state[0])
    return (np.array(places, np.int32),)


def table_rows(tokens: DataFrame) -> DataFrame:
    """Rows of MIN/NOM/MAX tables: the label text, the value token of each column, the chosen column and the unit."""
    layout = settled(table_layout(tokens))
    places = settled(cluster_rows(tokens, layout))
    row = [*REGION, "chain", "row_no"]
    t = _centred(tokens).join(places, [*REGION, "id"]).join(layout, REGION)
    letters = F.length(F.regexp_replace("text", f"[^{LETTERS}]", ""))
    label = (F.col("cx") < F.col("label_right")) & (letters > 0) & ((letters >= 3) | strip("text").rlike(f"^[{LETTERS}][A-Za-z0-9Α-ωα-ω]*$"))
    labels = t.where(label).groupBy(*row).agg(
        F.array_sort(F.collect_list(F.struct("x1", "ord", "id", "text"))).alias("_l"), F.max("confidence").alias("_lc"))
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"x_{n}").alias("hx")) for n in ROLES])
    near = t.where(F.col("text").rlike(r"\d")).select(*row, "id", "cx", "confidence", "ord", "column_tolerance", F.explode(columns).alias("_c"))
    near = near.where(F.abs(F.col("cx") - F.col("_c.hx")) <= F.col("column_tolerance"))
    best = near.groupBy(*row, F.col("_c.name").alias("name")).agg(F.min_by(
        F.struct("id", "confidence"), F.struct(F.abs(F.col("cx") - F.col("_c.hx")).alias("d"), (-F.col("confidence")).alias("c"), "ord")).alias("_v"))
    values = best.groupBy(*row).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in ROLES])
    joined = labels.join(values, row)
    chosen = F.when(F.col("nom").isNotNull(), "nom").when(F.col("max").isNotNull(), "max")
    text = F.lower(F.array_join(F.transform("_l", lambda x: x.text), " "))
    out = joined.withColumn("column", chosen).where(F.col("column").isNotNull())
    return out.select(
        *row, F.array_join(F.transform("_l", lambda x: x.text), " ").alias("label"), F.transform("_l", lambda x: x.id).alias("label_ids"),
        *[F.col(f"{n}.id").alias(f"{n}_id") for n in ROLES], "column",
        F.when(text.contains("number of"), "count").when(text.contains("angle"), "deg").otherwise("mm").alias("unit"),
        F.least("_lc", F.when(F.col("column") == "nom", F.col("nom.confidence")).otherwise(F.col("max.confidence"))).alias("confidence"))


def table_groups(tokens: DataFrame) -> DataFrame:
    """Table rows of all three kinds as groups; `prompt_token_ids` holds one descriptive label, one symbol, the context and the NOM
    or MAX value, or all labels where none is descriptive or a symbol."""
    none, no_id = F.array().cast("array<string>"), F.lit(None).cast("string")
    held = ["min_id", "nom_id", "max_id"]
    view = [F.col("doc_id"), F.col("source_region_id").alias("view_id")]
    grid = table_rows(tokens).select(*view, "label_ids", none.alias("context_token_ids"), *held, "confidence")
    one = F.array("label_id").alias("label_ids")
    pairs = key_value_rows(tokens).select(*view, one, none.alias("context_token_ids"), no_id.alias("min_id"), F.col("value_id").alias("nom_id"), no_id.alias("max_id"), "confidence")
    matrix = pin_matrix_rows(tokens).select(*view, one, F.array("context_id").alias("context_token_ids"), F.when(F.col("column") == "min", F.col("value_id")).alias("min_id"),
                                            no_id.alias("nom_id"), F.when(F.col("column") == "max", F.col("value_id")).alias("max_id"), "confidence")
    # A row of a table may have very many labels, so its members carry its number and not its lists
    rows = grid.unionByName(pairs).unionByName(matrix).distinct()
    rows = settled(rows.withColumns({"token_ids": F.array_distinct(F.array_compact(F.concat("label_ids", F.array(*held)))), "_labels": F.size("label_ids"),
                                     "_row": F.monotonically_increasing_id()}))
    facts = tokens.select("doc_id", "id", F.col("source_region_id").alias("view_id"), "ord", "text", *BOX)
    members = rows.select("doc_id", "view_id", "_row", "_labels", F.posexplode("token_ids").alias("_p", "id")).join(facts, ["doc_id", "view_id", "id"])
    label = F.col("_p") < F.col("_labels")
    first = [F.min(F.when(label & wanted, F.col("_p"))).alias(name) for name, wanted in (
        ("_d", F.col("text").rlike(DESCRIPTIVE)), ("_s", strip("text").rlike("^[A-Za-z\u0370-\u03ff][A-Za-z0-9]?$")))]
    places = members.groupBy("_row").agg(
        F.min(F.when(label, F.col("ord"))).alias("ord"), *[F.min(c).cast("int").alias(c) for c in ("x1", "y1")], *[F.max(c).cast("int").alias(c) for c in ("x2", "y2")], *first)
    groups = rows.join(places, "_row").withColumns({c: F.get("token_ids", F.col(c)) for c in ("_d", "_s")})
    short = F.array_compact(F.array("_d", "_s"))
    prompt = F.concat(F.when(F.size(short) > 0, short).otherwise(F.col("label_ids")), F.col("context_token_ids"), F.array_compact(F.array(F.coalesce("nom_id", "max_id"))))
    return groups.select(
        "doc_id", "view_id", F.lit("table_row").alias("evidence_type"), "ord", *BOX, "token_ids", none.alias("dimension_line_ids"), none.alias("extension_line_ids"),
        none.alias("arrow_ids"), F.lit("horizontal").alias("orientation"), "confidence", "context_token_ids", F.array_distinct(prompt).alias("prompt_token_ids"))


# --- dimension groups -------------------------------------------------------------------------------------------------
def usable_tokens(tokens: DataFrame, confidence: float = T.TOKEN_CONFIDENCE, cell: float = 128.0) -> DataFrame:
    """Dimension texts without fragments of longer texts and without rotated readings across horizontal ones."""
    sure = tokens.where(F.col("confidence") >= confidence).withColumn("is_count", explicit_count("text").isNotNull())
    wanted = sure.where(F.col("is_count") | F.col("text").rlike(DIMENSION_TEXT))
    pairs = box_pairs(wanted.where(~F.col("is_count")), tokens, REGION, cell).where(F.col("a.id") != F.col("b.id"))
    area = overlap_area("a", "b")
    own = F.greatest(F.lit(1), (F.col("a.x2") - F.col("a.x1")) * (F.col("a.y2") - F.col("a.y1")))
    fragment = (F.col("b.confidence") >= 0.80) & (F.length(strip("b.text")) > F.length(strip("a.text"))) & (area / own >= 0.60)
    across = (F.col("a.rotation_deg") != 0) & (F.col("b.rotation_deg") == 0) & (area > 0) & F.col("b.text").rlike(r"\d")
    bad = pairs.groupBy("doc_id", F.col("a.id").alias("id")).agg(F.count_if(fragment).alias("_f"), F.count_if(across).alias("_x")).where(
        (F.col("_f") > 0) | (F.col("_x") >= 2))
    return wanted.join(bad.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def dimension_groups(tokens: DataFrame, lines: DataFrame, links: DataFrame | None = None, reach: float = 140.0) -> DataFrame:
    """Each dimension text with its lines and arrows; texts stacked on the same dimension lines become one group."""
    use = settled(usable_tokens(tokens))
    links = link_lines(tokens, lines) if links is None else links
    key = ["doc_id", "id"]
    linked = links.select(*key, "line_id", "rank", F.lit(0.90).alias("link_confidence"))
    # An explicit range without a line takes the nearest line of its region within reach.
    dims = use.where(~F.col("is_count"))
    ranged = dims.where(F.translate("text", ",−", ".-").rlike(RANGE)).join(links.select(*key).distinct(), key, "left_anti")
    grown = _centred(ranged).withColumns({"x1": F.col("cx") - reach, "x2": F.col("cx") + reach, "y1": F.col("cy") - reach, "y2": F.col("cy") + reach})
    points = lines.withColumns({"x1": _mid("lx1", "lx2"), "y1": _mid("ly1", "ly2")}).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    near = box_pairs(grown, points, REGION, reach).withColumn("_d", F.hypot(F.col("a.cx") - F.col("b.x1"), F.col("a.cy") - F.col("b.y1"))).where(F.col("_d") <= reach)
    near = near.select("doc_id", F.col("a.id").alias("id"), F.col("b.line_id").alias("line_id"), "_d", F.col("b.ord").alias("_o"))
    near = top_per_key(near, key, [F.col("_d"), F.col("_o")], 1, "rank").select(*key, "line_id", "rank", F.lit(0.75).alias("link_confidence"))
    facts = lines.select("doc_id", "line_id", "type", "lx1", "ly1", "lx2", "ly2", "arrow_ids", orientation().alias("_dir"))
    rows = dims.select(*key).join(linked.unionByName(near), key).join(facts, ["doc_id", "line_id"])
    is_dim = F.col("type") == "dimension_line"
    # A text has at most six linked lines; two dimension lines and three others are kept.
    place = F.row_number().over(Window.partitionBy(*key, is_dim).orderBy("rank"))
    rows = rows.withColumn("_p", place).where(F.col("_p") <= F.when(is_dim, 2).otherwise(3))
    picked = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(is_dim, F.struct("rank", "line_id")))).alias("_d"), F.array_sort(F.collect_list(F.when(~is_dim, F.struct("rank", "line_id")))).alias("_e"),
        F.array_sort(F.collect_list(F.struct((~is_dim).alias("k"), "rank", "arrow_ids"))).alias("_a"), F.min_by("_dir", F.struct((~is_dim).alias("k"), "rank")).alias("orientation"),
        F.min(F.least("lx1", "lx2")).alias("_x1"), F.min(F.least("ly1", "ly2")).alias("_y1"), F.max(F.greatest("lx1", "lx2")).alias("_x2"),
        F.max(F.greatest("ly1", "ly2")).alias("_y2"), F.max("link_confidence").alias("_lc"))
    joined = dims.join(picked, key)
    ids = F.array(F.col("id"))
    groups = joined.select(
        "doc_id", F.col("source_region_id").alias("view_id"), F.lit("dimension_line").alias("evidence_type"), "ord", F.least("x1", "_x1").cast("int").alias("x1"),
        F.least("y1", "_y1").cast("int").alias("y1"), F.greatest("x2", "_x2").cast("int").alias("x2"), F.greatest("y2", "_y2").cast("int").alias("y2"), ids.alias("token_ids"),
        F.transform("_d", lambda d: d.line_id).alias("dimension_line_ids"), F.transform("_e", lambda d: d.line_id).alias("extension_line_ids"),
        F.array_distinct(F.flatten(F.transform("_a", lambda a: a.arrow_ids))).alias("arrow_ids"), "orientation", F.least("confidence", "_lc").alias("confidence"))
    none = F.array().cast("array<string>")
    counts = use.where("is_count").select(
        "doc_id", F.col("source_region_id").alias("view_id"), F.lit("identity_text").alias("evidence_type"), "ord", *[F.col(c).cast("int").alias(c) for c in BOX], ids.alias("token_ids"),
        none.alias("dimension_line_ids"), none.alias("extension_line_ids"), none.alias("arrow_ids"), F.lit("horizontal").alias("orientation"), "confidence")
    return merge_stacked(groups).unionByName(counts)


def _stacks(across: int, above: int):
    """Number each box by the stack it joins: the first whose box reaches it. The state is the box of each stack."""
    def step(state: list, rows: dict):
        homes = []
        for box in zip(*(rows[c].tolist() for c in BOX), strict=True):
            left, top, right, bottom = (np.array(side) for side in zip(*state, strict=True)) if state else (np.zeros(0),) * 4
            reached = np.flatnonzero((np.maximum(left, box[0]) - across <= np.minimum(right, box[2])) & (np.abs(top + bottom - box[1] - box[3]) <= 2 * above))
            home = int(reached[0]) if len(reached) else len(state)
            if home == len(state):
                state.append(box)
            else:
                was = state[home]
                state[home] = (min(was[0], box[0]), min(was[1], box[1]), max(was[2], box[2]), max(was[3], box[3]))
            homes.append(home)
        return (homes,)
    return step


def merge_stacked(groups: DataFrame, across: int = 20, above: int = 90) -> DataFrame:
    """Join groups of a view that share their dimension lines and stand close, in their order.

    Which group joins which stack is decided in order over boxes alone; tokens, lines and confidences are aggregated per stack afterwards. Boxes further apart in
    height than the limit can't join, so each chain of close boxes with the same lines is a stream of its own.
    """
    shared = groups.withColumn("_lines", F.array_join(F.array_sort("dimension_line_ids"), "|"))
    key = ["doc_id", "view_id", "_lines"]
    several = shared.where(F.col("_lines") != "")
    spans = several.groupBy(*key, "y1").agg(F.max("y2").alias("_end"))
    chained = several.join(_islands(spans, key, "y1", "_end", float(above), "chain"), [*key, "y1"])
    chained = chained.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*key, "chain")))
    member = [*key, "chain", "ord", "token_ids"]
    # texts of one place in the order keep a fixed order by their tokens
    order = F.struct("ord", "token_ids")
    boxes = chained.where("_size > 1").select(*member, *BOX)
    stacks = fold_in_order(boxes, [*key, "chain"], [F.col("ord"), F.col("token_ids")], list, _stacks(across, above), {"home": "long"}).select(*member, "home")
    lists = ("token_ids", "extension_line_ids", "arrow_ids")
    facts = [c for c in groups.columns if c not in ("doc_id", "view_id", *BOX, "confidence", *lists)]
    merged = chained.where("_size > 1").join(stacks, member).groupBy(*key, "chain", "home").agg(
        F.min_by(F.struct(*facts), order).alias("_first"), *(F.min(c).alias(c) for c in ("x1", "y1", "confidence")), *(F.max(c).alias(c) for c in ("x2", "y2")),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), *lists))).alias("_members"))
    united = merged.select("doc_id", "view_id", "_first.*", *BOX, "confidence", *(F.array_distinct(F.flatten(F.col(f"_members.{c}"))).alias(c) for c in lists))
    alone = chained.where("_size = 1").select(*groups.columns).unionByName(shared.where(F.col("_lines") == "").select(*groups.columns))
    return united.select(*groups.columns).unionByName(alone)


def rank_groups(groups: DataFrame) -> list[Column]:
    """Identity first, then groups with dimension lines; more arrows, surer, higher, further left."""
    return [F.when(F.col("evidence_type") == "identity_text", 0).when(F.size("dimension_line_ids") > 0, 1).otherwise(2),
            -F.size("arrow_ids"), -F.col("confidence"), F.col("y1"), F.col("x1"), F.col("ord")]


def select_groups(groups: DataFrame, max_groups: int = 12, max_tokens: int = 25) -> DataFrame:
    """Best groups of every view while their new tokens fit the budget; a group that does not fit is passed over.

    A group's tokens are its prompt_token_ids (table rows), or else token_ids with context_token_ids; both columns may be missing.
    Each round takes the next fitting group of every view by a partial aggregate over all groups, so a view
    with very many groups is never gathered. The state of a view is its few chosen tokens.
    """
    view = ["doc_id", "view_id"]
    needed = F.concat("token_ids", F.coalesce("context_token_ids", F.array().cast("array<string>"))) if "context_token_ids" in groups.columns else F.col("token_ids")
    needed = F.coalesce("prompt_token_ids", needed) if "prompt_token_ids" in groups.columns else needed
    # Rows of two kinds may share a label, so the members decide last.
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*rank_groups(groups), F.col("evidence_type"), F.col("token_ids")])])
    ranked = settled(groups.select(*view, rank.alias("_r"), F.struct("ord", "evidence_type").alias("_g"), F.array_distinct(needed).alias("_t")))
    state = ranked.groupBy(*view).agg(F.min_by(F.struct("_r", "_g", "_t"), "_r").alias("_s")).select(
        *view, "_s._r", "_s._g", F.col("_s._t").alias("_tokens"), F.lit(1).alias("place"))
    state = settled(state)
    chosen = state
    small = ranked.where(F.size("_t") <= max_tokens)  # with tokens beyond the budget of its own a group can only come first
    for place in range(2, max_groups + 1):
        held = state.select(*view, F.col("_r").alias("_last"), "_tokens")
        fresh = F.array_except("_t", "_tokens")
        fits = small.join(held, view).where((F.col("_r") > F.col("_last")) & (F.size("_tokens") + F.size(fresh) <= max_tokens))
        state = fits.groupBy(*view).agg(F.min_by(F.struct("_r", "_g", F.array_union("_tokens", "_t").alias("_tokens")), "_r").alias("_s")).select(
            *view, "_s._r", "_s._g", "_s._tokens", F.lit(place).alias("place"))
        state = settled(state)
        if state.isEmpty():
            break
        chosen = chosen.unionByName(state)
    return chosen.select(*view, "_g.ord", "_g.evidence_type", "place")


# --- stacked ranges ---------------------------------------------------------------------------------------------------
def stacked_pairs(tokens: DataFrame, lines: DataFrame, cell: float = 128.0) -> DataFrame:
    """Two aligned millimetre values, the larger above, with a separating line between them: (doc_id, upper, lower, line_id)."""
    return _stacked_values(tokens, lines, cell).drop("high", "low")


def _stacked_values(tokens: DataFrame, lines: DataFrame, cell: float = 128.0) -> DataFrame:
    """Stacked pairs with both values."""
    typed = with_dimensions(tokens, "text", columns=("nominal",))
    plain = typed.where((F.col("unit_context") == "mm") & (F.col("source_region_id") != "unassigned") & ~F.col("value_role").startswith("table_")
                        & strip("text").rlike(r"^\d+(?:[.,]\d+)?$") & F.col("nominal").isNotNull() & (F.col("x2") > F.col("x1")))
    plain = plain.select(*REGION, "id", "nominal", *BOX, F.col("y1").alias("top"), F.col("y2").alias("bottom"))
    tall = (F.col("y2") - F.col("y1")) * 0.65
    # Either box grown by its own reach touches the other box.
    grown = plain.withColumns({"y1": F.col("top") - tall, "y2": F.col("bottom") + tall})
    pairs = box_pairs(grown, grown, REGION, cell).where((F.col("a.id") != F.col("b.id")) & (F.col("a.nominal") > F.col("b.nominal")))
    width = F.least(F.col("a.x2") - F.col("a.x1"), F.col("b.x2") - F.col("b.x1"))
    height = F.greatest(F.col("a.bottom") - F.col("a.top"), F.col("b.bottom") - F.col("b.top"))
    pairs = pairs.withColumns({"_w": width, "_h": height, "_gap": F.col("b.top") - F.col("a.bottom")})
    centre = F.abs((F.col("a.x1") + F.col("a.x2")) - (F.col("b.x1") + F.col("b.x2"))) / 2
    overlap = F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1")
    pairs = pairs.where((F.col("_h") > 0) & F.col("_gap").between(0, F.col("_h") * 0.65) & (centre <= F.col("_w") * 0.20) & (overlap >= F.col("_w") * 0.80))
    slots = pairs.select(*REGION, F.col("a.id").alias("upper"), F.col("b.id").alias("lower"), F.col("a.nominal").alias("high"), F.col("b.nominal").alias("low"), "_w", "_h",
                         F.greatest("a.x1", "b.x1").alias("ix1"), F.least("a.x2", "b.x2").alias("ix2"), F.least("a.x1", "b.x1").alias("ox1"), F.greatest("a.x2", "b.x2").alias("ox2"),
                         F.greatest("a.x1", "b.x1").cast("double").alias("x1"), F.least("a.x2", "b.x2").cast("double").alias("x2"),
                         F.col("a.bottom").cast("double").alias("y1"), F.col("b.top").cast("double").alias("y2"))
    level = lines.select(*REGION, "line_id", "ord", F.least("lx1", "lx2").alias("l1"), F.greatest("lx1", "lx2").alias("l2"), F.abs(F.col("ly2") - F.col("ly1")).alias("dy"),
                         F.least("lx1", "lx2").cast("double").alias("x1"), F.greatest("lx1", "lx2").cast("double").alias("x2"), _mid("ly1", "ly2").alias("y1"), _mid("ly1", "ly2").alias("y2"))
    hits = box_pairs(slots, level, REGION, cell).where(
        (F.col("b.dy") <= F.col("a._h") * 0.10) & (F.least("b.l2", "a.ix2") - F.greatest("b.l1", "a.ix1") >= F.col("a._w") * 0.60)
        & (F.col("b.l1") >= F.col("a.ox1") - F.col("a._w") * 0.20) & (F.col("b.l2") <= F.col("a.ox2") + F.col("a._w") * 0.20))
    return hits.groupBy(*REGION, F.col("a.upper").alias("upper"), F.col("a.lower").alias("lower")).agg(
        F.min_by("b.line_id", "b.ord").alias("line_id"), F.max("a.high").alias("high"), F.max("a.low").alias("low"))


def labelled_tokens(tokens: DataFrame, cell: float = 128.0) -> DataFrame:
    """Tokens with a label of their own close by on the same line."""
    words = tokens.where(strip("text").rlike("[A-Za-zΑ-ω]") & ~F.lower(strip("text")).isin("min", "max", "nom", "typ", "mm"))
    height = F.greatest(F.lit(1), F.col("y2") - F.col("y1"))
    grown = tokens.withColumns({"_h": height, "ox1": F.col("x1"), "ox2": F.col("x2")}).withColumns({"x1": F.col("x1") - F.col("_h"), "x2": F.col("x2") + F.col("_h")})
    pairs = box_pairs(grown, words, REGION, cell)
    overlap = F.least("a.y2", "b.y2") - F.greatest("a.y1", "b.y1")
    gap = F.greatest(F.col("a.ox1") - F.col("b.x2"), F.col("b.x1") - F.col("a.ox2"), F.lit(0))
    near = (overlap >= F.least("a._h", F.greatest(F.lit(1), F.col("b.y2") - F.col("b.y1"))) * 0.50) & (gap <= F.col("a._h"))
    return pairs.where(near).select("doc_id", F.col("a.id").alias("id")).distinct()


def reconcile_stacked(assignments: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Merges of split stacked ranges: (doc_id, upper_assignment, lower_assignment, line_id).

    Both assignments hold one token each. Blocked by a label of either value, by different outside dimension
    lines, and between different fields unless another view states the range of the lower field. An
    assignment takes part in one merge; merges are decided in the order of the upper assignment.
    """
    name = F.col("canonical_name")
    single = assignments.where((F.size("token_ids") == 1) & ~name.endswith("_deg") & ~name.endswith("_count")).select(
        "doc_id", "assignment_id", "canonical_name", F.col("token_ids")[0].alias("id"), "line_ids")
    pairs = settled(_stacked_values(tokens, lines))
    labelled = labelled_tokens(tokens)
    box = tokens.select("doc_id", "id", *BOX)
    out = single.select("doc_id", "assignment_id", "id", F.explode("line_ids").alias("line_id")).join(
        lines.where(F.col("type") == "dimension_line").select("doc_id", "line_id", "lx1", "ly1", "lx2", "ly2"), ["doc_id", "line_id"]).join(box, ["doc_id", "id"])
    margin = F.greatest(F.lit(1.0), (F.col("y2") - F.col("y1")) * 0.10)

    def inside(x, y):
        return F.col(x).between(F.col("x1") - margin, F.col("x2") + margin) & F.col(y).between(F.col("y1") - margin, F.col("y2") + margin)
    outer = out.where(~inside("lx1", "ly1") | ~inside("lx2", "ly2")).groupBy("doc_id", "assignment_id").agg(F.collect_set("line_id").alias("_out"))
    a = single.join(outer, ["doc_id", "assignment_id"], "left")
    none = F.array().cast("array<string>")

    def side(prefix, token):
        return a.select("doc_id", F.col("assignment_id").alias(f"{prefix}_assignment"), F.col("canonical_name").alias(f"{prefix}_name"), F.col("id").alias(token),
                        F.coalesce("_out", none).alias(f"{prefix}_out"))
    both = pairs.join(side("upper", "upper"), ["doc_id", "upper"]).join(side("lower", "lower"), ["doc_id", "lower"]).where(
        F.col("upper_assignment") != F.col("lower_assignment"))
    for token in ("upper", "lower"):
        both = both.join(labelled.select("doc_id", F.col("id").alias(token), F.lit(True).alias(f"_{token}_label")), ["doc_id", token], "left")
    up, low = F.array_remove("upper_out", F.col("line_id")), F.array_remove("lower_out", F.col("line_id"))
    rival = (F.size(up) > 0) & (F.size(low) > 0) & (F.array_sort(up) != F.array_sort(low))
    blocked = F.col("_upper_label").isNotNull() | F.col("_lower_label").isNotNull() | rival
    # Support of another field: a stacked pair of that field in another region whose range holds the lower value.
    two = assignments.where(F.size("token_ids") == 2).select("doc_id", F.col("canonical_name").alias("lower_name"), "token_ids")
    ranges = two.join(pairs.select("doc_id", F.col("source_region_id").alias("_region"), F.col("upper").alias("_u"), F.col("lower").alias("_l"), F.col("high").alias("_high"), F.col("low").alias("_low")), "doc_id").where(
        F.array_contains("token_ids", F.col("_u")) & F.array_contains("token_ids", F.col("_l"))).select("doc_id", "lower_name", "_region", "_low", "_high")
    crossing = (F.col("upper_name") != F.col("lower_name"))
    backed = both.where(crossing).join(ranges, ["doc_id", "lower_name"]).where(
        (F.col("_region") != F.col("source_region_id")) & (F.col("_low") <= F.col("low")) & (F.col("low") <= F.col("_high")) & (F.col("_high") < F.col("high")))
    backed = backed.select("doc_id", "upper_assignment", "lower_assignment").distinct().withColumn("_backed", F.lit(True))
    judged = both.join(backed, ["doc_id", "upper_assignment", "lower_assignment"], "left")
    extra = F.size(F.array_except(low, up)) > 0
    ok = ~blocked & (~crossing | (~extra & F.col("_backed").isNotNull()))
    judged = judged.select(*REGION, "upper_assignment", "lower_assignment", "line_id", ok.alias("ok"))

    # A pair whose assignments stand in no other pair needs no order; only contested pairs of a view are decided in order.
    judged = settled(judged)
    used = judged.select("doc_id", F.explode(F.array("upper_assignment", "lower_assignment")).alias("_a"))
    contested = used.groupBy("doc_id", "_a").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", "_a")
    for part in ("upper", "lower"):
        judged = judged.join(contested.select("doc_id", F.col("_a").alias(f"{part}_assignment"), F.lit(True).alias(f"_{part}")), ["doc_id", f"{part}_assignment"], "left")
    free = F.col("_upper").isNull() & F.col("_lower").isNull()
    columns = ["doc_id", "upper_assignment", "lower_assignment", "line_id"]
    offers = judged.where(~free).groupBy(*REGION, "upper_assignment").agg(F.array_sort(F.collect_list(F.struct("lower_assignment", "ok", "line_id"))).alias("_o"))
    offers = offers.withColumns({"lower": F.transform("_o", lambda o: o.lower_assignment), "fine": F.transform("_o", lambda o: o.ok)})
    decided = fold_in_order(offers.select(*REGION, "upper_assignment", "lower", "fine"), REGION, [F.col("upper_assignment")], set, _taken, {"at": "int"})
    taken = offers.join(decided.where("at >= 0").select(*REGION, "upper_assignment", "at"), [*REGION, "upper_assignment"]).select(
        "doc_id", "upper_assignment", F.col("_o")[F.col("at")].lower_assignment.alias("lower_assignment"), F.col("_o")[F.col("at")].line_id.alias("line_id"))
    return judged.where(free & F.col("ok")).select(*columns).unionByName(taken)


def _taken(used: set, rows: dict):
    """For each upper assignment the place of the lower one it merges with, or -1: both must be unused, and no second unused one may be offered."""
    places = []
    for upper, lower, fine in zip(rows["upper_assignment"].tolist(), rows["lower"], rows["fine"], strict=True):
        left = [] if upper in used else [k for k, x in enumerate(lower.tolist()) if x not in used]
        places.append(left[0] if len(left) == 1 and fine[left[0]] else -1)
        if places[-1] >= 0:
            used |= {upper, lower[left[0]].item()}
    return (np.array(places, np.int32),)
