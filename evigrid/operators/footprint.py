"""Footprints: consistency rules, derived geometry, pad expansion, label binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The counter-clockwise sides as unit vectors
SIDE_VECTORS = {"left": -1 + 0j, "right": 1 + 0j, "top": 1j, "bottom": -1j}
TO_MM = {"mm": 1.0, "inch": 25.4, "mil": 0.0254}

# Consistency rules over one specification with the totals of its pads: (code, condition that breaks it)
SPEC_RULES = [
    ("numbering_count", "size(pin_numbering) <> pin_count"),
    ("numbering_repeated", "size(array_distinct(pin_numbering)) <> pin_count"),
    ("dual_odd", "pin_layout = 'DUAL' AND pin_count % 2 <> 0"),
    ("quad_not_by_four", "pin_layout = 'QUAD' AND pin_count % 4 <> 0"),
    ("pad_size_missing", "ep_present AND (ep_x IS NULL OR ep_y IS NULL)"),
    ("number_shape", "exists(array_append(pin_numbering, ep_pin_number), n -> NOT n RLIKE '^[A-Za-z0-9_]{1,32}$')"),
    ("pad_number_used", "ep_present AND array_contains(pin_numbering, ep_pin_number)"),
    ("explicit_pads", "pin_layout = 'EXPLICIT' AND (pads <> pin_count OR misplaced > 0)"),
    ("explicit_mixed", "pin_layout = 'EXPLICIT' AND (pin_pitch IS NOT NULL OR pin_columns_x IS NOT NULL OR land_x IS NOT NULL OR land_y IS NOT NULL)"),
    ("pads_without_explicit", "pin_layout <> 'EXPLICIT' AND pads > 0"),
    ("uniform_incomplete", "pin_layout <> 'EXPLICIT' AND pads = 0 AND (pin_pitch IS NULL OR pin_columns_x IS NULL OR land_x IS NULL OR land_y IS NULL)"),
    ("columns_order", "pin_columns_x[0] >= pin_columns_x[1]"),
    ("units", "units <> 'millimeters'"),
    ("extents", "extents[0] >= extents[2] OR extents[1] >= extents[3]"),
    ("mask_inset", "NOT nsmd AND least(coalesce(smallest, least(land_x, land_y)), CASE WHEN ep_present THEN least(ep_x, ep_y) END) <= 2 * mask_expansion"),
    ("paste_inset", "paste_mode = 'INSET' AND least(coalesce(smallest, least(land_x, land_y)), CASE WHEN ep_present THEN least(ep_x, ep_y) END) <= 2 * paste_inset"),
    ("circle_not_round", "uneven_circles > 0"),
]


def spec_issues(specs: DataFrame, pads: DataFrame) -> DataFrame:
    """Broken consistency rules, one row each. Pads are reduced to totals before they meet their specification."""
    numbers = specs.select("spec_id", F.posexplode("pin_numbering").alias("ord", "_wanted"))
    placed = pads.join(numbers, ["spec_id", "ord"], "left")
    totals = placed.groupBy("spec_id").agg(
        F.count("*").alias("pads"), F.count_if(~F.coalesce(F.col("number") == F.col("_wanted"), F.lit(False))).alias("misplaced"),
        F.min(F.least("size_x", "size_y")).alias("smallest"),
        F.count_if((F.col("shape") == "CIRCLE") & (F.abs(F.col("size_x") - F.col("size_y")) > 1e-9)).alias("uneven_circles"))
    rows = specs.join(totals, "spec_id", "left").fillna(0, ["pads", "misplaced", "uneven_circles"])
    broken = F.array_compact(F.array(*[F.expr(f"CASE WHEN {cond} THEN '{code}' END") for code, cond in SPEC_RULES]))
    return rows.select("spec_id", F.explode(broken).alias("issue"))


def _r6(col: Column) -> Column:
    return F.round(col, 6)


def pad_layers(w: Column, h: Column) -> list[Column]:
    """Paste and mask size of a copper size, by the mode of its specification."""
    grow = F.when(F.col("nsmd"), 2.0).otherwise(-2.0) * F.col("mask_expansion")
    out = []
    for axis, size in (("x", w), ("y", h)):
        paste = (F.when(F.col("paste_mode") == "MATCH_LAND", size).when(F.col("paste_mode") == "INSET", _r6(size - 2 * F.col("paste_inset"))).otherwise(0.0))
        out += [paste.alias(f"paste_{axis}"), _r6(size + grow).alias(f"mask_{axis}")]
    return out


def dual_pads(specs: DataFrame) -> DataFrame:
    """Pads of dual-row specifications: left column top down, then right column top down."""
    rows = specs.where(F.col("pin_layout") == "DUAL").select("spec_id", "pin_count", "pin_pitch", "pin_columns_x", "land_x", "land_y",
                                                            F.posexplode("pin_numbering").alias("ord", "number"))
    half = F.floor(F.col("pin_count") / 2)
    right = F.col("ord") >= half
    row = F.when(right, F.col("ord") - half).otherwise(F.col("ord"))
    return rows.select("spec_id", "ord", "number", F.when(right, F.col("pin_columns_x")[1]).otherwise(F.col("pin_columns_x")[0]).alias("x"),
                       _r6(F.col("pin_pitch") * ((half - 1) / 2 - row)).alias("y"), F.col("land_x").alias("size_x"), F.col("land_y").alias("size_y"),
                       F.lit("RECTANGLE").alias("shape"))


def pad_geometry(specs: DataFrame, pads: DataFrame) -> DataFrame:
    """Copper, paste and mask of every pad, the thermal pad included."""
    rule = ["spec_id", "nsmd", "mask_expansion", "paste_mode", "paste_inset"]
    explicit = pads.join(specs.where(F.col("pin_layout") == "EXPLICIT").select("spec_id"), "spec_id", "left_semi")
    columns = ["spec_id", "ord", "number", "x", "y", "size_x", "size_y", "shape"]
    thermal = specs.where(F.col("ep_present") & F.col("ep_x").isNotNull() & F.col("ep_y").isNotNull()).select(
        "spec_id", F.lit(-1).alias("ord"), F.col("ep_pin_number").alias("number"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        F.col("ep_x").alias("size_x"), F.col("ep_y").alias("size_y"), F.lit("RECTANGLE").alias("shape"))
    every = explicit.select(*columns).unionByName(dual_pads(specs).select(*columns)).unionByName(thermal)
    return every.join(specs.select(*rule), "spec_id").select(*columns, *pad_layers(F.col("size_x"), F.col("size_y")))


def package_geometry(specs: DataFrame, pads: DataFrame) -> DataFrame:
    """Assembly, place bound, silk lines, label and marker of every specification."""
    masks = pad_geometry(specs, pads).where(F.col("ord") >= 0).groupBy("spec_id").agg(
        F.max(F.abs("x") + F.col("mask_x") / 2).alias("_mx"), F.max(F.abs("y") + F.col("mask_y") / 2).alias("_my"))
    s = specs.join(masks, "spec_id", "left")
    explicit = F.col("pin_layout") == "EXPLICIT"
    s = s.withColumns({"asm_half": _r6(F.col("body_x") / 2), "asm_half_y": _r6(F.col("body_y") / 2)})
    s = s.withColumns({"_pb": _r6(F.col("asm_half") + F.col("mold_flash")), "_pby": _r6(F.col("asm_half_y") + F.col("mold_flash")),
                       "_silk": _r6(F.col("asm_half") + F.col("silk_clearance"))})
    silk = (F.when(explicit, _r6(F.greatest(F.col("asm_half_y") + F.col("silk_clearance"), F.col("_my") + F.col("silk_clearance") + F.col("silk_line_width") / 2)))
            .when(F.col("body_x") != F.col("body_y"), _r6(F.col("asm_half_y") + F.col("silk_clearance"))).otherwise(F.col("_silk")))
    span = F.when(explicit, _r6(F.greatest("asm_half", "_mx") + F.col("silk_clearance") + F.col("silk_span_extra"))).otherwise(
        _r6(F.col("_silk") + F.col("silk_span_extra")))
    s = s.withColumns({"silk_half": silk, "silk_span": span,
                       "pb_half": F.when(explicit, _r6(F.greatest("_pb", F.col("_mx") + F.col("pb_clearance")))).otherwise(F.col("_pb")),
                       "pb_half_y": F.when(explicit, _r6(F.greatest("_pby", F.col("_my") + F.col("pb_clearance")))).otherwise(F.col("_pby"))})
    marked = F.col("pin1_marker") == "TRIANGLE"
    size = F.col("pin1_marker_size")
    return s.select("spec_id", "asm_half", "asm_half_y", "pb_half", "pb_half_y", "silk_half", "silk_span",
                    F.coalesce("refdes_silk_y", _r6(F.col("silk_half") + 0.70)).alias("refdes_silk_y"),
                    F.when(marked, _r6(-(F.col("silk_span") + size))).alias("marker_west"), F.when(marked, _r6(-F.col("silk_span"))).alias("marker_east"),
                    F.when(marked, _r6(F.col("silk_half") + size / 2)).alias("marker_top"), F.when(marked, _r6(F.col("silk_half") - size / 2)).alias("marker_bottom"))


def grid_issues(grids: DataFrame) -> DataFrame:
    """Why a two-row grid cannot be expanded."""
    numbers = F.array_union("bottom_numbers", "top_numbers")
    special = F.transform("special_pads", lambda p: p.number)
    count = F.size("top_numbers")
    rules = F.array_compact(F.array(
        F.when(count != F.size("bottom_numbers"), F.lit("columns")), F.when(F.col("outer_span_y") <= F.col("standard_size_y"), F.lit("span")),
        F.when((F.size(F.array_distinct("bridged_columns")) != F.size("bridged_columns")) | F.exists("bridged_columns", lambda c: (c < 0) | (c >= count)), F.lit("bridges")),
        F.when((F.size(F.array_distinct(special)) != F.size(special)) | (F.size(F.array_except(special, numbers)) > 0), F.lit("special_pads"))))
    return grids.select("spec_id", F.explode(rules).alias("issue"))


def pads_from_grid(grids: DataFrame, split_bridges: bool = False) -> DataFrame:
    """Pads of valid two-row grids, bottom row first; special pads keep their own width and alignment."""
    good = grids.join(grid_issues(grids).select("spec_id").distinct(), "spec_id", "left_anti")
    count = F.size("top_numbers")
    rows = F.array(F.struct(F.lit(-1).alias("sign"), F.col("bottom_numbers").alias("numbers")), F.struct(F.lit(1).alias("sign"), F.col("top_numbers").alias("numbers")))
    flat = good.withColumn("_n", count).select("*", F.explode(rows).alias("_r")).select("*", F.posexplode("_r.numbers").alias("col", "number"))
    own = F.filter("special_pads", lambda p: p.number == F.col("number"))
    flat = flat.withColumn("_s", F.try_element_at(own, F.lit(1)))
    bridged = F.array_contains("bridged_columns", F.col("col")) & F.lit(not split_bridges)
    width = F.coalesce("_s.size_x", "standard_size_x")
    base = F.col("pitch_x") * (F.col("col") - (F.col("_n") - 1) / 2)
    shift = (width - F.col("standard_size_x")) / 2 * F.when(F.col("_s.alignment") == "right", -1).otherwise(1)
    x = F.when(F.col("_s").isNull() | (F.col("_s.alignment") == "center"), base).when(F.col("_s.alignment") == "unknown", F.lit(None)).otherwise(base + shift)
    y = F.when(bridged, 0.0).otherwise(F.col("_r.sign") * (F.col("outer_span_y") - F.col("standard_size_y")) / 2)
    order = F.when(F.col("_r.sign") < 0, F.col("col")).otherwise(F.col("_n") + F.col("col"))
    return flat.select("spec_id", order.alias("ord"), "number", _r6(x).alias("x"), _r6(y).alias("y"), width.alias("size_x"),
                       F.when(bridged, F.col("outer_span_y")).otherwise(F.col("standard_size_y")).alias("size_y"))


def pads_from_quad(quads: DataFrame) -> DataFrame:
    """Pads of four rows from labelled spans; two end numbers of a run are filled in, other gaps stay null.

    quads(spec_id, count, pitch, pad_length, pad_width, outer_span_x, outer_span_y, bottom_numbers ...).
    """
    good = quads.where(F.col("pad_length") < F.least("outer_span_x", "outer_span_y"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).alias("turn"), F.col(f"{s}_numbers").alias("numbers"))
                      for i, s in enumerate(("bottom", "right", "top", "left"))])
    rows = good.select("*", F.explode(sides).alias("_r")).select("*", "_r.side", "_r.turn", "_r.numbers")
    n, count = F.size("numbers"), F.col("count")
    inner_empty = (n == count) & F.forall(F.slice("numbers", F.lit(2), F.greatest(n - 2, F.lit(0))), lambda v: v.isNull())
    first, last = F.try_element_at("numbers", F.lit(1)).try_cast("int"), F.try_element_at("numbers", F.lit(-1)).try_cast("int")
    run = ((n == 2) | inner_empty) & first.isNotNull() & last.isNotNull() & (F.abs(last - first) + 1 == count)
    filled = F.when(run, F.transform(F.sequence(first, last), lambda v: v.cast("string"))).when(n == count, F.col("numbers")).otherwise(
        F.transform(F.sequence(F.lit(1), count), lambda v: F.lit(None).cast("string")))
    rows = rows.withColumn("_f", filled).select("*", F.posexplode("_f").alias("pos", "number"))
    flat = F.col("side").isin("bottom", "top")
    along = F.round(F.col("pitch") * (F.col("pos") - (count - 1) / 2), 6)
    x_row, y_row = (F.col("outer_span_x") - F.col("pad_length")) / 2, (F.col("outer_span_y") - F.col("pad_length")) / 2
    return rows.select("spec_id", (F.col("turn") * count + F.col("pos")).alias("ord"), "number",
                       _r6(F.when(flat, along).when(F.col("side") == "left", -x_row).otherwise(x_row)).alias("x"),
                       _r6(F.when(~flat, along).when(F.col("side") == "bottom", -y_row).otherwise(y_row)).alias("y"),
                       F.when(flat, F.col("pad_width")).otherwise(F.col("pad_length")).alias("size_x"),
                       F.when(flat, F.col("pad_length")).otherwise(F.col("pad_width")).alias("size_y"))


def project_outlines(outlines: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pads from the MAX column of a package outline, and (spec_id, issue) of those that cannot be projected.

    outlines(spec_id, units, centered, rotation_deg, body_x_symbol, body_y_symbol, overall_symbol, height_symbol,
    pitch_symbol, dimensions MAP<STRING, STRUCT<maximum, typical>>), terminals(spec_id, ord, side, pitch_index,
    number, width_symbol, length_symbol). A terminal without a labelled length reaches from the body to the span.
    """
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in TO_MM.items() for x in kv]), F.col("units"))

    def largest(symbol):
        return F.try_element_at("dimensions", F.col(symbol)).maximum * F.col("_f")
    pitch = F.try_element_at("dimensions", F.col("pitch_symbol"))
    o = outlines.withColumn("_f", factor).withColumns({
        "body_x": largest("body_x_symbol"), "body_y": largest("body_y_symbol"), "span": largest("overall_symbol"), "height": largest("height_symbol"),
        "pitch": F.coalesce(pitch.typical, pitch.maximum) * F.col("_f")})
    rules = F.array_compact(F.array(
        F.when(F.col("_f").isNull(), F.lit("units")), F.when(~F.col("centered"), F.lit("not_centered")),
        *[F.when(F.col("_f").isNotNull() & F.col(c).isNull(), F.lit(f"missing_{c}")) for c in ("body_x", "body_y", "span", "height", "pitch")],
        F.when(F.col("span") <= F.col("body_y"), F.lit("span_not_above_body"))))
    t = terminals.join(o.select("spec_id", "_f", "dimensions", "body_y", "span", "pitch", "rotation_deg"), "spec_id")
    t = t.withColumns({"width": largest("width_symbol"),
                       "length": F.when(F.col("length_symbol").isNotNull(), largest("length_symbol")).otherwise((F.col("span") - F.col("body_y")) / 2)})
    own = F.array_compact(F.array(F.when(F.col("width").isNull(), F.lit("missing_width")), F.when(F.col("length").isNull(), F.lit("missing_length")),
                                  F.when(F.col("length") >= F.col("span") / 2, F.lit("length_beyond_span"))))
    repeated = terminals.groupBy("spec_id", "side", "pitch_index").count().where("count > 1").select("spec_id", F.lit("place_repeated").alias("issue"))
    issues = o.select("spec_id", F.explode(rules).alias("issue")).unionByName(t.select("spec_id", F.explode(own).alias("issue"))).unionByName(repeated).distinct()
    good = t.join(issues.select("spec_id").distinct(), "spec_id", "left_anti")
    x, y = F.col("pitch_index") * F.col("pitch"), (F.col("span") - F.col("length")) / 2 * F.when(F.col("side") == "top", 1).otherwise(-1)
    turn = F.col("rotation_deg")
    across = turn.isin(90, -90)
    px = F.when(turn == 90, -y).when(turn == -90, y).when(turn == 180, -x).otherwise(x)
    py = F.when(turn == 90, x).when(turn == -90, -x).when(turn == 180, -y).otherwise(y)
    pads = good.select("spec_id", "ord", "number", _r6(px).alias("x"), _r6(py).alias("y"), _r6(F.when(across, F.col("length")).otherwise(F.col("width"))).alias("size_x"),
                       _r6(F.when(across, F.col("width")).otherwise(F.col("length"))).alias("size_y"))
    return pads, issues


# --- label binding ---------------------------------------------------------------------------------------------------
def perimeter_rows(pads: DataFrame) -> DataFrame:
    """Pads of two opposite straight rows with side and place; other layouts are left out.

    A footprint has at most 512 pads, so the rows of one specification are numbered in one window.
    """
    def lines(axis):
        at = pads.groupBy("spec_id", F.round(axis, 6).alias("_at")).agg(F.count("*").alias("_n"))
        return at.groupBy("spec_id").agg(F.count("*").alias(f"_{axis}n"), F.min("_at").alias(f"_{axis}0"), F.max("_at").alias(f"_{axis}1"))
    whole = pads.groupBy("spec_id").agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("_open")).where("_open = 0").drop("_open")
    rows = pads.join(whole, "spec_id").join(lines("x"), "spec_id").join(lines("y"), "spec_id")

    def two(axis):
        return (F.col(f"_{axis}n") == 2) & (F.col(f"_{axis}0") < 0) & (F.col(f"_{axis}1") > 0)
    side = (F.when(two("x"), F.when(F.round("x", 6) < 0, "left").otherwise("right"))
            .when(two("y"), F.when(F.round("y", 6) < 0, "bottom").otherwise("top")))
    sided = rows.withColumns({"side": side, "_along": F.when(two("x"), F.col("y")).otherwise(F.col("x"))}).where(F.col("side").isNotNull())
    place = F.row_number().over(Window.partitionBy("spec_id", "side").orderBy("_along", "ord"))
    return sided.select("spec_id", "ord", "number", "x", "y", "side", (place - 1).alias("place"))


def rotations(spark: SparkSession) -> DataFrame:
    """(turns, side, target, reversed): where a row of a top view lands after quarter turns, and its direction."""
    names = {v: k for k, v in SIDE_VECTORS.items()}
    out = []
    for turns in range(4):
        for side, vector in SIDE_VECTORS.items():
            # Rows at the sides are read downwards, against the upward axis of the geometry.
            axis = (1j if side in ("left", "right") else 1) * 1j ** turns
            forward = axis.real + axis.imag > 0
            out.append((turns, side, names[complex(round((vector * 1j ** turns).real), round((vector * 1j ** turns).imag))],
                        forward == (side in ("left", "right"))))
    return spark.createDataFrame(out, "turns int, side string, target string, reversed boolean")


def bind_labels(pads: DataFrame, reference_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of a top view on the pads, where exactly one rotation fits; and (spec_id, issue) of the others.

    reference_rows(spec_id, side, numbers, view, view_evidence, confidence, row_evidence).
    """
    turns = F.broadcast(rotations(pads.sparkSession))
    rows = perimeter_rows(pads)
    sizes = rows.groupBy("spec_id", F.col("side").alias("target")).agg(F.count("*").alias("_n"))
    sides = sizes.groupBy("spec_id").agg(F.count("*").alias("_sides"))
    numbers = reference_rows.select("spec_id", F.explode("numbers").alias("n"))
    shape = numbers.groupBy("spec_id", "n").agg(F.count("*").alias("c")).groupBy("spec_id").agg(
        F.sum("c").alias("_labels"), F.count_if(F.col("c") > 1).alias("_twice"),
        F.count_if(~F.coalesce(F.col("n"), F.lit("")).rlike("^[A-Za-z0-9_]{1,32}$")).alias("_odd"))
    heads = reference_rows.groupBy("spec_id").agg(
        F.count("*").alias("_rows"), F.count_distinct("side").alias("_row_sides"),
        F.bool_and((F.col("view") == "top") & (F.trim("view_evidence") != "") & (F.col("confidence") >= 0.9)).alias("_proof"),
        F.bool_and(F.trim("row_evidence") != "").alias("_lined"))
    total = pads.groupBy("spec_id").agg(F.count("*").alias("_pads"))
    fit = reference_rows.join(turns, "side").join(sizes, ["spec_id", "target"], "left")
    fit = fit.groupBy("spec_id", "turns").agg(F.count_if(F.coalesce(F.size("numbers") == F.col("_n"), F.lit(False))).alias("_fits"), F.count("*").alias("_all"))
    fit = fit.join(sides, "spec_id").where((F.col("_fits") == F.col("_all")) & (F.col("_all") == F.col("_sides")))
    unique = fit.groupBy("spec_id").agg(F.count("*").alias("_matches"), F.min("turns").alias("turns"))
    state = heads.join(shape, "spec_id", "left").join(total, "spec_id").join(sides, "spec_id", "left").join(unique, "spec_id", "left")
    issue = (F.when(~F.coalesce("_proof", F.lit(False)), "no_top_view").when(F.col("_rows") != F.col("_row_sides"), "rows")
             .when((F.coalesce("_labels", F.lit(0)) != F.col("_pads")) | (F.col("_twice") > 0) | (F.col("_odd") > 0), "labels")
             .when(~F.coalesce("_lined", F.lit(False)), "row_evidence").when(F.col("_sides").isNull(), "layout")
             .when(F.coalesce("_matches", F.lit(0)) != 1, "rotation"))
    state = state.withColumn("issue", issue)
    good = state.where(F.col("issue").isNull()).select("spec_id", "turns")
    placed = reference_rows.join(good, "spec_id").join(turns, ["turns", "side"])
    listed = F.when(F.col("reversed"), F.reverse("numbers")).otherwise(F.col("numbers"))
    wanted = placed.select("spec_id", F.col("target").alias("side"), (F.col("turns") * 90).alias("rotation_deg"), F.posexplode(listed).alias("place", "label"))
    bound = rows.join(wanted, ["spec_id", "side", "place"])
    return bound.select("spec_id", "ord", "side", "place", F.col("label").alias("number"), "rotation_deg"), state.where(F.col("issue").isNotNull()).select("spec_id", "issue")


def label_differences(pads: DataFrame, expected: DataFrame) -> DataFrame:
    """Places whose number differs from the source view: (spec_id, side, place, expected, actual)."""
    key = ["spec_id", "side", "place"]
    a = perimeter_rows(pads).select(*key, F.coalesce("number", F.lit("")).alias("actual"))
    b = perimeter_rows(expected).select(*key, F.col("number").alias("expected"))
    return a.join(b, key).where(F.col("actual") != F.col("expected"))
