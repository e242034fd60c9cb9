"""Component families: contracts, taxonomy, derived parameters, dimension chains, plans.

Rules are data: a family, a code, the parameters a rule needs and a boolean in SQL over one wide row per
document. All rules of an operator are evaluated in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from .ordering import previous_row

GULLWING, QUAD, QFN = "ic/gullwing_ic", "ic/quad_gullwing_ic", "ic/qfn_ufqfpn"
DSUB, RESISTOR, CAPACITOR = "connector/cn/dsub_connector", "resistor/two_terminal_chip", "capacitor/two_terminal_chip"

# Parameters of the two rows of a gullwing package
ROW_COUNTS = ("negative_side_pin_count", "positive_side_pin_count")
ROW_SPANS = ("negative_side_pin_span", "positive_side_pin_span")
ROW_WIDTHS = ("negative_side_terminal_width", "positive_side_terminal_width")
ROW_LENGTHS = ("negative_side_terminal_length", "positive_side_terminal_length")
ROW_THICKNESSES = ("negative_side_terminal_thickness", "positive_side_terminal_thickness")
ROWS = ROW_COUNTS + ROW_SPANS

# Required parameters
REQUIRED = {
    GULLWING: ("nominal_pin_count", "terminal_pitch", "pin_span", "total_height", "housing_height", "body_standoff",
               "overall_width", "body_width", "body_length", "terminal_length", "terminal_thickness", "terminal_width"),
    QUAD: ("nominal_pin_count", "total_height", "housing_height", "body_standoff", "overall_length", "overall_width",
           "body_length", "body_width", "terminal_span", "terminal_pitch", "terminal_length", "lead_projection",
           "terminal_width", "terminal_thickness"),
    QFN: ("nominal_pin_count", "body_length", "body_width", "total_height", "body_standoff", "terminal_pitch",
          "terminal_length", "terminal_width", "terminal_height"),
    RESISTOR: ("body_length", "body_width", "body_height", "terminal_length"),
    CAPACITOR: ("body_length", "body_width", "body_height", "terminal_length"),
    DSUB: ("circuit_count", "overall_width", "front_plate_height", "plate_thickness", "front_shell_top_width",
           "front_shell_bottom_width", "front_shell_height", "front_projection_depth", "shell_wall_thickness",
           "mounting_center_span", "mounting_hole_diameter", "mounting_outer_diameter", "rear_housing_width",
           "rear_body_depth", "rear_housing_height", "contact_pitch", "contact_column_span", "contact_row_spacing",
           "contact_outer_diameter", "contact_inner_diameter", "signal_pin_width", "pin_tail_length", "overall_height"),
}
# Optional parameters and features
OPTIONAL = {
    GULLWING: ("mold_draft_angle_top_deg", "mold_draft_angle_bottom_deg", "lead_angle_deg", *ROWS, *ROW_WIDTHS,
               *ROW_LENGTHS, *ROW_THICKNESSES),
    QFN: ("exposed_pad_length", "exposed_pad_width"),
}
FEATURES = {
    GULLWING: ("molded_body", "gullwing_lead", "two_side_lead_array"),
    QUAD: ("molded_body", "gullwing_lead", "four_side_lead_array"),
    QFN: ("molded_body", "no_lead_terminal", "four_side_terminal_array"),
    RESISTOR: ("chip_body", "end_cap_pair"), CAPACITOR: ("chip_body", "end_cap_pair"),
    DSUB: ("front_metal_shell", "mounting_flange", "rear_insulator_housing", "female_contact_array", "right_angle_leads",
           "mounting_hardware"),
}
# Fields a view of a gullwing drawing may supply
GULLWING_VIEWS = {
    "top": ("nominal_pin_count", "terminal_pitch", "pin_span", "overall_width", "body_width", "body_length", *ROWS, *ROW_WIDTHS),
    "front": ("nominal_pin_count", "total_height", "housing_height", "body_standoff", "terminal_pitch", "terminal_width",
              "terminal_thickness"),
    "side": (*ROW_LENGTHS, *ROW_THICKNESSES, "total_height", "housing_height", "body_standoff", "terminal_length",
             "terminal_thickness", "mold_draft_angle_top_deg", "mold_draft_angle_bottom_deg", "lead_angle_deg"),
    "detail": (*ROW_LENGTHS, *ROW_THICKNESSES, "terminal_length", "terminal_thickness", "terminal_width",
               "mold_draft_angle_top_deg", "mold_draft_angle_bottom_deg", "lead_angle_deg"),
}
# Fields by view for the families without groups of their own
COMMON_VIEWS = {
    "top": ("nominal_pin_count", "terminal_pitch", "pin_span", "overall_length", "overall_width", "body_length", "body_width",
            "terminal_span", "terminal_length", "lead_projection", "terminal_width", "terminal_thickness",
            "mold_draft_angle_top_deg", "mold_draft_angle_bottom_deg", "lead_angle_deg"),
    "front": ("circuit_count", "overall_width", "front_plate_height", "front_shell_top_width", "front_shell_bottom_width",
              "front_shell_height", "mounting_center_span", "mounting_hole_diameter", "mounting_outer_diameter",
              "contact_pitch", "contact_column_span", "contact_row_spacing", "contact_outer_diameter", "contact_inner_diameter"),
    "side": ("plate_thickness", "front_projection_depth", "shell_wall_thickness", "rear_body_depth", "rear_housing_height",
             "signal_pin_width", "pin_tail_length", "overall_height", "total_height", "housing_height", "body_standoff",
             "terminal_length", "terminal_thickness", "lead_projection", "lead_angle_deg", "mold_draft_angle_top_deg",
             "mold_draft_angle_bottom_deg"),
    "pcb": ("circuit_count", "contact_pitch", "contact_column_span", "contact_row_spacing", "signal_pin_width",
            "mounting_center_span", "mounting_hole_diameter"),
}
# Taxonomy (category, subcategory) and earlier names
LOCATIONS = {
    RESISTOR: ("resistor", None), CAPACITOR: ("capacitor", None), "inductor": ("inductor", None), "diode": ("diode", None),
    "transistor": ("transistor", None), DSUB: ("connector", "cn"), "connector/cn/pin_header": ("connector", "cn"),
    "connector/mt": ("connector", "mt"), GULLWING: ("ic", None), QUAD: ("ic", None), QFN: ("ic", None), "misc": ("misc", None),
}
CATEGORIES = ("resistor", "capacitor", "inductor", "diode", "transistor", "connector", "ic", "misc")
ALIASES = {"gullwing_ic": GULLWING, "quad_gullwing_ic": QUAD, "dsub_connector": DSUB, "pin_header": "connector/cn/pin_header",
           "ufqfpn": QFN, "ic/ufqfpn": QFN}
RESISTOR_WORDS, CAPACITOR_WORDS = r"(?i)\bresistors?\b|电阻", r"(?i)\bcapacitors?\b|\bmlcc\b|电容"
GULLWING_WORDS = r"(?i)\b(?:SOT\s*[-–—]?\s*\d+|SOIC|TSSOP|SSOP|MSOP)\b|small\s+outline\s+transistor|gull\s*wing"
QUAD_WORDS = r"(?i)\b(?:L?QFP|TQFP)\s*\d*\b|quad\s+flat\s+package"
QFN_WORDS = r"(?i)\b(?:U?F?QFPN|QFN|UQFNP)(?:\s*[-–—]?\s*\d+)?\b"
COUNT_WORDS = r"(?i)\b(\d{1,3})\s*[-–—]?\s*(?:lead|pin|circuit)s?\b"
SOT_NAME = r"(?i)^SOT\b|^SOT\d"
# Symbols of a no-lead package table
TABLE_SYMBOLS = {"A": "total_height", "A1": "body_standoff", "A3": "terminal_height", "B": "terminal_width", "b": "terminal_width",
                 "D": "body_length", "E": "body_width", "e": "terminal_pitch", "D2": "exposed_pad_length",
                 "E2": "exposed_pad_width", "L": "terminal_length", "L2": "terminal_length"}

_any_row = "(" + " OR ".join(f"{n} IS NOT NULL" for n in ROWS) + ")"
_all_rows = "(" + " AND ".join(f"{n} IS NOT NULL" for n in ROWS) + ")"
_half = "floor(nominal_pin_count / 2)"
_even_span = f"(({_half} - 1) * terminal_pitch)"


def _row(side: str) -> dict[str, str]:
    n = f"CASE WHEN {_any_row} THEN {side}_side_pin_count ELSE {_half} END"
    s = f"CASE WHEN {_any_row} THEN {side}_side_pin_span ELSE {_even_span} END"
    w = f"coalesce({side}_side_terminal_width, terminal_width)"
    step = f"(({s}) / (({n}) - 1))"
    return {"n": f"({n})", "s": f"({s})", "w": w, "step": step}


def _row_rules(side: str) -> list[tuple[str, str]]:
    r = _row(side)
    times = f"round({r['step']} / terminal_pitch)"
    return [(f"{side}_side_pin_span:single", f"{r['n']} = 1 AND abs({r['s']}) > 1e-9"),
            (f"{side}_side_pin_span:multiple",
             f"{r['n']} > 1 AND ({times} < 1 OR abs({r['step']} - {times} * terminal_pitch) > 0.05)")]


def _envelope_rules(side: str) -> list[tuple[str, str]]:
    r = _row(side)
    return [(f"{side}_side_terminal_width:gap", f"{r['n']} > 1 AND {r['w']} >= {r['step']} - 1e-9"),
            (f"{side}_side_terminal_width:body_length", f"body_length IS NOT NULL AND {r['s']} + {r['w']} > body_length + 0.05")]


# Ordered: the first rule that holds is the issue of the layout.
ROW_LAYOUT_RULES = [
    ("nominal_pin_count:range", "nominal_pin_count <> floor(nominal_pin_count) OR nominal_pin_count < 2 OR nominal_pin_count > 1000"),
    ("pin_span/terminal_pitch", "terminal_pitch <= 0 OR pin_span < 0"),
    ("rows:missing", f"{_any_row} AND NOT {_all_rows}"),
    ("rows:counts", " OR ".join(f"({n} IS NOT NULL AND ({n} <> floor({n}) OR {n} < 1))" for n in ROW_COUNTS)),
    ("rows:sum", f"{_all_rows} AND negative_side_pin_count + positive_side_pin_count <> nominal_pin_count"),
    ("rows:negative_span", "negative_side_pin_span < 0 OR positive_side_pin_span < 0"),
    ("rows:largest_span", f"{_all_rows} AND abs(greatest(negative_side_pin_span, positive_side_pin_span) - pin_span) > 0.05"),
    ("rows:odd", f"NOT {_any_row} AND nominal_pin_count % 2 <> 0"),
    ("pin_span:pitch", f"NOT {_any_row} AND abs(pin_span - {_even_span}) > 0.05"),
    *_row_rules("negative"), *_row_rules("positive"),
]
WIDTH_RULES = [
    ("widths:missing", "(negative_side_terminal_width IS NULL) <> (positive_side_terminal_width IS NULL)"),
    ("widths:positive", "negative_side_terminal_width <= 0 OR positive_side_terminal_width <= 0 OR (negative_side_terminal_width IS NULL AND terminal_width <= 0)"),
    *_envelope_rules("negative"), *_envelope_rules("positive"),
]
_reach = "(overall_width - body_width) / 2"


def _profile(side: str) -> str:
    t = f"coalesce({side}_side_terminal_thickness, terminal_thickness)"
    length = f"{side}_side_terminal_length"
    return (f"(negative_side_terminal_length IS NOT NULL AND positive_side_terminal_length IS NOT NULL AND terminal_thickness IS NOT NULL AND "
            f"({length} <= {t} OR {length} >= {_reach} + least(0.03, {t} * 0.2)))")


PROFILE_RULES = [(f"{side}_side_terminal_length:profile", _profile(side)) for side in ("negative", "positive")]


def _first(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{code}'" for code, cond in rules) + " END"


# Dimension chains: (family or None, code, needed parameters, condition of the conflict)
_gull = ("nominal_pin_count", "terminal_pitch", "pin_span", "total_height", "housing_height", "body_standoff", "overall_width", "body_width")
_quad = ("nominal_pin_count", "terminal_pitch", "terminal_span", "total_height", "housing_height", "body_standoff", "overall_length",
         "overall_width", "body_length", "body_width", "terminal_length", "lead_projection")
_qfn = REQUIRED[QFN]
_whole = "abs(round(nominal_pin_count) - nominal_pin_count) <= 1e-9 AND round(nominal_pin_count) >= 3"
_laid = f"{_whole} AND ((round(nominal_pin_count) % 2 = 0 AND NOT {_any_row}) OR {_all_rows})"
CHAIN_RULES = [
    *[(None, f"{a}>={b}", (a, b), f"{a} >= {b}") for a, b in (
        ("front_shell_top_width", "overall_width"), ("front_shell_bottom_width", "overall_width"),
        ("rear_housing_width", "overall_width"), ("contact_inner_diameter", "contact_outer_diameter"))],
    (None, "contact_column_span!=pitch*(row_count-1)", ("circuit_count", "contact_pitch", "contact_column_span"),
     "abs(greatest(0, floor((round(circuit_count) + 1) / 2) - 1) * contact_pitch - contact_column_span) > 0.10"),
    (GULLWING, "nominal_pin_count:not_integer_or_below_3", _gull, f"NOT ({_whole})"),
    (GULLWING, "row_layout", _gull, f"{_laid} AND coalesce({_first(ROW_LAYOUT_RULES)}, CASE WHEN terminal_width IS NOT NULL THEN {_first(WIDTH_RULES)} END, {_first(PROFILE_RULES)}) IS NOT NULL"),
    (GULLWING, "body_width>=overall_width", _gull, "body_width >= overall_width"),
    (GULLWING, "total_height!=housing_height+body_standoff", _gull, "abs(housing_height + body_standoff - total_height) > 0.05"),
    (GULLWING, "body_length<pin_span+terminal_width", (*_gull, "body_length", "terminal_width"),
     "NOT (negative_side_terminal_width IS NOT NULL AND positive_side_terminal_width IS NOT NULL) AND body_length + 0.05 < pin_span + terminal_width"),
    (QUAD, "nominal_pin_count:not_divisible_by_4", _quad, "round(nominal_pin_count) < 4 OR round(nominal_pin_count) % 4 <> 0"),
    (QUAD, "terminal_span!=pitch*(pins_per_side-1)", _quad,
     "round(nominal_pin_count) >= 4 AND round(nominal_pin_count) % 4 = 0 AND abs((floor(round(nominal_pin_count) / 4) - 1) * terminal_pitch - terminal_span) > 0.05"),
    (QUAD, "body_length>=overall_length", _quad, "body_length >= overall_length"),
    (QUAD, "body_width>=overall_width", _quad, "body_width >= overall_width"),
    (QUAD, "lead_projection!=half_overall_body_difference", _quad,
     "abs((overall_length - body_length) / 2 - lead_projection) > 0.05 OR abs((overall_width - body_width) / 2 - lead_projection) > 0.05"),
    (QUAD, "terminal_length:outside_lead_projection", _quad, "NOT (terminal_length > 0 AND terminal_length <= lead_projection)"),
    (QUAD, "housing_height+body_standoff>total_height", _quad, "housing_height + body_standoff > total_height + 0.05"),
    (QFN, "nominal_pin_count:not_divisible_by_4", _qfn, "round(nominal_pin_count) < 4 OR round(nominal_pin_count) % 4 <> 0"),
    (QFN, "body_standoff>=total_height", _qfn, "body_standoff >= total_height"),
    (QFN, "terminal_height>total_height", _qfn, "terminal_height > total_height"),
    (QFN, "exposed_pad_length>=body_length", (*_qfn, "exposed_pad_length"), "exposed_pad_length >= body_length"),
    (QFN, "exposed_pad_width>=body_width", (*_qfn, "exposed_pad_width"), "exposed_pad_width >= body_width"),
    *[(f, code, REQUIRED[RESISTOR], cond) for f in (RESISTOR, CAPACITOR) for code, cond in (
        ("2*terminal_length>=body_length", "terminal_length * 2 >= body_length"),
        ("two_terminal_chip:non_positive_dimension", "least(body_length, body_width, body_height, terminal_length) <= 0"))],
]
# Relations counted as checked: (family or None, needed parameters, number)
CHECKED = [*[(None, (a, b), 1) for a, b in (
    ("front_shell_top_width", "overall_width"), ("front_shell_bottom_width", "overall_width"),
    ("rear_housing_width", "overall_width"), ("contact_inner_diameter", "contact_outer_diameter"))],
    (None, ("circuit_count", "contact_pitch", "contact_column_span"), 1), (GULLWING, _gull, 3),
    (GULLWING, (*_gull, "body_length", "terminal_width"), 1), (QUAD, _quad, 6), (QFN, _qfn, 3),
    (RESISTOR, REQUIRED[RESISTOR], 2), (CAPACITOR, REQUIRED[CAPACITOR], 2)]
PARAMETERS = tuple(dict.fromkeys([n for names in (*REQUIRED.values(), *OPTIONAL.values()) for n in names]))

# Derivations: (family, parameter, unit, formula, sources, guard, value). Explicit parameters are never replaced.
_square = "abs(body_length - body_width) <= 0.05"
_length, _width = "coalesce(overall_length, CASE WHEN {s} THEN overall_width END)", "coalesce(overall_width, CASE WHEN {s} THEN overall_length END)"
_length, _width = _length.format(s=_square), _width.format(s=_square)
_no_rows = "NOT " + _any_row
DERIVATIONS = [
    (GULLWING, "nominal_pin_count", "count", "negative_side_pin_count+positive_side_pin_count", ROW_COUNTS, "true",
     "negative_side_pin_count + positive_side_pin_count"),
    *[(GULLWING, name, "mm", f"legacy_default_from_{pair[0]}", (pair[0],), f"{pair[1]} IS NOT NULL", pair[0])
      for name, pair in (("terminal_width", ROW_WIDTHS), ("terminal_length", ROW_LENGTHS), ("terminal_thickness", ROW_THICKNESSES))],
    (GULLWING, "pin_span", "mm", "max(negative_side_pin_span,positive_side_pin_span)", ROW_SPANS, "true",
     "greatest(negative_side_pin_span, positive_side_pin_span)"),
    (GULLWING, "pin_span", "mm", "(nominal_pin_count/2-1)*terminal_pitch", ("nominal_pin_count", "terminal_pitch"),
     f"{_no_rows} AND round(nominal_pin_count) >= 4 AND round(nominal_pin_count) % 2 = 0 AND abs(nominal_pin_count - round(nominal_pin_count)) <= 1e-9 AND NOT is_sot",
     "(floor(round(nominal_pin_count) / 2) - 1) * terminal_pitch"),
    *[(f, "housing_height", "mm", "total_height-body_standoff", ("total_height", "body_standoff"), "true", "total_height - body_standoff")
      for f in (GULLWING, QUAD)],
    (QUAD, "overall_length", "mm", "square_package_symmetry", ("overall_width",), _square, "overall_width"),
    (QUAD, "overall_width", "mm", "square_package_symmetry", ("overall_length",), _square, "overall_length"),
    (QUAD, "terminal_pitch", "mm", "terminal_span/(nominal_pin_count/4-1)", ("nominal_pin_count", "terminal_span"),
     "floor(round(nominal_pin_count) / 4) > 1", "terminal_span / (floor(round(nominal_pin_count) / 4) - 1)"),
    (QUAD, "lead_projection", "mm", "mean((overall_length-body_length)/2,(overall_width-body_width)/2)",
     ("overall_length", "body_length", "overall_width", "body_width"),
     f"abs(({_length} - body_length) / 2 - ({_width} - body_width) / 2) <= 0.05",
     f"(({_length} - body_length) / 2 + ({_width} - body_width) / 2) / 2"),
]
TITLE_SIZE, TITLE_PITCH = r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*mm", r"(?i)(\d+(?:\.\d+)?)\s*mm\s*pitch"


# --- shape changes -----------------------------------------------------------------------------------------------------
def wide(params: DataFrame, names: tuple[str, ...] = PARAMETERS) -> DataFrame:
    """One row per document with a column per parameter; null where it is absent."""
    return params.groupBy("doc_id", "family_id").agg(
        *[F.max(F.when(F.col("canonical_name") == n, F.col("value"))).alias(n) for n in names])


def contracts(spark: SparkSession) -> DataFrame:
    """(family_id, field, kind): a fixed table of about a hundred rows."""
    rows = [(f, n, k) for k, table in (("required", REQUIRED), ("optional", OPTIONAL), ("feature", FEATURES))
            for f, names in table.items() for n in names]
    return spark.createDataFrame(rows, "family_id string, field string, kind string")


def _needs(family: str | None, needed: tuple[str, ...]) -> str:
    parts = [f"{n} IS NOT NULL" for n in dict.fromkeys(needed)]
    if family:
        parts.insert(0, f"family_id = '{family}'")
    return "(" + " AND ".join(parts) + ")"


def chain_conflicts(params: DataFrame) -> DataFrame:
    """Conflicting relations of every document, one row each."""
    rows = [F.expr(f"CASE WHEN {_needs(f, needed)} AND ({cond}) THEN '{code}' END") for f, code, needed, cond in CHAIN_RULES]
    return wide(params).select("doc_id", "family_id", F.explode(F.array_compact(F.array(*rows))).alias("conflict"))


def checked_relations(params: DataFrame) -> DataFrame:
    total = " + ".join(f"CASE WHEN {_needs(f, needed)} THEN {n} ELSE 0 END" for f, needed, n in CHECKED)
    return wide(params).select("doc_id", "family_id", F.expr(total).alias("checked"))


def row_layout_issues(layouts: DataFrame) -> DataFrame:
    """First issue of a two-row layout given as a wide row, or null."""
    issue = f"coalesce({_first(ROW_LAYOUT_RULES)}, CASE WHEN coalesce(terminal_width, negative_side_terminal_width) IS NOT NULL THEN {_first(WIDTH_RULES)} END)"
    return layouts.withColumn("issue", F.expr(issue))


def row_positions(layouts: DataFrame) -> DataFrame:
    """Positions of the leads along both rows of every valid layout; a row has at most 1000 leads."""
    valid = row_layout_issues(layouts).where("issue IS NULL")
    sides = []
    for side, sign in (("negative", -1), ("positive", 1)):
        r = _row(side)
        sides.append(F.struct(F.lit(sign).alias("side"), F.expr(f"CAST({r['n']} AS INT)").alias("n"), F.expr(f"CAST({r['s']} AS DOUBLE)").alias("s")))
    rows = valid.select("doc_id", F.explode(F.array(*sides)).alias("_r")).select("doc_id", "_r.side", "_r.n", "_r.s")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    at = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(-F.col("s") / 2 + F.col("i") * F.col("s") / (F.col("n") - 1))
    return rows.select("doc_id", "side", "i", at.alias("x"))


# --- derivations ---------------------------------------------------------------------------------------------------------
def derived_values(params: DataFrame, docs: DataFrame) -> DataFrame:
    """Derived parameters (doc_id, family_id, canonical_name, value, unit, formula, sources).

    docs(doc_id, package_type). Titles of no-lead packages are read from the raw texts of the pin count.
    """
    base = wide(params).join(docs.select("doc_id", F.col("package_type").rlike(SOT_NAME).alias("is_sot")), "doc_id", "left")
    base = base.fillna(False, ["is_sot"])
    rows = []
    for family, name, unit, formula, sources, guard, value in DERIVATIONS:
        needed = [n for n in sources if not (formula.startswith("mean(") and n.startswith("overall_"))]
        present = " AND ".join(f"{n} IS NOT NULL" for n in needed)
        # The copied side of a square package feeds the projection, so the guard there may use either side.
        listed = ", ".join(f"'{n}'" for n in sources)
        rows.append(f"CASE WHEN family_id = '{family}' AND {name} IS NULL AND {present} AND ({guard}) THEN named_struct('canonical_name', '{name}', "
                    f"'value', CAST({value} AS DOUBLE), 'unit', '{unit}', 'formula', '{formula}', 'sources', array({listed})) END")
    found = base.select("doc_id", "family_id", F.explode(F.array_compact(F.array(*[F.expr(r) for r in rows]))).alias("_d"))
    found = found.select("doc_id", "family_id", "_d.*")
    titles = params.where((F.col("family_id") == QFN) & (F.col("canonical_name") == "nominal_pin_count"))
    text = F.concat_ws(" ", "raw_texts")

    def title(name, pattern, group, formula):
        value = F.regexp_extract(text, pattern, group).try_cast("double")
        return F.when(value.isNotNull(), F.struct(
            F.lit(name).alias("canonical_name"), value.alias("value"), F.lit("mm").alias("unit"), F.lit(formula).alias("formula"),
            F.array(F.lit("nominal_pin_count")).alias("sources")))
    read = F.array_compact(F.array(title("body_length", TITLE_SIZE, 1, "package_title_length"), title("body_width", TITLE_SIZE, 2, "package_title_width"),
                                   title("terminal_pitch", TITLE_PITCH, 1, "package_title_pitch")))
    read = titles.select("doc_id", "family_id", F.explode(read).alias("_d")).select("doc_id", "family_id", "_d.*")
    explicit = params.select("doc_id", "canonical_name").distinct()
    return found.unionByName(read.join(explicit, ["doc_id", "canonical_name"], "left_anti"))


def derive_parameters(params: DataFrame, docs: DataFrame) -> DataFrame:
    """Parameters plus the derived ones, which carry the merged evidence of their sources.

    params(doc_id, family_id, canonical_name, value, unit, ocr_confidence, semantic_confidence, evidence_kind,
    evidence_ids, token_ids, raw_texts).
    """
    key = ["doc_id", "family_id", "canonical_name"]
    derived = derived_values(params, docs)
    used = derived.select(*key, F.posexplode("sources").alias("_pos", "_source"))
    facts = params.select("doc_id", F.col("canonical_name").alias("_source"), "evidence_ids", "token_ids", "raw_texts",
                          F.when(F.col("evidence_kind") != "human_input", F.col("ocr_confidence")).alias("_ocr"),
                          F.when(F.col("evidence_kind") != "human_input", F.col("semantic_confidence")).alias("_sem"))
    # A derivation has at most four sources.
    parts = used.join(facts, ["doc_id", "_source"]).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "evidence_ids", "token_ids", "raw_texts"))).alias("_p"),
        F.coalesce(F.min("_ocr"), F.lit(0.0)).alias("ocr_confidence"), F.coalesce(F.min("_sem"), F.lit(0.0)).alias("semantic_confidence"))
    merged = parts.select(*key, "ocr_confidence", "semantic_confidence",
                          *[F.array_distinct(F.flatten(F.col(f"_p.{c}"))).alias(c) for c in ("evidence_ids", "token_ids")],
                          F.flatten("_p.raw_texts").alias("raw_texts"))
    rows = derived.join(merged, key).select(
        *key, "value", "unit", "ocr_confidence", "semantic_confidence", F.lit("derived").alias("evidence_kind"), "evidence_ids", "token_ids",
        F.array_append("raw_texts", F.concat(F.lit("derived:"), "formula")).alias("raw_texts"))
    return params.select(rows.columns).unionByName(rows)


def override_parameters(params: DataFrame, answers: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operator values replace their fields, derived rows are dropped and derived again; also the rows they replaced.

    answers(doc_id, family_id, canonical_name, value, unit, question_id).
    """
    key = ["doc_id", "canonical_name"]
    touched = answers.select("doc_id").distinct()
    superseded = params.join(answers.select(*key), key, "left_semi")
    derived = F.col("evidence_kind") == "derived"
    kept = params.join(answers.select(*key), key, "left_anti").join(touched.withColumn("_t", F.lit(True)), "doc_id", "left")
    kept = kept.where(F.col("_t").isNull() | ~derived).drop("_t")
    texts = F.array(F.concat(F.lit("operator supplied "), "canonical_name", F.lit("="), F.col("value").cast("string"), F.lit(" "), "unit"))
    none = F.array().cast("array<string>")
    rows = answers.select(
        "doc_id", "family_id", "canonical_name", "value", "unit", F.lit(0.0).alias("ocr_confidence"), F.lit(0.0).alias("semantic_confidence"),
        F.lit("human_input").alias("evidence_kind"),
        F.array(F.concat_ws(":", F.lit("human_input"), "question_id", "canonical_name")).alias("evidence_ids"), none.alias("token_ids"), texts.alias("raw_texts"))
    return derive_parameters(kept.select(rows.columns).unionByName(rows), docs), superseded


def cleared_issues(issues: DataFrame, answers: DataFrame, params: DataFrame) -> DataFrame:
    """Issues left after operator values: those naming a replaced or a dropped derived field are gone.

    issues(doc_id, kind, field); a conflict names its fields inside a longer text.
    """
    touched = answers.select("doc_id").distinct()
    fields = answers.select("doc_id", "canonical_name").unionByName(
        params.where(F.col("evidence_kind") == "derived").join(touched, "doc_id", "left_semi").select("doc_id", "canonical_name"))
    # The fields of a document come from a closed contract.
    named = fields.groupBy("doc_id").agg(F.collect_set("canonical_name").alias("_names"))
    joined = issues.join(named, "doc_id", "left")
    word = F.exists("_names", lambda n: F.regexp_like(F.col("field"), F.concat(F.lit("(^|[^A-Za-z0-9_])"), n, F.lit("([^A-Za-z0-9_]|$)"))))
    hit = F.when(F.col("kind") == "conflict", word).otherwise(F.array_contains("_names", F.col("field")))
    return joined.where(~F.coalesce(hit, F.lit(False))).drop("_names")


# --- taxonomy ---------------------------------------------------------------------------------------------------------------
def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def resolve_family(rows: DataFrame) -> DataFrame:
    """Registered family, category and status of a selection.

    rows(doc_id, family_id, category_id, subcategory_id, identity_text).
    """
    raw = F.trim(F.coalesce("family_id", F.lit("")))
    category = F.lower(F.trim(F.coalesce("category_id", F.lit(""))))
    sub = F.nullif(F.lower(F.trim(F.coalesce("subcategory_id", F.lit("")))), F.lit(""))
    text = F.coalesce("identity_text", F.lit(""))
    resistor = (category == "resistor") | text.rlike(RESISTOR_WORDS)
    capacitor = (category == "capacitor") | text.rlike(CAPACITOR_WORDS)
    chip = raw == "two_terminal_chip"
    family = (F.when(chip & resistor & ~capacitor, RESISTOR).when(chip & capacitor & ~resistor, CAPACITOR)
              .when(chip, F.lit(None).cast("string")).otherwise(F.coalesce(_lookup(ALIASES, raw), raw)))
    places = {f: c for f, (c, _) in LOCATIONS.items()}
    subs = {f: s for f, (_, s) in LOCATIONS.items() if s}
    staged = rows.withColumns({"_f": family, "_c": category, "_s": sub}).withColumns(
        {"_fc": _lookup(places, F.col("_f")), "_fs": _lookup(subs, F.col("_f"))})
    f, c, s, fc, fs = (F.col(x) for x in ("_f", "_c", "_s", "_fc", "_fs"))
    status = (F.when(f.isNull(), "needs_human_follow_up")
              .when((f != "") & fc.isNull(), "stopped_unsupported_template")
              .when((f != "") & (c != "") & (c != fc), "invalid_hierarchy")
              .when((f != "") & s.isNotNull() & ~F.coalesce(s == fs, F.lit(False)), "invalid_hierarchy")
              .when(f != "", "resolved").when(~c.isin(*CATEGORIES), "stopped_unsupported_template")
              .when((c == "connector") & ~F.coalesce(s.isin("cn", "mt"), F.lit(False)), "needs_human_follow_up")
              .otherwise("stopped_unsupported_template"))
    staged = staged.withColumn("status", status)
    ok = F.col("status") == "resolved"
    keeps_place = ok | ((F.col("status") == "invalid_hierarchy") & ((c == "") | (c == fc)))
    return staged.select(
        "doc_id", "status", F.when(ok, f).otherwise("").alias("family_id"), F.when(keeps_place, fc).otherwise(c).alias("category_id"),
        F.when(ok, fs).when((f == "") & (c == "connector") & ~F.coalesce(s.isin("cn", "mt"), F.lit(False)), F.lit(None).cast("string")).otherwise(s).alias("subcategory_id"))


def text_signature(tokens: DataFrame, bucket: Column | None = None, confidence: float = 0.80) -> DataFrame:
    """Family evidence in the reliable texts of a document. A phrase may run over three neighbouring tokens."""
    sure = tokens.where(F.col("confidence") >= confidence).select("doc_id", "ord", "text")
    order = [F.col("ord")]
    sure = previous_row(sure, ["doc_id"], order, bucket, {"_b1": F.col("text")})
    sure = previous_row(sure, ["doc_id"], order, bucket, {"_b2": F.col("_b1")})
    run = F.concat_ws(" \n ", "_b2", "_b1", "text")
    symbol = F.upper(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    counts = F.array_max(F.transform(F.regexp_extract_all(run, F.lit(COUNT_WORDS), 1), lambda n: n.cast("int")))
    symbols = ("D2", "E2", "A3", "B", "L", "L2")
    docs = sure.groupBy("doc_id").agg(
        F.bool_or(run.rlike(QFN_WORDS)).alias("qfn_name"), F.bool_or(run.rlike(QUAD_WORDS)).alias("quad"),
        F.bool_or(run.rlike(GULLWING_WORDS)).alias("gullwing"), F.max(counts).alias("largest_count"),
        F.bool_or(run.rlike(RESISTOR_WORDS)).alias("resistor"), F.bool_or(run.rlike(CAPACITOR_WORDS)).alias("capacitor"),
        *[F.bool_or(symbol == s).alias(f"s_{s}") for s in symbols])
    extra = sum((F.col(f"s_{s}").cast("int") for s in symbols[2:]), F.lit(0))
    qfn = F.col("qfn_name") | (F.col("s_D2") & F.col("s_E2") & (extra >= 2))
    return docs.select("doc_id", qfn.alias("qfn"), "quad", "gullwing", "largest_count", "resistor", "capacitor")


def reconcile_family(classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Check a classification against the texts of its document; the confidence is capped by the outcome.

    classes(doc_id, family_id, category_id, subcategory_id, overall_confidence).
    """
    rows = classes.join(signatures, "doc_id", "left").fillna(False, ["qfn", "quad", "gullwing", "resistor", "capacitor"])
    words = F.concat_ws(" ", F.when(F.col("resistor"), "resistor"), F.when(F.col("capacitor"), "capacitor"))
    resolved = resolve_family(rows.withColumn("identity_text", words)).select(
        "doc_id", F.col("status").alias("_status"), F.col("family_id").alias("_family"), F.col("category_id").alias("_cat"))
    rows = rows.join(resolved, "doc_id")
    chip = F.col("family_id").isin("two_terminal_chip", RESISTOR, CAPACITOR)
    many = chip & (F.coalesce("largest_count", F.lit(0)) > 2)
    outcome = (F.when(F.col("qfn"), "qfn_text").when(F.col("quad"), "quad_text").when(many & F.col("gullwing"), "gullwing_text")
               .when(many, "terminal_conflict").otherwise(F.col("_status")))
    rows = rows.withColumn("outcome", outcome)
    o, conf = F.col("outcome"), F.col("overall_confidence")
    family = (F.when(o == "qfn_text", QFN).when(o == "quad_text", QUAD).when(o == "gullwing_text", GULLWING)
              .when(o == "resolved", F.col("_family")).otherwise(""))
    category = F.when(o.isin("qfn_text", "quad_text", "gullwing_text"), "ic").when(o == "terminal_conflict", F.col("category_id")).otherwise(F.col("_cat"))
    capped = (F.when(o.isin("qfn_text", "quad_text"), F.least(conf, F.lit(0.95))).when(o == "gullwing_text", F.least(conf, F.lit(0.90)))
              .when(o == "resolved", conf).otherwise(0.0))
    return rows.select("doc_id", "outcome", family.alias("family_id"), category.alias("category_id"), capped.alias("overall_confidence"))


# --- views and tables ---------------------------------------------------------------------------------------------------------
def view_fields(views: DataFrame) -> DataFrame:
    """Fields a view may supply: (doc_id, view_type, family_id, field, kind) for views(doc_id, view_type, family_id)."""
    spark = views.sparkSession
    table = contracts(spark).where("kind <> 'feature'")
    view = F.lower("view_type")

    def chosen(groups):
        pick = F.when(view.contains("dimension_table"), F.lit(None).cast("array<string>"))
        for key, names in groups.items():
            pick = pick.when(view.contains(key), F.array(*[F.lit(n) for n in names]))
        return pick
    own = chosen(GULLWING_VIEWS)
    # Families that share no field with the common groups keep their whole contract.
    common_all = {n for names in COMMON_VIEWS.values() for n in names}
    whole = [f for f, names in REQUIRED.items() if not common_all & set(names)]
    common = F.when(~F.col("family_id").isin(*whole), chosen(COMMON_VIEWS)) if whole else chosen(COMMON_VIEWS)
    fields = views.withColumn("_fields", F.when(F.col("family_id") == GULLWING, own).otherwise(common))
    out = fields.join(F.broadcast(table), "family_id")
    kept = out.where(F.col("_fields").isNull() | F.array_contains("_fields", F.col("field")))
    # The quad and no-lead contracts differ only for gullwing in listing optional fields per view.
    return kept.select("doc_id", "view_type", "family_id", "field", "kind")


def table_semantics(rows: DataFrame) -> DataFrame:
    """Fields of a no-lead package table by symbol; the surest label of a field wins, then the first row.

    rows(doc_id, ord, label_token, label, confidence, nom, max, min).
    """
    text = F.trim("label")
    symbol = F.when(text.isin("b", "e"), text).otherwise(F.upper(text))
    value = F.coalesce(F.nullif("nom", F.lit("")), F.nullif("max", F.lit("")), F.nullif("min", F.lit("")))
    named = rows.withColumns({"canonical_name": _lookup(TABLE_SYMBOLS, symbol), "value_token": value})
    named = named.where(F.col("canonical_name").isNotNull() & F.col("value_token").isNotNull())
    best = named.groupBy("doc_id", "canonical_name").agg(
        F.max_by(F.struct("label_token", "value_token"), F.struct(F.col("confidence"), (-F.col("ord")).alias("o"))).alias("_b"))
    return best.select("doc_id", "canonical_name", "_b.label_token", "_b.value_token", F.lit(0.99).alias("confidence"))


# Fixed pattern: a terminal count in a text that names the part
IDENTITY_COUNT = r"(?i)\b\d{1,3}\s*[-–—]?\s*(?:lead|pin)s?\b"


def package_semantics(rows: DataFrame, identity: DataFrame) -> DataFrame:
    """table_semantics and, from the first identity text that states one, the terminal count.

    identity(doc_id, ord, token_id, text): the tokens of identity texts in order.
    """
    stated = identity.where(F.col("text").rlike(IDENTITY_COUNT)).groupBy("doc_id").agg(F.min_by("token_id", "ord").alias("label_token"))
    counts = stated.select("doc_id", F.lit("nominal_pin_count").alias("canonical_name"), "label_token",
                           F.lit(None).cast("string").alias("value_token"), F.lit(0.99).alias("confidence"))
    return table_semantics(rows).unionByName(counts)


def unresolved_fields(docs: DataFrame, found: DataFrame, required: tuple[str, ...] = REQUIRED[QFN]) -> DataFrame:
    """Required fields no assignment names: (doc_id, field); found(doc_id, canonical_name)."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, required))).alias("field"))
    return wanted.join(found.select("doc_id", F.col("canonical_name").alias("field")), ["doc_id", "field"], "left_anti")


def corner_counts(numbers: DataFrame) -> DataFrame:
    """Largest multiple of four whose corner numbers appear at least four times among the numbers of a drawing.

    numbers(doc_id, number INT). Each candidate looks its eight corners up by a join, so the numbers of a
    document are never gathered.
    """
    known = numbers.select("doc_id", "number").distinct()
    n = F.col("number")
    candidates = known.where((n >= 4) & (n % 4 == 0))
    corners = F.array_distinct(F.transform(F.array(
        F.lit(1), n / 4, n / 4 + 1, n / 2, n / 2 + 1, 3 * n / 4, 3 * n / 4 + 1, n), lambda c: c.cast("int")))
    asked = candidates.select("doc_id", n.alias("candidate"), F.explode(corners).alias("number"))
    proven = asked.join(known, ["doc_id", "number"]).groupBy("doc_id", "candidate").agg(F.count("*").alias("hits")).where("hits >= 4")
    return proven.groupBy("doc_id").agg(F.max("candidate").alias("nominal_pin_count"))


# --- plans ------------------------------------------------------------------------------------------------------------------------
def plan_issues(params: DataFrame, docs: DataFrame) -> DataFrame:
    """Why a document cannot be planned: missing, untraceable, wrong unit, not positive, or an uneven count.

    params as for derive_parameters plus has_boxes; docs(doc_id, family_id).
    """
    spark = params.sparkSession
    needed = F.broadcast(contracts(spark).where("kind = 'required'").select("family_id", F.col("field").alias("canonical_name")))
    slots = docs.select("doc_id", "family_id").join(needed, "family_id")
    facts = params.select("doc_id", "canonical_name", "value", "unit", "evidence_ids", "has_boxes", F.lit(True).alias("_known"))
    rows = slots.join(facts, ["doc_id", "canonical_name"], "left")
    name, value = F.col("canonical_name"), F.col("value")
    unit = F.when(name.isin("nominal_pin_count", "circuit_count"), "count").otherwise("mm")
    human = F.forall("evidence_ids", lambda e: e.startswith("human_input:"))
    traced = (F.size("evidence_ids") > 0) & (F.col("has_boxes") | human)
    four = F.col("family_id").isin(QUAD, QFN) & (name == "nominal_pin_count")
    two = (F.col("family_id") == GULLWING) & (name == "nominal_pin_count")
    may_be_zero = (name == "body_standoff") & F.col("family_id").isin(GULLWING, QUAD)
    known = F.col("_known").isNotNull()
    bad_count = (four & ((F.round(value) < 4) | (F.round(value) % 4 != 0) | (F.abs(value - F.round(value)) > 1e-9))) | (
        two & ((F.round(value) < 3) | (F.abs(value - F.round(value)) > 1e-9)))
    signed = F.col("family_id") != DSUB
    issues = F.array_compact(F.array(
        F.when(~known, F.lit("missing")), F.when(known & ~F.coalesce(traced, F.lit(False)), F.lit("untraceable")),
        F.when(known & (F.col("unit") != unit), F.lit("unit")), F.when(known & bad_count, F.lit("count")),
        F.when(known & signed & F.when(may_be_zero, value < 0).otherwise(value <= 0), F.lit("not_positive"))))
    return rows.select("doc_id", "family_id", "canonical_name", F.explode(issues).alias("issue"))


def expected_geometry(params: DataFrame, docs: DataFrame) -> DataFrame:
    """Expected box, solids and faces of every document that can be planned."""
    good = docs.select("doc_id", "family_id").join(plan_issues(params, docs).select("doc_id").distinct(), "doc_id", "left_anti")
    w = wide(params).join(good, ["doc_id", "family_id"])
    f = F.col("family_id")
    chip = f.isin(RESISTOR, CAPACITOR)
    pads = (F.col("exposed_pad_length").isNotNull() & F.col("exposed_pad_width").isNotNull()).cast("int")
    count = F.round("nominal_pin_count").cast("int")
    exact = F.when(f.isin(GULLWING, QUAD), count + 1).when(f == QFN, count + 1 + pads)
    least = F.when(chip, 3).when(f == DSUB, F.round("circuit_count").cast("int") + 7).otherwise(exact)
    faces = F.when(chip, 18).when(f == DSUB, 50).when(f == QFN, least * 6).otherwise(least * 4)
    half_x = F.when(f == GULLWING, F.col("body_length")).when(f == QUAD, F.col("overall_length")).when(f == DSUB, F.col("overall_width")).otherwise(F.col("body_length")) / 2
    half_y = F.when(f.isin(GULLWING, QUAD), F.col("overall_width")).otherwise(F.col("body_width")) / 2
    top = (F.when(chip, F.col("body_height")).when(f == DSUB, F.col("overall_height"))
           .when(f == QUAD, F.col("housing_height") + F.col("body_standoff")).otherwise(F.col("total_height")))
    return w.select("doc_id", "family_id", exact.alias("solid_count"), least.alias("minimum_solid_count"), faces.alias("minimum_face_count"),
                    (-half_x).alias("xmin"), half_x.alias("xmax"),
                    F.when(f == DSUB, -F.col("front_projection_depth")).otherwise(-half_y).alias("ymin"),
                    F.when(f == DSUB, F.col("rear_body_depth")).otherwise(half_y).alias("ymax"), F.lit(0.0).alias("zmin"), top.alias("zmax"))


def contract_lists(spark: SparkSession, kind: str) -> DataFrame:
    """The names of one kind that the contract of a family asks for: (family_id, names ARRAY), one row per family."""
    return contracts(spark).where(F.col("kind") == kind).groupBy("family_id").agg(F.array_sort(F.collect_set("field")).alias("names"))


def gate_requirements(params: DataFrame, docs: DataFrame) -> DataFrame:
    """Required fields of a document (doc_id, fields ARRAY): the contract, and what its data makes necessary.

    docs(doc_id, family_id, package_type). Unequal or odd rows, and SOT names, ask for the rows of a gullwing
    package one by one. A document stays one row: its fields would be many times as many.
    """
    fixed = contract_lists(params.sparkSession, "required")
    name = F.col("canonical_name")
    seen = params.groupBy("doc_id").agg(
        F.max(F.when(name == "nominal_pin_count", F.col("value"))).alias("_n"),
        *[F.bool_or(name.isin(*names)).alias(a) for a, names in (
            ("_rows", ROWS), ("_widths", ROW_WIDTHS), ("_lengths", ROW_LENGTHS), ("_thick", ROW_THICKNESSES))])
    flags = docs.join(seen, "doc_id", "left").join(F.broadcast(fixed), "family_id", "left").fillna(False, ["_rows", "_widths", "_lengths", "_thick"])
    n = F.coalesce("_n", F.lit(0.0))
    sot = F.trim(F.coalesce("package_type", F.lit(""))).rlike(SOT_NAME)
    profile = F.col("_lengths") | F.col("_thick")
    odd = (n >= 3) & (n == F.floor(n)) & (n % 2 != 0)

    def fields(cond, names):
        return F.when(cond, F.array(*[F.lit(x) for x in names])).otherwise(F.array().cast("array<string>"))
    extra = F.concat(fields(sot | F.col("_rows") | F.col("_widths") | profile | odd, ROWS), fields(sot | F.col("_widths") | profile, ROW_WIDTHS),
                     fields(F.col("_lengths"), ROW_LENGTHS), fields(F.col("_thick"), ROW_THICKNESSES))
    none = F.array().cast("array<string>")
    return flags.select("doc_id", F.array_distinct(F.concat(F.coalesce("names", none), F.when(F.col("family_id") == GULLWING, extra).otherwise(none))).alias("fields"))
