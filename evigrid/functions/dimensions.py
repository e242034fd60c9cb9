"""Dimension texts of drawings: normalise once, then read quantity, unit, tolerance, range or value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import strip

# Fixed patterns and character folds
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
FOLD_FROM, FOLD_TO = ",Φ⌀＋－− ", ".ØØ+-- "
WORDS = r"(?i)\b(?:BSC|REF|MM|UNC|MIN|MAX|NOM|TYP)\b"
RADIUS = r"(?i)\bR\s*(\d)"
QUANTITY = r"(?i)^\s*(\d+)\s*[-×x]\s*[ØR.\d]"
SYMMETRIC = rf"({NUMBER})\s*±\s*({NUMBER})"
ASYMMETRIC = rf"({NUMBER})\s*\+\s*({NUMBER})\s*/\s*-\s*({NUMBER})"
RANGE = rf"(?i)^\s*({NUMBER})\s*(?:°|deg)?\s*[-–—]\s*({NUMBER})\s*(?:°|deg)?\s*$"
TABLE_CELL = rf"(?i)^\s*({NUMBER})(?:\s+({NUMBER}))?\s*(mm|BSC|REF)?\s*$"
COUNT_WORD = r"(?i)\b(\d{1,3})\s*[-–—]?\s*(?:lead|pin|circuit)s?\b"
COUNT_CODE = r"(?i)\b(?:[A-Z0-9]+-)+G(\d{1,3})\b"
# Worded confidences
WORDED_CONFIDENCE = {"high": 0.95, "medium": 0.70, "low": 0.40}

DIMENSION = ("nominal", "minimum", "maximum", "tolerance_plus", "tolerance_minus", "unit", "quantity", "symbol",
             "is_reference")


def _number(text: str | Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def with_dimensions(df: DataFrame, text: str = "text", table_cell: Column | None = None, columns: tuple[str, ...] = DIMENSION) -> DataFrame:
    """Add the DIMENSION columns (or those named) read from `text`; where `table_cell` holds a lone number may carry a lost tolerance.

    Text with any other letter reads as nothing; so does more than one parenthesised group. The columns leave as one row of a generator:
    a condition on one of them then stays above, where through the projections it would repeat the patterns many times over.
    """
    clean = F.translate(strip(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO)
    out = df.withColumn("_t", clean)
    left = F.regexp_replace(F.regexp_replace("_t", WORDS, ""), RADIUS, "$1")
    # Plain character tests come before the patterns: most texts hold no letters, brackets or signs.
    lettered = F.col("_t").rlike("[A-Za-z]")
    none = F.array().cast("array<string>")
    out = out.withColumn("_lettered", lettered).withColumns({
        "_words": F.col("_lettered") & left.rlike("[A-Za-z]"),
        "_groups": F.when(F.contains("_t", F.lit("(")), F.regexp_extract_all("_t", F.lit(r"\(([^()]*)\)"), 1)).otherwise(none)})
    inner = F.coalesce(F.try_element_at("_groups", F.lit(-1)), F.col("_t"))
    out = out.withColumns({
        "_v": F.when(F.col("_lettered"), strip(F.regexp_replace(inner, r"(?i)\bREF\b", ""))).otherwise(strip(inner)),
        "_void": F.col("_words") | (F.size("_groups") > 1)})
    v = F.col("_v")
    dash = v.contains("-") | v.contains("–") | v.contains("—")
    kind = (F.when(F.col("_void"), "none").when(v.contains("±") & v.rlike(SYMMETRIC), "symmetric")
            .when(v.contains("/") & v.rlike(ASYMMETRIC), "asymmetric").when(dash & v.rlike(RANGE), "range").when(F.regexp_count(v, F.lit(NUMBER)) == 1, "single").otherwise("none"))
    out = out.withColumn("_kind", kind)
    k = F.col("_kind")
    out = out.withColumns({
        "_n": F.when(k == "symmetric", _number(v, SYMMETRIC, 1)).when(k == "asymmetric", _number(v, ASYMMETRIC, 1))
        .when(k == "single", _number(v, f"({NUMBER})", 1)),
        "_p": F.when(k == "symmetric", F.abs(_number(v, SYMMETRIC, 2))).when(k == "asymmetric", F.abs(_number(v, ASYMMETRIC, 2))),
        "_m": F.when(k == "symmetric", -F.abs(_number(v, SYMMETRIC, 2))).when(k == "asymmetric", -F.abs(_number(v, ASYMMETRIC, 3))),
        "_a": F.when(k == "range", _number(v, RANGE, 1)), "_b": F.when(k == "range", _number(v, RANGE, 2))})
    words = F.col("_words")
    metric = (F.size("_groups") > 0) | (F.col("_lettered") & F.col("_t").rlike(r"(?i)\bmm\b"))
    angle = (k == "range") & F.col("_t").contains("°")
    out = out.withColumns({
        "nominal": F.col("_n"), "minimum": F.coalesce(F.least("_a", "_b"), F.col("_n") + F.col("_m")),
        "maximum": F.coalesce(F.greatest("_a", "_b"), F.col("_n") + F.col("_p")),
        "tolerance_plus": F.col("_p"), "tolerance_minus": F.col("_m"),
        "unit": F.when(words, "unknown").when(angle, "deg").when(metric, "mm").otherwise("unknown"),
        # a try_cast that fails raises and catches an exception, so texts without a quantity do not get there
        "quantity": F.when(~words & F.col("_t").rlike(QUANTITY), F.regexp_extract("_t", QUANTITY, 1).try_cast("int")),
        "symbol": F.when(words, "").when(F.col("_t").contains("Ø"), "Ø").when(F.col("_t").rlike(r"(?i)\bR\s*\d"), "R").otherwise(""),
        "is_reference": ~words & F.col("_t").rlike(r"(?i)\bREF\b")})
    if table_cell is not None:
        raw = F.translate(strip(F.coalesce(text, F.lit(""))), "−－", "--")
        hit = table_cell & F.col("nominal").isNull() & raw.rlike(TABLE_CELL)
        tail = F.lower(F.regexp_extract(raw, TABLE_CELL, 3))
        nothing = F.lit(None).cast("double")
        out = out.withColumn("_hit", hit).withColumns({
            "nominal": F.when(F.col("_hit"), _number(raw, TABLE_CELL, 1)).otherwise(F.col("nominal")),
            **{c: F.when(F.col("_hit"), nothing).otherwise(F.col(c)) for c in ("minimum", "maximum", "tolerance_plus", "tolerance_minus")},
            "unit": F.when(F.col("_hit"), F.when(tail == "mm", "mm").otherwise("unknown")).otherwise(F.col("unit")),
            "quantity": F.when(~F.col("_hit"), F.col("quantity")),
            "symbol": F.when(F.col("_hit"), "").otherwise(F.col("symbol")),
            "is_reference": F.when(F.col("_hit"), tail == "ref").otherwise(F.col("is_reference"))}).drop("_hit")
    return out.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def explicit_count(text: str | Column, low: int = 1, high: int = 512) -> Column:
    """Terminal count stated in words or in a package code."""
    col = strip(F.col(text) if isinstance(text, str) else text)
    first = F.when(~col.rlike("[A-Za-z]"), F.lit(None)).when(col.rlike(COUNT_WORD), F.regexp_extract(col, COUNT_WORD, 1)).when(col.rlike(COUNT_CODE), F.regexp_extract(col, COUNT_CODE, 1))
    # The filter reads the value once where a condition would repeat the patterns.
    return F.try_element_at(F.filter(F.array(first.try_cast("int")), lambda v: v.between(low, high)), F.lit(1))


def restored_box(polygon: str, rotation: str, width: str, height: str) -> Column:
    """Bounding box, in the unrotated image, of a polygon read in a rotated scan."""
    def point(p):
        x = F.when(F.col(rotation) == 90, p.y).when(F.col(rotation) == -90, F.col(width) - 1.0 - p.y).otherwise(p.x)
        y = F.when(F.col(rotation) == 90, F.col(height) - 1.0 - p.x).when(F.col(rotation) == -90, p.x).otherwise(p.y)
        return F.struct(x.alias("x"), y.alias("y"))
    points = F.transform(polygon, point)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(xs).cast("int").alias("x1"), F.array_min(ys).cast("int").alias("y1"),
                    F.array_max(xs).cast("int").alias("x2"), F.array_max(ys).cast("int").alias("y2"))


def confidence_number(value: str) -> Column:
    """Worded confidences as numbers; numeric text is kept."""
    worded = F.create_map(*[F.lit(x) for kv in WORDED_CONFIDENCE.items() for x in kv])
    return F.coalesce(F.try_element_at(worded, F.lower(value)), F.col(value).try_cast("double"))
