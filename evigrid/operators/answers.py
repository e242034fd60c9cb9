"""Supplied dimension answers: labelled slots in free text, units, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the fields
LABELS = {
    "positive_side_pin_count": ("上侧引脚数量", "上面引脚数量"),
    "negative_side_pin_count": ("下侧引脚数量", "下面引脚数量"),
    "positive_side_pin_span": ("上侧首末引脚中心距",),
    "negative_side_pin_span": ("下侧首末引脚中心距",),
    "positive_side_terminal_width": ("上侧引脚宽度",),
    "negative_side_terminal_width": ("下侧引脚宽度",),
    "positive_side_terminal_length": ("上侧引脚脚底长度",),
    "negative_side_terminal_length": ("下侧引脚脚底长度",),
    "positive_side_terminal_thickness": ("上侧引脚金属厚度",),
    "negative_side_terminal_thickness": ("下侧引脚金属厚度",),
    "nominal_pin_count": ("引脚数", "总引脚数", "pin count", "number of pins", "n-lead"),
    "terminal_pitch": ("引脚间距", "脚距", "pitch"),
    "pin_span": ("引脚跨距", "脚跨距", "lead span", "pin span"),
    "total_height": ("总高度", "整体高度", "overall height", "total height"),
    "housing_height": ("本体高度", "塑封本体高度", "package body height", "housing height"),
    "body_standoff": ("离板高度", "本体离板高度", "standoff"),
    "overall_width": ("总宽", "总体宽度", "整体宽度", "overall width"),
    "body_width": ("本体宽度", "塑封宽度", "body width"),
    "body_length": ("本体长度", "塑封长度", "body length"),
    "terminal_length": ("引脚长度", "脚长", "terminal length", "lead length"),
    "terminal_thickness": ("引脚厚度", "脚厚", "terminal thickness", "lead thickness"),
    "terminal_width": ("引脚宽度", "脚宽", "terminal width", "lead width"),
    "overall_length": ("总长度", "整体长度", "overall length"),
    "body_height": ("本体高度", "body height"),
    "lead_spacing": ("引脚间距", "脚距", "lead spacing"),
    "terminal_diameter": ("引脚直径", "脚径", "lead diameter"),
}
# units
TO_MM = {"mm": 1.0, "毫米": 1.0, "cm": 10.0, "厘米": 10.0, "um": 0.001, "μm": 0.001, "微米": 0.001, "mil": 0.0254,
         "mils": 0.0254, "in": 25.4, "inch": 25.4, "inches": 25.4, "英寸": 25.4, "": 1.0}
COUNT_UNITS = ("count", "pin", "pins", "个", "引脚", "")
ANGLE_UNITS = ("deg", "degree", "degrees", "度", "°", "")
#: Longest text of an answer
MAX_TEXT = 4000
MAY_BE_ZERO = ("negative_side_pin_span", "positive_side_pin_span")
# Fixed patterns: a number, a unit, and what joins a label to its value
NUMBER = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))"
UNIT = r"(mm|毫米|cm|厘米|um|μm|微米|mil|mils|inch|inches|in|英寸|deg|degree|degrees|度|pins?|个)?"
LINK = r"\s*(?:(?:[:=：])|(?:设定为|设为|等于|为|是|约))?\s*"


def expected_unit(field: str = "field") -> Column:
    col = F.col(field)
    return F.when(col.endswith("_count"), "count").when(col.endswith("_deg") | col.endswith("_angle"), "deg").otherwise("mm")


def normalise_values(rows: DataFrame) -> DataFrame:
    """Values in the unit of their field, or the reason for refusing them: (…, value, unit, issue).

    rows(…, field, value DOUBLE, unit).
    """
    target = expected_unit()
    unit = F.lower(F.trim(F.coalesce(F.nullif("unit", F.lit("")), target)))
    factors = F.create_map(*[F.lit(x) for kv in TO_MM.items() for x in kv])
    staged = rows.withColumns({"_target": target, "_unit": unit}).withColumn("_factor", F.try_element_at(factors, F.col("_unit")))
    t, v, mm = F.col("_target"), F.col("value"), F.col("value") * F.col("_factor")
    zero_ok = F.col("field").isin(*MAY_BE_ZERO) & (mm == 0)
    issue = (F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "not_a_number")
             .when(t == "count", F.when(~F.col("_unit").isin(*COUNT_UNITS), "unit").when(~v.between(1, 1000) | (v != F.floor(v)), "bounds"))
             .when(t == "deg", F.when(~F.col("_unit").isin(*ANGLE_UNITS), "unit").when(~((v >= 0) & (v < 90)), "bounds"))
             .when(F.col("_factor").isNull(), "unit").when(~zero_ok & ~((mm > 0) & (mm <= 1000)), "bounds"))
    out = staged.withColumn("issue", issue)
    value = F.when(F.col("issue").isNull(), F.when(t == "mm", mm).otherwise(v))
    return out.withColumns({"value": value, "unit": t}).drop("_target", "_unit", "_factor")


def _pattern(alias: Column) -> Column:
    guard = F.when(alias.rlike("[A-Za-z0-9_]"), F.lit("(?<![A-Za-z0-9_])")).otherwise(F.lit(""))
    quoted = F.regexp_replace(alias, r"([^\p{L}\p{N}_ ])", r"\\$1")
    return F.concat(F.lit("(?i)"), guard, quoted, F.lit(LINK + NUMBER + r"\s*" + UNIT))


def _asked(requests: DataFrame) -> DataFrame:
    """(doc_id, _asked): fields are names of a fixed list, so the array of a document is bounded."""
    return requests.where(F.col("field").isNotNull()).groupBy("doc_id").agg(F.collect_set("field").alias("_asked"))


def _text_slots(rows: DataFrame) -> DataFrame:
    """Slots read from rows(doc_id, text, _asked, _given): fields given otherwise are not read, but their labels count as theirs.

    Every text is read where it stands, against the labels of its own fields, a literal test before each pattern; what
    moves afterwards are the few slots found.
    """
    labels = F.create_map(*[x for f, names in LABELS.items() for x in (F.lit(f), F.array(*map(F.lit, names)))])
    named = F.flatten(F.transform("_asked", lambda f: F.transform(
        F.array_append(F.coalesce(F.try_element_at(labels, f), F.array().cast("array<string>")), f), lambda a: F.struct(f.alias("field"), a.alias("alias")))))
    rows = rows.withColumns({"_named": named, "_low": F.lower("text")})

    def owners(alias):
        same = F.filter("_named", lambda y: F.lower(y["alias"]) == F.lower(alias))
        return F.size(F.array_distinct(F.transform(same, lambda y: y["field"])))

    def part(alias, group):
        return F.call_function("regexp_extract", F.col("text"), _pattern(alias), F.lit(group))
    hits = F.filter("_named", lambda x: ~F.array_contains("_given", x["field"]) & F.contains(F.col("_low"), F.lower(x["alias"]))
                    & F.regexp_like("text", _pattern(x["alias"])))
    read = F.transform(hits, lambda x: F.struct(
        x["field"].alias("field"), F.length(x["alias"]).alias("_n"), x["alias"].alias("alias"), owners(x["alias"]).alias("_owners"),
        part(x["alias"], 1).try_cast("double").alias("value"), part(x["alias"], 2).alias("unit")))
    found = rows.select("doc_id", F.inline(read))
    best = found.groupBy("doc_id", "field").agg(F.max(F.struct("_n", "alias", "_owners", "value", "unit")).alias("_b"))
    out = normalise_values(best.select("doc_id", "field", "_b.alias", "_b._owners", "_b.value", "_b.unit"))
    shared = F.col("_owners") > 1
    return out.withColumns({"issue": F.when(shared, "ambiguous").otherwise(F.col("issue")),
                            "value": F.when(~shared, F.col("value"))}).drop("_owners")


def labelled_slots(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Values of the asked fields in free text; the longest label of a field that matches wins.

    answers(doc_id, text), requests(doc_id, field). A matching label that two asked fields share is refused
    as ambiguous.
    """
    none = F.array().cast("array<string>")
    return _text_slots(answers.select("doc_id", "text").join(_asked(requests), "doc_id").withColumn("_given", none))


def answered_slots(answers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots of whole answers (doc_id, field, alias, value, unit, issue), and one (doc_id, status) per answer.

    answers(doc_id, action, text, slots MAP<STRING, STRUCT<value DOUBLE, unit STRING>>), one per document,
    requests(doc_id, field). Structured slots come first (alias null), the text fills what they leave open. An answer
    is refused for nothing_asked, action, unknown_field, text_too_long, no_slot or values, where one slot has an issue;
    else it is cancelled or accepted.
    """
    given = F.coalesce(F.map_keys("slots"), F.array().cast("array<string>"))
    action = F.lower(F.trim(F.coalesce(F.nullif("action", F.lit("")), F.lit("provide"))))
    rows = answers.join(_asked(requests), "doc_id", "left").withColumn("_given", given)
    status = (F.when(F.col("_asked").isNull(), "nothing_asked").when(~action.isin("provide", "cancel"), "action").when(action == "cancel", "cancelled")
              .when(F.size(F.array_except("_given", "_asked")) > 0, "unknown_field").when(F.length("text") > MAX_TEXT, "text_too_long"))
    judged = rows.withColumn("status", status)
    readable = judged.where(F.col("status").isNull())
    typed = readable.select("doc_id", F.explode("slots").alias("field", "_s")).select(
        "doc_id", "field", F.lit(None).cast("string").alias("alias"), "_s.value", "_s.unit")
    slots = normalise_values(typed).unionByName(_text_slots(readable.select("doc_id", "text", "_asked", "_given")))
    found = slots.groupBy("doc_id").agg(F.count_if(F.col("issue").isNotNull()).alias("_bad"))
    status = F.coalesce("status", F.when(F.col("_bad").isNull(), "no_slot").when(F.col("_bad") > 0, "values").otherwise("accepted"))
    return slots, judged.select("doc_id", "status").join(found, "doc_id", "left").select("doc_id", status.alias("status"))
