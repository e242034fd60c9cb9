"""Two reading channels of one part: merge, review, resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import SIDES, confusable, folded
from ..functions.packages import documented_exposed_pad, pin_count_from_package
from .ordering import ranked

PIN = ["doc_id", "pin_number"]
RESOLVABLE = ("name", "side", "type", "description")


def figure_positions(figure_pins: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Side and 0-based order of every number in a figure; a number on two sides keeps the side seen first."""
    known = figure_pins.withColumn("side", F.when(F.col("side").isin(*SIDES), F.col("side")).otherwise("unknown"))
    placed = ranked(known, ["doc_id", "side"], [F.col("pos")], bucket, "_rank")
    sides = known.groupBy("doc_id", "side").agg(F.min("pos").alias("_side_pos"))
    row = F.struct("_side_pos", "pos", "side", (F.col("_rank") - 1).cast("int").alias("side_order"))
    best = placed.join(sides, ["doc_id", "side"]).groupBy(*PIN).agg(F.min(row).alias("_best"))
    return best.select(*PIN, "_best.side", "_best.side_order")


def merge_channels(text_pins: DataFrame, figure_pins: DataFrame, figures: DataFrame,
                   bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge the table channel with the figure channel.

    `figures` lists the documents that have a figure at all: without one nothing is compared, while an
    empty figure contradicts every pin. Returns the merged pins and the conflicts.
    """
    text = text_pins.select(*PIN, "ord", "name")
    firsts = text.groupBy(*PIN).agg(F.min_by(F.struct("ord", "name"), "ord").alias("_first"))
    firsts = firsts.select(*PIN, "_first.ord", "_first.name")
    seen = figure_positions(figure_pins, bucket)
    has_figure = figures.select("doc_id").distinct().withColumn("_figure", F.lit(True))
    # Documents without any table row are not compared either.
    has_text = text.select("doc_id").distinct()
    both = firsts.withColumn("_text", F.lit(True)).join(
        seen.join(has_text, "doc_id", "left_semi").withColumn("_seen", F.lit(True)), PIN, "full_outer")
    both = both.join(has_figure, "doc_id", "left")
    in_text, in_figure = F.col("_text").isNotNull(), F.col("_seen").isNotNull()
    compared = F.col("_figure").isNotNull()
    pins = both.where(in_text).select(
        *PIN, "ord", "name", F.coalesce("side", F.lit("unknown")).alias("side"),
        F.coalesce("side_order", F.lit(0)).alias("side_order"),
        F.when(compared, in_figure).alias("agreement"))
    one_sided = both.where(compared & (in_text != in_figure)).select(
        *PIN, F.when(in_text, "side").otherwise("pin_number").alias("field"),
        F.when(in_text, F.create_map(F.lit("text"), F.col("name")))
        .otherwise(F.create_map(F.lit("vision"), F.col("side"))).alias("values"))
    repeats = text.join(firsts.select(*PIN, F.col("ord").alias("_kept")), PIN).where(F.col("ord") > F.col("_kept"))
    repeats = repeats.select(*PIN, F.lit("pin_number").alias("field"),
                             F.create_map(F.lit("duplicate"), F.col("name")).alias("values"))
    return pins, one_sided.unionByName(repeats)


def review_differences(pins: DataFrame, observed: DataFrame) -> DataFrame:
    """Independent review: missing, extra, and name or side differences. Equal differences appear once."""
    latest = observed.where(F.trim("pin_number") != "").groupBy(*PIN).agg(
        F.max_by(F.struct("name", "side"), "pos").alias("_o"))
    expected = pins.select(*PIN, F.struct("name", "side").alias("_e"))
    both = expected.join(latest, PIN, "full_outer")
    seen_name = F.trim(F.coalesce("_o.name", F.lit("")))
    seen_side = F.lower(F.trim(F.coalesce("_o.side", F.lit(""))))

    def row(kind, left, right):
        return F.struct(F.lit(kind).alias("kind"), left.alias("expected"), right.alias("observed"))
    nothing = F.lit(None).cast("string")
    matched = F.col("_e").isNotNull() & F.col("_o").isNotNull()
    rows = F.array(
        F.when(F.col("_o").isNull(), row("missing", nothing, nothing)),
        F.when(F.col("_e").isNull(), row("extra", nothing, nothing)),
        F.when(matched & (seen_name != "") & (folded(seen_name) != folded("_e.name")),
               row("name", F.col("_e.name"), seen_name)),
        F.when(matched & ~seen_side.isin("", "unknown") & (F.col("_e.side") != "unknown")
               & (seen_side != F.col("_e.side")), row("side", F.col("_e.side"), seen_side)))
    out = both.select(*PIN, F.explode(F.array_compact(rows)).alias("_d"))
    return out.select(*PIN, "_d.kind", "_d.expected", "_d.observed").distinct()


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, labelled missing (left only) or extra (right only). Null is a value like others.

    Both sides go through one shuffle into as many tasks as it has, before repeats are removed: most keys are distinct, so removing them first
    would hold what a task reads.
    """
    rows = left.select(*keys, F.lit(True).alias("_left")).unionByName(right.select(*keys, F.lit(False).alias("_left")))
    dealt = rows.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    sides = dealt.groupBy(*keys).agg(F.bool_or("_left").alias("_any"), F.bool_and("_left").alias("_all")).where(F.col("_any") == F.col("_all"))
    return sides.select(*keys, F.when(F.col("_any"), "missing").otherwise("extra").alias("kind"))


def resolution_issues(resolutions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Why an answer is refused: unknown key, repeated key, bad value, or an item left open."""
    key = [*PIN, "field"]
    open_items = conflicts.select(*key).distinct()
    value = F.trim(F.coalesce("value", F.lit("")))
    bad = (value == "") | (F.length(value) > 200) | (
        (F.col("field") == "side") & ~value.isin(*SIDES, "unknown"))
    answered = resolutions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    docs = resolutions.select("doc_id").distinct()
    both = answered.withColumn("_answered", F.lit(True)).join(
        open_items.join(docs, "doc_id", "left_semi").withColumn("_open", F.lit(True)), key, "full_outer")
    issues = F.array_compact(F.array(
        F.when(F.col("_open").isNull(), F.lit("unknown")), F.when(F.col("_n") > 1, F.lit("duplicate")),
        F.when(F.col("_bad") > 0, F.lit("invalid")), F.when(F.col("_answered").isNull(), F.lit("uncovered"))))
    return both.select(*key, F.explode(issues).alias("issue"))


def apply_resolutions(pins: DataFrame, resolutions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Write accepted answers into the pins; an answer with any issue changes nothing in its document."""
    refused = resolution_issues(resolutions, conflicts).select("doc_id").distinct()
    fields = [f for f in RESOLVABLE if f in pins.columns]
    chosen = resolutions.join(refused, "doc_id", "left_anti").groupBy(*PIN).agg(
        *[F.max(F.when(F.col("field") == f, F.trim("value"))).alias(f"_{f}") for f in fields])
    joined = pins.join(chosen, PIN, "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def verified_exposed_pads(pins: DataFrame, packages: DataFrame) -> DataFrame:
    """Documents whose pins are exactly 1..N plus one documented pad numbered N+1."""
    pad = documented_exposed_pad()
    numbers = pins.groupBy(*PIN).agg(F.count(F.lit(1)).alias("n"), F.count_if(pad).alias("pads"))
    value = F.when(F.col("pin_number").rlike("^[1-9][0-9]{0,8}$"), F.col("pin_number").try_cast("int"))
    peripheral = F.col("pads") < F.col("n")
    docs = numbers.groupBy("doc_id").agg(
        F.sum("n").alias("n"), F.sum("pads").alias("pads"),
        F.max(F.when(F.col("pads") > 0, F.col("pin_number"))).alias("pad_number"),
        F.count_if(peripheral).alias("distinct_peripherals"),
        F.count_if(peripheral & value.isNull()).alias("odd"),
        F.min(F.when(peripheral, value)).alias("low"), F.max(F.when(peripheral, value)).alias("high"))
    known = packages.withColumn("count", pin_count_from_package("package")).where(F.col("count").isNotNull())
    ok = ((F.col("pads") == 1) & (F.col("n") == F.col("count") + 1) & (F.col("odd") == 0) & (F.col("low") == 1)
          & (F.col("high") == F.col("count")) & (F.col("distinct_peripherals") == F.col("count"))
          & (F.col("pad_number") == (F.col("count") + 1).cast("string")))
    return docs.join(known, "doc_id").where(ok).select("doc_id", "package", "count", "pad_number")


def dual_row_rotation(figure_pins: DataFrame, packages: DataFrame) -> DataFrame:
    """Give a proven dual-row figure the left/right convention; every other figure is returned unchanged.

    Proof: two opposite banks that together hold 1..N exactly once, one of them the lower half.
    """
    figure = figure_pins.join(packages.select("doc_id", "package"), "doc_id", "left")
    figure = figure.withColumn("count", F.when(F.col("package").rlike(r"(?i)^[XUV]?DFN(?:[\s_\-]|\d)"),
                                               pin_count_from_package("package")))
    value = F.when(F.col("pin_number").rlike("^[1-9][0-9]{0,8}$"), F.col("pin_number").try_cast("int"))
    low = value <= F.col("count") / 2
    # One row per (document, number) first, so that a hot document is aggregated in parts.
    numbers = figure.groupBy(*PIN, "count").agg(
        F.count(F.lit(1)).alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    sides = F.concat_ws(",", F.array_sort(F.array_distinct(F.array("first_side", "last_side"))))
    docs = numbers.groupBy("doc_id", "count").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.count_if(value.isNull()).alias("odd"),
        F.min(value).alias("first"), F.max(value).alias("last"),
        F.min("s0").alias("first_side"), F.max("s1").alias("last_side"),
        F.count_if(~F.col("s0").isin(*SIDES) | ~F.col("s1").isin(*SIDES)).alias("unsided"),
        (F.min(F.when(low, F.col("s0"))) == F.max(F.when(low, F.col("s0")))).alias("low_on_one"),
        (F.min(F.when(~low, F.col("s0"))) == F.max(F.when(~low, F.col("s0")))).alias("high_on_one"),
        F.bool_or((F.col("s0") != F.lit("left")) & (F.col("s0") != F.lit("right"))).alias("vertical"),
        F.bool_or((F.col("s0") == F.lit("left")) | (F.col("s0") == F.lit("right"))).alias("horizontal"))
    proven = docs.where(
        (F.col("count") % 2 == 0) & (F.col("rows") == F.col("count")) & (F.col("distinct") == F.col("count"))
        & (F.col("odd") == 0) & (F.col("first") == 1) & (F.col("last") == F.col("count")) & (F.col("unsided") == 0)
        & sides.isin("left,right", "bottom,top") & (F.col("vertical") != F.col("horizontal"))
        & F.col("low_on_one") & F.col("high_on_one")).select("doc_id", F.col("count").alias("_n"))
    out = figure.join(proven, "doc_id", "left")
    turned = F.col("_n").isNotNull()
    side = F.when(turned, F.when(value <= F.col("_n") / 2, "left").otherwise("right")).otherwise(F.col("side"))
    pos = F.when(turned, F.when(value <= F.col("_n") / 2, value - 1)
                 .otherwise(F.col("_n") + F.col("_n") / 2 - value).cast("bigint")).otherwise(F.col("pos").cast("bigint"))
    return out.select("doc_id", "pin_number", side.alias("side"), pos.alias("pos"), turned.alias("rotated"))


def name_resolution(pins: DataFrame, mismatches: DataFrame, observations: DataFrame) -> DataFrame:
    """Automatic verdict on name differences; null means it stays open.

    pins(doc_id, pin_number, name, side, description, evidence), mismatches(doc_id, pin_number, expected,
    observed), observations(doc_id, pin_number, confidence, uncertain).
    """
    norm = {c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")) for c in ("name", "expected", "observed")}
    joined = mismatches.join(pins, PIN, "left").join(
        observations.select(*PIN, F.col("confidence").alias("_conf"), F.col("uncertain").alias("_unc")), PIN, "left")
    agreed = F.exists("evidence", lambda e: (e.source == "vision") & F.coalesce(e.agreement, F.lit(False)))
    channels = F.array_distinct(F.transform(F.regexp_extract_all(
        F.coalesce("description", F.lit("")), F.lit(r"(?i)analog\s+input\s+channel\s+(\d+)\b"), 1), lambda c: c.try_cast("int")))
    wanted = F.regexp_extract(norm["observed"], r"^(?:AIN|IN)(\d{1,2})$", 1)
    aliases = ("EP", "EPAD", "EXPOSEDPAD")
    reason = (
        F.when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("observed", F.lit("")) == ""), None)
        .when(norm["name"] == norm["observed"], "already_equal")
        .when(norm["name"] != norm["expected"], None)
        .when(F.col("_conf").isNotNull() & ~F.col("_conf").between(0.9, 1.0), None)
        .when(F.coalesce("_unc", F.lit(False)), None)
        .when(norm["name"].isin(*aliases) & norm["observed"].isin(*aliases) & documented_exposed_pad(), "pad_alias")
        .when(~F.coalesce(agreed, F.lit(False)) | ~F.col("side").isin(*SIDES), None)
        .when((F.col("name") == F.col("pin_number")) & (F.col("observed") != F.col("pin_number"))
              & F.col("observed").rlike(r"^[A-Za-z][A-Za-z0-9_/.+()\-]{0,63}$"), "placeholder")
        .when((wanted != "") & (F.size(channels) == 1) & (channels[0] == wanted.try_cast("int"))
              & confusable(norm["name"], norm["observed"]), "channel_number"))
    out = joined.withColumn("reason", reason)
    value = F.when(F.col("reason") == "already_equal", F.col("name")).when(F.col("reason").isNotNull(), F.col("observed"))
    return out.select(*PIN, value.alias("value"), "reason")

