"""Self-check of pin tables: one pass of statistics per document, rules over it, score and verdict.

Rules are rows of data: a code, a severity and a boolean over the statistics. The statistics come from two
partial aggregates, first by (document, pin number) and then by document, so a hot document is reduced in
every map task and none of its rows are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T
from ..functions.names import folded, is_number
from ..functions.packages import documented_exposed_pad, exposed_pad_name, pin_count_from_package
from ..session import settled
from .ordering import next_row, top_per_key

KEY = ["doc_id", "code"]
# How a finding lists its items
SEPARATOR, MORE = "、", "…"
SEVERITY_ORDER = ("error", "warn", "info")


def pin_flags(pins: DataFrame) -> DataFrame:
    name = F.coalesce("name", F.lit(""))
    number = F.col("pin_number")
    return pins.select(
        "doc_id", "pin_number", "ord",
        (F.trim(name) == "").alias("empty"), (folded("name") == folded("pin_number")).alias("same"),
        name.rlike("[一-鿿]").alias("dirty"), (F.length(name) > T.MAX_NAME_LENGTH).alias("long"),
        (F.col("side") == "unknown").alias("unknown"), "side",
        F.when(is_number(number), F.trim(number).try_cast("bigint")).alias("value"),
        exposed_pad_name().alias("pad"), documented_exposed_pad().alias("documented"))


def pin_stats(pins: DataFrame, docs: DataFrame, pads: bool = True) -> DataFrame:
    """One row per document of `docs` with everything the rules look at; a document without pins has n = 0.

    Without `pads` the statistics of exposed pads, which only the package rules need, are left out.
    """
    flags = pin_flags(pins)
    if not pads:
        flags = flags.withColumns({"pad": F.lit(False), "documented": F.lit(False)})
    sums = {c: F.count_if(c).alias(c) for c in ("empty", "same", "dirty", "long", "unknown", "pad")}
    number = flags.groupBy("doc_id", "pin_number").agg(
        F.count(F.lit(1)).alias("n"), *sums.values(), F.max("value").alias("value"),
        F.min("side").alias("s0"), F.max("side").alias("s1"),
        F.max(F.when(F.col("pad") & F.col("documented"), F.col("pin_number"))).alias("pad_number"))
    peripheral = F.col("pad") < F.col("n")
    canonical = F.when(peripheral & F.col("pin_number").rlike("^[1-9][0-9]*$"), F.col("value"))
    stats = number.groupBy("doc_id").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("value").isNull()).alias("not_numeric"), F.count_if(F.col("pin_number").startswith("0")).alias("padded"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.max("pad_number").alias("pad_number"),
        F.count_if(peripheral).alias("peripheral_numbers"), F.count(canonical).alias("canonical_numbers"),
        F.min(canonical).alias("peripheral_low"), F.max(canonical).alias("peripheral_high"))
    filled = ["n", *sums, "repeated", "not_numeric", "padded"]
    return docs.join(stats, "doc_id", "left").fillna(0, filled)


def missing_numbers(pins: DataFrame, stats: DataFrame, bucket_width: int = 65536) -> DataFrame:
    """Gaps in 1..n of all-numeric documents as ranges (doc_id, first, last).

    A gap lies between two neighbours among the distinct numbers, with 0 and n + 1 as end posts, so no
    1..n list is ever built for a document.
    """
    # 1..n without repeats, first and last in place, has no gap; only the other documents are looked through.
    whole = (F.col("repeated") == 0) & (F.col("padded") == 0) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    numeric = stats.where((F.col("n") > 0) & (F.col("not_numeric") == 0) & ~whole).select("doc_id", "n")
    value = F.trim("pin_number").try_cast("bigint")
    inside = pins.select("doc_id", value.alias("value")).join(numeric, "doc_id")
    inside = inside.where(F.col("value").between(1, F.col("n"))).select("doc_id", "value").distinct()
    posts = numeric.select("doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("n") + 1)).alias("value"))
    ahead = next_row(inside.unionByName(posts), ["doc_id"], [F.col("value")],
                     F.floor(F.col("value") / bucket_width), {"next": F.col("value")})
    return ahead.where(F.col("next") > F.col("value") + 1).select(
        "doc_id", (F.col("value") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def _detail(items: DataFrame, counts: DataFrame, limit: int = T.DETAIL_ITEMS) -> DataFrame:
    """First items of every finding as text; the full number of items stays in `items`."""
    head = top_per_key(items, KEY, [F.col("rank"), F.col("item")], limit)
    text = head.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_rank", "item"))).alias("_i"))
    text = text.select(*KEY, F.array_join(F.transform("_i", lambda i: i.item), SEPARATOR).alias("_text"))
    out = counts.join(text, KEY, "left")
    shown = F.when(F.col("items") > 0, F.concat("_text", F.when(F.col("items") > limit, MORE).otherwise("")))
    return out.withColumn("detail", F.coalesce(shown, F.lit(""))).drop("_text")


def _apply(stats: DataFrame, rules: list[tuple[str, Column | str, Column, Column]]) -> DataFrame:
    """Explode the rules that hold: (code, severity, condition, number of items)."""
    def text(value):
        return F.lit(value) if isinstance(value, str) else value
    rows = [F.when(cond, F.struct(F.lit(code).alias("code"), text(severity).alias("severity"),
                                  items.cast("bigint").alias("items"))) for code, severity, cond, items in rules]
    return stats.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("_f")).select("doc_id", "_f.*")


def number_rules() -> list:
    n = F.col("n")
    zero = F.lit(0)
    return [("no_pins", "error", n == 0, zero), ("too_few_pins", "error", n.between(1, T.MIN_PINS - 1), n),
            ("pin_numbers_duplicated", "error", F.col("repeated") > 0, F.col("repeated"))]


def name_rules() -> list:
    n, zero = F.col("n"), F.lit(0)
    return [
        ("empty_pin_names", F.when(F.col("empty") == n, "error").otherwise("warn"), (n > 0) & (F.col("empty") > 0),
         F.when(F.col("empty") < n, F.col("empty")).otherwise(zero)),
        ("name_looks_like_number", "warn",
         (n >= T.EQUAL_NAME_MIN_PINS) & (F.col("same") >= n * T.EQUAL_NAME_RATIO), zero),
        ("name_has_non_ascii", "warn", F.col("dirty") > 0, F.col("dirty")),
        ("name_too_long", "info", F.col("long") > 0, F.col("long"))]


def side_rules(with_layout: bool = False) -> list:
    n, unknown = F.col("n"), F.col("unknown")
    rules = [("sides_unknown", F.when(unknown == n, "error").otherwise("warn"), (n > 0) & (unknown > 0),
              F.when(unknown < n, unknown).otherwise(F.lit(0)))]
    if with_layout:
        rules.append(("all_pins_one_side", "error", (n >= T.ONE_SIDE_MIN_PINS) & (unknown == 0)
                      & (F.col("s0") == F.col("s1")), F.lit(0)))
    return rules


def device_rules() -> list:
    """Needs `device` and `file_stem` in the statistics."""
    device = F.coalesce("device", F.lit(""))
    job_id = F.lower(device).rlike("^[0-9a-f]{8,}$") & device.rlike("[^A-Za-z]")
    stem = F.coalesce("file_stem", F.lit(""))
    return [("device_suspicious", "warn", (device == "") | job_id | ((stem != "") & (device == stem)), F.lit(0))]


def _pin_items(pins: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Pins a finding of the chosen groups lists: duplicates in text order, the others in table order."""
    flags = pin_flags(pins)
    wanted = {"empty_pin_names": "empty", "name_has_non_ascii": "dirty", "name_too_long": "long"} if "names" in groups else {}
    wanted |= {"sides_unknown": "unknown"} if "sides" in groups else {}
    codes = F.array_compact(F.array(*[F.when(F.col(f), F.lit(code)) for code, f in wanted.items()]).cast("array<string>"))
    listed = flags.select("doc_id", F.explode(codes).alias("code"), F.col("ord").alias("rank"),
                          F.col("pin_number").alias("item"))
    if "numbers" not in groups:
        return listed
    repeated = pins.groupBy("doc_id", "pin_number").count().where("count > 1")
    return listed.unionByName(repeated.select(
        "doc_id", F.lit("pin_numbers_duplicated").alias("code"), F.lit(0).cast("bigint").alias("rank"),
        F.col("pin_number").alias("item")))


def gap_findings(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbering finding and its items; a range adds at most the items that can be shown."""
    counts = gaps.groupBy("doc_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("items")).select(
        "doc_id", F.lit("pin_numbers_not_contiguous").alias("code"), F.lit("warn").alias("severity"), "items")
    shown = gaps.select("doc_id", F.explode(F.sequence(
        "first", F.least("last", F.col("first") + T.DETAIL_ITEMS - 1))).alias("rank"))
    items = shown.select("doc_id", F.lit("pin_numbers_not_contiguous").alias("code"), "rank",
                         F.col("rank").cast("string").alias("item"))
    return counts, items


def check_pins(pins: DataFrame, docs: DataFrame, groups: tuple[str, ...] = ("device", "numbers", "names", "sides"),
               with_layout: bool = False) -> DataFrame:
    """Findings (doc_id, code, severity, items, detail) of the chosen rule groups."""
    # One scan of the pins feeds all rules and the gaps.
    stats = pin_stats(pins, docs, pads=False)
    stats = settled(stats) if "numbers" in groups else stats
    rules = []
    if "device" in groups:
        rules += device_rules()
    if "numbers" in groups:
        rules += number_rules()
    if "names" in groups:
        rules += name_rules()
    if "sides" in groups:
        rules += side_rules(with_layout)
    found = _apply(stats, rules)
    items = _pin_items(pins, groups)
    if "numbers" in groups:
        counts, numbers = gap_findings(missing_numbers(pins, stats))
        found, items = found.unionByName(counts), items.unionByName(numbers)
    return _detail(items, found)


def check_severities(pins: DataFrame, docs: DataFrame, with_layout: bool = False) -> DataFrame:
    """(doc_id, code, severity) of what `check_pins` finds, without counting or listing items.

    n numbers without repeats, padding and gaps are 1..n, so the statistics of a document tell of a gap; only where a number is
    padded with zeros are the numbers themselves looked at.
    """
    stats = settled(pin_stats(pins, docs, pads=False))
    numeric = (F.col("n") > 0) & (F.col("not_numeric") == 0)
    whole = (F.col("repeated") == 0) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    gap = ("pin_numbers_not_contiguous", "warn", numeric & (F.col("padded") == 0) & ~whole, F.lit(0))
    found = _apply(stats, [*device_rules(), *number_rules(), *name_rules(), *side_rules(with_layout), gap])
    padded = stats.where(numeric & (F.col("padded") > 0))
    gaps = missing_numbers(pins.join(padded.select("doc_id"), "doc_id", "left_semi"), padded)
    more = gaps.select("doc_id").distinct().select("doc_id", F.lit("pin_numbers_not_contiguous").alias("code"), F.lit("warn").alias("severity"))
    return found.select("doc_id", "code", "severity").unionByName(more)


def package_findings(pins: DataFrame, docs: DataFrame, hint_counts: DataFrame | None = None,
                     candidates: DataFrame | None = None) -> DataFrame:
    """Pin count against the package name, else against the hinted counts; and whether the name is settled.

    docs(doc_id, package), hint_counts(doc_id, pin_count) distinct, candidates(doc_id, pos, label); leaving
    out candidates skips the name questions, as leaving out hints skips the second source.
    """
    stats = pin_stats(pins, docs).withColumn("expected", pin_count_from_package("package"))
    package = F.coalesce("package", F.lit(""))
    n, expected = F.col("n"), F.col("expected").cast("bigint")
    if hint_counts is None:
        stats = stats.withColumns({"hinted": F.lit(False), "hit": F.lit(False)})
    else:
        hinted = hint_counts.select("doc_id").distinct().withColumn("hinted", F.lit(True))
        hits = hint_counts.select("doc_id", F.col("pin_count").cast("bigint").alias("n")).distinct().withColumn(
            "hit", F.lit(True))
        stats = stats.join(hinted, "doc_id", "left").join(hits, ["doc_id", "n"], "left").fillna(False, ["hinted", "hit"])
    documented = (F.col("pad") == 1) & (F.col("pad_number") == (expected + 1).cast("string"))
    documented = F.coalesce(documented, F.lit(False))
    peripherals = n - F.col("pad")
    exact = (peripherals == expected) & (F.col("peripheral_numbers") == expected) \
        & (F.col("canonical_numbers") == expected) & (F.col("peripheral_low") == 1) & (F.col("peripheral_high") == expected)
    exact = F.coalesce(exact, F.lit(False))
    observed = F.when(documented, peripherals).otherwise(n)
    judged = (n > 0) & expected.isNotNull()
    rules = [
        ("exposed_pad", "info", judged & documented & exact, F.lit(0)),
        ("peripheral_numbers_mismatch", "error", judged & documented & ~exact & (expected == observed), F.lit(0)),
        ("pin_count_mismatch", "error",
         (judged & ~(documented & exact) & (expected != observed))
         | ((n > 0) & expected.isNull() & F.col("hinted") & ~F.col("hit")),
         F.when(expected.isNotNull(), F.abs(expected - observed)).otherwise(F.lit(0)))]
    if candidates is not None:
        labels = candidates.where(F.coalesce("label", F.lit("")) != "")
        named = labels.select("doc_id", F.col("label").alias("package")).distinct().withColumn("listed", F.lit(True))
        stats = stats.join(named, ["doc_id", "package"], "left").fillna(False, ["listed"])
        rules += [("package_unknown", "warn", package == "", F.lit(0)),
                  ("package_ambiguous", "info", (package != "") & ~F.col("listed"), F.lit(0))]
    return _apply(stats, rules).withColumn("detail", F.lit(""))


def review_findings(pins: DataFrame, differences: DataFrame, conflicts: DataFrame | None = None,
                    warnings: DataFrame | None = None, verified_pads: DataFrame | None = None) -> DataFrame:
    """Review differences judged again on the current pins, open conflicts, and warnings from upstream."""
    pin = ["doc_id", "pin_number"]
    current = pins.groupBy(*pin).agg(F.max_by(F.struct("name", "side"), "ord").alias("_c"))
    joined = differences.join(current, pin, "left")
    gone = F.col("_c").isNull()
    still = (F.when(F.col("kind") == "name", gone | (folded("_c.name") != folded("observed")))
             .when(F.col("kind") == "side", gone | (F.col("_c.side") != F.col("observed")))
             .otherwise(F.lit(True)))
    open_rows = joined.where(F.coalesce(still, F.lit(True)))
    code = (F.when(F.col("kind") == "missing", "review_missing").when(F.col("kind") == "extra", "review_extra")
            .when(F.col("kind") == "name", "review_name_mismatch").otherwise("review_side_mismatch"))
    severity = F.when(F.col("kind") == "side", "info").otherwise("warn")
    if verified_pads is not None:
        pads = verified_pads.select("doc_id", F.col("pad_number").alias("pin_number"), F.lit(True).alias("_pad"))
        open_rows = open_rows.join(pads, pin, "left")
        shown = (F.col("kind") == "missing") & F.col("_pad").isNotNull()
        code, severity = F.when(shown, "review_pad_not_shown").otherwise(code), F.when(shown, "info").otherwise(severity)
    out = open_rows.groupBy("doc_id", code.alias("code"), severity.alias("severity")).agg(F.count("*").alias("items"))
    for df, name, level in ((conflicts, "conflicts_unresolved", "warn"), (warnings, "upstream_warning", "info")):
        if df is not None:
            rows = df.where(F.col("resolved").isNull()) if name == "conflicts_unresolved" else df
            out = out.unionByName(rows.groupBy("doc_id").agg(F.count("*").alias("items")).select(
                "doc_id", F.lit(name).alias("code"), F.lit(level).alias("severity"), "items"))
    return out


def report(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Score and verdict per document."""
    counts = findings.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_ORDER])
    names = [f"n_{s}" for s in SEVERITY_ORDER]
    out = docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, names)
    score = F.greatest(F.lit(0), 100 - T.ERROR_WEIGHT * F.col("n_error") - T.WARN_WEIGHT * F.col("n_warn"))
    verdict = F.when(F.col("n_error") > 0, "broken").when(F.col("n_warn") > 0, "suspect").otherwise("ok")
    return out.select("doc_id", *names, score.alias("score"), verdict.alias("verdict"))

