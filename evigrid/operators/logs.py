"""Tool run logs: typed lines, assertions, verdicts. Only what a log says was done counts, never a return code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T
from ..functions.names import strip
from .ordering import previous_row

# Fixed patterns and values of the logs
BOX = r"\(\(\((-?[\d.]+) (-?[\d.]+)\) \((-?[\d.]+) (-?[\d.]+)\)\)\)"
QUOTED = r'\("([^"]+)"\)'
ENTRY = r'(\w+)\s+"([^"]*)"'
END_MARKS = {"build": "==== BUILD END ====", "verify": "==== VERIFY END ====", "props": "==== PROPERTY CHECK END ===="}
DRC_WARNING = "SPMHA1-301"
PLACE_BOUND = "PACKAGE GEOMETRY/PLACE_BOUND_TOP"
REQUIRED_LAYERS = ("PACKAGE GEOMETRY/ASSEMBLY_TOP", PLACE_BOUND, "PACKAGE GEOMETRY/SILKSCREEN_TOP", "REF DES/ASSEMBLY_TOP",
                   "REF DES/SILKSCREEN_TOP")
OBJECT_TYPES = ("polygon", "shape", "path", "pin", "text")
HEIGHT = "PACKAGE_HEIGHT_MAX"
# Objects besides the pins: assembly frame, place bound, two silk bars, two labels
FIXED_OBJECTS = 6


def box_of(text: Column) -> Column:
    corners = [F.regexp_extract(text, BOX, i).try_cast("double") for i in (1, 2, 3, 4)]
    return F.when(corners[0].isNotNull(), F.struct(*[c.alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1"))]))


def _after(text: Column, key: str) -> Column:
    """Text behind the first `key`, or null."""
    at = F.instr(text, key)
    return F.when(at > 0, F.substr(text, at + len(key)))


def _quoted(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), QUOTED, 1), F.lit(""))


def _whole(text: Column) -> Column:
    return F.regexp_extract(text, r"=(\d+)$", 1).try_cast("int")


def typed_lines(lines: DataFrame) -> DataFrame:
    """One typed record per known line (job_id, log_kind, line_no, record, name, part, value, x, y, box, copper, layer)."""
    t = strip("text")
    rows = lines.withColumn("_t", t)
    t, kind = F.col("_t"), F.col("log_kind")
    build, verify, props = kind == "build", kind == "verify", kind == "props"
    ends = F.lit(False)
    for k, mark in END_MARKS.items():
        ends = ends | ((kind == k) & t.contains(mark))
    pad, pin = r"^PADSTACK (\S+) (\w+)=(.*)$", r"^PIN (\S+) xy=(-?[\d.]+):(-?[\d.]+) "
    record = (F.when(ends, "end").when(F.startswith(t, F.lit("version=")) & (build | verify), "version")
              .when(build & t.startswith("rename "), "design").when(build & t.rlike(pad), "padstack").when(build & t.rlike(pin), "placed_pin")
              .when(build & t.startswith("DUMP pin_count="), "dumped_pins").when(build & t.startswith("OBJ "), "object")
              .when(build & t.startswith("SAVE dra ="), "saved").when(build & t.startswith("COMPILE psm ="), "compiled")
              .when(verify & t.startswith("designType="), "design_type").when(verify & t.startswith("units="), "units")
              .when(verify & t.startswith("pin_count="), "pin_count").when(verify & t.startswith("PIN number="), "pin")
              .when((verify | props) & t.startswith("object_count="), "object_count").when(verify & t.startswith("OBJ type="), "object")
              .when(verify & t.startswith("PROPOBJ "), "property").when(props & t.startswith("OBJ layer="), "layer")
              .when(props & t.startswith("props="), "property").when((kind == "symbol") & t.contains(DRC_WARNING), "drc_warning"))
    rows = rows.withColumn("record", record).where(F.col("record").isNotNull())
    r = F.col("record")
    name = (F.when(r.isin("version", "design", "saved", "compiled", "design_type", "units", "pin"), _quoted(t))
            .when(r == "padstack", F.regexp_extract(t, pad, 1)).when(r == "placed_pin", F.regexp_extract(t, pin, 1))
            .when(r == "object", _quoted(_after(t, "type="))))
    value = (F.when(r == "padstack", F.regexp_extract(t, pad, 3)).when(r == "pin", _quoted(_after(t, "shape=")))
             .when((r == "property") & verify, F.coalesce(_after(t, "prop="), F.lit("nil"))).when(r == "property", F.substr(t, F.lit(7)))
             .when(r == "units", F.regexp_extract(_after(t, "accuracy="), r"\((-?[\d.]+)\)", 1)))
    return rows.select(
        "job_id", "log_kind", "line_no", "record", name.alias("name"), F.when(r == "padstack", F.regexp_extract(t, pad, 2)).alias("part"), value.alias("value"),
        F.when(r.isin("dumped_pins", "pin_count", "object_count"), _whole(t)).alias("number"),
        F.when(r == "placed_pin", F.regexp_extract(t, pin, 2).try_cast("double")).alias("x"), F.when(r == "placed_pin", F.regexp_extract(t, pin, 3).try_cast("double")).alias("y"),
        F.when(r.isin("object", "pin", "units"), box_of(t)).alias("box"), F.when(r == "pin", box_of(F.coalesce(_after(t, "copper_bbox="), F.lit("")))).alias("copper"),
        F.when(r.isin("object", "property", "layer"), _quoted(_after(t, "layer="))).alias("layer"))


def properties(typed: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Property records with their layer: in a property log the layer is on the line before."""
    direct = typed.where((F.col("log_kind") == "verify") & (F.col("record") == "property")).select("job_id", "log_kind", "line_no", "layer", "value")
    pairs = typed.where((F.col("log_kind") == "props") & F.col("record").isin("layer", "property"))
    seen = previous_row(pairs, ["job_id"], [F.col("line_no")], bucket, {"_rec": F.col("record"), "_layer": F.col("layer")})
    paired = seen.where(F.col("record") == "property").select(
        "job_id", "log_kind", "line_no", F.when(F.col("_rec") == "layer", F.col("_layer")).alias("layer"), "value")
    return direct.unionByName(paired)


def property_entries(records: DataFrame) -> DataFrame:
    """(job_id, log_kind, line_no, layer, name, value): every named entry, upper-cased."""
    found = F.regexp_extract_all("value", F.lit(ENTRY), 0)
    rows = records.select("job_id", "log_kind", "line_no", "layer", F.posexplode(found).alias("pos", "_e"))
    return rows.select("job_id", "log_kind", "line_no", "pos", "layer", F.upper(F.regexp_extract("_e", ENTRY, 1)).alias("name"),
                       F.upper(F.regexp_extract("_e", ENTRY, 2)).alias("value"))


def _assert(name: str, passed: Column, expected: Column, actual: Column) -> Column:
    return F.struct(F.lit(name).alias("assertion"), F.coalesce(passed, F.lit(False)).alias("passed"),
                    expected.cast("string").alias("expected"), F.coalesce(actual.cast("string"), F.lit("absent")).alias("actual"))


def _rows(df: DataFrame, checks: list[Column], group: str) -> DataFrame:
    out = df.select("job_id", F.explode(F.array(*checks)).alias("_a"))
    return out.select("job_id", F.lit(group).alias("log_kind"), "_a.*")


def _latest(record: str, column: str) -> Column:
    """Last value of a record; a later line of a log replaces an earlier one."""
    return F.max_by(column, F.when(F.col("record") == record, F.col("line_no")))


def _seen(record: str, cond: Column | None = None) -> Column:
    hit = F.col("record") == record
    return F.count_if(hit if cond is None else hit & cond)


def judge_build(typed: DataFrame, specs: DataFrame, padstacks: DataFrame) -> DataFrame:
    """Assertions on the build log of every job that has one.

    specs(job_id, name, pin_count, ep_present), padstacks(job_id, padstack) that must be on disk.
    """
    build = typed.where(F.col("log_kind") == "build")
    facts = build.groupBy("job_id").agg(
        (_seen("end") > 0).alias("ended"), _latest("design", "name").alias("design"), _seen("placed_pin").alias("placed"),
        _latest("saved", "name").alias("saved"), _latest("compiled", "name").alias("compiled"), _seen("object", F.col("name") == "drc").alias("drc"))
    warned = typed.where(F.col("record") == "drc_warning").select("job_id").distinct().withColumn("warned", F.lit(True))
    rows = facts.join(specs, "job_id").join(warned, "job_id", "left").fillna(False, ["warned"])
    total = F.col("pin_count") + F.col("ep_present").cast("int")
    compiled = F.lower("compiled")
    checks = [
        _assert("build_complete", F.col("ended"), F.lit("end mark"), F.col("ended")),
        _assert("design_name", F.col("design") == F.col("name"), F.col("name"), F.col("design")),
        _assert("placed_pins", F.col("placed") == total, total, F.col("placed")),
        _assert("saved", F.col("saved") == F.col("name"), F.col("name"), F.col("saved")),
        _assert("compiled", compiled.endswith(".psm") & compiled.contains(F.lower("name")), F.concat(F.lower("name"), F.lit(".psm")), F.col("compiled")),
        _assert("build_drc_objects", F.col("drc") == 0, F.lit(0), F.col("drc")),
        _assert("compile_warnings", ~F.col("warned"), F.lit("none"), F.when(F.col("warned"), DRC_WARNING).otherwise("none"))]
    disk = build.where((F.col("record") == "padstack") & (F.col("part") == "toDisk")).groupBy("job_id", F.col("name").alias("padstack")).agg(
        F.max_by("value", "line_no").alias("disk"))
    stacks = padstacks.join(facts.select("job_id"), "job_id", "left_semi").join(disk, ["job_id", "padstack"], "left")
    stack = F.concat(F.lit("padstack_on_disk:"), "padstack")
    saved = stacks.select("job_id", F.lit("build").alias("log_kind"), stack.alias("assertion"), F.coalesce(F.col("disk") == "(t)", F.lit(False)).alias("passed"),
                          F.lit("(t)").alias("expected"), F.coalesce("disk", F.lit("absent")).alias("actual"))
    return _rows(rows, checks, "build").unionByName(saved)


def judge_verify(typed: DataFrame, specs: DataFrame, numbers: DataFrame, tolerance: float = T.ASSERTION_TOLERANCE) -> DataFrame:
    """Assertions on the read-back log of every job that has one.

    specs(job_id, units, accuracy, pin_count, ep_present, marker, ex0, ey0, ex1, ey1), numbers(job_id, number)
    of all wanted pins.
    """
    verify = typed.where(F.col("log_kind") == "verify")
    layers = [F.bool_or((F.col("record") == "object") & (F.col("layer") == layer)).alias(f"_l{i}") for i, layer in enumerate(REQUIRED_LAYERS)]
    facts = verify.groupBy("job_id").agg(
        (_seen("end") > 0).alias("ended"), _latest("design_type", "name").alias("design_type"), _latest("units", "name").alias("log_units"),
        _latest("units", "value").alias("log_accuracy"), _latest("units", "box").alias("extents"), _latest("pin_count", "number").alias("log_pins"),
        _latest("object_count", "number").alias("log_objects"), _seen("object", F.col("name") == "drc").alias("drc"),
        _seen("object", ~F.coalesce("name", F.lit("")).isin(*OBJECT_TYPES)).alias("odd"), *layers)
    got = verify.where(F.col("record") == "pin").select("job_id", F.coalesce("name", F.lit("")).alias("number")).distinct()
    wanted = numbers.select("job_id", "number").distinct().join(facts.select("job_id"), "job_id", "left_semi")
    off = (wanted.join(got, ["job_id", "number"], "left_anti").unionByName(got.join(wanted, ["job_id", "number"], "left_anti"))
           .groupBy("job_id").agg(F.count("*").alias("off")))
    rows = facts.join(specs, "job_id").join(off, "job_id", "left").fillna(0, ["off"])
    total = F.col("pin_count") + F.col("ep_present").cast("int")
    objects = total + FIXED_OBJECTS + F.col("marker").cast("int")

    def near(axis):
        return F.abs(F.col(f"extents.{axis}") - F.col(f"e{axis}")) <= tolerance
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(f"_l{i}", F.lit(False)), F.lit(layer)) for i, layer in enumerate(REQUIRED_LAYERS)]))
    checks = [
        _assert("verify_complete", F.col("ended"), F.lit("end mark"), F.col("ended")),
        _assert("design_type", F.col("design_type") == "PACKAGE", F.lit("PACKAGE"), F.col("design_type")),
        _assert("units", (F.col("log_units") == F.col("units")) & (F.col("log_accuracy").try_cast("double").cast("int") == F.col("accuracy")),
                F.concat_ws("/", "units", "accuracy"), F.concat_ws("/", "log_units", "log_accuracy")),
        _assert("extents", near("x0") & near("y0") & near("x1") & near("y1"), F.concat_ws(",", "ex0", "ey0", "ex1", "ey1"),
                F.concat_ws(",", "extents.x0", "extents.y0", "extents.x1", "extents.y1")),
        _assert("pin_total", F.coalesce("log_pins", F.lit(0)) == total, total, F.col("log_pins")),
        _assert("pin_numbers", F.col("off") == 0, F.lit(0), F.col("off")),
        _assert("drc_objects", F.col("drc") == 0, F.lit(0), F.col("drc")),
        _assert("object_types", F.col("odd") == 0, F.lit(0), F.col("odd")),
        _assert("object_total", F.coalesce("log_objects", F.lit(0)) == objects, objects, F.col("log_objects")),
        _assert("layers", F.size(missing) == 0, F.lit(""), F.array_join(missing, ","))]
    return _rows(rows, checks, "verify")


def judge_pins(expected: DataFrame, observed: DataFrame, tolerance: float = T.ASSERTION_TOLERANCE) -> DataFrame:
    """Size and centre of every expected pin against the read-back; circles also by shape and copper size.

    expected(job_id, number, x, y, mask_x, mask_y, shape, copper), observed(job_id, number, x, y, size_x,
    size_y, shape, copper_x, copper_y). Only jobs with a read-back are judged.
    """
    have = observed.select("job_id").distinct()
    seen = observed.select("job_id", "number", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "size_x", "size_y", "shape", "copper_x", "copper_y")])
    rows = expected.join(have, "job_id", "left_semi").join(seen, ["job_id", "number"], "left")

    def near(a, b):
        return F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    whole = near("o_size_x", "mask_x") & near("o_size_y", "mask_y") & near("o_x", "x") & near("o_y", "y")
    circle = (F.col("shape") == "CIRCLE") & F.col("o_x").isNotNull()
    checks = F.array_compact(F.array(
        F.struct(F.lit("pin_box").alias("assertion"), whole.alias("passed")),
        F.when(circle, F.struct(F.lit("copper_shape").alias("assertion"), F.coalesce(F.col("o_shape") == "CIRCLE", F.lit(False)).alias("passed"))),
        F.when(circle, F.struct(F.lit("copper_size").alias("assertion"), (near("o_copper_x", "copper") & near("o_copper_y", "copper")).alias("passed")))))
    return rows.select("job_id", "number", F.explode(checks).alias("_a")).select("job_id", "number", "_a.*")


def observed_pins(typed: DataFrame) -> DataFrame:
    """Pins of a read-back log with centre, size and copper size; of repeated numbers the last counts."""
    pins = typed.where((F.col("log_kind") == "verify") & (F.col("record") == "pin"))
    last = pins.groupBy("job_id", F.col("name").alias("number")).agg(F.max_by(F.struct("box", "value", "copper"), "line_no").alias("_p"))
    b, c = "_p.box", "_p.copper"

    def span(box, axis):
        return F.col(f"{box}.{axis}1") - F.col(f"{box}.{axis}0")
    return last.where(F.col(b).isNotNull()).select(
        "job_id", "number", ((F.col(f"{b}.x0") + F.col(f"{b}.x1")) / 2).alias("x"), ((F.col(f"{b}.y0") + F.col(f"{b}.y1")) / 2).alias("y"),
        span(b, "x").alias("size_x"), span(b, "y").alias("size_y"), F.col("_p.value").alias("shape"), span(c, "x").alias("copper_x"), span(c, "y").alias("copper_y"))


def judge_properties(records: DataFrame, ended: DataFrame, specs: DataFrame) -> DataFrame:
    """Assertions on the property log: the height survived, exactly one owner, on the right layer.

    records(job_id, line_no, layer, value) of property logs, ended(job_id, complete), specs(job_id, height).
    """
    entries = property_entries(records.withColumn("log_kind", F.lit("props")))
    height = entries.where(F.col("name") == HEIGHT).groupBy("job_id").agg(F.max_by("value", F.struct("line_no", "pos")).alias("_value"))
    owned = records.where(F.regexp_like("value", F.lit(ENTRY))).groupBy("job_id").agg(F.count("*").alias("_owners"), F.min("layer").alias("_layer"))
    rows = specs.join(ended, "job_id").join(height, "job_id", "left").join(owned, "job_id", "left").fillna(0, ["_owners"])
    one = F.col("_owners") == 1
    wanted = F.upper("height")
    checks = [_assert("props_complete", F.col("complete"), F.lit("end mark"), F.col("complete")),
              _assert("height_kept", F.col("_value") == wanted, wanted, F.col("_value")),
              _assert("one_owner", one, F.lit(1), F.col("_owners")),
              F.when(one, _assert("owner_layer", F.col("_layer") == PLACE_BOUND, F.lit(PLACE_BOUND), F.col("_layer")))]
    out = rows.select("job_id", F.explode(F.array_compact(F.array(*checks))).alias("_a"))
    return out.select("job_id", F.lit("props").alias("log_kind"), "_a.*")


def verdicts(assertions: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job passes with at least one assertion and none failed; a job without any fails."""
    counts = assertions.groupBy("job_id").agg(F.count("*").alias("assertions"), F.count_if(~F.col("passed")).alias("failures"))
    out = jobs.select("job_id").join(counts, "job_id", "left").fillna(0, ["assertions", "failures"])
    return out.withColumn("passed", (F.col("assertions") > 0) & (F.col("failures") == 0))
