"""Symbol layout and order within a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T
from ..functions.names import SIDES, natural_order
from .ordering import ranked


def order_within_side(rows: DataFrame, along: list[Column], bucket: Column | None = None) -> DataFrame:
    """0-based order inside (doc_id, side)."""
    out = ranked(rows, ["doc_id", "side"], along, bucket, "side_order")
    return out.withColumn("side_order", (F.col("side_order") - 1).cast("int"))


def natural_rank(pins: DataFrame, bucket: Column | None = None) -> DataFrame:
    return ranked(pins, ["doc_id"], [*natural_order(), F.col("ord")], bucket, "position")


def symbol_layout(pins: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Place pins around a rectangle: one pitch apart, centred on each side, hot spots one pin length out.

    Pins of unknown side go left; run the side rules before this step.
    """
    sided = pins.withColumn("side", F.when(F.col("side").isin(*SIDES), F.col("side")).otherwise("left"))
    placed = ranked(sided, ["doc_id", "side"], [F.col("side_order"), F.col("ord")], bucket, "_rank")
    counts = sided.groupBy("doc_id").agg(*[F.count_if(F.col("side") == s).alias(f"_{s}") for s in SIDES])
    out = placed.join(counts, "doc_id")
    half_height = F.floor(F.greatest("_left", "_right") * T.PITCH / 2)
    half_width = F.greatest(F.lit(T.MIN_BODY_WIDTH // 2),
                            F.floor(F.greatest("_top", "_bottom") * T.PITCH / 2) + T.PIN_LENGTH)
    side = F.col("side")
    count = F.when(side == "left", F.col("_left")).when(side == "right", F.col("_right")).when(
        side == "top", F.col("_top")).otherwise(F.col("_bottom"))
    along = (F.col("_rank") - 1) * T.PITCH - (F.floor(count * T.PITCH / 2) - T.PITCH // 2)
    sign = F.when(side.isin("left", "top"), -1).otherwise(1)
    across = side.isin("left", "right")
    x = F.when(across, sign * half_width).otherwise(along)
    y = F.when(across, along).otherwise(sign * half_height)
    reach = sign * T.PIN_LENGTH
    return out.select(
        "doc_id", "pin_number", "name", "side", x.alias("x"), y.alias("y"),
        F.when(across, x + reach).otherwise(x).alias("hx"), F.when(across, y).otherwise(y + reach).alias("hy"),
        (half_width * 2).alias("body_width"), (half_height * 2).alias("body_height"))
