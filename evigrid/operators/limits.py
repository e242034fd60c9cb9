"""Attempt limits over a sliding window in which only accepted attempts count."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import fold_in_order, previous_row, running_sum

# Fixed values: (seconds, attempts) by operation; anything else counts as a login
LIMITS = {"register": (300, 40), "login": (60, 60)}
KEY = ["operation", "client"]
#: Windows in a block of time: a busy client is judged a block at a time
BLOCK_WINDOWS = 16


def decide(times: np.ndarray, held: list[float], window: float, maximum: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Accepted, wait and the times that are in the window afterwards, for attempts in order after the accepted ones in `held`.

    While there is room the next attempts are accepted at once, and when there is none all are refused up to the time at which the oldest
    one leaves the window. So the steps are as many as the accepted attempts allow, however many are refused.
    """
    accepted, wait = np.zeros(len(times), bool), np.zeros(len(times), np.int32)
    opens, at = times - window, 0
    while at < len(times):
        held = held[bisect_right(held, opens[at]):]
        if len(held) < maximum:
            until = min(at + maximum - len(held), len(times))
            accepted[at:until] = True
            held = held + times[at:until].tolist()
        else:
            until = int(np.searchsorted(opens, held[0], "left"))
            wait[at:until] = np.maximum(1, np.trunc(window - (times[at:until] - held[0])) + 1)
        at = until
    return accepted, wait, held


def _limit(part: int, limits: dict) -> Column:
    pick = None
    for operation, values in limits.items():
        if operation != "login":
            cond = F.col("operation") == operation
            pick = F.when(cond, values[part]) if pick is None else pick.when(cond, values[part])
    return F.lit(limits["login"][part]) if pick is None else pick.otherwise(limits["login"][part])


def _handed_on(limits: dict):
    """For blocks in order the accepted times that reach into each; the state is those of one window, at most the limit."""
    def step(state: list, rows: dict):
        out = []
        for operation, times in zip(rows["operation"], rows["times"], strict=True):
            out.append(list(state))
            state[:] = decide(np.asarray(times), list(state), *limits.get(operation, limits["login"]))[2]
        return (out,)
    return step


def limit_attempts(attempts: DataFrame, limits: dict | None = None, bucket: Column | None = None, windows: int = BLOCK_WINDOWS) -> DataFrame:
    """attempts(operation, client, attempt_id, ts) with accepted and retry_after.

    A pause of a whole window empties it, so the attempts of a client fall into independent bursts, and a burst within the limit is accepted as it is. Larger
    ones are cut into blocks of `windows` windows. A block hands on only the accepted times of its last window; that pass reads nothing but sorted times, a row
    per block. With what reaches into it, each block then judges its attempts by itself, so a client with most of all attempts is spread over its blocks.
    """
    limits = limits or LIMITS
    order = [F.col("at"), F.col("attempt_id")]
    rows = attempts.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    seen = previous_row(rows, KEY, order, bucket, {"_before": F.col("at")})
    fresh = F.when(F.col("at") - F.col("_before") < _limit(0, limits), 0).otherwise(1)
    bursts = running_sum(seen.withColumn("_fresh", fresh), KEY, order, bucket, F.col("_fresh"), "burst")
    size = bursts.groupBy(*KEY, "burst").agg(F.count("*").alias("_size"))
    sized = bursts.join(size, [*KEY, "burst"]).select(*KEY, "burst", "attempt_id", "at", "_size")
    small = F.col("_size") <= _limit(1, limits)
    calm = sized.where(small).select(*KEY, "attempt_id", F.lit(True).alias("accepted"), F.lit(0).alias("retry_after"))
    part = [*KEY, "burst", "block"]
    busy = sized.where(~small).withColumn("block", F.floor(F.col("at") / (_limit(0, limits) * windows))).select(*part, "attempt_id", "at")
    times = busy.groupBy(*part).agg(F.array_sort(F.collect_list("at")).alias("times"))
    reaching = fold_in_order(times, [*KEY, "burst"], [F.col("block")], list, _handed_on(limits), {"held": "array<double>"}).select(*part, "held")

    def judge(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "attempt_id"])
        accepted, wait, _ = decide(rows["at"].to_numpy(), list(before["held"].iloc[0]), *limits.get(rows["operation"].iloc[0], limits["login"]))
        return rows[[*KEY, "attempt_id"]].assign(accepted=accepted, retry_after=wait)

    judged = busy.groupBy(*part).cogroup(reaching.groupBy(*part)).applyInPandas(
        judge, "operation string, client string, attempt_id bigint, accepted boolean, retry_after int")
    return calm.unionByName(judged)


def _between(limits: dict):
    """Late attempts among accepted ones, in order: the state is the accepted times of one window."""
    def step(state: list, rows: dict):
        accepted, wait = [], []
        for operation, at, late in zip(rows["operation"], rows["at"].tolist(), rows["late"], strict=True):
            window, maximum = limits.get(operation, limits["login"])
            del state[:bisect_right(state, at - window)]
            room = not late or len(state) < maximum
            accepted.append(room)
            wait.append(0 if room else max(1, int(window - (at - state[0])) + 1))
            if room:
                state.append(at)
        return accepted, wait
    return step


def judge_late(late: DataFrame, verdicts: DataFrame, limits: dict | None = None) -> DataFrame:
    """Verdicts on attempts that came when later ones of their client had been decided: late and verdicts have operation, client, attempt_id, ts.

    What was decided stays. A late attempt is accepted if the window that ends at it holds fewer accepted attempts, late ones included, than the limit. Only accepted
    attempts less than two windows before a late one are read.
    """
    limits = limits or LIMITS
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    block = F.floor(F.col("at") / _limit(0, limits))
    own = late.select(*KEY, "attempt_id", at.alias("at"), F.lit(True).alias("late")).withColumn("block", block)
    near = own.select(*KEY, F.explode(F.array("block", F.col("block") - 1)).alias("block")).distinct()
    taken = verdicts.where("accepted").select(*KEY, "attempt_id", at.alias("at"), F.lit(False).alias("late")).withColumn("block", block).join(
        near, [*KEY, "block"], "left_semi").select(own.columns)
    judged = fold_in_order(own.unionByName(taken), KEY, [F.col("at"), F.col("late"), F.col("attempt_id")], list, _between(limits), {"accepted": "boolean", "retry_after": "int"})
    return judged.where("late").select(*KEY, "attempt_id", "accepted", "retry_after")


def attempts_in_window(attempts: DataFrame, seconds: int) -> DataFrame:
    """Attempts of a client in the window that ends at each attempt, refused ones included.

    Time is cut into blocks of one window, so a busy client is spread over its blocks. What an attempt counts lies in its own block up to itself, and in the block before
    from its own time less the window on. Attempts are put, as asked, at that place among those the block before holds: as many asked ones up to there and as many held
    ones from there on are in the window. Both are running counts, so an attempt costs the same however many its window has.
    """
    span = seconds * 1000000
    rows = attempts.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    start = F.col("at") - F.pmod("at", F.lit(span))
    asked = F.struct((start - span).alias("block"), (F.col("at") - span).alias("place"), F.lit(True).alias("asked"), F.col("attempt_id"))
    held = F.struct(start.alias("block"), F.col("at").alias("place"), F.lit(False).alias("asked"), F.lit(None).cast(attempts.schema["attempt_id"].dataType).alias("attempt_id"))
    # attempts without a time are in one window with each other
    flat = rows.select(*KEY, F.inline(F.when(F.col("at").isNull(), F.array(asked)).otherwise(F.array(asked, held))))
    block = Window.partitionBy(*KEY, "block")
    place = block.orderBy("place", F.desc("asked")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = flat.withColumn("in_window", F.sum(F.when(F.col("asked"), 1).otherwise(-1)).over(place) + F.count_if(~F.col("asked")).over(block))
    return counted.where("asked").select(*KEY, "attempt_id", "in_window")
