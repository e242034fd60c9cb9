"""Streams over the event table, run to completion into tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import jobs, limits
from ..session import shared_folder
from ..streaming import jobs as streams
from .account_queries import W14
from .registry import query
from .shapes import SHAPES, _pick, ctes, frame

# Fixed parameters of the examples: the events of a client are minutes apart
SLOW = {"register": (21600, 12), "login": (7200, 9)}


def _stream(spark, sf, name):
    source, columns, where = SHAPES[name]
    df = streams.table_stream(spark, sf, f"{source}.parquet")
    df = df.where(_pick(where, 0)) if where else df
    return df.selectExpr(*[_pick(c, 0) for c in columns])


def _run(spark, stream):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return streams.run_to_table(stream, f"{base}/out", f"{base}/state")


#: Files that arrive one after the other, and the seconds by which an event may come after younger ones
FILES, JITTER = 5, 480


def _arriving(df, key):
    """Which file brings a row: by time, but up to JITTER seconds late."""
    come = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.pmod(F.xxhash64(key), F.lit(JITTER))
    low, high = df.select(F.min(come), F.max(come)).first()
    return F.least(F.floor((come - (low or 0)) / max((high or 0) - (low or 0), 1) * FILES), F.lit(FILES - 1)).cast("int")


def _closing(df, *keys):
    """Rows that only move the clock: an hour after the last event."""
    end = df.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 HOUR")).cast(df.schema["ts"].dataType).alias("ts"))
    rows = df.select(*keys).distinct().crossJoin(F.broadcast(end)) if keys else end  # one row on the right
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(f.dataType).alias(c) for c, f in zip(df.columns, df.schema.fields, strict=True)])


def _fed(spark, df, key, closing):
    return streams.feed(df, f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}", _arriving(df, key), FILES, closing)


PAIRED = W14.split("UNION ALL SELECT job_id, task_id, id, node, 'error'")[0]


@query("r1_stage_timing", PAIRED)
def r1(spark, sf):
    df = frame(spark, sf, "progress")
    return _run(spark, streams.stage_timing(_fed(spark, df, "id", _closing(df))))


@query("r1_resumed_stages", PAIRED)
def r1_resumed(spark, sf):
    """A batch does the first half and a stream goes on with the starts it left open."""
    df = frame(spark, sf, "progress")
    # Taken once: an approximate median may come out another way each time it is computed, and then a start between two of them is in neither half
    cut = df.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    half = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(cut).cast("bigint")
    head, tail = df.where(half), df.where(~half)
    rest = _run(spark, streams.stage_timing(_fed(spark, tail, "id", _closing(df)), started=streams.open_stages(head)))
    return jobs.stage_durations(head, F.date_trunc("day", "ts")).unionByName(rest)


# One attempt of every client after the other, with the accepted times that are still in the window
R2 = ctes("attempts").replace("WITH", "WITH RECURSIVE", 1) + """, a AS (SELECT operation, client, attempt_id, epoch_us(ts) / 1e6 AS sec, CASE operation WHEN 'register' THEN 21600 ELSE 7200 END AS win,
    CASE operation WHEN 'register' THEN 12 ELSE 9 END AS most, row_number() OVER (PARTITION BY operation, client ORDER BY ts, attempt_id) AS rn FROM attempts),
  s AS (SELECT DISTINCT operation, client, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS held, CAST(NULL AS BIGINT) AS attempt_id, false AS accepted, CAST(0 AS INT) AS retry_after FROM a
    UNION ALL SELECT operation, client, rn, CASE WHEN len(f) < most THEN list_append(f, sec) ELSE f END, attempt_id, len(f) < most,
      CAST(CASE WHEN len(f) < most THEN 0 ELSE greatest(1, floor(win - (sec - f[1])) + 1) END AS INT)
    FROM (SELECT a.*, list_filter(s.held, lambda x: x > a.sec - a.win) AS f FROM s JOIN a ON a.operation = s.operation AND a.client = s.client AND a.rn = s.rn + 1))
  SELECT operation, client, attempt_id, accepted, retry_after FROM s WHERE rn > 0"""


@query("r2_limited_attempts", R2)
def r2(spark, sf):
    df = frame(spark, sf, "attempts")
    out = _run(spark, streams.limited_attempts(_fed(spark, df, "attempt_id", _closing(df, "operation", "client")), SLOW))
    return out.where("reason IS NULL").select("operation", "client", "attempt_id", "accepted", "retry_after")


# A client of its own with nine tenths of all attempts
HOT = R2.replace(ctes("attempts").replace("WITH", "WITH RECURSIVE", 1), ctes("hot_attempts").replace("WITH", "WITH RECURSIVE", 1)).replace("FROM attempts)", "FROM hot_attempts)", 1)


@query("r2_hot_client", HOT)
def r2_hot(spark, sf):
    df = frame(spark, sf, "hot_attempts")
    return limits.limit_attempts(df, SLOW, F.date_trunc("day", "ts"), windows=2)


@query("r2_limited_attempts_batch", R2)
def r2_batch(spark, sf):
    return limits.limit_attempts(frame(spark, sf, "attempts"), SLOW, F.date_trunc("day", "ts"))


@query("r2_attempts_in_window", ctes("attempts") + """ SELECT operation, client, attempt_id, count(*) OVER (PARTITION BY operation, client ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS in_window FROM attempts""")
def r2_window(spark, sf):
    return limits.attempts_in_window(frame(spark, sf, "attempts"), 7200)


@query("r3_bounded_log", ctes("job_log") + """ SELECT job_id, ordinal, message, value FROM job_log
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ordinal DESC) <= 600""")
def r3(spark, sf):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams.bounded_log(_stream(spark, sf, "job_log"), f"{base}/out", f"{base}/state").awaitTermination()
    return streams.current_log(spark, f"{base}/out").drop("bucket")
