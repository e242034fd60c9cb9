"""Jobs, accounts, progress and conversations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, jobs
from ..sources import files
from .registry import query
from .shapes import SHAPES, _pick, ctes, frame

JOBS = ctes("symbol_jobs", "pcb_jobs", "step_jobs") + """, jobs AS (
  SELECT 'symbol' AS kind, * FROM symbol_jobs UNION ALL SELECT 'pcb' AS kind, * FROM pcb_jobs
  UNION ALL SELECT 'step' AS kind, * FROM step_jobs)"""
TITLE = """coalesce(nullif(json_extract_string(package_params, '$.spec_name'), ''),
  nullif(json_extract_string(package_params, '$.device'), ''),
  nullif(json_extract_string(package_params, '$.original_filename'), ''),
  nullif(json_extract_string(package_params, '$.human_request'), ''), upper(kind))"""


def _jobs(spark, sf):
    return jobs.all_jobs(symbol=frame(spark, sf, "symbol_jobs"), pcb=frame(spark, sf, "pcb_jobs"),
                         step=frame(spark, sf, "step_jobs"))


@query("u1_union_jobs", JOBS + """ SELECT kind, status, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at
  FROM jobs GROUP BY kind, status""")
def u1(spark, sf):
    return _jobs(spark, sf).groupBy("kind", "status").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("s6_job_table_read", ctes("symbol_jobs") + " SELECT id, tenant_id, status, created_at FROM symbol_jobs")
def s6(spark, sf):
    # the reader opens the stored table; the shape's columns are what this application calls its own
    source, columns, where = SHAPES["symbol_jobs"]
    stored = files.read_job_table(spark, source, path=f"{sf}/{source}.parquet")
    stored = stored.where(_pick(where, 0)) if where else stored
    return stored.selectExpr(*[_pick(c, 0) for c in columns]).select("id", "tenant_id", "status", "created_at")


@query("f1_visible_jobs", JOBS + """ SELECT kind, id, status FROM jobs WHERE tenant_id = '3' AND deleted_at IS NULL""")
def f1(spark, sf):
    return jobs.visible_jobs(_jobs(spark, sf), "3").select("kind", "id", "status")


@query("f1_visible_jobs_of_kind", JOBS + """ SELECT kind, id, status FROM jobs
  WHERE tenant_id = '2' AND deleted_at IS NULL AND kind = 'symbol'""")
def f1_kind(spark, sf):
    return jobs.visible_jobs(_jobs(spark, sf), "2", "symbol").select("kind", "id", "status")


@query("f2_job_titles", JOBS + f" SELECT kind, {TITLE} AS title, count(*) AS n FROM jobs GROUP BY 1, 2")
def f2(spark, sf):
    return _jobs(spark, sf).groupBy("kind", jobs.job_title().alias("title")).agg(F.count("*").alias("n"))


@query("t1_job_page", JOBS + f""" SELECT kind, id, status, {TITLE} AS title, created_at,
    CAST(row_number() OVER (ORDER BY created_at DESC, kind, id DESC) AS INT) AS position,
    count(*) OVER () > 30 AS has_more
  FROM (SELECT * FROM jobs WHERE tenant_id = '3' AND deleted_at IS NULL
        ORDER BY created_at DESC, kind, id DESC LIMIT 31 OFFSET 60) QUALIFY position <= 30""")
def t1(spark, sf):
    page = jobs.job_page(jobs.visible_jobs(_jobs(spark, sf), "3"), 30, 60)
    return page.select("kind", "id", "status", jobs.job_title().alias("title"), "created_at", "position", "has_more")


@query("f6_stuck_jobs", ctes("symbol_jobs") + """ SELECT id, tenant_id, created_at FROM symbol_jobs
  WHERE deleted_at IS NULL AND (status = 'ai_processing'
    OR json_extract_string(package_params, '$.projection_sync_failed') = 'true')""")
def f6(spark, sf):
    return jobs.stuck_jobs(frame(spark, sf, "symbol_jobs"))


@query("f7_status_violations", JOBS + """ SELECT kind, id, status FROM jobs WHERE status IS NULL OR status NOT IN
  ('pending','ai_processing','awaiting_input','pending_review','reviewed','completed','rejected','stopped','failed')""")
def f7(spark, sf):
    return jobs.status_violations(_jobs(spark, sf)).select("kind", "id", "status")


@query("j19_identity_collisions", ctes("users") + """, ids AS (
    SELECT id AS user_id, lower(username) AS identity FROM users UNION SELECT id, lower(email) FROM users),
  own AS (SELECT identity, min(user_id) AS owner_id FROM ids GROUP BY identity)
  SELECT identity, user_id, owner_id FROM ids JOIN own USING (identity) WHERE user_id > owner_id""")
def j19(spark, sf):
    return jobs.identity_collisions(frame(spark, sf, "users"))


@query("j20_redeem_invites", ctes("invites", "redemptions") + """, m AS (SELECT r.*, max_uses, used_count,
    coalesce(max_uses IS NOT NULL AND revoked_at IS NULL AND expires_at > redeemed_at, false) AS live
    FROM redemptions r LEFT JOIN invites USING (token_hash)),
  n AS (SELECT *, row_number() OVER (PARTITION BY token_hash, live ORDER BY redeemed_at, attempt_id) AS place FROM m)
  SELECT token_hash, attempt_id, live, place, coalesce(live AND place <= max_uses - used_count, false) AS accepted FROM n""")
def j20(spark, sf):
    out = jobs.redeem_invites(frame(spark, sf, "invites"), frame(spark, sf, "redemptions"), F.date_trunc("day", "redeemed_at"))
    return out.select("token_hash", "attempt_id", "live", F.col("place").cast("long").alias("place"),
                      F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("w13_latest_log", ctes("job_log") + """ SELECT job_id, ordinal, message, value FROM job_log
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ordinal DESC) <= 600""")
def w13(spark, sf):
    return jobs.latest_log(frame(spark, sf, "job_log"))


W14 = ctes("progress") + """, s AS (SELECT *, lag(is_start) OVER w AS prev_start, lag(ts) OVER w AS prev_ts,
    lead(id) OVER w AS next_id FROM progress WINDOW w AS (PARTITION BY job_id, task_id ORDER BY ts, id)),
  failed AS (SELECT job_id, max(ts) AS failed_at FROM progress GROUP BY job_id)
  SELECT job_id, task_id, id, node, CASE WHEN interrupted THEN 'waiting'
      WHEN has_error OR coalesce(result_status, '') = 'failed' OR node = 'failed' THEN 'error'
      WHEN coalesce(result_status, '') LIKE 'stopped%' OR node LIKE 'stopped\\_%' ESCAPE '\\' THEN 'warning'
      ELSE 'completed' END AS phase,
    round(CASE WHEN prev_start THEN (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 ELSE 0.0 END, 1) AS duration_seconds
  FROM s WHERE NOT is_start
  UNION ALL SELECT job_id, task_id, id, node, 'error', round(greatest((epoch_us(failed_at) - epoch_us(ts)) / 1e6, 0.0), 1)
  FROM s JOIN failed USING (job_id) WHERE is_start AND next_id IS NULL"""


@query("w14_stage_durations", W14)
def w14(spark, sf):
    progress = frame(spark, sf, "progress")
    failed = progress.groupBy("job_id").agg(F.max("ts").alias("failed_at"))
    return jobs.stage_durations(progress, F.date_trunc("day", "ts"), failed)


@query("w11_conversation_window", ctes("messages") + """, d AS (SELECT *, count(*) FILTER (role <> 'system')
    OVER (PARTITION BY conv_id) > 4 AS trimmed,
    row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS rn FROM messages)
  SELECT conv_id, CAST(trimmed AND role <> 'system' AS INT) AS segment, turn, role, text, trimmed FROM d
  WHERE role = 'system' OR rn <= 4""")
def w11(spark, sf):
    return chat.conversation_window(frame(spark, sf, "messages"), 2)


@query("w12_summary_triggers", ctes("messages") + """ SELECT conv_id, turn,
    CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dialogue_count,
    dialogue_count % 4 = 0 AS summary_due FROM messages""")
def w12(spark, sf):
    out = chat.summary_triggers(frame(spark, sf, "messages"), 2, F.floor(F.col("turn") / 4096))
    return out.select("conv_id", "turn", "dialogue_count", "summary_due")


@query("a25_session_turns", """SELECT conv_id, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY conv_id""")
def a25(spark, sf):
    return chat.session_turns(frame(spark, sf, "messages"))
