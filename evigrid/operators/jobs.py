"""Job tables, accounts, progress logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import thresholds as T
from .ordering import next_row, previous_row, ranked, top_per_key

# Job states
JOB_STATES = ("pending", "ai_processing", "awaiting_input", "pending_review", "reviewed", "completed", "rejected",
              "stopped", "failed")
# Title keys in falling priority
TITLE_KEYS = ("spec_name", "device", "original_filename", "human_request")


def all_jobs(**tables: DataFrame) -> DataFrame:
    """UNION ALL of the job tables with a kind tag; later filters reach every branch."""
    union = None
    for kind, df in tables.items():
        tagged = df.select(F.lit(kind).alias("kind"), "*")
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return union


def visible_jobs(jobs: DataFrame, tenant_id: str, kind: str | None = None) -> DataFrame:
    """Rows of one tenant that are not deleted; kind None means every kind."""
    kept = jobs.where((F.col("tenant_id") == tenant_id) & F.col("deleted_at").isNull())
    return kept if kind is None else kept.where(F.col("kind") == kind)


def job_title(params: str = "package_params", kind: str = "kind") -> Column:
    """First non-empty title key of the JSON parameters, else the upper-cased kind. The JSON is parsed once."""
    parsed = F.from_json(params, ", ".join(f"{k} STRING" for k in TITLE_KEYS))
    title = F.transform(F.array(parsed), lambda p: F.coalesce(*[F.nullif(p[k], F.lit("")) for k in TITLE_KEYS]))[0]
    return F.coalesce(title, F.upper(kind))


def job_page(jobs: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """One stable page; the row after the page tells whether there are more."""
    order = [F.desc("created_at"), F.asc("kind"), F.desc("id")]
    page = jobs.orderBy(*order).offset(offset).limit(limit + 1)
    # The page is at most limit + 1 rows, so one task numbers it.
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    numbered = numbered.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return numbered.where(F.col("position") <= limit)


def stuck_jobs(jobs: DataFrame) -> DataFrame:
    """Interrupted or unsynchronised jobs to take up again, oldest first."""
    flagged = F.get_json_object("package_params", "$.projection_sync_failed") == "true"
    return (jobs.where(F.col("deleted_at").isNull() & ((F.col("status") == "ai_processing") | F.coalesce(flagged, F.lit(False))))
            .select("id", "tenant_id", "created_at").orderBy("created_at", "id"))


def status_violations(jobs: DataFrame, allowed: tuple[str, ...] = JOB_STATES) -> DataFrame:
    """Rows whose status is outside the contract."""
    return jobs.where(F.col("status").isNull() | ~F.col("status").isin(*allowed))


def identity_collisions(users: DataFrame) -> DataFrame:
    """Users whose name or address, ignoring case, already belongs to an earlier user.

    The earliest owner of each identity comes from a partial aggregate, so a name shared by very many
    users costs one summary row per map task and no pair of users is ever formed.
    """
    identity = users.select(F.col("id").alias("user_id"),
                            F.explode(F.array_distinct(F.array(F.lower("username"), F.lower("email")))).alias("identity"))
    owners = identity.groupBy("identity").agg(F.min("user_id").alias("owner_id"), F.max("user_id").alias("_last"))
    owners = owners.where(F.col("_last") > F.col("owner_id")).drop("_last")
    return identity.join(owners, "identity").where(F.col("user_id") > F.col("owner_id"))


def redeem_invites(invites: DataFrame, attempts: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Accept attempts on live invites in time order until the quota is used up."""
    joined = attempts.join(invites, "token_hash", "left")
    live = F.col("max_uses").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > F.col("redeemed_at"))
    marked = joined.withColumn("live", F.coalesce(live, F.lit(False)))
    numbered = ranked(marked, ["token_hash", "live"], [F.col("redeemed_at"), F.col("attempt_id")], bucket, "place")
    left = F.col("max_uses") - F.col("used_count")
    return numbered.withColumn("accepted", F.col("live") & (F.col("place") <= left))


def latest_log(log: DataFrame, keep: int = T.LOG_ITEMS) -> DataFrame:
    """The latest items of every job; `ordinal` gives their original order."""
    return top_per_key(log, ["job_id"], [F.desc("ordinal")], keep).drop("_rank")


def seconds_between(start: str, end: str) -> Column:
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (start, end)]
    return (micros[1] - micros[0]) / 1e6


def stage_durations(progress: DataFrame, bucket: Column | None = None, failed_at: DataFrame | None = None) -> DataFrame:
    """Pair each finish with the start just before it in the same task and classify the stage.

    A finish without a start lasts 0. With `failed_at` (job_id, failed_at), a start that nothing finishes
    becomes an error stage ending at the failure.
    """
    order = [F.col("ts"), F.col("id")]
    keys = ["job_id", "task_id"]
    seen = previous_row(progress, keys, order, bucket, {"prev_start": F.col("is_start"), "prev_ts": F.col("ts")})
    status = F.coalesce("result_status", F.lit(""))
    phase = (F.when(F.col("interrupted"), "waiting")
             .when(F.col("has_error") | (status == "failed") | (F.col("node") == "failed"), "error")
             .when(status.startswith("stopped") | F.col("node").startswith("stopped_"), "warning")
             .otherwise("completed"))
    seconds = seconds_between("prev_ts", "ts")
    done = seen.where(~F.col("is_start")).select(
        *keys, "id", "node", phase.alias("phase"),
        F.round(F.when(F.col("prev_start"), seconds).otherwise(F.lit(0.0)), 1).alias("duration_seconds"))
    if failed_at is None:
        return done
    ahead = next_row(progress, keys, order, bucket, {"next_id": F.col("id")})
    open_starts = ahead.where(F.col("is_start") & F.col("next_id").isNull()).join(failed_at, "job_id")
    waited = seconds_between("ts", "failed_at")
    return done.unionByName(open_starts.select(
        *keys, "id", "node", F.lit("error").alias("phase"),
        F.round(F.greatest(waited, F.lit(0.0)), 1).alias("duration_seconds")))


