"""Job queues, workers and index versions as queries over their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_seconds(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", ts, now)


def backoff(attempt: Column) -> Column:
    """Seconds to wait before the next attempt."""
    return F.least(F.lit(300), 15 * F.pow(F.lit(2), attempt)).cast("bigint")


def liveness(age: Column, online: int, degraded: int) -> Column:
    return F.when(age <= online, "ONLINE").when(age <= degraded, "DEGRADED").otherwise("OFFLINE")


def recover(jobs: DataFrame, expired: Column, cancelled: Column, attempts_left: Column) -> DataFrame:
    """Running jobs whose lease is over, with the state that they go to."""
    return jobs.where(expired).withColumn("next_state", F.when(cancelled, "CANCELLED").when(attempts_left, "QUEUED").otherwise("FAILED"))


def retention(versions: DataFrame, state: str, created: str, key: str, keep: int, young: Column) -> DataFrame:
    """Which index versions may go: not the active one, the newest retired ones or young failures."""
    # ``keep`` rows
    newest = versions.where(F.col(state) == "RETIRED").orderBy(F.desc(created), F.desc(key)).limit(keep).select(key, F.lit(True).alias("newest"))
    held = (F.col(state) == "ACTIVE") | F.col("newest").isNotNull() | ((F.col(state) == "FAILED") & young)
    return versions.join(F.broadcast(newest), key, "left").withColumn("action", F.when(held, "KEEP").otherwise("DELETE")).drop("newest")


def resolve_mode(requested: Column, initial_completed: Column) -> Column:
    """AUTO becomes INCREMENTAL after a completed first ingestion and INITIAL before it; others stay."""
    return F.when(requested != "AUTO", requested).when(initial_completed, "INCREMENTAL").otherwise("INITIAL")


def merge_heartbeats(leases: DataFrame, beats: DataFrame, job: str, worker: str, seconds: int) -> DataFrame:
    """leases (job, worker, heartbeat_at, lease_expires_at) after beats (job, worker, at): neither time goes back.

    Only beats of the worker that holds the job count.
    """
    last = beats.groupBy(job, worker).agg(F.max("at").alias("at"))
    rows = leases.join(last, [job, worker], "left")
    ends = F.col("at") + F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumns({"heartbeat_at": F.greatest("heartbeat_at", "at"), "lease_expires_at": F.greatest(F.col("lease_expires_at"), ends)}).drop("at")


def account_changes(users: DataFrame, changes: DataFrame, user: str, admin_role: str) -> DataFrame:
    """users (user, role, status, version) after changes (user, actor, new_role, block), with outcome and sessions_revoked.

    Nobody changes or blocks themselves, and changes that would leave no active administrator are
    refused; a blocked account stays as it is.  Each real change raises the account's version and
    revokes its sessions.
    """
    admins = F.col("role").eqNullSafe(F.lit(admin_role)) & (F.col("status") == "ACTIVE")
    rows = users.join(changes.withColumnRenamed("actor", "__actor"), user, "left").withColumn("__admin", admins)
    lowers = F.col("__admin") & (F.coalesce(F.col("new_role") != admin_role, F.lit(False)) | F.coalesce("block", F.lit(False)))
    # one row: active administrators, and how many of them would remain
    left = rows.agg(F.count_if(F.col("__admin") & ~lowers).alias("__left"))
    rows = rows.join(F.broadcast(left))
    asked = F.col("__actor").isNotNull()
    blocks = F.coalesce("block", F.lit(False))
    outcome = (
        F.when(~asked, "NONE").when(F.col("__actor") == F.col(user), "SELF").when(lowers & (F.col("__left") < 1), "LAST_ADMIN")
        .when(blocks & (F.col("status") == "BLOCKED"), "UNCHANGED").otherwise("CHANGED")
    )
    rows = rows.withColumn("outcome", outcome)
    done = F.col("outcome") == "CHANGED"
    return rows.select(
        user, F.when(done & F.col("new_role").isNotNull(), F.col("new_role")).otherwise(F.col("role")).alias("role"), F.when(done & blocks, "BLOCKED").otherwise(F.col("status")).alias("status"),
        (F.col("version") + done.cast("int")).alias("version"), "outcome", done.alias("sessions_revoked"),
    )


def window_counts(events: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Events of the key in the ``seconds`` up to and including each."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    return F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0))
