"""Outcomes of checks and observation times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS = ("baseline_created", "unchanged", "review")


def route_fetch(status: Column, length: Column | None = None, declared: Column | None = None) -> Column:
    """What follows from an HTTP status: `ok`, `agent_fetch_required` for 403, else `error`; a body of another length than declared is an error."""
    out = F.when(status.between(200, 299), "ok").when(status == 403, "agent_fetch_required").otherwise("error")
    return F.when((out == "ok") & declared.isNotNull() & (length != declared), "error").otherwise(out) if declared is not None else out


def check_outcomes(targets: DataFrame, pending: DataFrame, statuses: DataFrame) -> DataFrame:
    """One compact row a target: (target_id, action, retained, first_row), in order of retained reviews first, then configuration.

    A target with an open review is `review` and retained; a disabled one `skipped`; of the others the status decides:
    baseline -> baseline_created, unchanged -> unchanged, changed -> review, none -> error.
    """
    held = pending.select("target_id", F.lit(True).alias("held"))
    joined = targets.select("target_id", "first_row", "enabled").join(held, "target_id", "left").join(statuses.select("target_id", "status"), "target_id", "left")
    action = (
        F.when(F.col("held"), "review")
        .when(~F.col("enabled"), "skipped")
        .when(F.col("status") == "baseline", "baseline_created")
        .when(F.col("status") == "changed", "review")
        .when(F.col("status") == "unchanged", "unchanged")
        .otherwise("error")
    )
    return joined.select("target_id", action.alias("action"), F.coalesce("held", F.lit(False)).alias("retained"), "first_row").orderBy(F.desc("retained"), "first_row")


def outcome_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by, "action").agg(F.count("*").alias("n"))


def observation_status(events: DataFrame, snapshots: DataFrame, records: DataFrame) -> DataFrame:
    """(target_id, last_checked_at, baseline_updated_at).

    events(target_id, ts, action): the last successful check, which late rows can't move back. records(target_id, sha256,
    version, updated_at, stage): a promotion time counts only if the snapshot still has its digest and version, `prepared`
    records before `settled` ones.
    """
    checked = events.groupBy("target_id").agg(F.max(F.when(F.col("action").isin(*SUCCESS), F.col("ts"))).alias("last_checked_at"))
    bound = records.join(snapshots.select("target_id", "sha256", "version"), ["target_id", "sha256", "version"])
    pick = bound.groupBy("target_id").agg(F.max(F.when(F.col("stage") == "prepared", F.col("updated_at"))).alias("p"), F.max(F.when(F.col("stage") == "settled", F.col("updated_at"))).alias("s"))
    return checked.join(pick, "target_id", "left").select("target_id", "last_checked_at", F.coalesce("p", "s").alias("baseline_updated_at"))


def merge_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status table after a batch: times only move forward."""
    both = old.unionByName(new)
    return both.groupBy("target_id").agg(F.max("last_checked_at").alias("last_checked_at"), F.max("baseline_updated_at").alias("baseline_updated_at"))
