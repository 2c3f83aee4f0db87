"""Open reviews, decisions and the baselines that they advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.operators.targets import enabled_interests

# Forms of ids and digests.
TARGET_ID = r"^[a-z0-9](?:[a-z0-9-]{0,78}[a-z0-9])?$"
RUN_ID = r"^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}$"
REVISION = r"^[0-9a-f]{32}$"
SHA256 = r"^[0-9a-f]{64}$"


def revision_token(target_id: str = "target_id", candidate: str = "candidate_sha256", run_id: str = "run_id"):
    """A review's token: the same when a task is repeated, another for another candidate or run."""
    return F.substring(F.sha2(F.concat_ws("|", target_id, candidate, run_id), 256), 1, 32)


def targets_to_check(targets: DataFrame, pending: DataFrame) -> DataFrame:
    """Enabled targets without an open review."""
    return targets.where("enabled").join(pending.select("target_id"), "target_id", "left_anti")


def open_reviews(pending: DataFrame, targets: DataFrame) -> DataFrame:
    """Open reviews in today's context: name, url and enabled interests come from the configuration, never from the saved row.

    Targets that the configuration lacks or that have no enabled interest aren't open any more (`discarded_reviews`).
    """
    now = targets.where("enabled").select("target_id", "name", "url", enabled_interests(F.col("interests")).alias("interests"))
    return pending.drop("name", "url", "interests").join(now, "target_id")


def discarded_reviews(pending: DataFrame, targets: DataFrame) -> DataFrame:
    return pending.join(targets.where("enabled").select("target_id"), "target_id", "left_anti")


def put_review(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    """One open review a target: a fresh row replaces the whole old one."""
    return pending.join(fresh.select("target_id"), "target_id", "left_anti").unionByName(fresh)


def pending_violations(pending: DataFrame) -> DataFrame:
    """(target_id, violations): names of the rules that a stored review breaks."""
    rules = {
        "target_id": ~F.col("target_id").rlike(TARGET_ID),
        "run_id": ~F.col("run_id").rlike(RUN_ID),
        "revision": ~F.col("revision").rlike(REVISION),
        "expected_sha256": F.col("expected_sha256").isNotNull() & ~F.col("expected_sha256").rlike(SHA256),
        "candidate_sha256": ~F.col("candidate_sha256").rlike(SHA256),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return pending.select("target_id", F.array_join(broken, ",").alias("violations")).where("violations <> ''")


def finalize_reviews(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decision against open review by target: (target_id, outcome).

    `unknown` without a review, `undecided` without a decision, `revision_mismatch` for another review's token,
    `report_missing` for a material decision without a report, `manual_review` where a cut diff is called immaterial, else `accepted`.
    """
    d = decisions.select("target_id", F.col("revision").alias("decided_revision"), "material", "report")
    both = pending.select("target_id", "revision", "diff_truncated").join(d, "target_id", "full_outer")
    outcome = (
        F.when(F.col("revision").isNull(), "unknown")
        .when(F.col("decided_revision").isNull(), "undecided")
        .when(F.col("revision") != F.col("decided_revision"), "revision_mismatch")
        .when(F.col("material") & F.coalesce(F.trim("report") == "", F.lit(True)), "report_missing")
        .when(F.col("diff_truncated") & ~F.col("material"), "manual_review")
        .otherwise("accepted")
    )
    return both.select("target_id", outcome.alias("outcome"))


def promote_baseline(snapshots: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare and set: (actions, new snapshots).

    snapshots(target_id, sha256, version), candidates(target_id, expected_sha256, candidate_sha256). Already at the
    candidate: `already`, so that a repeated batch changes nothing; not at what was expected: `conflict`; else `promoted`.
    """
    s = snapshots.select("target_id", F.col("sha256").alias("now"), "version")
    joined = candidates.join(s, "target_id", "left")
    action = F.when(F.col("now") == F.col("candidate_sha256"), "already").when(~F.col("now").eqNullSafe(F.col("expected_sha256")), "conflict").otherwise("promoted")
    actions = joined.select("target_id", action.alias("action"), "candidate_sha256", (F.coalesce("version", F.lit(0)) + 1).alias("next_version"))
    moved = actions.where("action = 'promoted'").select("target_id", F.col("candidate_sha256").alias("sha256"), F.col("next_version").cast("long").alias("version"))
    kept = snapshots.select("target_id", "sha256", "version").join(moved.select("target_id"), "target_id", "left_anti")
    return actions.drop("next_version"), kept.unionByName(moved)


def receipt_retry(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Decisions that a receipt already answers: (target_id, answer): `same` if the report's digest agrees, `changed` if not, `new` without a receipt."""
    digest = F.sha2(F.coalesce("report", F.lit("")), 256)
    joined = decisions.select("target_id", "revision", digest.alias("report_sha256")).join(receipts.select("target_id", "revision", F.col("report_sha256").alias("had")), ["target_id", "revision"], "left")
    answer = F.when(F.col("had").isNull(), "new").when(F.col("had") == F.col("report_sha256"), "same").otherwise("changed")
    return joined.select("target_id", answer.alias("answer"))


def ingest_observations(observations: DataFrame, targets: DataFrame, pending: DataFrame) -> DataFrame:
    """Content obtained elsewhere, for enabled targets without an open review; plain text without a list of links is marked incomplete."""
    live = observations.join(targets.where("enabled").select("target_id"), "target_id", "left_semi").join(pending.select("target_id"), "target_id", "left_anti")
    return live.withColumn("link_evidence_incomplete", (F.col("content_type") == "text/plain") & F.col("links").isNull())
