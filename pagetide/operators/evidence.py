"""Evidence bundles of material decisions: payloads, manifest, receipt, verified reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = "pagetide-evidence"


def ingestion_id(target_id: Column, revision: Column) -> Column:
    return F.sha2(F.concat(F.lit(f'["{TAG}",1,"'), target_id, F.lit('","'), revision, F.lit('"]')), 256)


def payloads(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """decisions(target_id, revision, material, report, diff, candidate) -> (ingestion_id, target_id, name, bytes, sha256, content), for material decisions on targets still enabled."""
    live = decisions.where("material").join(targets.where("enabled").select("target_id"), "target_id", "left_semi")
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(c), F.lit("")).alias("content")) for n, c in (("report.md", "report"), ("diff.txt", "diff"), ("candidate.txt", "candidate"))])
    rows = live.select(ingestion_id(F.col("target_id"), F.col("revision")).alias("ingestion_id"), "target_id", "revision", F.explode(each).alias("p"))
    return rows.select("ingestion_id", "target_id", "revision", "p.name", F.octet_length("p.content").cast("long").alias("bytes"), F.sha2("p.content", 256).alias("sha256"), "p.content")


def manifests(rows: DataFrame) -> DataFrame:
    """(ingestion_id, target_id, revision, manifest, manifest_sha256): name -> size and digest as canonical JSON, names in order."""
    entry = F.concat(F.lit('"'), F.col("name"), F.lit('":{"bytes":'), F.col("bytes").cast("string"), F.lit(',"sha256":"'), F.col("sha256"), F.lit('"}'))
    made = rows.groupBy("ingestion_id", "target_id", "revision").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return made.select("ingestion_id", "target_id", "revision", F.concat(F.lit("{"), F.array_join("e", ","), F.lit("}")).alias("manifest")).withColumn("manifest_sha256", F.sha2("manifest", 256))


def verify(receipts: DataFrame, rows: DataFrame) -> DataFrame:
    """receipts(ingestion_id, name, bytes, sha256) against stored payloads, digests computed anew: (ingestion_id, verdict)."""
    stored = rows.select("ingestion_id", "name", F.octet_length("content").cast("long").alias("b"), F.sha2("content", 256).alias("s"))
    both = receipts.join(stored, ["ingestion_id", "name"], "full_outer")
    fine = F.coalesce((F.col("bytes") == F.col("b")) & (F.col("sha256") == F.col("s")), F.lit(False))
    return both.groupBy("ingestion_id").agg(F.when(F.bool_and(fine), "verified").otherwise("rejected").alias("verdict"))
