"""Tables in files that other runs read back: decisions, reports, evidence, deliveries, checkpoints.

Reports and manifests replace whole partitions by the data's own keys. Evidence and deliveries are appended, and readers drop the
rows that a repeated write adds. Checkpoint objects are appended only where they aren't stored yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.operators import checkpoint, evidence
from pagetide.operators.reviews import REVISION, TARGET_ID

DECISION = "target_id string, revision string, material boolean, report string"
PAYLOAD = "target_id string, revision string, name string, bytes long, sha256 string, content string, ingestion_id string"
RECEIPT = "name string, bytes long, sha256 string, ingestion_id string"
DELIVERY = "run_id string, sha256 string, delivered_at timestamp"


def read_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decisions from JSON lines: (valid, quarantined with `problems`). A line that is no JSON object, lacks a field, has an odd id or a material decision without a report is set aside and stops nothing."""
    rows = spark.read.schema(DECISION + ", __line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").json(path)
    rules = {
        "json": F.col("__line").isNotNull(),
        "target_id": ~F.coalesce(F.col("target_id").rlike(TARGET_ID), F.lit(False)),
        "revision": ~F.coalesce(F.col("revision").rlike(REVISION), F.lit(False)),
        "material": F.col("material").isNull(),
        "report": F.coalesce(F.col("material"), F.lit(False)) & F.coalesce(F.trim("report") == "", F.lit(True)),
    }
    found = rows.withColumn("problems", F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])), ","))
    valid = found.where("problems = ''").select("target_id", "revision", "material", "report")
    return valid, found.where("problems <> ''").select("target_id", "problems")


def write_reports(reports: DataFrame, path: str) -> None:
    """One text below run_id=<id> for each run; a run written again replaces its own text alone."""
    rows = reports.select("run_id", F.col("report").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\x00").partitionBy("run_id").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, report)"""
    return spark.read.option("lineSep", "\x00").schema("value string, run_id string").text(path).select("run_id", F.col("value").alias("report"))


def write_evidence(payloads: DataFrame, path: str) -> None:
    """Payloads and their receipts, by the first two digits of the bundle's id; receipts come last, so that a bundle without one isn't complete."""
    for name, columns in (("payloads", PAYLOAD), ("receipts", RECEIPT)):
        rows = payloads.select(*[c.split()[0] for c in columns.split(", ")]).withColumn("part", F.substring("ingestion_id", 1, 2))
        rows.write.mode("append").partitionBy("part").parquet(f"{path}/{name}")


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, verdicts): repeated writes count once; a verdict is `verified` if all payloads are there and give their receipts' sizes and digests."""
    payloads = spark.read.schema(PAYLOAD + ", part string").parquet(f"{path}/payloads").drop("part").dropDuplicates(["ingestion_id", "name", "sha256"])
    receipts = spark.read.schema(RECEIPT + ", part string").parquet(f"{path}/receipts").drop("part").distinct()
    return payloads, evidence.verify(receipts, payloads)


def record_deliveries(reports: DataFrame, path: str, at: str) -> None:
    """Append what was delivered, (run_id, sha256), to the ledger; `at` is the time as text."""
    reports.select("run_id", "sha256", F.lit(at).cast("timestamp").alias("delivered_at")).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, sha256) of each run's last delivery."""
    rows = spark.read.schema(DELIVERY).parquet(path)
    return rows.groupBy("run_id").agg(F.max_by("sha256", F.struct("delivered_at", "sha256")).alias("sha256"))


OBJECT = "sha256 string, size long, content string, born long"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table's rows, none before its first write."""
    fs, p = _folder(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def write_checkpoint(manifest: DataFrame, objects: DataFrame, path: str) -> None:
    """Add a checkpoint: objects that aren't stored yet below the generation that brings them, then the manifest below its generation.

    Objects come first, so that a manifest never names what isn't there. A repeated write finds its objects and replaces
    its manifest by the same rows. Objects in folders that retention has marked count as absent and are written again.
    """
    spark = manifest.sparkSession
    held = _stored(spark, f"{path}/objects", OBJECT).join(_stored(spark, f"{path}/retired", "born long").distinct(), "born", "left_anti")
    fresh = objects.select("sha256", "size", "content").dropDuplicates(["sha256", "size"]).join(held.select("sha256", "size"), ["sha256", "size"], "left_anti")
    born = manifest.agg(F.max("generation")).first()[0]
    if born is None:
        return
    fresh.withColumn("born", F.lit(born).cast("long")).write.mode("append").partitionBy("born").parquet(f"{path}/objects")
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{path}/manifests")


def read_checkpoint(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """The files of a generation, (path, content, intact), digests computed anew."""
    manifest = spark.read.parquet(f"{path}/manifests").where(F.col("generation") == generation)
    objects = _stored(spark, f"{path}/objects", OBJECT).drop("born").dropDuplicates(["sha256", "size"])
    return checkpoint.restore(manifest, objects)


def mark_retired(spark: SparkSession, path: str, keep: int = checkpoint.KEEP) -> list[int]:
    """First phase of retention: mark all generations but the newest `keep`; nothing is removed yet. The marked generations.

    From now on no checkpoint relies on objects that these brought. Let at least the longest time that writing a checkpoint takes
    go by before `sweep_retired`, so that those begun before the mark are there to be seen.
    """
    generations = spark.read.parquet(f"{path}/manifests").select("generation").distinct()
    kept = generations.orderBy(F.desc("generation")).limit(keep)
    gone = generations.join(F.broadcast(kept), "generation", "left_anti").select(F.col("generation").cast("long").alias("born"))
    new = gone.join(_stored(spark, f"{path}/retired", "born long"), "born", "left_anti")
    new.coalesce(1).write.mode("append").parquet(f"{path}/retired")
    return sorted(r[0] for r in gone.collect())


def sweep_retired(spark: SparkSession, path: str) -> None:
    """Second phase: objects of marked generations that another manifest names move on, then the marked folders go.

    What manifests name is read again here, so that a checkpoint written since the mark keeps its objects. Copies are made
    before anything goes and only of objects that no other folder holds: a sweep that stops halfway is done again from where it was.
    A sweep doesn't touch generations marked later, nor folders that are there no more.
    """
    retired = _stored(spark, f"{path}/retired", "born long").distinct()
    marks = sorted(r[0] for r in retired.collect())
    manifests = spark.read.parquet(f"{path}/manifests").withColumn("generation", F.col("generation").cast("long"))
    live = manifests.join(F.broadcast(retired), F.col("generation") == F.col("born"), "left_anti")
    oldest = live.agg(F.min("generation")).first()[0]
    if oldest is None or not marks:
        return
    objects = _stored(spark, f"{path}/objects", OBJECT)
    named = live.where("inline_text IS NULL").select("sha256", "size").distinct()
    safe = objects.where(~F.col("born").isin(marks)).select("sha256", "size")
    moving = objects.where(F.col("born").isin(marks)).dropDuplicates(["sha256", "size"]).join(named, ["sha256", "size"], "left_semi").join(safe, ["sha256", "size"], "left_anti")
    moving.withColumn("born", F.lit(oldest).cast("long")).write.mode("append").partitionBy("born").parquet(f"{path}/objects")
    for born in marks:
        for name in (f"manifests/generation={born}", f"objects/born={born}"):
            fs, p = _folder(spark, f"{path}/{name}")
            fs.delete(p, True)
