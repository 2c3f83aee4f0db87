"""Commits, conflicts, replays, compaction and removal in versioned tables."""

import pytest
from pyspark.sql import functions as F

from pagetide.sources.versioned import Conflict, VersionedTable
from pagetide.streaming import observations as ST

SCHEMA = ST.SNAPSHOTS


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)


def offers(spark, *rows):
    return spark.createDataFrame(list(rows), "target_id string, seq long, sha256 string, expected_sha256 string")


def state(table):
    return {r["target_id"]: tuple(r)[1:] for r in table.read().collect()}


def test_compare_and_set_in_order_and_replay(spark, table):
    first = offers(spark, ("a", 2, "B", "A"), ("a", 1, "A", None), ("a", 3, "B", "A"), ("a", 4, "C", "A"), ("b", 1, "X", "Y"), (None, 1, "X", None), ("c", 1, None, None))
    assert table.update(first, ST.promoted, "w", 0) == 1
    want = {"a": ("B", 2, 1, 1), "b": (None, 0, 0, 1)}
    assert state(table) == want
    assert table.update(first, ST.promoted, "w", 0) == 1 and state(table) == want  # the same batch again
    assert table.update(offers(spark, ("b", 2, "X", None), ("d", 1, "D", None)), ST.promoted, "w", 1) == 2
    assert state(table) == want | {"b": ("X", 1, 0, 1), "d": ("D", 1, 0, 0)}
    assert table.update(first.limit(0), ST.promoted) == 2  # nothing to commit


def test_two_writers_from_one_version(spark, table):
    table.update(offers(spark, ("a", 1, "A", None), ("z", 1, "Z", None)), ST.promoted)
    base = table.manifest()
    table.update(offers(spark, ("a", 2, "B", "A")), ST.promoted)
    with pytest.raises(Conflict):
        table.commit(base["version"], base["folders"], {})
    assert state(table)["a"][0] == "B"

    ran = []

    def overtaken(now, batch):
        if not ran:
            table.update(offers(spark, ("a", 3, "C", "B")), ST.promoted)
        ran.append(1)
        return ST.promoted(now, batch)

    table.update(offers(spark, ("a", 4, "D", "B"), ("z", 4, "Y", "Z")), overtaken)
    assert len(ran) == 2  # the first merge came too late and ran again, on what the other had left
    assert state(table) == {"a": ("C", 3, 0, 1), "z": ("Y", 2, 0, 0)}


def test_small_batches_write_few_rows(spark, table):
    n = 20_000
    base = spark.range(n).select(F.col("id").cast("string").alias("target_id"), F.lit(1).cast("long").alias("seq"), F.lit("A").alias("sha256"), F.lit(None).cast("string").alias("expected_sha256"))
    table.update(base, ST.promoted)
    written = 0
    for k in range(6):
        table.update(base.where(f"target_id % {n // 10} = {k}").withColumn("sha256", F.lit("B")).withColumn("expected_sha256", F.lit("A")), ST.promoted)
        written += table.manifest()["folders"][-1][1]
        if table.compact():
            written += table.manifest()["folders"][-1][1]
    assert written <= 10 * 6 * 4 and len(table.manifest()["folders"]) <= 4
    assert {(r["sha256"], r["version"], r["n"]) for r in table.read().groupBy("sha256", "version").agg(F.count("*").alias("n")).collect()} == {("A", 1, n - 60), ("B", 2, 60)}
    before = state(table)
    assert table.vacuum(keep=1) == 0  # all young
    assert table.vacuum(keep=1, grace_seconds=-5) > 0 and state(table) == before
    assert table.vacuum(keep=1, grace_seconds=-5) == 0 and table.manifest()["folders"]


def test_empty_table(spark, table):
    assert table.read().count() == 0 and not table.compact() and table.vacuum() == 0
