"""Streams of observations: change status by key, promotions, last checks, repeated observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from pagetide.operators.status import merge_status
from pagetide.sources.versioned import VersionedTable


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "target_id string, seq long, status string, links_added long, links_removed long"


class AcceptedState(StatefulProcessor):
    """The accepted digest of a target and the set of its accepted link identities."""

    def __init__(self, unseen_ms: int | None):
        self.unseen_ms = unseen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.digest = handle.getValueState("digest", "sha256 string")
        self.links = handle.getMapState("links", "identity string", "seen boolean")

    def _links(self) -> set[str]:
        return {k[0] for k in self.links.keys()}

    def _accept(self, digest: str | None, links: set[str], before: set[str]) -> None:
        self.digest.update((digest,))
        for identity in before - links:
            self.links.removeKey((identity,))
        for identity in links - before:
            self.links.updateValue((identity,), (True,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for digest, links in zip(initialState["sha256"], initialState["links"], strict=True):
            self._accept(digest, _identities(links), self._links())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        columns = [[x for f in frames for x in f[c]] for c in ("seq", "sha256", "links", "accepted")]
        held = self.digest.get()  # a call to the JVM, as is each use of state: few a target, whatever its rows
        first, known, before = held is None, None if held is None else held[0], set() if held is None else self._links()
        links, taken_over, out = before, False, []
        for seq, digest, offered, taken in sorted(zip(*columns, strict=True), key=_in_order):
            now = _identities(offered)
            added, removed = len(now - links), len(links - now)
            status = "baseline" if first else "unchanged" if digest == known and not added and not removed else "review"
            out.append((seq, status, added, removed))
            if first or (taken and status == "review"):
                first, taken_over, known, links = False, True, digest, now
        if taken_over:
            self._accept(known, links, before)
        if self.unseen_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(max(f["seen_ms"].max() for f in frames)) + self.unseen_ms)
        numbers, statuses, added, removed = zip(*out, strict=True)
        yield pd.DataFrame({"target_id": [key[0]] * len(out), "seq": numbers, "status": statuses, "links_added": added, "links_removed": removed})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"target_id": [key[0]], "seq": pd.array([None], dtype="Int64"), "status": ["unseen"], "links_added": [0], "links_removed": [0]})

    def close(self) -> None:
        pass


def _in_order(row: tuple) -> tuple:
    """Rows by seq, then digest, nulls last."""
    seq, digest = row[0], row[1]
    none = pd.isna(seq)
    return none, 0 if none else seq, not isinstance(digest, str), digest if isinstance(digest, str) else ""


def _identities(links: object) -> set[str]:
    return set() if links is None else {x for x in links if x is not None}


def change_status(stream: DataFrame, initial: DataFrame | None = None, unseen_seconds: int | None = None) -> DataFrame:
    """stream(target_id, seq long, sha256, accepted boolean[, links array<string>][, ts]) -> CHANGES. State holds a target's accepted digest and link identities, never a text.

    The first observation makes the baseline. Later ones are compared with what was accepted last and don't change it, unless
    a decision accepts them: A, B, B is baseline, review, review. Links count as a set: another order or a repeat of them is no
    change, and `sha256` is the digest of the rest. links_added and links_removed are relative to the accepted set.
    initial(target_id, sha256, links) is what had been accepted before the stream began. With `unseen_seconds` the stream needs
    `ts` under a watermark, and a target that isn't observed for so long gives a row `unseen` without seq, once until it comes
    again. Rows of a target come in order of seq inside a batch, and are sorted together: bound a batch by the source's options.
    Null targets are left out; null digests equal each other. The session's state store is set to RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    links = F.col("links") if "links" in stream.columns else F.lit(None).cast("array<string>")
    columns = [F.col("target_id"), F.col("seq").cast("long").alias("seq"), "sha256", F.coalesce("accepted", F.lit(False)).alias("accepted"), links.alias("links")]
    if unseen_seconds is not None:
        columns += ["ts", F.unix_millis("ts").alias("seen_ms")]
    rows = stream.where("target_id IS NOT NULL").select(*columns)
    begun = None if initial is None else initial.where("target_id IS NOT NULL").select("target_id", "sha256", "links").groupBy("target_id")
    processor = AcceptedState(None if unseen_seconds is None else unseen_seconds * 1000)
    mode = "None" if unseen_seconds is None else "EventTime"
    return rows.groupBy("target_id").transformWithStateInPandas(processor, CHANGES, "Append", mode, begun)


def last_checked(stream: DataFrame) -> DataFrame:
    """stream(target_id, ts) -> target_id, last_checked_at; late rows can't move it back."""
    return stream.groupBy("target_id").agg(F.max("ts").alias("last_checked_at"))


def without_repeats(stream: DataFrame, delay: str = "31 days") -> DataFrame:
    """stream(target_id, sha256, ts) without repeated observations inside the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["target_id", "sha256"])


SNAPSHOTS = "target_id string, sha256 string, version long, repeats long, conflicts long"
STATUS = "target_id string, last_checked_at timestamp, baseline_updated_at timestamp"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a table that one of the writers below keeps."""
    return VersionedTable(spark, path, schema).read()


def promoted(now: DataFrame, candidates: DataFrame) -> DataFrame:
    """Snapshots after compare-and-set by every candidate of a target in order of seq; rows of the candidates' targets alone.

    now(SNAPSHOTS), candidates(target_id, seq, sha256[, expected_sha256]). A candidate that is there already counts in `repeats`;
    one that expected another digest than there is changes nothing and counts in `conflicts`; else it becomes the snapshot and
    `version` goes up. A null expectation means no snapshot; without the column every candidate is expected. Of equal seq the
    smaller digest comes first; rows without a target or digest count for nothing. One sort by target; a task holds one row at a time.
    """
    expects = "expected_sha256" in candidates.columns
    state = now.select("target_id", F.lit(None).cast("long").alias("seq"), "sha256", F.lit(None).cast("string").alias("expected_sha256"), "version", "repeats", "conflicts", F.lit(0).alias("kind"))
    zero = F.lit(0).cast("long")
    wanted = F.col("expected_sha256") if expects else F.lit(None).cast("string")
    fresh = candidates.where("target_id IS NOT NULL AND sha256 IS NOT NULL").select("target_id", "seq", "sha256", wanted.alias("expected_sha256"), zero.alias("version"), zero.alias("repeats"), zero.alias("conflicts"), F.lit(1).alias("kind"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = digest = None
        counts = [0, 0, 0]
        for frame in frames:
            out = []
            for key, offered, expected, version, repeats, conflicts, kind in zip(*(frame[c] for c in ("target_id", "sha256", "expected_sha256", "version", "repeats", "conflicts", "kind")), strict=True):
                if key != target:
                    if target is not None:
                        out.append((target, digest, *counts))
                    target, digest, counts = key, None, [0, 0, 0]
                if kind == 0:
                    digest, counts = offered, [version, repeats, conflicts]
                elif offered == digest:
                    counts[1] += 1
                elif expects and (expected if isinstance(expected, str) else None) != digest:
                    counts[2] += 1
                else:
                    digest = offered
                    counts[0] += 1
            yield pd.DataFrame(out, columns=["target_id", "sha256", "version", "repeats", "conflicts"])
        if target is not None:
            yield pd.DataFrame([(target, digest, *counts)], columns=["target_id", "sha256", "version", "repeats", "conflicts"])

    both = state.unionByName(fresh).repartition("target_id").sortWithinPartitions("target_id", "kind", F.asc_nulls_first("seq"), "sha256", "expected_sha256")
    return both.mapInPandas(fold, SNAPSHOTS).where((F.col("version") > 0) | (F.col("conflicts") > 0))


def promote_batches(stream: DataFrame, path: str, writer: str = "promote") -> DataStreamWriter:
    """A writer that promotes candidates batch by batch into the versioned table below `path`.

    The table remembers each writer's last batch, so a replayed batch changes nothing; give each checkpoint folder its own
    `writer`. Where another writer commits in between, the batch is compared anew with what that one left.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, SNAPSHOTS)
        table.update(batch, promoted, writer, number)
        table.compact()

    return stream.writeStream.foreachBatch(put)


def keep_last_checked(stream: DataFrame, path: str, writer: str = "last-checked") -> DataStreamWriter:
    """A writer that keeps the times of the last checks in the versioned table below `path`; late rows and replayed batches move nothing back."""

    def put(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, STATUS)
        table.update(batch.where("target_id IS NOT NULL").withColumn("baseline_updated_at", F.lit(None).cast("timestamp")), merge_status, writer, number)
        table.compact()

    return last_checked(stream).writeStream.outputMode("update").foreachBatch(put)
