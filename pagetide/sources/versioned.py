"""Tables whose every change is one commit: folders of changed rows, and a numbered manifest that names the live ones.

A writer reads version v, writes its changed rows beside the table and renames a manifest to v + 1. A name that is taken
means that another writer came first: nothing of the table has changed, and the writer merges anew with what is there.
A repeated or lost task leaves at most a folder that no manifest names, which `vacuum` removes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer has made the version that this one wanted to make."""


class VersionedTable:
    """Rows with one key column below `path`; `schema` is DDL text. The highest `_version` of a key is its row."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "target_id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    # ---- reading

    def manifest(self) -> dict:
        """{version, folders: [[name, rows]] from old to new, writers: {name: last batch}} of the newest version."""
        versions = [int(name) for name, _ in self._children("log") if name.isdigit()]
        return self._read(max(versions)) if versions else {"version": 0, "folders": [], "writers": {}}

    def read(self, manifest: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of `keys` alone if given."""
        rows = self._latest((manifest or self.manifest())["folders"], keys)
        return rows.drop("_version")

    def _latest(self, folders: list, keys: DataFrame | None = None) -> DataFrame:
        schema = self.schema + ", _version long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{name}" for name, _ in folders])
        if keys is not None:
            rows = rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        if len(folders) == 1:  # keys are unique inside a folder
            return rows
        others = [c for c in rows.columns if c not in (self.key, "_version")]
        newest = rows.groupBy(self.key).agg(F.max("_version").alias("_version"), F.max_by(F.struct(*others), "_version").alias("r"))
        return newest.select(*[F.col(f"r.{c}").alias(c) if c in others else F.col(c) for c in rows.columns])

    # ---- writing

    def update(self, batch: DataFrame, merge: Merge, writer: str | None = None, number: int = 0, attempts: int = 8) -> int:
        """Commit merge(rows of the batch's keys, batch), which returns changed rows only, one a key; the table's version then.

        Reads the batch's keys, writes its changed rows. A `writer` numbers its batches: one that is done already changes
        nothing. After a conflict the merge runs again on the new rows, so that it sees what the other writer did.
        """
        for _ in range(attempts):
            now = self.manifest()
            if writer is not None and now["writers"].get(writer, -1) >= number:
                return now["version"]
            folder = self._write(merge(self.read(now, batch), batch).withColumn("_version", F.lit(now["version"] + 1).cast("long")))
            writers = now["writers"] | ({writer: number} if writer is not None else {})
            if not folder[1]:
                self._delete(f"data/{folder[0]}")
                if writer is None:
                    return now["version"]
            try:
                return self.commit(now["version"], now["folders"] + ([folder] if folder[1] else []), writers)
            except Conflict:
                self._delete(f"data/{folder[0]}")
        raise Conflict(f"{attempts} attempts lost")

    def commit(self, base: int, folders: list, writers: dict) -> int:
        """Make version base + 1; raises Conflict if there is one already.

        A rename onto a folder that exists fails in HDFS. On file systems that check and rename in two steps both may seem to
        win, so the manifest is read back and counts only for the writer whose id it holds. Object stores without an atomic
        rename need a committer of their own.
        """
        own = uuid.uuid4().hex
        body = json.dumps({"version": base + 1, "folders": folders, "writers": writers, "id": own})
        draft = f"{self.path}/log/.draft-{own}"
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(draft)
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf())
        try:
            context.rename(self._path(f"log/.draft-{own}"), self._path(f"log/{base + 1}"), options)
        except Py4JJavaError as e:
            self._delete(f"log/.draft-{own}")
            if not self._exists(f"log/{base + 1}"):
                raise
            raise Conflict(f"version {base + 1} exists") from e
        if self._read(base + 1)["id"] != own:
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def compact(self) -> bool:
        """Fold the newest folders into one, as long as the next older one has at most twice their rows.

        So a row is written again a number of times that grows with the logarithm of the table, and so does the number of
        folders. A compaction that loses to a writer is left to the next one.
        """
        now = self.manifest()
        rest, taken = list(now["folders"]), []
        while rest and (not taken or rest[-1][1] <= 2 * sum(n for _, n in taken)):
            taken.append(rest.pop())
        if len(taken) < 2:
            return False
        folder = self._write(self._latest(taken[::-1]))
        try:
            self.commit(now["version"], rest + [folder], now["writers"])
        except Conflict:
            self._delete(f"data/{folder[0]}")
            return False
        return True

    def vacuum(self, keep: int = 3, grace_seconds: float = 86_400) -> int:
        """Remove manifests before the newest `keep` and folders that none of these names; how many folders went.

        Younger ones than the grace stay: a writer may be about to commit them, or a reader of an old version still read them.
        """
        versions = sorted(int(name) for name, _ in self._children("log") if name.isdigit())
        if not versions:
            return 0
        limit = (time.time() - grace_seconds) * 1000
        named = {name for v in versions[-keep:] for name, _ in self._read(v)["folders"]}
        stale = [name for name, at in self._children("data") if name not in named and at < limit]
        for name, at in self._children("log"):
            if at < limit and (name.startswith(".draft-") or (name.isdigit() and int(name) in versions[:-keep])):
                self._delete(f"log/{name}")
        for name in stale:
            self._delete(f"data/{name}")
        return len(stale)

    def _write(self, rows: DataFrame) -> list:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return [name, self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}").count()]

    # ---- files

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path("").getFileSystem(self._conf())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _children(self, name: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of the folders below a folder, none if there is no such folder."""
        if not self._exists(name):
            return []
        found = self._fs().listStatus(self._path(name))
        return [(f.getPath().getName(), f.getModificationTime()) for f in found if f.isDirectory()]

    def _read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{version}", wholetext=True).first()[0])
