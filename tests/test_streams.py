"""State of streams: links as sets, restarts, an initial state, targets that aren't seen any more."""

import datetime

from pagetide.streaming import observations as ST

SCHEMA = "target_id string, seq long, sha256 string, accepted boolean, links array<string>, ts timestamp"


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def run(spark, folder, batches, name, **options):
    """Each batch is one run of the stream on the same checkpoint."""
    rows = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/{name}-in").withWatermark("ts", "1 day")
        q = ST.change_status(stream, **options).writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-log")
        q.trigger(availableNow=True).start().awaitTermination()
        rows = [tuple(r) for r in spark.read.schema(ST.CHANGES).parquet(f"{folder}/{name}-out").collect()]
    return sorted(rows, key=lambda r: (r[0], r[1] is None, r[1]))


ROWS = [
    ("a", 1, "A", False, ["x", "y"], at(0)),
    ("a", 2, "A", False, ["y", "x", "y", None], at(1)),  # another order: no change
    ("a", 3, "A", False, ["x", "z"], at(2)),
    ("a", 4, "A", True, ["x", "z"], at(3)),
    ("a", 5, "A", False, ["z", "x"], at(4)),
    ("a", 6, "B", False, ["x"], at(5)),
    ("a", 7, "A", True, ["z", "x"], at(6)),
    ("b", 1, None, None, None, at(0)),
    ("b", 2, None, None, [], at(1)),
    (None, 1, "A", True, ["x"], at(1)),
]
WANT = [
    ("a", 1, "baseline", 2, 0), ("a", 2, "unchanged", 0, 0), ("a", 3, "review", 1, 1), ("a", 4, "review", 1, 1), ("a", 5, "unchanged", 0, 0),
    ("a", 6, "review", 0, 1), ("a", 7, "unchanged", 0, 0), ("b", 1, "baseline", 0, 0), ("b", 2, "unchanged", 0, 0),
]


def test_links_are_sets_and_restarts_keep_them(spark, tmp_path):
    assert run(spark, tmp_path, [ROWS[::-1]], "once") == WANT
    assert run(spark, tmp_path, [ROWS[:3], ROWS[3:5] + ROWS[7:8], ROWS[5:7] + ROWS[8:]], "restarted") == WANT


def test_initial_state(spark, tmp_path):
    initial = spark.createDataFrame([("a", "A", ["x", "y"]), ("c", "C", None)], "target_id string, sha256 string, links array<string>")
    got = run(spark, tmp_path, [ROWS[1:3] + ROWS[7:8]], "initial", initial=initial)
    assert got == [("a", 2, "unchanged", 0, 0), ("a", 3, "review", 1, 1), ("b", 1, "baseline", 0, 0)]


def test_targets_not_seen(spark, tmp_path):
    late = [("b", 3, None, None, None, at(40))]
    got = run(spark, tmp_path, [ROWS[:1] + ROWS[7:8], late, [("b", 4, None, None, None, at(41))]], "unseen", unseen_seconds=7 * 86_400)
    assert ("a", None, "unseen", 0, 0) in got and [r for r in got if r[1] is not None] == [WANT[0], WANT[7], ("b", 3, "unchanged", 0, 0), ("b", 4, "unchanged", 0, 0)]


def test_state_is_written_once_a_target_and_batch():
    """However many observations of a batch are accepted, the digest is read and written once, and only the links that differ move."""
    import pandas as pd

    from pagetide.streaming.observations import AcceptedState

    calls = []

    class Value:
        def exists(self):
            calls.append("exists")
            return False

        def get(self):
            calls.append("get")
            return None

        def update(self, row):
            calls.append(("update", *row))

    class Links:
        def keys(self):
            calls.append("keys")
            return iter(())

        def updateValue(self, key, _):
            calls.append(("add", *key))

        def removeKey(self, key):
            calls.append(("remove", *key))

    state = AcceptedState(None)
    state.digest, state.links = Value(), Links()
    n = 50
    frame = pd.DataFrame({"seq": range(n, 0, -1), "sha256": [f"d{i}" for i in range(n, 0, -1)], "links": [["a"] if i % 2 else ["b", None] for i in range(n, 0, -1)], "accepted": True})
    (out,) = state.handleInputRows(("t",), iter([frame[:20], frame[20:]]), None)
    assert out["seq"].tolist() == list(range(1, n + 1)) and out["status"].tolist() == ["baseline", *["review"] * (n - 1)]
    assert calls == ["get", ("update", "d50"), ("add", "b")]
