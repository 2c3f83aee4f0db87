"""Diffs against brute force: as few edits as any, texts rebuilt from edits, hunks, long texts in gaps between anchors."""

import random

import pytest
from pyspark.sql import functions as F

from pagetide.operators import compare, diffs


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def pairs_of_texts():
    rng = random.Random(11)
    made = [([], ["a"]), (["a"], []), (["a", "b"], ["b", "a"]), (["x"] * 9, ["x"] * 4), (["a", "b", "c"], ["d", "e"])]
    for _ in range(60):
        old = [f"l{rng.randrange(rng.choice([3, 8, 60]))}" for _ in range(rng.randrange(40))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randrange(6)):
            new.insert(rng.randrange(len(new) + 1), f"l{rng.randrange(12)}")
        made.append((old, new))
    return made


def test_edits_are_as_few_as_any():
    for old, new in pairs_of_texts():
        done = diffs.script(old, new)
        assert [x for op, x in done if op != "+"] == old and [x for op, x in done if op != "-"] == new
        assert sum(op == " " for op, _ in done) == longest(old, new)


def test_rising_places():
    rng = random.Random(3)
    for n in range(9):
        for _ in range(30):
            places = rng.sample(range(20), n)
            got = [places[i] for i in diffs.rising(places)]
            assert got == sorted(got) and len(got) == longest(places, sorted(places))


@pytest.mark.parametrize("most_pairs", [diffs.MAX_PAIRS, 50])
def test_scripts_rebuild_both_texts(spark, most_pairs):
    """Under a limit of 50 most pairs are cut at anchors; what is rebuilt is the same."""
    made = pairs_of_texts()
    rows = spark.createDataFrame([(k, "".join(x + "\n" for x in new), "".join(x + "\n" for x in old)) for k, (old, new) in enumerate(made)], "k int, new_text string, old_text string")
    got = {}
    for r in diffs.edit_script(rows, "k", most_pairs).orderBy("k", "gap", "nth").collect():
        got.setdefault(r["k"], []).append((r["op"], r["line"]))
    for k, (old, new) in enumerate(made):
        done = got.get(k, [])
        assert [x for op, x in done if op != "+"] == old and [x for op, x in done if op != "-"] == new
        if most_pairs > 50 or len(old) * len(new) <= 50:
            assert sum(op == " " for op, _ in done) == longest(old, new)


def test_long_texts_hunks_and_bounds(spark):
    old = [f"line {i}" for i in range(60_000)]
    new = old[:10] + ["fresh"] + old[10:20] + old[21:50_000] + ["a", "b"] + old[50_001:]
    text = lambda a: "".join(x + "\n" for x in a)
    side = lambda *t: spark.createDataFrame(list(enumerate(t)), "k int, text string").withColumn("sha256", F.sha2("text", 256))
    now, before = side(text(new), "a\nb\n", "same\n", text(f"n{i}" for i in range(300))), side(text(old), "a\nc\n", "same\n", "o\n")
    got = {r["k"]: r for r in compare.unified_diff(now, before, "k", most_pairs=None).collect()}
    assert sorted(got) == [0, 1, 3]
    assert [x for x in got[0]["diff"].split("\n") if x[0] in "@+-"] == ["--- previous", "+++ current", "@@ -8,6 +8,7 @@", "+fresh", "@@ -18,7 +19,6 @@", "-line 20", "@@ -49998,7 +49998,8 @@", "-line 50000", "+a", "+b"]
    assert got[1]["diff"] == "--- previous\n+++ current\n@@ -1,2 +1,2 @@\n a\n-c\n+b" and not got[1]["truncated"]
    assert got[3]["truncated"] and got[3]["diff"].count("\n") == 199
    bounded = {r["k"]: r for r in compare.unified_diff(now, before, "k", most_bytes=30).collect()}
    assert bounded[0]["truncated"] and bounded[0]["diff"] == "--- previous\n+++ current\n@@ di" and bounded[1]["truncated"]


def test_change_record(spark):
    side = lambda *t: spark.createDataFrame(list(t), "k int, text string").withColumn("sha256", F.sha2("text", 256))
    mark = lambda c: f"[a:href:sha256:{c * 64}]\n"
    now = side((1, "a\n"), (2, "a\n"), (3, "b\n"), (4, "t\n" + mark("1") + mark("2")), (5, "t\n" + mark("3") + mark("1")))
    before = side((2, "a\n"), (3, "a\n"), (4, "t\n" + mark("2") + mark("1")), (5, "t\n" + mark("1")))
    got = {r["k"]: (r["status"], r["diff"], r["diff_truncated"]) for r in compare.change_record(now, before, "k").collect()}
    assert got[1] == ("baseline", "", False) and got[2] == got[4] == ("unchanged", "", False)
    assert got[3] == ("changed", "--- previous\n+++ current\n@@ -1 +1 @@\n-a\n+b", False)
    # Markers are sorted before the comparison, so that only the new one is a change.
    assert got[5][1].split("\n")[2:] == ["@@ -1,2 +1,3 @@", " t", " " + mark("1").strip(), "+" + mark("3").strip()]


@pytest.mark.parametrize("most_pairs", [0, 50, 5_000])
def test_longer_texts_are_compared_as_exactly(spark, most_pairs):
    """Beyond the limit too: repeated lines without any that a side has once, and lines of one side alone."""
    rng = random.Random(7)
    line = lambda kinds: f"l{rng.randrange(kinds)}"
    made = pairs_of_texts() + [([line(k) for _ in range(rng.randrange(1, 150))], [line(k) for _ in range(rng.randrange(1, 150))]) for k in [1, 2, 5, 400] * 10]
    for old, new in made:
        places = diffs.common(old, new, most_pairs)
        assert all(old[i] == new[j] for i, j in places) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:]))
        assert len(places) == longest(old, new)
    rows = spark.createDataFrame([(k, "".join(x + "\n" for x in new), "".join(x + "\n" for x in old)) for k, (old, new) in enumerate(made)], "k int, new_text string, old_text string")
    same = {r["k"]: r["n"] for r in diffs.edit_script(rows, "k", most_pairs).where("op = ' '").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert [same.get(k, 0) for k in range(len(made))] == [longest(*pair) for pair in made]


def test_few_equal_pairs_and_masks_made_again(monkeypatch):
    """Both ways for long texts against the table of all rows: by equal pairs of lines, and in halves with one mask kept."""
    monkeypatch.setattr(diffs, "MASK_BYTES", 1)
    rng = random.Random(8)
    for kinds, n in ((100_000, 6_000), (7, 2_100)):
        old, new = [[str(rng.randrange(kinds)) for _ in range(n)] for _ in range(2)]
        places = diffs.common(old, new)
        assert all(old[i] == new[j] for i, j in places) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:]))
        assert len(places) == len(diffs._by_rows(old, new)) > 0
