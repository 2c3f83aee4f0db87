"""Reports merged by their markers; objects through linked pieces and back."""

from pyspark.sql import functions as F

from pagetide.operators import checkpoint, reports
from pagetide.sources import stores


def section(target, text):
    return f"{reports.START} {target} -->\n{text}\n{reports.END} {target} -->"


def test_sections_merge_into_stored_texts(spark):
    a, b = section("a", "old a"), section("b", "old b")
    texts = {
        "replace": f"# Mine\r\n\n intro \n{a}\nbetween\t\n{b}\n\n\ntail  ",
        "add": f"# Mine\n{b}\n\n",
        "half": f"{a[:-5]}",
        "swapped": f"{reports.END} a -->{reports.START} a -->",
        "twice": f"{a}\n{a}",
        "nested": a.replace("old a", b),
        "other": f"{a}\n{reports.START} b -->",
        "kept": f"{a} \n",
    }
    stored = spark.createDataFrame(list(texts.items()), "run_id string, report string")
    rows = [(r, "a", 1, " new a\n") for r in texts if r != "kept"] + [("add", "c", 2, "new c"), ("fresh", "c", 2, "second"), ("fresh", "a", 1, "first"), ("reserved", "a", 1, f"x {reports.END} a -->")]
    fresh = spark.createDataFrame(rows, "run_id string, target_id string, seq long, section string")
    got = {r["run_id"]: (r["report"], r["problem"]) for r in reports.merge_sections(stored, fresh, "# T").collect()}
    new = section("a", "new a")
    assert got["replace"] == (texts["replace"].replace(a, new), None)
    assert got["add"] == (f"# Mine\n{b}\n\n{new}\n\n{section('c', 'new c')}\n", None)
    for run, why in {"half": "half section", "swapped": "half section", "twice": "repeated section", "nested": "nested section"}.items():
        assert got[run] == (texts[run], why)
    # What is odd about another target's markers is left alone.
    assert got["other"] == (texts["other"].replace(a, new), None) and got["kept"] == (texts["kept"], None)
    assert got["fresh"] == (f"# T\n\n{section('a', 'first')}\n\n{section('c', 'second')}\n", None) and got["reserved"] == (None, "reserved marker")
    assert len(got) == len(texts) + 2


def test_objects_come_back_through_their_pieces(spark):
    contents = ["", "x", "abcdefgh", "abcdefghi", "zzzzdefgh" * 9, "é" * 33, "0123" * 4, "9999" + "0123" * 3]
    objects = checkpoint.files(spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(contents)], "path string, content string"))
    heads, pieces = checkpoint.linked_chunks(objects, 4)
    heads, pieces = spark.createDataFrame(heads.collect(), heads.schema), spark.createDataFrame(pieces.collect(), pieces.schema)
    assert {r["content"] for r in checkpoint.reassembled(heads, pieces).where("problem IS NULL").collect()} == set(contents)
    assert pieces.count() < sum(r["chunks"] for r in heads.collect())  # a shared end is stored once
    digest = {r["content"]: r["sha256"] for r in objects.collect()}

    def problems(h, p):
        return {r["sha256"]: r["problem"] for r in checkpoint.reassembled(h, p).collect() if r["problem"]}

    lost = pieces.where(F.col("index") != 1)
    assert problems(heads, lost) == {r["sha256"]: "missing piece" for r in heads.where("chunks > 1").collect()}
    assert set(problems(heads, pieces.withColumn("data", F.when(F.col("data") == F.encode(F.lit("x"), "UTF-8"), F.encode(F.lit("y"), "UTF-8")).otherwise(F.col("data")))).items()) == {(digest["x"], "broken link")}
    ring = heads.where(F.col("sha256") == digest["abcdefgh"]).first()["head"]
    assert problems(heads, pieces.withColumn("next", F.when(F.col("id") == ring, F.lit(ring)).otherwise(F.col("next")))) == {digest["abcdefgh"]: "broken link"}
    short = heads.withColumn("chunks", F.when(F.col("sha256") == digest["abcdefghi"], 2).otherwise(F.col("chunks")))
    assert problems(short, pieces) == {digest["abcdefghi"]: "extra piece"}
    other = heads.withColumn("sha256", F.when(F.col("sha256") == digest["x"], F.lit("0" * 64)).otherwise(F.col("sha256")))
    assert problems(other, pieces) == {"0" * 64: "wrong content"}
    assert checkpoint.reassembled(heads.limit(0), pieces).count() == 0


def test_retention_keeps_what_is_named(spark, tmp_path):
    path = f"file://{tmp_path}/state"

    def state(g):
        rows = [("same", "s" * 2000), ("small", f"{g}"), (f"own{g}", f"{g}" * 3000)] + [(f"late{g}", "1" * 3000)] * (g >= 5)
        return checkpoint.files(spark.createDataFrame(rows, "path string, content string"))

    def put(g):
        stores.write_checkpoint(*checkpoint.pack(state(g), g), path)

    def stored():
        return sorted((r["sha256"], r["born"]) for r in spark.read.parquet(f"{path}/objects").collect())

    def intact(g):
        return {r["path"]: r["content"] for r in stores.read_checkpoint(spark, path, g).where("intact").collect()} == {r["path"]: r["content"] for r in state(g).collect()}

    for g in (1, 2, 3, 4):
        put(g)
    before = stored()
    put(4)
    assert stored() == before and len(before) == 5  # a repeated write adds nothing, a common object is there once
    # A checkpoint that was begun before the mark and relies on an object of the first generation.
    manifest, _ = checkpoint.pack(state(5), 5)
    stores.write_checkpoint(*checkpoint.pack(state(5).where("path = 'own5'"), 5), path)
    assert stores.mark_retired(spark, path, keep=3) == [1, 2] and stores.mark_retired(spark, path, keep=3) == [1, 2]
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{path}/manifests")
    stores.sweep_retired(spark, path)
    assert all(intact(g) for g in (3, 4, 5))
    named = {r["sha256"] for g in (3, 4, 5) for r in state(g).where("size > 1024").collect()}
    assert {s for s, _ in stored()} == named and len(stored()) == len(named)  # no orphan, no copy
    after = stored()
    stores.sweep_retired(spark, path)
    assert stored() == after
    put(6)
    assert stores.mark_retired(spark, path, keep=1) == [3, 4, 5]
    put(7)  # writes the marked objects anew
    stores.sweep_retired(spark, path)
    assert intact(6) and intact(7)
