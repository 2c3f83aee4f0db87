from pyspark.sql import functions as F

from pagetide.operators import addresses, checkpoint, compare, evidence, links, reports, reviews, status, targets


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def mark(i):
    return f"[a:href:sha256:{i * 64}]\n"


def texts(spark, data):
    return spark.createDataFrame(data, "k int, text string").withColumn("sha256", F.sha2("text", 256))


def test_change_status_ignores_the_order_of_trailing_links(spark):
    new = texts(spark, [(1, "a\n"), (2, "a\n"), (3, "b\n"), (4, "t\n" + mark("b") + mark("a")), (5, mark("b") + "t\n" + mark("a"))])
    old = texts(spark, [(2, "a\n"), (3, "a\n"), (4, "t\n" + mark("a") + mark("b") + mark("a")), (5, mark("a") + "t\n" + mark("b"))])
    assert rows(compare.change_status(new, old, "k"), "k", "status") == [(1, "baseline"), (2, "unchanged"), (3, "changed"), (4, "unchanged"), (5, "changed")]


def test_line_delta_is_a_multiset(spark):
    delta = compare.line_delta(texts(spark, [(1, "a\na\nb\n")]), texts(spark, [(1, "a\nc\n")]), "k")
    assert rows(delta, "line", "change", "times") == [("a", "added", 1), ("b", "added", 1), ("c", "removed", 1)]
    assert rows(compare.bounded_line_delta(delta, "k", 2, 100), "lines_kept", "truncated") == [(2, True)]


def test_unified_diff(spark):
    (got,) = compare.unified_diff(texts(spark, [(1, "a\nb\n")]), texts(spark, [(1, "a\nc\n")]), "k").collect()
    assert got["diff"] == "--- previous\n+++ current\n@@ -1,2 +1,2 @@\n a\n-c\n+b" and not got["truncated"]
    (cut,) = compare.unified_diff(texts(spark, [(1, "a\nb\n")]), texts(spark, [(1, "a\nc\n")]), "k", most_lines=2).collect()
    assert cut["diff"] == "--- previous\n+++ current" and cut["truncated"]


def test_added_links_need_a_new_url(spark):
    cur = spark.createDataFrame([(1, "i1", "u1"), (1, "i2", "u2"), (1, "i3", "u1"), (1, "i4", "me")], "k int, identity string, fetch_url string")
    old = spark.createDataFrame([(1, "i1")], "k int, identity string")
    src = spark.createDataFrame([(1, "me")], "k int, source_url string")
    assert rows(links.added_links(cur, old, src, "k"), "fetch_url", "rank") == [("u2", 1)]


def test_traversal_visits_each_node_once_and_stops_at_the_cap(spark):
    roots = spark.createDataFrame([(0,)], "root long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 2), (2, 4), (3, 5), (4, 6)], "parent long, child long")
    docs = spark.createDataFrame([(1, True), (2, True), (4, True)], "node long, ok boolean")
    got = links.linked_documents(roots, edges, docs, depth=3, most=4)
    assert rows(got, "rank", "node", "depth", "status") == [(1, 1, 1, "ok"), (2, 2, 1, "ok"), (3, 3, 2, "error"), (4, 4, 2, "ok"), (5, 6, 3, "omitted")]


def test_target_rows(spark):
    base = {"url": "https://h/", "publisher": "", "category": "", "keywords": "", "priority": "", "enabled": ""}
    data = [{"row_no": 1, "name": "n", **base}, {"row_no": 2, **base, "name": "同上"}, {"row_no": 3, "name": "n", **base, "enabled": "no"}, {"row_no": 4, "name": "n", **base, "priority": "0"}, {"row_no": 5, **{k: " " for k in base}, "name": ""}]
    df = spark.createDataFrame(data)
    assert rows(targets.row_errors(df), "row_no", "error") == [(1, None), (2, "name: ditto"), (3, "enabled"), (4, "priority")]
    big = targets.interests(spark.createDataFrame([{"row_no": 1, "name": "n", **base, "priority": "00" + "9" * 50}])).first()
    assert big["priority_text"] == "9" * 50 and big["priority"] is None


def test_grouping_keeps_order_and_all_rows(spark):
    df = spark.createDataFrame([(3, "c", "u", True), (1, "a", "u", False), (2, "b", "v", False)], "row_no long, name string, url string, enabled boolean")
    assert rows(targets.group_targets(df), "first_row", "name", "enabled") == [(1, "c", True), (2, "b", False)]


def test_finalize(spark):
    p = spark.createDataFrame([("a", "r", False), ("b", "r", True), ("c", "r", False), ("d", "r", False)], "target_id string, revision string, diff_truncated boolean")
    d = spark.createDataFrame([("a", "r", True, "x"), ("b", "r", False, None), ("c", "q", True, "x"), ("e", "r", True, "x"), ("d", "r", True, " ")], "target_id string, revision string, material boolean, report string")
    assert rows(reviews.finalize_reviews(p, d), "target_id", "outcome") == [("a", "accepted"), ("b", "manual_review"), ("c", "revision_mismatch"), ("d", "report_missing"), ("e", "unknown")]


def test_promotion_twice_changes_nothing(spark):
    snaps = spark.createDataFrame([("a", "1", 1), ("b", "9", 1)], "target_id string, sha256 string, version long")
    cand = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", None, "2")], "target_id string, expected_sha256 string, candidate_sha256 string")
    actions, after = reviews.promote_baseline(snaps, cand)
    assert rows(actions, "target_id", "action") == [("a", "promoted"), ("b", "conflict"), ("c", "promoted")]
    again, same = reviews.promote_baseline(after, cand)
    assert rows(again, "target_id", "action") == [("a", "already"), ("b", "conflict"), ("c", "already")]
    assert rows(same, "target_id", "sha256", "version") == rows(after, "target_id", "sha256", "version") == [("a", "2", 2), ("b", "9", 1), ("c", "2", 1)]


def test_status_never_moves_back(spark):
    one = spark.createDataFrame([("a", "2024-01-02", None)], "target_id string, last_checked_at string, baseline_updated_at string")
    two = spark.createDataFrame([("a", "2024-01-01", "2024-01-01")], one.schema)
    assert rows(status.merge_status(one, two), "last_checked_at", "baseline_updated_at") == [("2024-01-02", "2024-01-01")]


def test_reports_replace_in_place(spark):
    old = spark.createDataFrame([("r", "a", 1, "A"), ("r", "b", 2, "B")], "run_id string, target_id string, seq long, section string")
    new = spark.createDataFrame([("r", "a", 9, "A2"), ("r", "c", 10, "C"), ("r", "d", 11, "x <!-- target: y -->")], old.schema)
    (got,) = reports.run_reports(reports.upsert_sections(old, new)).collect()
    assert got["n_sections"] == 3 and got["report"].index("A2") < got["report"].index("B\n") < got["report"].index("C\n")


def test_evidence_round_trip(spark):
    d = spark.createDataFrame([("a", "r", True, "rep", "d", "c"), ("b", "r", True, "rep", "d", "c"), ("c", "r", False, None, "d", "c")], "target_id string, revision string, material boolean, report string, diff string, candidate string")
    t = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "target_id string, enabled boolean")
    p = evidence.payloads(d, t)
    assert rows(evidence.verify(p.select("ingestion_id", "name", "bytes", "sha256"), p), "verdict") == [("verified",)]
    assert rows(evidence.verify(p.select("ingestion_id", "name", "bytes", "sha256"), p.withColumn("content", F.lit("x"))), "verdict") == [("rejected",)]
    assert '"candidate.txt":{"bytes":1,' in evidence.manifests(p).first()["manifest"]


def test_checkpoint_restores_exact_bytes(spark):
    files = checkpoint.files(spark.createDataFrame([("a", "x" * 5000), ("b", "x" * 5000), ("c", "small")], "path string, content string"))
    manifest, objects = checkpoint.pack(files, 1)
    assert objects.count() == 1
    assert rows(checkpoint.restore(manifest, objects), "path", "content", "intact") == [("a", "x" * 5000, True), ("b", "x" * 5000, True), ("c", "small", True)]
    assert checkpoint.pack(files, 2, manifest)[1].count() == 0
    got = rows(checkpoint.chunks(checkpoint.files(spark.createDataFrame([("p", "é" * 10000)], "path string, content string"))), "chunk", "bytes")
    assert got == [(0, 12288), (1, 7712)]


def test_retention_keeps_shared_objects(spark):
    m = spark.createDataFrame([(g, "p", 2000, f"h{g}", None) for g in range(5)] + [(4, "q", 2000, "h0", None)], "generation long, path string, size long, sha256 string, inline_text string")
    got = rows(checkpoint.retention(m), "action", "kind", "id")
    assert ("keep", "object", "h0") in got and ("delete", "object", "h1") in got and ("delete", "manifest", "0") in got and ("keep", "manifest", "2") in got


def test_manifest_problems(spark):
    m = spark.createDataFrame([("a", None), ("a/b", None), ("../x", None), ("ok", "bad\x01"), ("t", None), ("t", None)], "path string, inline_text string")
    assert rows(checkpoint.manifest_problems(m), "path", "problem") == [("../x", "unsafe"), ("a", "is a folder"), ("ok", "control characters"), ("t", "repeated")]


def test_public_addresses(spark):
    df = spark.createDataFrame([("8.8.8.8",), ("10.1.2.3",), ("192.0.0.9",), ("192.0.0.8",), ("nonsense",)], "a string")
    assert rows(addresses.public_addresses(df, "a"), "a", "public") == [("10.1.2.3", False), ("192.0.0.8", False), ("192.0.0.9", True), ("8.8.8.8", True), ("nonsense", False)]
