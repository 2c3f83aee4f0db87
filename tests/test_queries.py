"""Registered queries against their SQL on the smallest data."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pagetide.functions import html
from pagetide.plans import queries, views

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "conversations")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["normalize_text", "credential_urls", "normalize_pages", "change_status", "added_links", "public_ipv6_filter", "targets_surplus", "sniff_content_type", "put_reviews", "run_reports", "decision_source", "report_files", "evidence_store", "delivery_ledger", "checkpoint_store", "feed_text", "stream_change_status", "stream_promote", "stream_compare_and_set", "stream_link_status", "group_targets", "finalize_reviews", "promoted_snapshots", "evidence_verify", "checkpoint_retention", "object_chunks", "feed_entries", "stream_last_checked"])
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.SQL[name])
    assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())


def test_traversal_equals_brute_force(spark):
    """Every page is a root; hubs, cycles, pages without a body, the cap and the depth."""
    import random

    from pagetide.operators import links

    rng = random.Random(4)
    n = 40
    arcs = {(a, rng.choice([0, 1, rng.randrange(n)])) for a in range(n) for _ in range(rng.randrange(5))}
    dead = {x for x in range(n) if x % 11 == 0 and x}
    edges = spark.createDataFrame([(a, b) for a, b in arcs if a != b], "parent long, child long")
    roots = spark.createDataFrame([(x,) for x in range(n)], "root long")
    docs = spark.createDataFrame([(x, True) for x in range(n) if x not in dead], "node long, ok boolean")
    got = {(r["root"], r["node"], r["depth"], r["rank"], r["status"]) for r in links.linked_documents(roots, edges, docs, depth=3, most=6).collect()}
    want = set()
    for root in range(n):
        seen, frontier, done = {root}, [(0, root)], 0
        for depth in (1, 2, 3):
            reached = {}
            for rank, node in frontier:
                for a, b in arcs:
                    if a == node and b != a and b not in seen:
                        reached[b] = min(reached.get(b, rank), rank)
            frontier = []
            for node, _ in sorted(reached.items(), key=lambda x: (x[1], x[0])):
                done += 1
                status = "omitted" if done > 6 else "error" if node in dead else "ok"
                want.add((root, node, depth, done, status))
                seen.add(node)
                if status == "ok":
                    frontier.append((done, node))
    assert got == want
    rows = links.linked_documents(roots, edges, docs, depth=3, most=6)
    sizes = spark.createDataFrame([(x, 10, 5) for x in range(n) if x not in dead], "node long, body_bytes long, text_bytes long")
    reviews = {r["root"]: r for r in links.link_reviews(rows, links.link_budget(rows, sizes)).collect()}
    for root in reviews:
        mine = [w for w in want if w[0] == root]
        assert reviews[root]["omitted"] == sum(w[4] == "omitted" for w in mine) and len(reviews[root]["documents"]) == sum(w[4] != "omitted" for w in mine)
        assert reviews[root]["incomplete"] == any(w[4] != "ok" for w in mine)


def test_unified_diff_applies_to_the_old_text(spark):
    """The lines of a diff, context and removals on one side, context and additions on the other, stand in both texts in order."""
    import random

    from pagetide.operators import compare

    rng = random.Random(9)
    rows = []
    for i in range(30):
        old = [f"line {rng.randrange(12)}" for _ in range(rng.randrange(1, 40))]
        new = [x for x in old if rng.random() > 0.2] + [f"new {rng.randrange(9)}" for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join(new) + "\n", "\n".join(old) + "\n"))
    from pyspark.sql import functions as F

    side = lambda c: spark.createDataFrame([(r[0], r[c]) for r in rows], "k int, text string").withColumn("sha256", F.sha2("text", 256))
    got = {r["k"]: r for r in compare.unified_diff(side(1), side(2), "k").collect()}
    for k, new, old in rows:
        if new == old:
            assert k not in got
            continue
        body = got[k]["diff"].split("\n")[2:]
        rebuilt, at, source = [], 0, old.splitlines()
        for line in body:
            if line.startswith("@@"):
                start = int(line.split()[1][1:].split(",")[0])
                count = int((line.split()[1].split(",") + ["1"])[1])
                upto = start - 1 if count else start
                rebuilt += source[at:upto]
                at = upto
            elif line[0] == "+":
                rebuilt.append(line[1:])
            else:
                assert source[at] == line[1:]
                at += 1
                if line[0] == " ":
                    rebuilt.append(line[1:])
        assert rebuilt + source[at:] == new.splitlines() and not got[k]["truncated"]


def test_review_texts_equal_brute_force(spark):
    """Budgets of bytes that end inside characters, errors, bodies that are too long, and what one document leaves to the next."""
    import random

    from pagetide.operators import links

    rng = random.Random(11)
    limits = {"most_bytes": 300, "each_bytes": 90, "review_bytes": 60, "text_bytes": 25}
    texts = {k: (rng.randrange(0, 100), rng.choice([None, "", "".join(rng.choice("aé€😀") for _ in range(rng.randrange(25)))])) for k in range(60)}
    found, want = [], {}
    for root in range(150):
        queue = [(rank, rng.randrange(66), rng.choice(["ok"] * 5 + ["error"])) for rank in range(1, rng.randrange(1, 16))]
        beyond = rng.choice([0, 0, 2])
        found += [(root, node, rank, status) for rank, node, status in queue] + [(root, 900 + i, 50 + i, "omitted") for i in range(beyond)]
        fetch, room, out = limits["most_bytes"], limits["review_bytes"], []
        for rank, node, status in queue:
            if fetch <= 0 or room <= 0:
                break
            allowed = min(fetch, limits["each_bytes"])
            body, text = texts.get(node, (None, None))
            if status != "ok" or body is None or body > allowed:
                fetch -= allowed
                out.append((rank, node, None, False, True))
                continue
            raw = (text or "").encode()
            kept = raw[: min(room, limits["text_bytes"])].decode(errors="ignore")
            fetch, room = fetch - body, room - len(kept.encode())
            out.append((rank, node, kept, kept != (text or ""), False))
        omitted = beyond + len(queue) - len(out)
        if queue or beyond:
            want[root] = (out, omitted, omitted > 0 or any(x[3] or x[4] for x in out))
    rows = spark.createDataFrame(found, "root long, node long, rank long, status string")
    bodies = spark.createDataFrame([(k, *v) for k, v in texts.items()], "node long, body_bytes long, text string")
    got = {r["root"]: ([tuple(x) for x in r["documents"]], r["omitted"], r["incomplete"]) for r in links.link_review_texts(rows, bodies, **limits).collect()}
    assert got == want
    assert any(a[2] == "" and b[2] for r in want.values() for a, b in zip(r[0], r[0][1:])) and links.link_review_texts(rows.limit(0), bodies).count() == 0


def test_report_files_reads_the_pages_once(spark, monkeypatch):
    calls, made = [], queries._sections
    monkeypatch.setattr(queries, "_sections", lambda *a: calls.append(a) or made(*a))
    assert queries.QUERIES["report_files"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["link_budget", "link_reviews", "link_review_texts"])
def test_link_reviews_scan_the_pages_once(spark, monkeypatch, name):
    calls, scan = [], html.scanned
    monkeypatch.setattr(html, "scanned", lambda *a: calls.append(a) or scan(*a))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_scans_hold_what_separate_scans_give(spark):
    d = "/root/testdata/sf0.001"
    scanned = views.scans(spark, d)
    lines = views.texts(views.pages(spark, d)).join(views.table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("body_bytes")), "page_id")
    want = sorted(map(tuple, lines.select("page_id", "body_bytes", "text").collect()))
    assert sorted(map(tuple, scanned.select("page_id", "body_bytes", "text").collect())) == want
    edges = [sorted(map(tuple, x.collect())) for x in (views.edges(spark, d), views.edges(spark, d, scanned))]
    assert edges[0] == edges[1] and edges[0]


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    """(folder, connection): pages of more than four million pairs of lines and of lines whose diff is longer than any bound of the operators."""
    d, c = tmp_path_factory.mktemp("odd"), duckdb.connect()
    page = lambda body: f"<html><body><ul><li><a href=\"/a\">a</a></li></ul><article><h1>t</h1>{body}</article><footer>f</footer></body></html>"
    many, long = "".join(f"<p>line {i % 900}</p>" for i in range(2_100)), "".join(f"<p>{'word ' * 6_000}{i}</p>" for i in range(5))
    pages = [(3, page(many)), (4, page(many)), (8, page(long)), (13, page("<p>x</p>")), (14, page(long)), (10, page("<p>y</p>")), (11, page("<p>z</p>"))]
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, f"https://example.org/{k}", html) for k, html in pages])
    c.sql(f"COPY pages TO '{d}/pages.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["unified_diff", "change_record"])
def test_long_pages_equal_the_sql(spark, odd_pages, name):
    d, c = odd_pages
    df, want = queries.QUERIES[name](spark, d), c.sql(queries.SQL[name])
    assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())


def test_link_reviews_hold_all_that_the_links_reach(spark):
    """No document within three links of a root is left out, nor a byte of its text."""
    d = "/root/testdata/sf0.001"
    arcs, sizes = {}, {}
    for r in views.edges(spark, d).collect():
        arcs.setdefault(r["parent"], []).append(r["child"])
    for r in views.bodies(views.scans(spark, d)).collect():
        sizes[r["node"]] = r["text_bytes"]
    want = {}
    for root in arcs:
        seen, frontier, documents = {root}, [root], []
        for _ in range(3):
            found = dict.fromkeys(x for parent in frontier for x in sorted(arcs.get(parent, ())) if x not in seen)
            documents += found
            seen |= set(found)
            frontier = [x for x in found if x in sizes]
        want[root] = [(rank, x, "ok" if x in sizes else "error", sizes.get(x, 0), False) for rank, x in enumerate(documents, 1)]
    got = {r["root"]: r for r in queries.QUERIES["link_reviews"](spark, d).collect()}
    assert {root: [tuple(x) for x in r["documents"]] for root, r in got.items()} == want and max(map(len, want.values())) > 20
    for root, r in got.items():
        assert (r["n_documents"], r["omitted"]) == (len(want[root]), 0) and r["incomplete"] == any(x[2] == "error" for x in want[root])


@pytest.fixture(scope="module")
def empty_pages(tmp_path_factory):
    """(folder, connection): pages without HTML, with empty HTML or without text, today or in both versions, among others."""
    d, c = tmp_path_factory.mktemp("empty"), duckdb.connect()
    pages = [(k, f"https://example.org/{k}", html) for k, html in enumerate(([None, "", "<html></html>", "<p>text</p>"] * 5))]
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    c.sql(f"COPY pages TO '{d}/pages.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["normalize_pages", "change_status", "change_record", "link_set_compare"])
def test_empty_pages_equal_the_sql(spark, empty_pages, name):
    d, c = empty_pages
    df, want = queries.QUERIES[name](spark, d), c.sql(queries.SQL[name])
    assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())
