"""Views that Spark derives from the test tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import urls
from pagetide.functions.batches import small_batches
from pagetide.functions.text import normalize_whitespace
from pagetide.operators import links as links_op
from pagetide.operators import targets as targets_op


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagetide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several steps read, written once in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer files than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark, d) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "url", "html"))


def previous_pages(spark, d) -> DataFrame:
    """The accepted versions: four pages in five, of which two in four differ from today's."""
    retired = F.replace("html", F.lit("</article>"), F.lit("<p>Retired notice.</p></article>"))
    shorter = F.regexp_replace("html", r"(?s)^(.*?)<li>.*?</li>", "$1")
    k = F.col("page_id") % 5
    return pages(spark, d).where(k != 0).withColumn("html", F.when(k == 3, retired).when(k == 4, shorter).otherwise(F.col("html")))


def texts(rows: DataFrame) -> DataFrame:
    """Pages as lines; a page without HTML has an empty text."""
    return rows.select("page_id", "url", H.to_lines(F.coalesce("html", F.lit("")), F.col("url")).alias("text")).withColumn("sha256", F.sha2("text", 256))


def watched(spark, d) -> DataFrame:
    """Pages with the URL that a target has: no fragment, and one parameter that makes it unique."""
    plain = urls.strip_fragment(F.col("url"))
    url = F.concat(plain, F.when(F.contains(plain, F.lit("?")), "&").otherwise("?"), F.lit("p="), F.col("page_id").cast("string"))
    return pages(spark, d).select("page_id", url.alias("url"), F.sha2("html", 256).alias("html_sha256"))


def interests(spark, d) -> DataFrame:
    rows = watched(spark, d).select("page_id", "url", F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 3)).alias("k"))
    return rows.select(
        (F.col("page_id") * 3 + F.col("k")).alias("row_no"),
        F.concat(F.lit("interest-"), F.col("page_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("name"),
        "url",
        (F.col("k") + 1).alias("priority"),
        ((F.col("page_id") + F.col("k")) % 4 != 0).alias("enabled"),
    )


def targets(spark, d) -> DataFrame:
    return targets_op.group_targets(interests(spark, d))


def pending(spark, d) -> DataFrame:
    old = previous_pages(spark, d).select("page_id", F.sha2("html", 256).alias("expected_sha256"))
    rows = watched(spark, d).where(F.col("page_id") % 7 == 0).join(old, "page_id", "left")
    hexed = lambda p, n: F.substring(F.sha2(F.concat(F.lit(p), F.col("page_id").cast("string")), 256), 1, n)
    return rows.select(
        "page_id",
        urls.target_id(F.col("url")).alias("target_id"),
        F.concat(F.lit("20240101T000000Z-"), hexed("run-", 8)).alias("run_id"),
        hexed("rev-", 32).alias("revision"),
        "expected_sha256",
        F.col("html_sha256").alias("candidate_sha256"),
        (F.col("page_id") % 14 == 0).alias("diff_truncated"),
    )


def decisions(spark, d) -> DataFrame:
    p = pending(spark, d)
    material = F.col("page_id") % 2 == 1
    wrong = F.substring(F.sha2(F.concat(F.lit("other-"), F.col("page_id").cast("string")), 256), 1, 32)
    return p.select(
        "page_id",
        "target_id",
        F.when(F.col("page_id") % 21 == 0, wrong).otherwise(F.col("revision")).alias("revision"),
        material.alias("material"),
        F.when(material, F.concat(F.lit("## Page "), F.col("page_id").cast("string"))).alias("report"),
        "run_id",
        "candidate_sha256",
    )


def scans(spark, d) -> DataFrame:
    """Pages read once for all that the traversal's queries need of them: size of the body, text as lines, links."""
    p = pages(spark, d).select("page_id", F.octet_length("html").cast("long").alias("body_bytes"), H.scanned(F.col("html"), F.col("url")).alias("scan"))
    return kept(p.select("page_id", "body_bytes", normalize_whitespace(F.col("scan.text")).alias("text"), F.col("scan.links").alias("links")), "scans")


def edges(spark, d, scanned: DataFrame | None = None) -> DataFrame:
    """Where pages lead: their links, matched with the pages' own URLs, fragments aside. Relative links of pages lead to few
    pages, so each link also stands for the page whose number its hash gives: the graph has hubs and uneven fan-out as the links have."""
    p = table(spark, d, "pages")
    n = p.count()
    found = links_op.page_links(pages(spark, d)) if scanned is None else links_op.scanned_links(scanned.select("page_id", "links"))
    found = found.select(F.col("page_id").alias("parent"), "fetch_url", "identity")
    known = p.select(F.col("page_id").alias("child"), urls.strip_fragment(F.col("url")).alias("fetch_url"))
    direct = found.join(known, "fetch_url").select("parent", "child")
    by_hash = found.select("parent", F.pmod(F.conv(F.substring("identity", 1, 15), 16, 10).cast("long"), F.lit(max(n, 1))).alias("child"))
    return direct.union(by_hash).where("parent <> child").distinct()


def bodies(scanned: DataFrame) -> DataFrame:
    """Pages that can be fetched, with the sizes of body and text."""
    return scanned.where("page_id % 11 <> 0").select(F.col("page_id").alias("node"), "body_bytes", F.octet_length("text").cast("long").alias("text_bytes"))


def state_files(spark, d, generation: int) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("doc_id") % 5 <= generation)
    text = F.when((F.lit(generation) == 4) & (F.col("doc_id") % 10 == 0), F.concat(F.col("text"), F.lit(" v2"))).otherwise(F.col("text"))
    return docs.select(F.concat(F.lit("state/doc/"), F.col("doc_id").cast("string")).alias("path"), text.alias("content"))


def url_variants(spark, d) -> DataFrame:
    u, k = urls.strip_fragment(F.col("url")), F.col("page_id") % 6
    tail = F.when(k == 1, "?token=x").when(k == 2, "?a=1;api_key=x").when(k == 3, "?next=token%3Dx").when(k == 4, "#access_token=x").otherwise("")
    made = F.when(k == 5, F.regexp_replace(u, "://", "://user:secret@")).otherwise(F.concat(u, tail))
    return pages(spark, d).select("page_id", made.alias("url"))


def checks(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, 403).otherwise(500)).otherwise(200)
    action = F.when(kind == "error", "error").when(kind == "purchase", "baseline_created").when(kind == "view", "unchanged").otherwise("review")
    target = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return e.select("event_id", target.alias("target_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("http_status"), action.alias("action"), "event_type", "props")


def messy_texts(spark, d) -> DataFrame:
    k = F.col("doc_id") % 4
    t = F.when(k == 1, F.replace("text", F.lit(" "), F.lit(" \t "))).when(k == 2, F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\r\n\r\n")))).when(k == 3, F.concat(F.replace("text", F.lit(". "), F.lit(".\n   \n")), F.lit("\n\n"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


def feeds(spark, d) -> DataFrame:
    """RSS texts of up to a thousand documents of a source each, forward and backward: URIs as identities, two kinds of links, enclosures, HTML in CDATA, dates."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.floor(F.col("doc_id") / 1000).alias("part"))
    n = F.col("doc_id").cast("string")
    guid = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://example.com/id/"), n)).otherwise(F.concat(F.lit("doc-"), n))
    body = F.concat(F.lit("<![CDATA[<p>Of "), F.col("n_chars").cast("string"), F.lit(' letters &amp; <a href="/more/'), n, F.lit('">more</a></p>]]>'))
    item = F.concat(
        F.lit("<item><guid>"), guid, F.lit("</guid><link>"), n, F.lit("?a=1&amp;b=2</link><title>"), F.upper("lang"), F.lit("</title><pubDate>2024-01-01</pubDate><author>A&eacute; "), F.col("source"),
        F.lit('</author><enclosure url="/audio/'), n, F.lit('.mp3"/><description>'), body, F.lit("</description></item>"),
    )
    grouped = docs.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("a"))
    wrap = lambda a: F.concat(F.lit('<rss version="2.0" xml:base="https://example.com/feed/"><channel><title>t</title>'), F.array_join(F.transform(a, lambda s: s["x"]), ""), F.lit("</channel></rss>"))
    both = grouped.select(F.concat_ws("-", "source", F.col("part").cast("string")).alias("feed"), F.explode(F.array(F.struct(F.lit("forward").alias("dir"), wrap(F.col("a")).alias("xml")), F.struct(F.lit("backward").alias("dir"), wrap(F.reverse("a")).alias("xml")))).alias("v"))
    return both.select(F.concat_ws(":", "feed", "v.dir").alias("feed"), "v.xml")


# ---- the same in DuckDB -------------------------------------------------------------------------------------------------

_BLANK = r"[\s\p{Z}\x1C-\x1F\x{85}]"


def sql_norm(x: str) -> str:
    split = rf"string_split(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), chr(10))"
    kept = f"list_filter(list_transform({split}, lambda l: regexp_replace(l, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda l: l <> '')"
    return f"(CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, chr(10)) || chr(10) ELSE '' END)"


def sql_target_id(url: str) -> str:
    host = rf"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '[^a-z0-9]+', '-', 'g')"
    return rf"left(regexp_replace({host}, '^-+|-+$', '', 'g'), 48) || '-' || left(sha256({url}), 12)"


def _sql_text(html: str, root: str) -> str:
    h = rf"regexp_replace({html}, '<!--.*?(?:-->|\z)', '', 'gs')"
    for tag in H.SKIP_TAGS:
        h = rf"regexp_replace({h}, '<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)', '', 'gis')"
    tokens = rf"""regexp_extract_all({h}, '(<[^<>"'']*(?:"[^"]*"[^<>"'']*|''[^'']*''[^<>"'']*)*>|[^<]+|<)', 1)"""
    decoded = lambda t: f"replace(replace(replace(replace(replace({t}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '&amp', '&')"
    blocks = "|".join(H.BLOCK_TAGS)
    piece = rf"""CASE WHEN regexp_matches(t, '^<[aA]\s[^>]*href="[^"]+"') THEN chr(10) || '[a:href:sha256:' || sha256({root} || {decoded("regexp_extract(t, 'href=\"([^\"]*)\"', 1)")}) || ']' || chr(10)
      WHEN regexp_matches(t, '(?i)^(?:<br\b|</?(?:{blocks})\b)') THEN chr(10) WHEN regexp_matches(t, '^<[/A-Za-z!?]') THEN '' ELSE {decoded("t")} END"""
    return sql_norm(f"array_to_string(list_transform({tokens}, lambda t: {piece}), '')")


SQL = {
    "cur": r"SELECT page_id, url, html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages",
    "prev": r"SELECT page_id, url, root, CASE page_id % 5 WHEN 3 THEN replace(html, '</article>', '<p>Retired notice.</p></article>') WHEN 4 THEN regexp_replace(html, '^(.*?)<li>.*?</li>', '\1', 's') ELSE html END AS html FROM cur WHERE page_id % 5 <> 0",
    "ct": f"SELECT page_id, url, {_sql_text('html', 'root')} AS text FROM cur",
    "pt": f"SELECT page_id, url, {_sql_text('html', 'root')} AS text FROM prev",
    "w": "SELECT page_id, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'p=' || page_id AS url, hsha FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, sha256(html) AS hsha FROM pages)",
    "ints": "SELECT page_id * 3 + k AS row_no, 'interest-' || page_id || '-' || k AS name, url, k + 1 AS priority, (page_id + k) % 4 <> 0 AS enabled FROM (SELECT page_id, url, unnest(range(0, page_id % 3 + 1)) AS k FROM w)",
    "tg": f"SELECT url, {sql_target_id('url')} AS target_id, min(row_no) AS first_row, coalesce(min_by(name, row_no) FILTER (WHERE enabled), min_by(name, row_no)) AS name, bool_or(enabled) AS enabled, count(*) AS n_interests, count(*) FILTER (WHERE enabled) AS n_enabled FROM ints GROUP BY url",
    "pend": f"SELECT w.page_id, {sql_target_id('w.url')} AS target_id, '20240101T000000Z-' || left(sha256('run-' || w.page_id), 8) AS run_id, left(sha256('rev-' || w.page_id), 32) AS revision, sha256(prev.html) AS expected_sha256, hsha AS candidate_sha256, w.page_id % 14 = 0 AS diff_truncated FROM w LEFT JOIN prev USING (page_id) WHERE w.page_id % 7 = 0",
    "dec": "SELECT page_id, target_id, CASE WHEN page_id % 21 = 0 THEN left(sha256('other-' || page_id), 32) ELSE revision END AS revision, page_id % 2 = 1 AS material, CASE WHEN page_id % 2 = 1 THEN '## Page ' || page_id END AS report, run_id, candidate_sha256 FROM pend",
    "st": "SELECT g, 'state/doc/' || doc_id AS path, CASE WHEN g = 4 AND doc_id % 10 = 0 THEN text || ' v2' ELSE text END AS content FROM documents, range(0, 5) r(g) WHERE doc_id % 5 <= g",
    "man": "SELECT g, path, strlen(content) AS size, sha256(content) AS sha256, strlen(content) > 1024 AS is_object, content FROM st",
    "uv": r"SELECT page_id, CASE page_id % 6 WHEN 1 THEN u || '?token=x' WHEN 2 THEN u || '?a=1;api_key=x' WHEN 3 THEN u || '?next=token%3Dx' WHEN 4 THEN u || '#access_token=x' WHEN 5 THEN replace(u, '://', '://user:secret@') ELSE u END AS url, page_id % 6 AS k FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)",
    "chk": "SELECT event_id, 'user-' || user_id AS target_id, ts, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 403 ELSE 500 END ELSE 200 END AS http_status, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'baseline_created' WHEN 'view' THEN 'unchanged' ELSE 'review' END AS action, event_type, props FROM events",
    "mt": r"SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN replace(text, ' ', ' ' || chr(9) || ' ') WHEN 2 THEN '  ' || replace(text, chr(10), chr(13) || chr(10) || chr(13) || chr(10)) WHEN 3 THEN replace(text, '. ', '.' || chr(10) || '   ' || chr(10)) || chr(10) || chr(10) ELSE text END AS text FROM documents",
    "fi": "SELECT source || '-' || (doc_id // 1000) || ':' || dir AS feed, doc_id, lang, source, n_chars, dir, CASE WHEN doc_id % 3 = 0 THEN 'https://example.com/id/' || doc_id ELSE 'doc-' || doc_id END AS guid, 'https://example.com/feed/' || doc_id || '?a=1&b=2' AS link FROM documents, (VALUES ('forward'), ('backward')) v(dir)",
}


def with_views(body: str) -> str:
    """A query over the views that it names, with their definitions in front."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name, sql in SQL.items():
            if name not in used and re.search(rf"\b{name}\b(?!\s*\()", text):
                need(sql)
                if name not in used:
                    used.append(name)

    need(body)
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in used) + " " if used else "") + body
