"""Links of pages: tables, additions, traversal with budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import urls
from pagetide.functions.text import utf8_prefix, utf8_prefix_within

MAX_LINKS = 100
MAX_LINK_BYTES = 2 << 20
MAX_TOTAL_BYTES = 10 << 20
MAX_TEXT_BYTES = 8 << 10
MAX_REVIEW_BYTES = 64 << 10
MAX_MANIFEST = 500


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages(key, url, html) -> key, pos, tag, attr, destination, identity, fetch_url; pages with a credential in any destination give no rows but those of `credential_pages`."""
    return scanned_links(pages.select(key, H.links(F.col("html"), F.col("url")).alias("links")), key)


def scanned_links(found: DataFrame, key: str = "page_id") -> DataFrame:
    """`page_links` of pages that were scanned before: found(key, links)."""
    found = found.where(~F.exists("links", lambda d: urls.has_credentials(d["destination"])))
    return found.select(key, F.posexplode("links").alias("pos", "d")).select(key, "pos", "d.tag", "d.attr", "d.destination", "d.identity", urls.strip_fragment(F.col("d.destination")).alias("fetch_url"))


def credential_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that fail as a whole, as one of their destinations holds credentials, be it past the limit."""
    return pages.select(key, H.links(F.col("html"), F.col("url")).alias("links")).where(F.exists("links", lambda d: urls.has_credentials(d["destination"]))).select(key)


def added_links(current: DataFrame, previous: DataFrame, sources: DataFrame, key: str, most: int = MAX_LINKS) -> DataFrame:
    """Links whose identity is new, whose URL was not reachable before and isn't the page itself: key, fetch_url, rank, in order of URL, cut at `most`.

    current(key, identity, fetch_url), previous(key, identity), sources(key, source_url). Two keys on purpose: a new
    fragment of a known URL is a new identity but no new URL.
    """
    live = current.where(urls.is_navigable(F.col("destination")) if "destination" in current.columns else F.lit(True)).select(key, "identity", "fetch_url").distinct()
    old = previous.select(key, "identity").distinct()
    known = live.join(old, [key, "identity"], "left_semi").select(key, "fetch_url").union(sources.select(key, F.col("source_url").alias("fetch_url")))
    fresh = live.select(key, "fetch_url").distinct().join(known, [key, "fetch_url"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("fetch_url"))).where(F.col("rank") <= most)


def link_omissions(links: DataFrame, added: DataFrame, key: str, limit: int = H.MAX_DESTINATIONS, most: int = MAX_LINKS) -> DataFrame:
    """(key, overflow, oversize, beyond_cap, omitted): destinations past the page's limit, too long ones, added ones past the cap; links(key, pos, destination), added(key, fetch_url) before the cut."""
    per_page = links.groupBy(key).agg(F.count_if(F.col("pos") >= limit).alias("overflow"), F.count_if(F.octet_length("destination") > urls.MAX_LINK_BYTES).alias("oversize"))
    cap = added.groupBy(key).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("beyond_cap"))
    out = per_page.join(cap, key, "left").withColumn("beyond_cap", F.coalesce("beyond_cap", F.lit(0)))
    return out.withColumn("omitted", F.col("overflow") + F.col("oversize") + F.col("beyond_cap"))


def nav_manifest(manifests: DataFrame, key: str, column: str = "manifest") -> DataFrame:
    """A JSON array of absolute URLs -> key, pos, url, first occurrences only; arrays that are no JSON, too long or hold an invalid URL give one row with the error."""
    urls_in = F.from_json(F.col(column), "array<string>", {"mode": "PERMISSIVE"})
    parsed = manifests.select(key, urls_in.alias("urls"))
    bad = F.exists("urls", lambda u: F.coalesce(~urls.is_navigable(u), F.lit(True)) | urls.has_credentials(u) | (F.trim(u) != u))
    error = F.when(F.col("urls").isNull(), "not a JSON array").when(F.size("urls") > MAX_MANIFEST, "too many URLs").when(bad, "invalid URL")
    checked = parsed.select(key, error.alias("error"), F.when(error.isNull(), F.array_distinct("urls")).alias("urls"))
    return checked.select(key, "error", F.posexplode_outer("urls").alias("pos", "url"))


def merged_links(page: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """Links of a page and links supplied from outside, each identity once, the page's own first."""
    more = supplied.join(page.select(key, "identity"), [key, "identity"], "left_anti")
    return page.select(key, "identity", F.lit("page").alias("origin")).distinct().union(more.select(key, "identity", F.lit("supplied").alias("origin")).distinct())


def linked_documents(roots: DataFrame, edges: DataFrame, documents: DataFrame, depth: int = 3, most: int | None = MAX_LINKS, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Breadth-first from each root: (root, node, depth, rank, status).

    roots(root), edges(parent, child), documents(node, ok). A node belongs to the first parent in queue order that reaches
    it; past `most` nodes a root's further ones are `omitted`, none with None; a node without a document is an `error` and leads nowhere.
    The number of rounds is `depth`, whatever the data; each round joins the frontier with the edges once. `keep` writes a frontier and reads it back, so that no round runs
    again for the ones behind it.
    """
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit("root").alias("status"))
    frontier = seen
    out = None
    for level in range(1, depth + 1):
        reached = frontier.where("status IN ('ok', 'root')").select("root", F.col("node").alias("parent"), F.col("rank").alias("parent_rank"))
        reached = reached.join(edges, "parent").groupBy("root", F.col("child").alias("node")).agg(F.min("parent_rank").alias("parent_rank"))
        fresh = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        before = seen.groupBy("root").agg(F.max("rank").alias("done"))
        ranked = fresh.join(before, "root").withColumn("rank", F.col("done") + F.row_number().over(Window.partitionBy("root").orderBy("parent_rank", "node")))
        found = ranked.join(documents, "node", "left")
        beyond = F.lit(False) if most is None else F.col("rank") > most
        status = F.when(beyond, "omitted").when(F.col("ok"), "ok").otherwise("error")
        frontier = keep(found.select("root", "node", F.lit(level).alias("depth"), "rank", status.alias("status")))
        seen = seen.union(frontier)
        out = frontier if out is None else out.union(frontier)
    return out


def link_budget(found: DataFrame, sizes: DataFrame, most_bytes: int | None = MAX_TOTAL_BYTES, each_bytes: int = MAX_LINK_BYTES, review_bytes: int | None = MAX_REVIEW_BYTES, text_bytes: int | None = MAX_TEXT_BYTES) -> DataFrame:
    """Shared budgets of a root in queue order: (root, node, rank, included, kept_bytes, truncated).

    found(root, node, rank, status), sizes(node, body_bytes, text_bytes). An error costs the full allowance of a document. None for a
    budget sets no bound; `each_bytes` is what a document costs at most of `most_bytes`.
    """
    rows = found.where("status <> 'omitted'").join(sizes, "node", "left")
    cost = F.when((F.col("status") == "error") | (F.col("body_bytes") > each_bytes), each_bytes).otherwise(F.col("body_bytes"))
    size = F.col("text_bytes") if text_bytes is None else F.least(F.col("text_bytes"), F.lit(text_bytes))
    kept = F.when(F.col("status") == "ok", size).otherwise(0)
    before = Window.partitionBy("root").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn("cost", cost).withColumn("kept", kept)
    rows = rows if most_bytes is None else rows.withColumn("fetched", spent("cost"))
    rows = rows if review_bytes is None else rows.withColumn("used", spent("kept"))
    fetchable = F.lit(True) if most_bytes is None else F.col("fetched") < most_bytes
    included = fetchable & (F.lit(True) if review_bytes is None else F.col("used") < review_bytes)
    room = F.col("kept") if review_bytes is None else F.least(F.col("kept"), review_bytes - F.col("used"))
    return rows.select("root", "node", "rank", included.alias("included"), F.when(included, room).otherwise(0).cast("long").alias("kept_bytes"), F.coalesce(included & (F.col("status") == "ok") & (room < F.col("text_bytes")), F.lit(False)).alias("truncated"))


def link_reviews(found: DataFrame, budget: DataFrame) -> DataFrame:
    """(root, documents, omitted, incomplete): one row a root with documents(rank, node, status, kept_bytes, truncated) in order.

    Documents past the cap or the budgets count as omitted; any omission, error or cut makes the review incomplete. A
    root has at most the cap's documents; without a cap as many as its links reach.
    """
    rows = found.join(budget.select("root", "node", "included", "kept_bytes", "truncated"), ["root", "node"], "left")
    taken = (F.col("status") != "omitted") & F.coalesce("included", F.lit(False))
    document = F.struct("rank", "node", "status", "kept_bytes", "truncated")
    bad = ~taken | (F.col("status") == "error") | F.coalesce("truncated", F.lit(False))
    return rows.groupBy("root").agg(F.array_sort(F.collect_list(F.when(taken, document))).alias("documents"), F.count_if(~taken).alias("omitted"), F.bool_or(bad).alias("incomplete"))


def link_review_texts(found: DataFrame, texts: DataFrame, most_bytes: int = MAX_TOTAL_BYTES, each_bytes: int = MAX_LINK_BYTES, review_bytes: int = MAX_REVIEW_BYTES, text_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(root, documents(rank, node, text, truncated, error), omitted, incomplete): the linked documents' texts, one row a root.

    found(root, node, rank, status), texts(node, body_bytes, text). In queue order each document takes what the root's budgets
    have left: its body up to `each_bytes` of what can still be fetched (a longer one is an error and costs the whole allowance,
    as does any error), its text up to `text_bytes` of what the review still holds, cut at a character; bytes that a cut leaves go
    to the next one. Once either budget is spent the rest counts as omitted. A null text is empty, a missing document an error.

    The order is a fold over a root's documents, of which the traversal's cap bounds the number. Only as much text goes
    there as could be kept: behind the document that fills the review by its size, no more than the three bytes that cuts can
    leave. So a root's row holds review_bytes + text_bytes and a few hundred bytes at most.
    """
    # Texts are cut before the join: once a document, not once a link, and no whole text travels.
    text = F.coalesce("text", F.lit(""))
    sized = texts.select("node", "body_bytes", utf8_prefix(text, text_bytes).alias("head"), F.octet_length(text).alias("size"), F.lit(True).alias("there"))
    rows = found.where("status <> 'omitted'").join(sized, "node", "left")
    good = F.coalesce(F.col("there") & (F.col("status") == "ok") & (F.col("body_bytes") <= each_bytes), F.lit(False))
    rows = rows.select("root", "rank", "node", good.alias("good"), "body_bytes", F.when(good, F.col("head")).alias("head"), "size")
    before = Window.partitionBy("root").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.coalesce(F.octet_length("head"), F.lit(0))).over(before), F.lit(0)) >= review_bytes
    rows = rows.withColumn("full", full)
    document = F.struct("rank", "node", "good", "body_bytes", F.when(F.col("full"), utf8_prefix(F.col("head"), 3)).otherwise(F.col("head")).alias("head"), "size")
    node = rows.schema["node"].dataType.simpleString()
    state = f"struct<fetch:bigint,room:bigint,documents:array<struct<rank:bigint,node:{node},text:string,truncated:boolean,error:boolean>>>"

    def step(a: Column, x: Column) -> Column:
        limit = F.least(a["fetch"], F.lit(each_bytes))
        good = x["good"] & (x["body_bytes"] <= limit)
        text = F.when(good, utf8_prefix_within(x["head"], a["room"]))
        taken = F.coalesce(F.octet_length(text), F.lit(0))
        entry = F.struct(x["rank"].cast("long").alias("rank"), x["node"].alias("node"), text.alias("text"), (good & (taken < x["size"])).alias("truncated"), (~good).alias("error"))
        after = F.struct((a["fetch"] - F.when(good, x["body_bytes"]).otherwise(limit)).alias("fetch"), (a["room"] - taken).alias("room"), F.array_append(a["documents"], entry).alias("documents"))
        return F.when((a["fetch"] > 0) & (a["room"] > 0), after.cast(state)).otherwise(a)

    start = F.struct(F.lit(most_bytes).alias("fetch"), F.lit(review_bytes).alias("room"), F.array().alias("documents")).cast(state)
    folded = rows.groupBy("root").agg(F.array_sort(F.collect_list(document)).alias("queue")).select("root", F.size("queue").alias("queued"), F.aggregate("queue", start, step)["documents"].alias("documents"))
    beyond = found.groupBy("root").agg(F.count_if(F.col("status") == "omitted").alias("beyond"))
    both = beyond.join(folded, "root", "left").withColumn("documents", F.coalesce("documents", F.array().cast(state[state.index("array") : -1])))
    omitted = F.col("beyond") + F.coalesce("queued", F.lit(0)) - F.size("documents")
    flawed = F.exists("documents", lambda x: x["truncated"] | x["error"])
    return both.select("root", "documents", omitted.alias("omitted"), ((omitted > 0) | flawed).alias("incomplete"))
