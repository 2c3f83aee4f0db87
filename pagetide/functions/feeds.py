"""RSS and Atom feeds as tables and as stable text: entries are split off and spread, then each is scanned once; a feed with a document type or an entity is refused first."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import urls
from pagetide.functions.batches import by_pieces
from pagetide.functions.scan import digest, feed_part
from pagetide.functions.scan import identity_token as _token
from pagetide.functions.text import has_doctype, normalize_whitespace, sha256, strip

# Where an entry begins and ends, and how a feed begins.
ENTRY = r"(?s)<(?:[\w.-]+:)?(?:item|entry)(?:\s[^>]*)?(?<!/)>.*?</(?:[\w.-]+:)?(?:item|entry)\s*>"
FEED = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*+<(?:[\w.-]+:)?(?:rss|feed|RDF)\b"


def _plain_xml(xml: Column) -> Column:
    """Without comments and instructions, and with CDATA sections as escaped text."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.split(F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>", ""), r"<!\[CDATA\[|\]\]>", -1)
    return F.when(xml.contains("<![CDATA["), F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, escaped(x)).otherwise(x)), "")).otherwise(F.array_join(parts, "]]>"))


def _attribute(token: Column, name: str) -> Column:
    """The value of an attribute as it stands, null where it is absent or empty."""
    value = rf"\s(?:[\w.-]+:)?{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.nullif(strip(F.concat(F.regexp_extract(token, value, 1), F.regexp_extract(token, value, 2))), F.lit(""))


@lru_cache
def _scanner():
    """The scan of (piece, base, url) batches as a function of columns, kept in one place like the one of pages."""

    def scan_piece(xml: pa.Array, base: pa.Array, url: pa.Array) -> pa.Array:
        rows = []
        for piece, inner, outer in zip(xml.to_pylist(), base.to_pylist(), url.to_pylist(), strict=True):
            text, known, title, link, links = feed_part(piece or "", inner or "", outer or "")
            identity = next((known[k] for k in ("guid", "id", "link") if k in known), None)
            rows.append((identity, digest(text if identity is None else identity), title, link, links, text))
        kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["identity", "key", "title", "link", "links", "text"])

    @F.arrow_udf("struct<identity:string,key:string,title:string,link:string,links:array<string>,text:string>")
    def scan_parts(xml: pa.Array, base: pa.Array, url: pa.Array) -> pa.Array:
        return by_pieces(scan_piece, xml, base, url)

    return scan_parts.asNondeterministic()


@lru_cache
def _tokens():
    @F.arrow_udf("string")
    def tokens(field: pa.Array, value: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _token(f, v, u or "") for f, v, u in zip(field.to_pylist(), value.to_pylist(), url.to_pylist(), strict=True)], pa.string())

    return tokens


def identity_token(field: str | Column, value: Column, base: Column | None = None) -> Column:
    """An identity kept as it is, or only its hash, resolved against the feed's URL, if it has the form of a URI."""
    return _tokens()(field if isinstance(field, Column) else F.lit(field), value, F.lit("") if base is None else base)


def _bases(xml: Column, base: Column) -> Column:
    """The base that the feed's root and channel set."""
    first = lambda tag: _attribute(F.regexp_extract(xml, rf"(?s)<(?:[\w.-]+:)?(?:{tag})\b[^>]*>", 0), "base")
    over = lambda b, v: F.when(v.isNull(), b).otherwise(urls.resolve(b, v))
    return over(over(base, first("rss|feed|RDF")), first("channel"))


def parsed(feeds: DataFrame, key: str, column: str = "xml", base: Column | None = None) -> DataFrame:
    """(key, nth, is_entry, identity, entry_key, title, link, links, text): a row for each entry, by number, and for what stands before and behind all of them; feeds that are refused, or are none, have no row."""
    base = F.lit("") if base is None else base
    ok = feeds.where(~has_doctype(F.col(column)) & F.col(column).rlike(FEED)).select(key, _plain_xml(F.col(column)).alias("x"), base.alias("outer"))
    around = F.split("x", ENTRY, -1)
    tail = F.array_join(F.slice(around, 2, F.greatest(F.size(around) - 1, F.lit(0))), "")
    part = lambda nth, entry, raw: F.struct(nth.alias("nth"), F.lit(entry).alias("is_entry"), raw.alias("raw"))
    own = F.transform(F.regexp_extract_all("x", F.lit(ENTRY), 0), lambda e, i: part(i, True, e))
    parts = F.concat(F.array(part(F.lit(-1), False, F.get(around, F.lit(0)))), own, F.array(part(F.lit(1 << 30), False, tail)))
    rows = ok.select(key, "outer", _bases(F.col("x"), F.col("outer")).alias("feed_base"), parts.alias("parts")).select(key, "outer", "feed_base", F.explode("parts").alias("p"))
    # A feed is one row, and few feeds may hold many entries: from here on each entry is a row of its own, wherever its feed was.
    spread = rows.repartition(key, F.col("p.nth"))
    scanned = spread.select(key, "p.nth", "p.is_entry", _scanner()(F.col("p.raw"), F.col("feed_base"), F.col("outer")).alias("e"))
    return scanned.select(key, "nth", "is_entry", "e.identity", F.col("e.key").alias("entry_key"), "e.title", "e.link", "e.links", "e.text")


def feed_entries(feeds: DataFrame, key: str, column: str = "xml", base: Column | None = None) -> DataFrame:
    """(key, pos, entry_key, identity, title, link) of every entry; link: the first alternate one, against xml:base and the feed's URL."""
    rows = parsed(feeds, key, column, base).where("is_entry")
    return rows.select(key, F.col("nth").alias("pos"), "entry_key", "identity", "title", "link")


def feed_links(feeds: DataFrame, key: str, column: str = "xml", base: Column | None = None) -> DataFrame:
    """(key, pos, nth, link, identity): where entries lead: alternate links, text links, `a` elements and links of HTML in fields; enclosures are hashed in the text, but not followed."""
    rows = parsed(feeds, key, column, base).where("is_entry")
    each = rows.select(key, F.col("nth").alias("pos"), F.posexplode("links").alias("nth", "link"))
    return each.select(key, "pos", "nth", "link", sha256(F.col("link")).alias("identity"))


def feed_text(feeds: DataFrame, key: str, column: str = "xml", base: Column | None = None) -> DataFrame:
    """(key, text): a feed as stable text, every element between marker lines, entries in order of their keys, so that their order in the feed can't be seen but any changed field can.

    A feed's parts are gathered by its key; they are no more than the feed itself.
    """
    rows = parsed(feeds, key, column, base)
    order = F.struct(F.when(F.col("is_entry"), 0).otherwise(F.signum(F.col("nth") + 0.0).cast("int")).alias("side"), F.when(F.col("is_entry"), F.col("entry_key")).alias("k"), F.col("text").alias("t"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("all"))
    return whole.select(key, normalize_whitespace(F.array_join(F.transform("all", lambda e: e["t"]), "\n")).alias("text"))


def feed_fingerprint(feeds: DataFrame, key: str, column: str = "xml", base: Column | None = None) -> DataFrame:
    """(key, entries, fingerprint): hash over the sorted entry keys; 0 and the hash of nothing for a feed without entries."""
    rows = parsed(feeds, key, column, base)
    keys = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("is_entry"), F.col("entry_key")))).alias("k"))
    return keys.select(key, F.size("k").alias("entries"), sha256(F.array_join("k", "\n")).alias("fingerprint"))


def xml_text(xml: Column) -> Column:
    """All text of an XML document that is no feed; null where it is refused."""
    return F.when(~has_doctype(xml), normalize_whitespace(F.array_join(F.xpath(xml, F.lit("//text()")), "\n")))
