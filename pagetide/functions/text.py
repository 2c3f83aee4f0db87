"""Row-local text functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks of a text, and what counts as blank at a line's ends.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
BLANK_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
MAX_TEXT_BYTES = 41_943_040
# Media types by file suffix, and the families that types are compared by.
SUFFIX_TYPES = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "xml": "application/xml", "rss": "application/rss+xml", "atom": "application/atom+xml"}
FEED_TYPES = ("application/atom+xml", "application/rss+xml")
XML_TYPES = (*FEED_TYPES, "application/xml", "text/xml")
HTML_TYPES = ("text/html", "application/xhtml+xml")


def strip(c: Column) -> Column:
    """Without blank characters at both ends, Unicode ones too."""
    return F.regexp_replace(c, BLANK_ENDS, "")


def normalize_whitespace(c: Column) -> Column:
    """Lines by LF, runs of blanks as one space, trimmed, empty ones dropped; LF at the end unless empty."""
    t = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t\f\x0B]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n", -1), strip), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(joined, r"(?s)(?<=.)\z", "\n")


def lines(c: Column) -> Column:
    """The lines of a normalized text as an array, without the empty end."""
    return F.filter(F.split(c, "\n", -1), lambda x: x != "")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def line_count(c: Column) -> Column:
    """Number of lines by the full set of line breaks; a last line without a break counts."""
    open_end = (c != "") & ~c.rlike(f"(?:{LINE_BREAK})\\z")
    return F.regexp_count(c, F.lit(LINE_BREAK)) + F.when(open_end, 1).otherwise(0)


def utf8_prefix(c: Column, most: int) -> Column:
    """Longest prefix within `most` bytes that cuts no character."""
    raw = F.encode(c, "UTF-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) for k in range(most, max(most - 4, 0), -1)], F.lit(""))
    return F.when(F.octet_length(c) <= most, c).when(c.isNotNull(), cut)


def utf8_prefix_within(c: Column, room: Column) -> Column:
    """utf8_prefix with as many bytes as another column or a fold's state has left."""
    raw = F.encode(c, "UTF-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(room - k, F.lit(0)).cast("int")).cast("string")) for k in range(4)], F.lit(""))
    return F.when(F.octet_length(c) <= room, c).when(c.isNotNull(), cut)


def is_plain_text(c: Column) -> Column:
    """No control characters but tab, CR and LF."""
    return ~c.rlike(CONTROL)


def within_size(c: Column, most: int = MAX_TEXT_BYTES) -> Column:
    return F.octet_length(c).between(1, most)


def guess_content_type(path: Column) -> Column:
    """Media type by suffix; unknown ones are plain text."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text/plain")
    for name, kind in SUFFIX_TYPES.items():
        out = F.when(suffix == name, kind).otherwise(out)
    return out


def media_type(header: Column) -> Column:
    """The type of a Content-Type header, lower-cased, without parameters."""
    return F.lower(F.trim(F.regexp_extract(header, r"^([^;]*)", 1)))


def charset(header: Column) -> Column:
    """The charset parameter of a Content-Type header, null if absent."""
    found = F.regexp_extract(header, r"(?i);\s*charset\s*=\s*[\"']?([A-Za-z][A-Za-z0-9._:-]*)", 1)
    return F.when(found != "", F.lower(found))


# Roots of feeds, and elements by which a text counts as HTML.
FEED_ROOTS = ("rss", "feed", "rdf")
HTML_ELEMENTS = ("html", "head", "body", "main", "article", "section", "div", "h1", "h2", "h3", "h4", "h5", "h6", "p", "table", "script", "a", "area", "form", "button", "input")


def sniff_content_type(body: Column) -> Column:
    """Structural type from the first 8192 characters of a text: PDF by its mark; a feed if any element is a feed's root; with
    an XML declaration HTML if the root or document type is html, else XML; HTML if any element is one of HTML's; else plain."""
    start = F.lower(strip(F.substring(body, 1, 8192)))
    # Names behind each <, as (prefix, name); an HTML document type counts as the element html.
    names = F.transform(F.regexp_extract_all(start, F.lit(r"<((?:\w+:)?\w+|!doctype\s+html)\b"), 1), lambda n: F.when(n.startswith("!"), "html").otherwise(n))
    local = F.transform(names, lambda n: F.substring_index(n, ":", -1))
    is_xml = start.rlike(r"^<\?xml\b[^>]*>")
    root_is_html = (F.get(local, F.lit(0)) == "html") & start.rlike(r"^<\?xml\b[^>]*\?>\s*<(?:!doctype\s+html|\w)")
    return (
        F.when(body.startswith("%PDF-"), "application/pdf")
        .when(F.arrays_overlap(local, F.array(*map(F.lit, FEED_ROOTS))), "application/rss+xml")
        .when(is_xml, F.when(root_is_html, "text/html").otherwise("application/xml"))
        .when(F.arrays_overlap(names, F.array(*map(F.lit, HTML_ELEMENTS))), "text/html")
        .otherwise("text/plain")
    )


def type_family(kind: Column) -> Column:
    return (
        F.when(kind.isin(*HTML_TYPES), "html")
        .when(kind.isin(*XML_TYPES), "xml")
        .when(kind == "application/pdf", "pdf")
        .when(kind == "text/plain", "text")
    )


def content_type_gate(declared: Column, detected: Column) -> Column:
    """The type to normalize by, null where declared and detected types differ in family; plain text defers to what is detected."""
    kind = media_type(declared)
    return F.when(kind == "text/plain", detected).when(type_family(kind) == type_family(detected), F.when(kind.isin("application/xml", "text/xml") & detected.isin(*FEED_TYPES), detected).otherwise(kind))


def has_doctype(xml: Column) -> Column:
    """Whether an XML text declares a document type or an entity; such texts are refused before parsing."""
    return xml.rlike(r"(?i)<!DOCTYPE|<!ENTITY")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def parse_stamp(c: Column) -> Column:
    """The instant of a stamp, null unless formatting it gives the stamp again."""
    ts = F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.when(run_stamp(ts) == c, ts)
