"""HTML pages as stable lines and hashed link identities: one scan a page, in Arrow batches; what is done with its result is built-in."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions import urls
from pagetide.functions.batches import by_pieces
from pagetide.functions.scan import BLOCK_TAGS, MAX_DESTINATIONS, SKIP_TAGS, page_text
from pagetide.functions.text import normalize_whitespace

__all__ = ["BLOCK_TAGS", "MAX_DESTINATIONS", "SKIP_TAGS", "comparison_view", "decode_references", "link_markers", "links", "markers_trail", "scanned", "to_lines", "without_markers"]
#: Names that also count without a semicolon, by the standard's table.
OPEN_NAMES = tuple(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_LINK = "struct<tag:string,attr:string,destination:string,identity:string>"


def decode_references(c: Column) -> Column:
    """Named and numeric character references replaced by their characters: all names of the standard, those that may go without a semicolon as prefixes, too."""
    # The table is one string that is searched for the name: a map of this size, copied into every use, is slow to plan.
    table = F.lit("\x01" + "\x01".join(f"{n}\x02{v}" for n, v in html5.items()) + "\x01")
    after = lambda name: F.call_function("substring_index", table, F.concat(F.lit("\x01"), name, F.lit("\x02")), F.lit(-1))
    find = lambda name: F.nullif(F.substring_index(after(name), "\x01", 1), F.lit(""))
    prefix = r"^&(" + "|".join(OPEN_NAMES) + ")"

    def named(t: Column) -> Column:
        # The whole name, or else the longest name that may go without a semicolon, with what follows it.
        short = F.regexp_extract(t, prefix, 1)
        found = F.transform(F.array(F.substr(t, F.lit(2)), short), find)
        return urls.let(found, lambda f: F.coalesce(F.get(f, F.lit(0)), F.concat(F.get(f, F.lit(1)), F.substr(t, F.char_length(short) + 2)), t))

    code = lambda t: F.when(t.rlike(r"^&#[xX]"), F.conv(F.regexp_extract(t, r"^&#[xX]0*([0-9A-Fa-f]{1,6});?$", 1), 16, 10)).otherwise(F.regexp_extract(t, r"^&#0*([0-9]{1,7});?$", 1))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def numeric(t: Column) -> Column:
        n = F.try_to_number(F.nullif(code(t), F.lit("")), F.lit("9999999")).cast("long")
        return urls.let(n, lambda k: F.when(k.between(1, 0x10FFFF) & ~k.between(0xD800, 0xDFFF), char(k)).otherwise("�"))

    def one(t: Column) -> Column:
        return F.when(t.startswith("&#"), numeric(t)).when(t.rlike("^&[A-Za-z]"), named(t)).otherwise(t)

    pieces = F.regexp_extract_all(c, F.lit(r"(&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&)"), 1)
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


@lru_cache
def _scanner():
    """The scan of (html, url) batches as a function of columns. Marked as not deterministic so that the optimizer keeps it in one place: a filter on its result must not run it again."""

    def scan_piece(html: pa.Array, url: pa.Array) -> pa.Array:
        texts, sizes, found = [], [0], []
        for page, address in zip(html.to_pylist(), url.to_pylist(), strict=True):
            text, links = (None, []) if page is None else page_text(page, address or "")
            texts.append(text)
            found += links
            sizes.append(len(found))
        names = ("tag", "attr", "destination", "identity")
        flat = pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(4)], names)
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists], ["text", "links"])

    @F.arrow_udf(f"struct<text:string,links:array<{_LINK}>>")
    def scan_pages(html: pa.Array, url: pa.Array) -> pa.Array:
        return by_pieces(scan_piece, html, url)

    return scan_pages.asNondeterministic()


def scanned(html: Column, url: Column) -> Column:
    """(text, links) of a page in one scan: text before blanks are put in order; links (tag, attr, destination, identity) in page order."""
    return _scanner()(html, url)


def links(html: Column, url: Column) -> Column:
    """Array of (tag, attr, destination, identity) in page order; identity is the hash of the resolved URL with its fragment."""
    return scanned(html, url)["links"]


def to_lines(html: Column, url: Column) -> Column:
    """The page's text as lines, with a hashed marker line for each destination; those past the limit in one closing marker."""
    return normalize_whitespace(scanned(html, url)["text"])


def link_markers(text: Column) -> Column:
    """Sorted distinct identities of the `[a:href:sha256:...]` lines of a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[a:href:sha256:([0-9a-f]{64})\]"), 1)))


def without_markers(text: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(text, r"\[a:href:sha256:[0-9a-f]{64}\]", ""))


def comparison_view(text: Column) -> Column:
    """A text with its link markers, sorted and without repeats, moved behind the rest; texts without any stay as they are."""
    marks = F.transform(link_markers(text), lambda i: F.concat(F.lit("[a:href:sha256:"), i, F.lit("]")))
    return F.when(F.size(marks) == 0, text).otherwise(normalize_whitespace(F.concat(without_markers(text), F.lit("\n"), F.array_join(marks, "\n"))))


def markers_trail(text: Column) -> Column:
    """Whether a text has link markers and no other line comes after the first of them."""
    marks = F.transform(F.filter(F.split(text, "\n", -1), lambda x: x != ""), lambda x: x.rlike(r"^\[a:href:sha256:[0-9a-f]{64}\]$"))

    def trail(m: Column) -> Column:
        n = F.size(F.filter(m, lambda x: x))
        return (n > 0) & (F.array_position(m, True) + n - 1 == F.size(m))

    return urls.let(marks, trail)
