"""Main text of pages by equivalence-class template deduction.

Tokens are the tags and the text blocks of a page, told apart by the path of containers they stand in. Over the pages of one
host, tokens with the same occurrence vector (how often in which page) form an equivalence class; a class of tags is valid
if it has both ends of its elements, stands in enough pages, and occurs in the order of its positions. Valid classes nest
by their paths into the host's template; what stands between its tokens are the slots. A text block that nearly all of a
host's pages have in the same place is template, too, under whatever name. Slots in menus, notices, adverts, forms and
the like are left out, of the rest the container that holds the most text that isn't links is the article, and its blocks
are the page's text. Hosts with few pages use the template of tags deduced from the pages of all hosts, and the names
of containers alone.

Copies of one article must not pass for a template: pages count by a MinHash value of their word 5-grams, so that many near
copies are few pages.

An occurrence vector has as many entries as a host has pages, so it is never gathered: the sum of hash(page, count) over
the pages stands for it, and sums are taken before and after the shuffle alike. A host with a third of all pages is no
larger in this than another.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, slices

#: Pages a host needs for a template of its own, and share of them a class must stand in.
MIN_PAGES = 3
MIN_SUPPORT = 0.5
#: Templates are broadcast up to this many hosts, joined by shuffle beyond.
BROADCAST_HOSTS = 50_000
BROADCAST_TOKENS = 1_000_000
#: Of a container's text, the share that one below it must hold to be preferred.
INNER_SHARE = 0.95
#: Share of a host's pages, near copies counted about once, that a text block of the template stands in.
TEXT_SUPPORT = 0.8

_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTES = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_RAW_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>]|\Z)", re.I) if name == "template" else re.compile(rf"<(/){name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
#: Raw elements that go on to the page's end where they aren't closed; others then count as not raw.
_OPEN_ENDED = {"script", "style"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that path and template are made of; all others neither open nor close a level.
_CONTAINERS = {"html", "head", "body", "nav", "header", "footer", "main", "article", "section", "aside", "div", "form", "ul", "ol", "dl", "table", "figure", "details", "dialog", "menu", "select", "button", "svg", "object", "video", "audio", "canvas", "fieldset"}
_BLOCKS = _CONTAINERS | {"address", "blockquote", "center", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "p", "pre", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend", "option", "title"}
#: Containers whose text is never the article's, by tag and by word in class, id or role.
_OUT_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "select", "button", "svg", "dialog", "object", "canvas", "video", "audio", "header", "fieldset"}
_OUT_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|adbox|adslot|sponsor\w*|banner\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|sidebar\w*|nav\w*|menu\w*|breadcrumb\w*|topbar|masthead|header|foot\w*|comment\w*|disqus\w*|repl(?:y|ies)|discussion|newsletter\w*|subscri\w*|signup|login|popup|pagination|pager|toolbar)(?:$|[^a-z])"
)
#: Words that an article's own parts may have in their names as well: there only links are left out, and what the template holds.
_WEAK_WORDS = re.compile(
    r"(?:^|[^a-z])(?:alert\w*|side|share\w*|sharing|social\w*|related\w*|recommend\w*|modal|overlay|widget\w*|search\w*|form|legal|copyright|disclaimer)(?:$|[^a-z])"
)
_ARTICLE = re.compile(r"^(?:article|main)\b")


def _label(tag: str, attrs: str) -> str:
    """A container's name: tag, then its class, id and role words."""
    words = sorted({w for m in _NAMES.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").lower().replace(">", "").replace("\t", " ").split()}) if attrs else []
    return tag + "".join("." + w for w in words)


def _kind(label: str, known: dict[str, int] = {}) -> int:  # noqa: B006  labels come again and again
    """2 for a container that is never the article's, 1 for one with a weak name, else 0."""
    if label not in known:
        if len(known) > 1 << 16:
            known.clear()
        tag, _, words = label.partition(".")
        known[label] = 2 if tag in _OUT_TAGS or (words and _OUT_WORDS.search(words)) else 1 if words and _WEAK_WORDS.search(words) else 0
    return known[label]


def _out(label: str) -> bool:
    """Whether a container is left out where no text template is known."""
    return _kind(label) > 0


def _raw_end(page: str, name: str, at: int, gone: set[str]) -> int:
    """Where the close tag of a raw element begins; -1 without one, which is looked for once a page only."""
    if name in gone:
        return -1
    depth = 1
    for m in _RAW_TAGS[name].finditer(page, at):
        depth += -1 if m[1] else name == "template"
        if not depth:
            return m.start()
    gone.add(name)
    return -1


def tags(page: str) -> Iterator[tuple[int, int, str, str, str, str | None]]:
    """(start, end, "/" or "", name, attributes, CDATA text) of tags, comments and declarations, in one pass over the page.

    A quote in a tag hides a > up to its fellow; once a tag has none before the page's end, quotes count as letters in the rest of
    the page, so that broken markup is never read again and again. A tag, comment or CDATA section that the page's end cuts off ends there.
    What raw elements hold is passed over as it stands, up to the first close tag of their name.
    """
    at, quoted, n = 0, True, len(page)
    gone: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        start = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", "", "", None
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            at = n if end < 0 else end + 3
            yield start, at, "", "", "", page[start + 9 : n if end < 0 else end]
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            yield start, at, "", "", "", None
        elif m := _TAG_NAME.match(page, at + 1):
            end, look = -1, m.end()
            while quoted and (q := _QUOTES.search(page, look)):
                if q[0] == ">":
                    end = q.start()
                    break
                look = page.find(q[0], q.end()) + 1
                if not look:
                    break
            if end < 0:
                quoted = False
                end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            name, attrs = m[2].lower(), page[m.end() : n if end < 0 else end]
            if name in _RAW and not m[1]:
                close = _raw_end(page, name, at, gone)
                if close < 0 and name not in _OPEN_ENDED:
                    name = "span"
                elif close != at:
                    yield start, n if close < 0 else close, "", name, attrs, None
                    at = n if close < 0 else close
                    continue
            yield start, at, m[1], name, attrs, None
        else:
            at += 1


def events(page: str) -> Iterator[tuple[str, object]]:
    """A page as ("open", path), ("close", path), ("text", (path, text, in link)) and ("break", path); path: labels of the open containers."""
    path: list[str] = []
    names: list[str] = []
    at, link = 0, 0
    for start, end, slash, tag, attrs, cdata in tags(page):
        if start < at:
            continue
        if start > at:
            yield "text", (tuple(path), page[at:start], link > 0)
        at = end
        if cdata is not None:
            yield "text", (tuple(path), cdata, link > 0)
        if not tag:
            continue
        if slash:
            if tag == "a":
                link = max(0, link - 1)
            if tag in _BLOCKS:
                yield "break", tuple(path)
            if tag in names:
                while True:
                    yield "close", tuple(path)
                    path.pop()
                    if names.pop() == tag:
                        break
            continue
        if tag in _RAW:
            continue
        if tag == "br":
            yield "text", (tuple(path), " ", link > 0)
        if tag == "a":
            link += 1
        if tag in _BLOCKS:
            yield "break", tuple(path)
            link = 0 if tag != "li" else link
        if tag in _CONTAINERS and tag not in _VOID and not attrs.endswith("/"):
            path.append(_label(tag, attrs))
            names.append(tag)
            yield "open", tuple(path)
    if at < len(page):
        yield "text", (tuple(path), page[at:], link > 0)
    while path:
        yield "close", tuple(path)
        path.pop()


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], list[tuple[str, bool]]]]:
    """(path, pieces) of the text between two ends of blocks; a piece is (text, in link)."""
    path, pieces = (), []
    for kind, what in events(page):
        if kind == "text":
            path = what[0]
            pieces.append((what[1], what[2]))
        elif pieces:
            yield path, pieces
            pieces = []
    if pieces:
        yield path, pieces


def said(pieces: list[tuple[str, bool]]) -> str:
    """A block's text: references decoded, white space as single spaces."""
    return " ".join(html.unescape("".join(t for t, _ in pieces)).split())


def block_token(path: tuple[str, ...], text: str) -> int:
    """A 63-bit hash of a block's place and text."""
    return xxhash.xxh3_64_intdigest(f"{'>'.join(path)}\0{text}") >> 1


def page_tokens(page: str) -> tuple[dict[tuple[str, str], list], set[int], int]:
    """((kind, path) -> [times, first position, letters] of the tags, tokens of the text blocks, MinHash of the words); letters: those inside, left-out slots and links aside."""
    out: dict[tuple[str, str], list] = {}
    texts: set[int] = set()
    words: list[str] = []
    for n, (kind, what) in enumerate(events(page)):
        if kind == "text":
            path, text, link = what
            size = 0 if link else len(text.strip())
            if size and not any(map(_out, path)):
                for depth in range(1, len(path) + 1):
                    out[("open", ">".join(path[:depth]))][2] += size
        elif kind != "break":
            out.setdefault((kind, ">".join(what)), [0, n, 0])[0] += 1
    for path, pieces in blocks(page):
        if (text := said(pieces)) and not any(_kind(x) == 2 for x in path):
            texts.add(block_token(path, text))
            words += text.split()
    sketch = min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1
    return out, texts, sketch


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """pages(page_id, host, html) -> (host, kind, path, token, sketch, vector, pages, times, place, letters), also for host "*" (all).

    Rows of kind "text" have a token and a sketch in place of a path: one for each host, text block and MinHash value of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                sums: dict[tuple[str, str, str | None, int | None, int | None], list] = {}
                for key, host, page in zip(part.column("page_key").to_pylist(), part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    counts, texts, sketch = page_tokens(page or "")
                    for (kind, path), (times, place, letters) in counts.items():
                        h = xxhash.xxh64_intdigest(f"{key}:{times}", 7) >> 16
                        for site in (host, "*"):
                            row = sums.setdefault((site, kind, path, None, None), [0, 0, 0, 0, 0])
                            for i, v in enumerate((h, 1, times, place, letters)):
                                row[i] += v
                    for token in texts:
                        sums.setdefault((host, "text", None, token, sketch), [0, 0, 0, 0, 0])[1] += 1
                cols = list(zip(*[(*k, *v) for k, v in sums.items()], strict=True)) or [[]] * len(_VECTOR_NAMES)
                kinds = [pa.string()] * 3 + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_VECTOR_NAMES)

    rows = pages.mapInArrow(run, ", ".join(f"{n} {'string' if i < 3 else 'long'}" for i, n in enumerate(_VECTOR_NAMES)))
    sums = [F.sum(F.col(n).cast("decimal(38,0)") if n == "vector" else F.col(n)).alias(n) for n in _VECTOR_NAMES[5:]]
    return rows.groupBy(*_VECTOR_NAMES[:5]).agg(*sums)


_VECTOR_NAMES = ["host", "kind", "path", "token", "sketch", "vector", "pages", "times", "place", "letters"]


def text_templates(vectors: DataFrame) -> DataFrame:
    """(host, constants array<long>): the tokens of text blocks that TEXT_SUPPORT of a host's sketches have, for hosts of MIN_PAGES sketches or more.

    Each of them stands in most pages, so a host has hardly more of them than a page has blocks; hosts without any have an empty array.
    """
    rows = vectors.where("kind = 'text'")
    sketches = rows.select("host", "sketch").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    often = rows.groupBy("host", "token").agg(F.count("*").alias("times")).where(F.col("times") >= TEXT_SUPPORT * MIN_PAGES)
    return sketches.join(often, "host", "left").groupBy("host").agg(F.collect_list(F.when(F.col("times") >= TEXT_SUPPORT * F.col("n"), F.col("token"))).alias("constants"))


def templates(vectors: DataFrame) -> DataFrame:
    """(host, article): the path of the article's container in each host's template.

    A valid class holds both ends of its elements, stands in at least MIN_SUPPORT of the host's pages, once a page. Of the
    containers whose tokens are in valid classes and that no left-out container encloses, a named article or main element
    comes first; else the innermost one that holds INNER_SHARE of what its enclosing one holds.
    """
    vectors = vectors.where("kind <> 'text'")
    n = vectors.groupBy("host").agg(F.max("pages").alias("n"))
    often = vectors.join(n, "host").where((F.col("pages") >= MIN_SUPPORT * F.col("n")) & (F.col("times") == F.col("pages")))
    in_class = Window.partitionBy("host", "vector", "pages", "times")
    valid = often.withColumn("ends", F.size(F.collect_set("kind").over(in_class))).where("ends = 2 AND kind = 'open'")

    @F.udf("boolean")
    def left_out(path: str) -> bool:
        return any(_out(x) for x in path.split(">"))

    held = valid.withColumn("out", left_out("path")).where("NOT out").withColumn("named", F.substring_index("path", ">", -1).rlike(_ARTICLE.pattern)).withColumn("depth", F.size(F.split("path", ">"))).withColumnRenamed("letters", "held")
    most = F.max("held").over(Window.partitionBy("host", "named"))
    fit = held.where("named OR held > 0").withColumn("most", most).where(F.col("held") >= INNER_SHARE * F.col("most"))
    best = F.struct(F.col("named"), F.when(F.col("named"), -F.col("depth")).otherwise(F.col("depth")), F.col("held"), F.col("path"))
    found = fit.groupBy("host", "n").agg(F.max(best).alias("b"))
    return found.where(F.col("n") >= F.when(F.col("host") == "*", 1).otherwise(MIN_PAGES)).select("host", F.col("b.path").alias("article"))


def main_text(page: str, article: str | None, constants: Sequence[int] | None = None) -> str:
    """The article's blocks; where the page lacks the template's container, its own article or main element, else its body.

    With the host's constants these blocks are left out, and containers with weak names lose their links only; without
    them (None) they are left out as a whole.
    """
    seen = [what for kind, what in events(page) if kind == "open"]
    want = tuple(article.split(">")) if article else None
    if want not in seen:
        own = [p for p in seen if _ARTICLE.match(p[-1]) and not any(map(_out, p))]
        body = [p for p in seen if p[-1].startswith("body")]
        want = min(own, key=len) if own else body[0] if body else ()
    known, depth, out = set(constants or ()), len(want), []
    for path, pieces in blocks(page):
        if path[:depth] != want:
            continue
        kind = max(map(_kind, path[depth:]), default=0)
        if kind == 2 or (kind and constants is None):
            continue
        text = said(pieces)
        if text and block_token(path, text) not in known:
            out.append(said([p for p in pieces if not p[1]]) if kind else text)
    return " ".join(filter(None, out))


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars, host, article), one row per row.

    Null and empty html give an empty text; a null or odd url counts as host ""; repeated rows and null ids keep their
    rows; pages without any container give all their text; an empty table gives an empty one.
    """
    src = pages.select(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html")).withColumn("host", host_of())
    keyed = src.select(F.xxhash64("page_id", "url").alias("page_key"), "host", "html")
    vectors = materialize(occurrence_vectors(keyed), "page-tokens")
    found = materialize(templates(vectors).join(text_templates(vectors), "host", "full_outer"), "templates")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("constants")), F.lit(0))).first()
    joined = src.join(F.broadcast(found) if n <= BROADCAST_HOSTS and size <= BROADCAST_TOKENS else found, "host", "left")
    default = found.where("host = '*'").first()
    joined = joined.withColumn("article", F.coalesce("article", F.lit(default["article"] if default else None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h or "", a, c) for h, a, c in zip(*(part.column(c).to_pylist() for c in ("html", "article", "constants")), strict=True)]
                cols = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column("host"), part.column("article")]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "host", "article"])

    out = T.StructType([T.StructField("page_id", src.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("host", T.StringType()), T.StructField("article", T.StringType())])
    return joined.select("page_id", "url", "html", "host", "article", "constants").mapInArrow(run, out)
