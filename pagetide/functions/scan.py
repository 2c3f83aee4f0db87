"""Markup read once from left to right: the scanner behind the HTML and feed functions, used inside Arrow batches.

A scanner rather than patterns over the whole text, as what a < means depends on what came before: in a script it is a letter, in
a quoted value too, and a comment begins only outside of both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin, urlsplit

# Subtrees without text, tags that end a line, and attributes that lead elsewhere.
SKIP_TAGS = ("script", "style", "noscript", "template")
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)
DESTINATIONS = {"a": "href", "area": "href", "button": "formaction", "form": "action", "input": "formaction"}
MAX_DESTINATIONS = 500
# Elements whose content is no markup, those of them whose content is text, and the parts of a feed entry.
RAW_TAGS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
TEXT_TAGS = ("textarea", "title")
EMBEDDED = ("content", "description", "encoded", "summary")
LEADING = ("a", "enclosure", "link")
IDENTITIES = ("guid", "id", "link")

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z_][^\s/>]*))")
_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW_TAGS}
_COMMENT_END = re.compile(r"--!?>")
_BLOCKS, _SKIPPED, _RAW = frozenset(BLOCK_TAGS), frozenset(SKIP_TAGS), frozenset(RAW_TAGS)


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether the tag closes itself, place behind the tag's >, or -1 without one). The last of equal names counts, if it isn't empty."""
    found: dict[str, str] = {}
    while True:
        m = _NAME.match(page, at)
        if not m:
            end = page.find(">", at)
            return found, end > 0 and page[end - 1] == "/", end + 1 if end >= 0 else -1
        at, value = m.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote and last[quote] > at:
                end = page.find(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if value:
            found[m[1].lower()] = unescape(value)


def markup(page: str, xml: bool = False) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start" | "both" | "end", name, attributes) in order, references decoded.

    Comments, declarations and instructions say nothing. In HTML names are lower-cased and raw elements end at their own close tag,
    a script or style at the page's end without one; in XML names lose their prefix and CDATA is text. Each place is read a bounded
    number of times, whatever the markup.
    """
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "'\""}
    closed = {tag: True for tag in RAW_TAGS}
    while at < n:
        lt = page.find("<", at)
        m = _OPEN.match(page, lt) if lt >= 0 else None
        if not m:
            end = n if lt < 0 else lt + 1
            yield "text", unescape(page[at:end]), {}
            at = end
            continue
        if lt > at:
            yield "text", unescape(page[at:lt]), {}
        if not m[2]:
            head = m[0]
            if head == "<!--":
                end = _COMMENT_END.search(page, lt + 4)
                short = 5 if page.startswith(">", lt + 4) else 6 if page.startswith("->", lt + 4) else 0
                at = lt + short if short else end.end() if end else n
            elif head == "<![CDATA[" and xml:
                end = page.find("]]>", m.end())
                yield "text", page[m.end() : n if end < 0 else end], {}
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", m.end())
                at = n if end < 0 else end + 1
            continue
        name = m[2].rpartition(":")[2] if xml else m[2].lower()
        found, itself, at = _attributes(page, m.end(), last)
        if at < 0:  # a tag that never ends is no tag, and nothing behind it is lost
            yield "text", unescape(page[lt:]), {}
            return
        if m[1]:
            yield "end", name, {}
            continue
        yield "both" if itself else "start", name, found
        if not xml and name in _RAW and not itself:
            end = _CLOSE[name].search(page, at) if closed[name] else None
            if end is None:
                closed[name] = False
                if name in ("script", "style"):
                    return
                continue
            if name in TEXT_TAGS and end.start() > at:
                yield "text", unescape(page[at : end.start()]), {}
            at = end.start()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def absolute(base: str, reference: str) -> str:
    """The URL that a reference stands for; one that can't be read stays as it is."""
    try:
        return urljoin(base, reference.strip())
    except ValueError:
        return reference.strip()


def page_text(page: str, url: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """(text, links) of an HTML page: text with a hashed marker line for each destination, those past the limit in one closing marker;
    links: (tag, attribute, destination, identity) of all of them. Blanks are as they come."""
    base, based, skipped, parts, links = url, False, 0, [], []
    for kind, name, found in markup(page):
        if kind == "text":
            if not skipped:
                parts.append(name)
            continue
        if name in _SKIPPED:
            skipped += {"start": 1, "end": -1 if skipped else 0, "both": 0}[kind]
            continue
        if skipped:
            continue
        if name == "br" and kind != "end" or name in _BLOCKS:
            parts.append("\n")
        if kind == "end":
            continue
        if name == "base" and found.get("href") and not based:
            base, based = absolute(url, found["href"]), True
        value = found.get(DESTINATIONS.get(name, ""))
        if value:
            destination = absolute(base, value)
            links.append((name, DESTINATIONS[name], destination, digest(destination)))
            if len(links) <= MAX_DESTINATIONS:
                parts.append(f"\n[{name}:{DESTINATIONS[name]}:sha256:{links[-1][3]}]\n")
        if kind == "both" and name in _BLOCKS:
            parts.append("\n")
    if rest := links[MAX_DESTINATIONS:]:
        listed = "".join(f"{tag}:{attr}:{identity}\n" for tag, attr, _, identity in rest)
        parts.append(f"\n[omitted-destinations:{len(rest)}:sha256:{digest(listed)}]\n")
    return "".join(parts), links


def identity_token(field: str, value: str, url: str) -> str:
    """An identity as it is, or only its hash if it has the form of a URI."""
    try:
        parts = urlsplit(value)
    except ValueError:
        return f"[{field}:sha256:{digest(value)}]"
    if not parts.scheme and not parts.netloc:
        return value
    return f"[{field}:sha256:{digest(absolute(url, value) if parts.scheme in ('http', 'https') or parts.netloc else value)}]"


class Element:
    """An open element of a feed: its name, the base that it inherits or sets, and the texts that wait for its end."""

    def __init__(self, name: str, found: dict[str, str], outer: str) -> None:
        self.name, self.base = name, outer
        own = found.get("xml:base", "").strip()
        if own:
            self.base = absolute(outer, own)
        local = {k.rpartition(":")[2]: v for k, v in found.items()}
        self.leads = sorted((k, local[k]) for k in ("href", "url") if local.get(k))
        self.alternate = local.get("rel", "alternate").strip().lower() == "alternate"
        self.html: list[str] | None = [] if name in EMBEDDED else None
        self.link: list[str] | None = [] if name == "link" and not self.leads else None
        self.said: list[str] = []


def feed_part(xml: str, base: str, url: str) -> tuple[str, dict[str, str], str | None, str | None, list[str]]:
    """(text, identities, title, link, links) of a piece of a feed: an entry, or what stands around them. link: the first alternate one, or
    else the first of all; links: alternate ones, `a` elements and those of HTML in fields.

    A stack of open elements carries the base of each, so that an inner xml:base counts for all that it encloses. Each element's
    text stands between marker lines, destinations and identities that are URIs only as hashes, HTML in fields as its own text.
    """
    out: list[str] = []
    stack: list[Element] = []
    heard: list[Element] = []  # the open ones whose text is asked for
    identities: dict[str, str] = {}
    title, alternate, links = None, None, []

    def flush() -> None:
        if stack and stack[-1].html:
            value = "".join(stack[-1].html)
            stack[-1].html.clear()
            tag = re.search(r"</?[A-Za-z]", value)
            if tag and ">" in value[tag.end() :]:
                value, inner = page_text(value, stack[-1].base)
                links.extend(destination for tag, _, destination, _ in inner[:MAX_DESTINATIONS] if tag in ("a", "area"))
            out.append(value)

    def close(name: str) -> None:
        nonlocal title, alternate
        flush()
        if stack and (stack[-1].name == name or any(e.name == name for e in stack)):
            while True:
                e = stack.pop()
                if heard and heard[-1] is e:
                    heard.pop()
                value = "".join(e.said).strip()
                if e.link is not None and value:
                    destination = absolute(e.base, value)
                    out.append(f"[link:href:sha256:{digest(destination)}]\n")
                    links.append(destination)
                    alternate = alternate or destination
                if e.name in IDENTITIES:
                    value = next((v.strip() for k, v in e.leads if k == "href"), value) if e.name == "link" else value
                    if value and (e.name != "link" or e.alternate):
                        identities.setdefault(e.name, value)
                        if e.name != "link":
                            out.append(identity_token(e.name, value, url))
                if e.name == "title" and title is None and value:
                    title = value
                if e.name == name:
                    break
        out.append(f"\n[{name}:end]\n")

    for kind, name, found in markup(xml, xml=True):
        if kind == "text":
            for e in heard:
                e.said.append(name)
            top = stack[-1] if stack else None
            if top is None or not (top.name in ("guid", "id") or top.link is not None):
                (out if top is None or top.html is None else top.html).append(name)
            continue
        if kind == "end":
            close(name)
            continue
        flush()
        e = Element(name, found, stack[-1].base if stack else base)
        stack.append(e)
        if name in IDENTITIES or name == "title":
            heard.append(e)
        out.append(f"\n[{name}:start]\n")
        if name in LEADING:
            for attribute, value in e.leads:
                destination = absolute(e.base, value)
                out.append(f"[{name}:{attribute}:sha256:{digest(destination)}]\n")
                if name == "a" or (name == "link" and e.alternate):
                    links.append(destination)
                    alternate = alternate or (destination if name == "link" else None)
        if kind == "both":
            close(name)
    flush()
    return "".join(out), identities, title, alternate or (links[0] if links else None), links
