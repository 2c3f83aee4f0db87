"""URL functions on string columns, by one splitter pattern instead of parse_url (which raises or gives null on odd URLs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.text import sha256, strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
ROOT = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)"
PORT = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/:?#]*):([0-9]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"#(.*)$"
MAX_LINK_BYTES = 4096
DECODE_LEVELS = 6
# Names of URL parameters that hold credentials, and endings of such names.
SENSITIVE_NAMES = (
    "access-token", "api-key", "api-token", "apikey", "auth", "auth-token", "authorization", "awsaccesskeyid", "credential", "id-token",
    "key", "oauth-token", "password", "refresh-token", "secret", "sig", "signature", "subscription-key", "token", "x-api-key",
)
SENSITIVE_ENDS = ("credential", "secret", "signature", "security-token", "session-token")
# Hosts whose paths are secrets themselves.
WEBHOOKS = (("hooks.slack.com", "/services/%"), ("discord.com", "%/api/webhooks/%"), ("discordapp.com", "%/api/webhooks/%"))
# IPv4 ranges that are not public, and the two public addresses inside them.
NON_PUBLIC_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_IPV4 = ("192.0.0.9", "192.0.0.10")
# IPv6 ranges that are not public.
NON_PUBLIC_IPV6 = (
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001:2::/48", "2001:10::/28", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)


def part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def host(url: Column) -> Column:
    """Host in lower case without user, port and brackets; empty if there is none."""
    return F.lower(F.regexp_replace(part(url, HOST), r"[\[\]]", ""))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def target_id(url: Column) -> Column:
    """Readable key of an exact URL: host words, then twelve digits of its hash."""
    words = F.regexp_replace(F.regexp_replace(host(url), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat_ws("-", F.substring(F.when(words == "", "target").otherwise(words), 1, 48), F.substring(sha256(url), 1, 12))


def _without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments applied."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    empty = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(segments, empty, lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.array_append(acc, s)))
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, not once for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_parts(base: Column) -> Column:
    """What references resolve against, taken apart once."""
    path = part(base, PATH)
    return F.struct(
        base.alias("base"),
        part(base, ROOT).alias("root"),
        part(base, SCHEME).alias("scheme"),
        F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "").alias("folder"),
        strip_fragment(base).alias("plain"),
        F.regexp_replace(base, r"[?#].*$", "").alias("bare"),
    )


def resolve_parts(b: Column, href: Column) -> Column:
    """The absolute URL of a reference, given base_parts()."""

    def flat(path: Column) -> Column:
        return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(path)).otherwise(path)

    def body(h: Column) -> Column:
        own, tail = F.regexp_extract(h, r"^([^?#]*)", 1), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
        return (
            F.when(h == "", b["base"])
            .when(h.rlike(SCHEME), h)
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(b["root"], flat(own), tail))
            .when(h.startswith("?"), F.concat(b["bare"], h))
            .when(h.startswith("#"), F.concat(b["plain"], h))
            .otherwise(F.concat(b["root"], flat(F.concat(b["folder"], own)), tail))
        )

    return let(strip(href), body)


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL that a reference on a page stands for."""
    return let(base_parts(base), lambda b: resolve_parts(b, href))


def _decoded(c: Column) -> Column:
    """One round of percent-decoding; what can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _names_credential(c: Column) -> Column:
    """Whether any name in a query or fragment is a sensitive one; values count as queries themselves, so each piece is a name."""
    names = F.transform(F.split(c, r"[&;?#=]", -1), lambda p: F.regexp_replace(F.lower(F.trim(p)), r"[\s._-]+", "-"))
    ends = "(?:" + "|".join(SENSITIVE_ENDS) + ")$"
    return F.exists(names, lambda n: n.isin(*SENSITIVE_NAMES) | n.rlike(ends))


def _credentials_here(url: Column) -> Column:
    """Credentials that show without further decoding: a user, also of a URL in a value, a webhook path, or a sensitive name behind the first ? or #."""
    user = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@") | url.rlike(r"=[A-Za-z][A-Za-z0-9+.-]*://[^/?#&;]*@")
    hooks = F.lit(False)
    for name, like in WEBHOOKS:
        hooks = hooks | ((F.regexp_replace(host(url), r"\.+$", "") == name) & part(url, PATH).like(like))
    named = F.when(url.rlike(r"[?#]"), _names_credential(F.regexp_extract(url, r"^[^?#]*[?#](.*)$", 1))).otherwise(False)
    return user | hooks | named


def has_credentials(url: Column) -> Column:
    """Whether a URL holds credentials: a user, a sensitive name in query or fragment, also in nested or repeatedly encoded values, or a webhook path.

    Encoding that goes on beyond the last level counts as credentials.
    """
    last = lambda a: F.element_at(a, -1)
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(DECODE_LEVELS)), F.array(url), lambda a, _: F.array_append(a, _decoded(last(a))))
    plain = F.when(~url.contains("%"), _credentials_here(url))
    deep = let(levels, lambda a: F.exists(F.array_distinct(a), _credentials_here) | (last(a) != F.get(a, F.lit(DECODE_LEVELS - 1))))
    return F.coalesce(plain, deep, F.lit(False))


def url_problem(url: Column) -> Column:
    """Why a URL can't be watched: `no web address`, `fragment` or `credentials`; null if it can."""
    return (
        F.when(url.isNull() | ~url.rlike(r"(?i)^https?://") | (host(url) == ""), "no web address")
        .when(url.rlike(r"#."), "fragment")
        .when(has_credentials(url), "credentials")
    )


def is_navigable(url: Column) -> Column:
    """Absolute http(s) URL with a host and a port over 0 or none; longer than 4096 bytes is null (its identity counts as omitted)."""
    port = part(url, PORT)
    ok = url.rlike(r"(?i)^https?://") & (host(url) != "") & ((port == "") | (F.try_to_number(port, F.lit("99999999")) > 0))
    return F.when(F.octet_length(url) <= MAX_LINK_BYTES, ok).when(~ok, False)


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number, null if it isn't one."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255), number)


def address_hex(address: Column) -> Column:
    """An IPv4 address as 8, an IPv6 address as 32 hex digits in lower case; null if it is neither. Brackets and a zone count as no address."""
    four = lambda c: F.lower(F.lpad(F.hex(ipv4_number(c)), 8, "0"))
    # A dotted end stands for the last two groups.
    dotted = F.regexp_extract(address, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    pair = F.concat(F.substring(four(dotted), 1, 4), F.lit(":"), F.substring(four(dotted), 5, 4))
    plain = F.lower(F.when(dotted != "", F.concat(F.regexp_replace(address, r"\d{1,3}(?:\.\d{1,3}){3}$", ""), pair)).otherwise(address))
    groups = lambda c: F.filter(F.split(c, ":", -1), lambda g: g != "")
    sides = F.split(plain, "::", -1)
    left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    all_ = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    shaped = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)$")
    six = F.when(shaped & (F.size(all_) == 8) & ((missing > 0) | ~plain.contains("::")), F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), ""))
    return F.coalesce(four(address), six)


def address_ranges() -> list[tuple[str, str]]:
    """First and last address of each non-public range, in the form of address_hex()."""
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in (*NON_PUBLIC_IPV4, *NON_PUBLIC_IPV6)]
    return [(n.network_address.packed.hex(), n.broadcast_address.packed.hex()) for n in nets]


def ipv4_ranges() -> list[tuple[int, int, str]]:
    """First and last number and name of each non-public range."""
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in NON_PUBLIC_IPV4]
    return [(int(n.network_address), int(n.broadcast_address), str(n)) for n in nets]
