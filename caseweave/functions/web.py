"""Addresses, media types and routing, as decision tables over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def origin(url: Column) -> Column:
    """Scheme, host and port in lower case, without a default port; null for what isn't http."""
    found = F.lower(F.regexp_extract(url, "^(?i)(https?://[^/?#]+)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(found, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1"), F.lit(""))


def admitted(url: Column, upgraded: list[str] = [], paths: str = ".*") -> Column:  # noqa: B006
    """A publisher's address in the one form that is kept, else null.

    https only, but http is upgraded for the hosts listed; no port, no user, no % or backslash in the
    path; the path must match paths; query and fragment go.
    """
    secure = F.when(host(url).isin(upgraded), F.regexp_replace(url, "^http://", "https://")).otherwise(url) if upgraded else url
    bare = F.regexp_replace(secure, "[?#].*$", "")
    path = F.regexp_replace(bare, "^https://[^/]*", "")
    good = bare.rlike("^https://[A-Za-z0-9.-]+(/.*)?$") & ~path.rlike("[%\\\\]") & path.rlike("^(?:" + paths + ")$")
    return F.when(good, bare)


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def route(url: Column, local_only: Column, direct: list[str], pages: list[str], publishers: list[str]) -> Column:
    """Where a request goes; local_only comes before everything."""
    h = host(url)
    return (
        F.when(local_only, F.lit("refuse"))
        .when(h.isNull(), F.lit("refuse"))
        .when(h.isin(direct), F.lit("direct"))
        .when(h.isin(pages), F.lit("page"))
        .when(h.isin(publishers), F.lit("publisher"))
        .otherwise(F.lit("foreign"))
    )


def answer_days(url: Column, body: Column) -> Column:
    """How long an answer is kept: 30 days for a whole case, one for a section or an empty result."""
    lasting = url.rlike("/fetch\\?") & url.rlike("doc_type=cases") & ~url.rlike("[?&]section=")
    return F.when(lasting & ~F.coalesce(body, F.lit("")).rlike('"results"\\s*:\\s*\\[\\s*\\]'), F.lit(30)).otherwise(F.lit(1)).cast("long")


#: The paths of the service, each with its one method.
SERVICE = {"/pdf": "GET", "/health": "GET", "/source": "POST"}
#: The bytes that a request's body may have, under /runtime/ and elsewhere.
RUNTIME_BODY, BODY = 128 * 1024 * 1024, 132_000


def status_of(method: Column, path: Column, origin_header: Column, allowed: list[str], asked_method: Column | None = None, asked_headers: Column | None = None) -> Column:
    """The status a request gets before any work is done: its origin, then its path, then its method.

    OPTIONS is answered, unless the preflight asks for another method than the path's own, or for a
    header; /source takes content-type. An absent or empty value asks for nothing.
    """
    own = F.when(path == "/source", "POST").otherwise("GET")
    other_method = F.coalesce(asked_method, F.lit("")) if asked_method is not None else F.lit("")
    header = F.lower(F.coalesce(asked_headers, F.lit(""))) if asked_headers is not None else F.lit("")
    refused = ((other_method != "") & (other_method != own)) | ((header != "") & ~((path == "/source") & (header == "content-type")))
    return (
        F.when((F.coalesce(origin_header, F.lit("")) != "") & ~origin_header.isin(allowed), F.lit(403))
        .when(~path.isin(*SERVICE), F.lit(404))
        .when(method == "OPTIONS", F.when(refused, F.lit(403)).otherwise(F.lit(204)))
        .when(method != own, F.lit(405))
        .otherwise(F.lit(200))
        .cast("long")
    )


def body_fits(path: Column, size: Column) -> Column:
    """Whether a request's body is within the limit of its path."""
    return size <= F.when(path.startswith("/runtime/"), F.lit(RUNTIME_BODY)).otherwise(F.lit(BODY))


#: An IPv4 address, without leading zeros.
IPV4 = r"^(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def ip_number(address: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(address, "\\.")
    value = sum((parts[i].try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(IPV4), value)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def ip_key(address: Column) -> Column:
    """An address of either family as 4: or 6: and 8 or 32 hex digits, so that those of a family compare
    like numbers; null for what is no address. A double colon stands for the groups that are missing,
    none too, and the last two groups may be dotted."""

    def dotless(text: Column) -> Column:
        dotted = F.regexp_extract(text, "(\\d+\\.\\d+\\.\\d+\\.\\d+)$", 1)
        pair = once(ip_number(dotted), lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535)))))
        return F.when(dotted == "", text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(dotted)), F.lower(pair)))

    def listed(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def parts(halves: Column) -> Column:
        ends = F.struct(listed(F.get(halves, 0)).alias("head"), listed(F.get(halves, 1)).alias("tail"), F.size(halves).alias("n"))
        fill = lambda e: F.when(e["n"] == 2, F.greatest(F.lit(0), 8 - F.size(e["head"]) - F.size(e["tail"]))).otherwise(F.lit(0))
        return once(ends, lambda e: F.when(e["n"] <= 2, F.concat(e["head"], F.array_repeat(F.lit("0"), fill(e)), e["tail"])))

    def digits(groups: Column) -> Column:
        sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(sound, F.concat(F.lit("6:"), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")))

    long = once(F.lower(address), lambda a: once(dotless(a), lambda t: once(F.split(t, "::", -1), lambda h: once(parts(h), digits))))
    short = F.concat(F.lit("4:"), F.lpad(F.lower(F.hex(ip_number(address))), 8, "0"))
    return F.when(address.rlike(IPV4), short).otherwise(long)


#: What a hex digit is when only its first one, two or three bits count.
FIRST_BITS = {1: "0000000088888888", 2: "000044448888cccc", 3: "0022446688aaccee"}


def ip_prefix(key: Column, bits: Column) -> Column:
    """The first so many bits of an ip_key, as family, hex digits, and one that is cut."""
    whole = F.floor(bits / 4).cast("int")
    digit = F.substring(key, whole + 3, F.lit(1))
    cut = F.lit("")
    for n, mapped in FIRST_BITS.items():
        cut = F.when(bits % 4 == n, F.translate(digit, "0123456789abcdef", mapped)).otherwise(cut)
    return F.concat(F.substring(key, F.lit(1), whole + 2), cut)


#: What may be asked, as host, method and path.
ENDPOINTS = (
    ("www.courtlistener.com", "GET", r"^/api/rest/v4/(citation-lookup/|search/|clusters/\d+/|opinions/(\d+/)?)$"),
    ("www.courtlistener.com", "POST", r"^/api/rest/v4/citation-lookup/$"),
    ("api.govinfo.gov", "GET", r"^/packages/USCOURTS-[A-Za-z0-9_-]+/(summary|pdf)$"),
    ("api.govinfo.gov", "POST", r"^/search$"),
    ("www.govinfo.gov", "GET", r"^/content/pkg/(USCOURTS-[A-Za-z0-9_-]+)/pdf/\1\.pdf$"),
    ("assets.publishing.service.gov.uk", "GET", r"^(?i)/(media/[A-Za-z0-9_-]+|government/uploads/system/uploads/attachment_data/file/\d+)/[^/]+\.pdf$"),
    ("storage.courtlistener.com", "GET", r"^(?i)/[A-Za-z0-9_%./-]+\.pdf$"),
)


def provider(url: Column, method: Column) -> Column:
    """The host that a request is for; null for one that isn't allowed.

    https only, without a user or another port than its own, and without encoded slashes, backslashes
    and NULs in the path. Query and fragment don't count.
    """
    whole = r"^https://([^/?#@:]+)(?::443)?(/[^?#]*)?([?#].*)?$"
    asked, path = F.lower(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)
    fits = F.lit(False)
    for name, verb, pattern in ENDPOINTS:
        fits = fits | ((asked == name) & (method == verb) & path.rlike(pattern))
    return F.when(fits & ~path.rlike(r"(?i)\\|%(00|2f|5c)"), asked)


def credential_fits(value: Column, longest: int = 4096) -> Column:
    """Whether a credential may be sent on: none, or a short text of one line."""
    return value.isNull() | ((F.length(value) <= longest) & ~value.rlike("[\\r\\n]"))


def safe_path(path: Column, kind: Column) -> Column:
    """Whether an archive's entry may be unpacked: a file or folder, relative, without .. or odd characters."""
    return kind.isin("-", "d") & ~path.rlike("^/|[\\\\:\\x00]") & ~F.array_contains(F.split(path, "/"), "..") & (path != "")


def resolved_path(path: Column) -> Column:
    """The path without . and .. components; .. at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def script_hashes(html: Column) -> Column:
    """sha256-... sources of a content policy for the inline scripts of a page, in order, once each."""
    bodies = F.filter(F.regexp_extract_all(html, F.lit("(?s)<script(?:\\s[^>]*)?>(.*?)</script>"), F.lit(1)), lambda b: b != "")
    return F.array_distinct(F.transform(bodies, lambda b: F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2(b, 256))))))


def is_pdf(content: Column) -> Column:
    """The magic at the begin, and the end mark in the last 1,024 bytes."""
    head = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    tail = F.hex(F.substring(content, -1024, 1024))
    return head & tail.contains("2525454F46")
