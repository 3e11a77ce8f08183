"""URL algebra: Column expressions for ASCII URLs, and an exact canonicaliser as an Arrow UDF for all others.

The expressions stay in the JVM and cover what nearly all URLs are made of; ``canonical`` sends only the rest through
Python.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the URL grammar and the trap rules.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
PATH_SAFE = UNRESERVED + "!$&'()*+,;=:@/"
QUERY_SAFE = PATH_SAFE + "?"
HOST_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
PATH_SESSION = r"(?i)(?:^|[;/])(?:jsessionid|phpsessid|sessionid)="
QUERY_SESSION = r"(?i)(?:^|[&;])(?:aspsessionid|jsessionid|phpsessid|session_id|sessionid)="
SESSION_KEYS = ("aspsessionid", "jsessionid", "phpsessid", "session_id", "sessionid")
MAYBE_SESSION_KEYS = ("session", "sid")
SESSION_VALUE = r"^[A-Za-z0-9._~-]{16,}$"
CALENDAR_PATH = r"(?i)(?:^|/)(?:calendar|calendars|events|agenda|archive)(?:/|$)"
CALENDAR_KEYS = ("calendar", "date", "day", "end_date", "month", "start_date", "view_date", "year")
FACET_PARTS = ("attribute", "brand", "category", "color", "facet", "filter", "order", "price", "size", "sort", "tag")
MAX_SEGMENTS, MAX_REPEATED, MAX_PARAMS, MAX_KEY_REPEAT, MAX_FACETS, MAX_VARIANTS, MAX_CALENDAR, YEARS = 96, 3, 24, 6, 8, 32, 24, (1990, 2100)
MAX_LENGTH = 8192
#: URLs that the Column form of ``canonical`` covers: plain host, optional port, no escapes, no dot segments, safe characters.
PLAIN = r"^[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9](?::[0-9]{1,4})?(?:/[A-Za-z0-9._~!$&'()*+,;=:@/-]*)?(?:\?[A-Za-z0-9._~!$&'()*+,;=:@/?-]*)?(?:#[^\x00-\x20\x7f]*)?$"
DOTS = r"/\.{1,2}(?:/|$|\?|#)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def key_token(key: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), F.lit("_"))


def query_pairs(url: Column) -> Column:
    """Array of struct(key, value) of the query's non-empty parameters (escapes are left as they are)."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("").alias("value")))


def stable_seed(value: Column) -> Column:
    """The first 8 bytes of the SHA-256 as an unsigned number (decimal)."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def partition_of(value: Column, parts: int) -> Column:
    return (stable_seed(value) % F.lit(parts).cast("decimal(20,0)")).cast("int")


def calendar_signature(url: Column) -> Column:
    """Path with its numbers masked and query with its calendar values masked; null for URLs without calendar signs."""
    pairs = query_pairs(url)
    is_cal = lambda p: key_token(p["key"]).isin(*CALENDAR_KEYS)
    masked = F.regexp_replace(F.lower(path(url)), r"(?<![A-Za-z])\d{1,4}(?![A-Za-z])", "{n}")
    shown = F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), F.when(is_cal(p), F.lit("{calendar}")).otherwise(p["value"])))
    return F.when(F.exists(pairs, is_cal) | path(url).rlike(CALENDAR_PATH), F.concat(masked, F.lit("?"), F.array_join(shown, "&")))


def trap(url: Column) -> Column:
    """The row-wise trap reasons of a canonical URL, or null."""
    segments = F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lower)
    repeats = lambda a: F.coalesce(F.array_max(F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)))), F.lit(0))
    pairs = query_pairs(url)
    keys = F.transform(pairs, lambda p: key_token(p["key"]))
    session = F.exists(pairs, lambda p: key_token(p["key"]).isin(*SESSION_KEYS) | (key_token(p["key"]).isin(*MAYBE_SESSION_KEYS) & p["value"].rlike(SESSION_VALUE)))
    facets = F.size(F.filter(keys, lambda k: F.arrays_overlap(F.split(k, "_"), F.array(*map(F.lit, FACET_PARTS)))))
    cal_values = F.filter(pairs, lambda p: key_token(p["key"]).isin(*CALENDAR_KEYS))
    text = F.concat_ws(" ", path(url), F.array_join(F.transform(cal_values, lambda p: p["value"]), " "))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    odd_year = F.exists(years, lambda y: (y < YEARS[0]) | (y > YEARS[1]))
    return (
        F.when(F.size(segments) > MAX_SEGMENTS, "path_too_deep")
        .when(repeats(segments) > MAX_REPEATED, "trap_repeated_path")
        .when(path(url).rlike(PATH_SESSION) | query(url).rlike(QUERY_SESSION), "trap_session")
        .when(F.size(pairs) > MAX_PARAMS, "trap_query_parameters")
        .when(session, "trap_session")
        .when(repeats(keys) > MAX_KEY_REPEAT, "trap_query_parameters")
        .when(facets > MAX_FACETS, "trap_facets")
        .when(calendar_signature(url).isNotNull() & odd_year, "trap_calendar")
    )


def in_scope(host: Column, roots: list[str], subdomains: bool) -> Column:
    """Host is a root, or below one where subdomains are allowed; never below for IP addresses."""
    out = host.isin(*roots)
    if subdomains:
        below = F.lit(False)
        for r in roots:
            below = below | F.endswith(host, F.lit("." + r))
        out = out | (below & ~host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"))
    return out


def same_site(site: Column, candidate: Column) -> Column:
    """Same host, a subdomain, or the apex of a www host."""
    s = F.rtrim(F.lower(site), F.lit("."))
    return (candidate != "") & ((candidate == s) | F.endswith(candidate, F.concat(F.lit("."), s)) | (s.startswith("www.") & (F.concat(F.lit("www."), candidate) == s)))


def domain_cluster(host: Column) -> Column:
    """The last two labels of a host; an IP address as it is."""
    labels = F.split(host, r"\.")
    return F.when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), host).otherwise(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."))


class Rejected(ValueError):
    """A URL that has no canonical form; str() is the reason."""


def _component(text: str, safe: str) -> str:
    """Escapes in upper case and only where needed; a percent sign must begin an escape."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise Rejected("invalid_url")

    def fix(m: re.Match) -> str:
        if m[1]:
            c = chr(int(m[1], 16))
            return c if c in UNRESERVED else "%" + m[1].upper()
        try:
            return "".join(f"%{b:02X}" for b in m[0].encode())
        except UnicodeEncodeError as e:
            raise Rejected("invalid_url") from e

    return re.sub(rf"%([0-9A-Fa-f]{{2}})|[^{re.escape(safe)}]", fix, text)


def _no_dots(path: str) -> str:
    """Dot segments resolved; empty segments stay."""
    kept: list[str] = []
    for s in path.split("/"):
        if s == "..":
            del kept[max(1, len(kept) - 1) :]
        elif s != ".":
            kept.append(s)
    out = "/".join(kept)
    out = out if out.startswith("/") else "/" + out
    return out + "/" if path.endswith(("/", "/.", "/..")) and not out.endswith("/") else out


def _host(raw: str) -> tuple[str, bool]:
    name = raw.removesuffix(".")
    if not name or raw.endswith("..") or "%" in name:
        raise Rejected("invalid_url")
    try:
        ip = ipaddress.ip_address(name)
    except ValueError:
        try:
            name = name.encode("idna").decode().lower()
        except UnicodeError as e:
            raise Rejected("invalid_url") from e
        if len(name) > 253 or not all(re.fullmatch(HOST_LABEL, x) for x in name.split(".")):
            raise Rejected("invalid_url") from None
        return name, False
    return ip.compressed, ip.version == 6


def canonicalize(url: str | None) -> str:
    """The canonical form of an http(s) URL: lower-case ASCII host, no default port, no fragment, resolved dots, least
    escapes; the order and repeats of query parameters stay. Raises Rejected."""
    if not url or len(url) > MAX_LENGTH or url != url.strip() or re.search(r"[\x00-\x1f\x7f]", url):
        raise Rejected("invalid_url")
    try:
        p = urlsplit(url)
        named, port, raw = p.username is not None or p.password is not None, None, p.hostname
        if p.scheme.lower() in ("http", "https") and not named:
            port = p.port
    except ValueError as e:
        raise Rejected("invalid_url") from e
    kind = p.scheme.lower()
    if kind not in ("http", "https"):
        raise Rejected("unsupported_scheme")
    if named:
        raise Rejected("userinfo_not_allowed")
    if not raw or p.netloc.endswith(":"):
        raise Rejected("invalid_url")
    name, six = _host(raw)
    if p.netloc.startswith("[") and not six:
        raise Rejected("invalid_url")
    where = f"[{name}]" if six else name
    if port is not None and port != {"http": 80, "https": 443}[kind]:
        where += f":{port}"
    asked = _component(p.query, QUERY_SAFE)
    out = f"{kind}://{where}{_no_dots(_component(p.path or '/', PATH_SAFE))}" + (f"?{asked}" if asked else "")
    if len(out) > MAX_LENGTH:
        raise Rejected("invalid_url")
    return out


@F.pandas_udf(T.StructType().add("canonical", "string").add("reason", "string"))
def canonicalize_exact(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct(canonical, reason): one of them is null."""
    for batch in urls:
        rows = []
        for u in batch:
            try:
                rows.append((canonicalize(u), None))
            except Rejected as e:
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=["canonical", "reason"])


def canonical_plain(url: Column) -> Column:
    """The canonical form of a URL that matches PLAIN and has no dot segments, in Column form; null for all others."""
    port = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    number = F.nullif(port, F.lit("")).cast("int")
    default = F.coalesce(number == F.when(scheme(url) == "http", 80).otherwise(443), F.lit(False))
    host = F.lower(F.regexp_extract(authority(url), r"^([^:]*)", 1))
    shown = F.when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    p, q = path(url), query(url)
    good = url.rlike(PLAIN) & ~url.rlike(DOTS) & ~host.rlike(r"\.\.|-\.|\.-|^\d") & (F.length(url) <= MAX_LENGTH) & ~host.rlike(r"[^.]{64}")
    return F.when(good, F.concat(scheme(url), F.lit("://"), shown, F.when(p == "", "/").otherwise(p), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))


def github_route(url: Column) -> Column:
    """struct(kind, owner, repo, number) of a URL on the code host's exact names; null elsewhere."""
    from brookmill.functions.page import host as host_of

    h = host_of(url)
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    owner, repo = at(0), F.regexp_replace(at(1), r"\.git$", "")
    named = owner.rlike("^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?$") & repo.rlike("^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$") & (F.length(owner) <= 39) & (F.length(repo) <= 100)
    route = F.lower(at(2))
    kind = F.when(h == "raw.githubusercontent.com", F.when((F.size(parts) >= 4) & named, "raw").otherwise("other"))
    kind = kind.when((F.size(parts) < 2) | F.lower(owner).isin(*GITHUB_RESERVED), "root").when(~named, "other").when(F.size(parts) == 2, "repo").when(route.isin(*GITHUB_ROUTES), route).otherwise("other")
    whole = ~kind.isin("root", "other") | ((kind == "other") & named & (F.size(parts) > 2) & (h != "raw.githubusercontent.com"))
    number = F.when(kind.isin("issues", "pull", "discussions") & at(3).rlike("^[0-9]+$"), at(3).cast("bigint"))
    return F.when(h.isin("github.com", "www.github.com", "raw.githubusercontent.com"), F.struct(kind.alias("kind"), F.when(whole, owner).otherwise("").alias("owner"), F.when(whole, repo).otherwise("").alias("repo"), number.alias("number")))


# Routes of the code host, and first path segments that are no owners.
GITHUB_ROUTES = ("tree", "blob", "raw", "issues", "pull", "discussions", "releases", "commit", "compare")
GITHUB_RESERVED = (
    "about", "account", "collections", "customer-stories", "enterprise", "events", "explore", "features", "issues", "login", "marketplace", "new",
    "notifications", "organizations", "orgs", "pricing", "readme", "search", "security", "settings", "signup", "site", "sponsors", "topics", "trending", "users",
)


def academic_source(url: Column) -> Column:
    """arxiv, pubmed, pmc, doi, github or journal by host boundaries and identifiers; null elsewhere."""
    from brookmill.functions.page import host as host_of

    h, p = host_of(url), path(url)
    on = lambda s: (h == s) | F.endswith(h, F.lit("." + s))
    journal = F.lit(False)
    for s in JOURNAL_HOSTS:
        journal = journal | on(s)
    return (
        F.when(on("arxiv.org") & p.rlike(r"(?i)^/(?:abs|pdf|html|format)/(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?/?$"), "arxiv")
        .when(((h == "pubmed.ncbi.nlm.nih.gov") & p.rlike(r"^/+\d{1,8}(?:/|$)")) | (on("ncbi.nlm.nih.gov") & p.rlike(r"(?i)^/+pubmed/+\d{1,8}(?:/|$)")), "pubmed")
        .when(on("ncbi.nlm.nih.gov") & p.rlike(r"(?i)/PMC\d+(?:/|$)"), "pmc")
        .when(h.isin("doi.org", "dx.doi.org") & p.rlike(r"10\.\d{4,9}/\S+"), "doi")
        .when(on("github.com"), "github")
        .when(journal, "journal")
    )


# Hosts of journals and preprint servers.
JOURNAL_HOSTS = ("nature.com", "science.org", "sciencedirect.com", "springer.com", "wiley.com", "ieee.org", "acm.org", "plos.org", "biorxiv.org", "medrxiv.org", "cell.com", "nejm.org", "thelancet.com")


def publisher_target(url: Column) -> Column:
    """struct(provider, id) of a publisher's URL; null elsewhere."""
    from brookmill.functions.page import host as host_of

    h, p = host_of(url), path(url)
    pair = lambda a, b: F.struct(F.lit(a).alias("provider"), b.alias("id"))
    doi = F.regexp_extract(p, r"^/(10\.\d{4,9}/[^\s/][^\s]*?)/?$", 1)
    acm = F.regexp_extract(p, r"(?i)^/doi/(?:abs/|full(?:html)?/|pdf/)?(10\.\d{4,9}/[^\s]+?)/?$", 1)
    pii = F.upper(F.regexp_extract(p, r"^/(?:science/article/)?pii/([A-Za-z0-9]+)/?$", 1))
    number = F.regexp_extract(p, r"^/document/(\d+)/?$", 1)
    return (
        F.when(h.isin("doi.org", "dx.doi.org") & (doi != ""), pair("crossref", doi))
        .when((h == "dl.acm.org") & (acm != ""), pair("crossref", acm))
        .when(h.isin("sciencedirect.com", "www.sciencedirect.com") & pii.rlike("^[SB][0-9X]{16}$"), pair("elsevier", pii))
        .when((h == "ieeexplore.ieee.org") & (number != ""), pair("ieee", number))
    )
