"""Bytes to text, bounded inflation, public addresses, strict JSON, keyed digests. Pure functions with Arrow forms, and columns."""

from __future__ import annotations

import codecs
import ipaddress
import json
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 10 * 1024 * 1024
URL_MOST = 4096
CHARSET = re.compile(r"""charset\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s;"'/>]+))""", re.IGNORECASE)
META = re.compile(r"<meta\b[^>]*>", re.IGNORECASE)
# Labels that stand for windows-1252 on the web, and codecs that are no text encodings.
AS_1252 = {"ascii", "us-ascii", "latin-1", "latin1", "iso-8859-1", "iso8859-1", "l1"}
NOT_TEXT = {"base64", "bz2", "hex", "quopri", "rot13", "uu", "zlib", "idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape"}
BOMS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"), (codecs.BOM_UTF8, "utf-8-sig"))


def stated_charset(text: str | None) -> str | None:
    m = CHARSET.search(text or "")
    return next((g.strip() for g in m.groups() if g), None) if m else None


def codec_of(label: str | None) -> str | None:
    """The codec that a label means on the web; None for unknown ones and those that do not decode text."""
    name = (label or "").strip().lower().replace("_", "-")
    try:
        found = codecs.lookup("windows-1252" if name in AS_1252 else name).name.replace("_", "-") if name else None
    except LookupError:
        return None
    return None if found in NOT_TEXT else found


def decoded(body: bytes | None, content_type: str | None) -> str | None:
    """Text of a body: by its byte order mark, the declared charset, one in a meta tag near the start, UTF-8, then windows-1252 and Latin-1."""
    if body is None:
        return None
    for mark, codec in BOMS:
        if body.startswith(mark):
            return body.decode(codec, errors="replace")
    head = body[:4096].decode("latin-1").replace("\0", "")
    in_meta = next((c for m in META.finditer(head) if (c := stated_charset(m[0]))), None)
    for label in (stated_charset(content_type), in_meta, "utf-8", "windows-1252"):
        codec = codec_of(label)
        if codec:
            try:
                return body.decode(codec)
            except (LookupError, UnicodeDecodeError):
                continue
    return body.decode("latin-1")


def inflated(body: bytes | None, most: int = MOST_BYTES) -> bytes | None:
    """A gzip body, if it is whole and no larger than the bound when inflated; other bodies as they are, under the same bound."""
    if body is None or not body.startswith(b"\x1f\x8b"):
        return body if body is None or len(body) <= most else None
    d = zlib.decompressobj(16 + zlib.MAX_WBITS)
    try:
        out = d.decompress(body, most + 1)
    except zlib.error:
        return None
    return out if d.eof and len(out) <= most else None


def address_error(url: str | None) -> str | None:
    """Why a URL may not be fetched, as far as it can be told without resolving names; None where nothing speaks against it."""
    if not url or len(url) > URL_MOST:
        return "length"
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return "malformed"
    if parts.scheme.lower() not in ("http", "https"):
        return "scheme"
    if not host:
        return "host"
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return "address" if host == "localhost" or host.endswith(".localhost") else None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return None if ip.is_global and not ip.is_multicast else "address"


class _Duplicate(ValueError):
    pass


def strict_object(text: str | None) -> dict | None:
    """A JSON object; None for anything else, for repeated keys, and for numbers that JSON does not have."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise _Duplicate
        return out

    def refuse(value: str) -> None:
        raise ValueError(value)

    try:
        out = json.loads(text or "", object_pairs_hook=once, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def canonical(text: str | None) -> str | None:
    """A JSON object with sorted keys, no spaces and characters as themselves; None where it is not strict."""
    found = strict_object(text)
    return None if found is None else json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def closed_schema(schema: object) -> object:
    """A JSON schema in which every object refuses properties that it does not name."""
    if isinstance(schema, list):
        return [closed_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: closed_schema(v) for k, v in schema.items()}
    if out.get("type") == "object" or "properties" in out:
        out["additionalProperties"] = False
    return out


def embedded_object(text: str | None, marker: str) -> dict:
    """The JSON object that follows a marker in a page's text; {} if there is none."""
    at = (text or "").find(marker)
    start = (text or "").find("{", at) if at >= 0 else -1
    if start < 0:
        return {}
    try:
        found, _ = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _arrow(f: Callable, kind: T.DataType, n: int = 1):
    if n == 1:

        @F.pandas_udf(kind)
        def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in parts:
                yield pd.Series([f(v) for v in x], dtype=object)

        return one

    @F.pandas_udf(kind)
    def two(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([f(v, w) for v, w in zip(x, y, strict=True)], dtype=object)

    return two


decode_body = _arrow(decoded, T.StringType(), 2)
inflate = _arrow(inflated, T.BinaryType())
fetch_error = _arrow(address_error, T.StringType())
canonical_json = _arrow(canonical, T.StringType())


def framed_sha256(*fields: Column) -> Column:
    """SHA-256 over fields, each behind its length as eight bytes, so that no two lists of fields read alike."""
    framed = [x for f in fields for x in (F.unhex(F.lpad(F.hex(F.octet_length(f).cast("bigint")), 16, "0")), F.encode(f, "UTF-8"))]
    return F.sha2(F.concat(*framed), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC with SHA-256 (lower-case hex) under a key of at most 64 bytes, in built-in functions."""
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def token_bound(text: Column) -> Column:
    """At most so many tokens of a byte-level tokenizer: the bytes of the text."""
    return F.octet_length(F.coalesce(text, F.lit("")))


def safe_url(url: Column) -> Column:
    """struct(host, path) of an ordinary http(s) URL without credentials, other ports and control characters; null otherwise. The path stays encoded."""
    pattern = r"^(?i:(https?))://([^/?#@:]+)(?::(\d+))?(/[^?#]*)?(?:[?#](?s:.*))?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    scheme, port = F.lower(part(1)), part(3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    sound = (F.length(url) <= URL_MOST) & (scheme != "") & usual & (F.length(part(4)) <= 2048) & ~url.rlike(r"[\x00-\x1f]")
    return F.when(sound, F.struct(F.regexp_replace(F.lower(part(2)), r"\.$", "").alias("host"), part(4).alias("path")))
