"""Queries over bodies, addresses, identities and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions import bodies as B
from brookmill.functions import text as X
from brookmill.plans.pages import pages
from brookmill.plans.registry import query
from brookmill.sources.tables import spread, table

C = F.col


@query("decoded_html", "SELECT page_id, md5(html) AS text_md5 FROM pages")
def decoded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages encoded in five ways (declared or not, with byte order marks) and read back as the text they were."""
    p, k, h = spread(pages(spark, sf_dir)), C("page_id") % 5, C("html")
    mark = lambda hexed, charset: F.concat(F.unhex(F.lit(hexed)), F.encode(h, charset))
    body = F.when(k == 0, F.encode(h, "UTF-8")).when(k == 1, mark("EFBBBF", "UTF-8")).when(k == 2, mark("FFFE", "UTF-16LE")).when(k == 3, mark("FEFF", "UTF-16BE")).otherwise(F.encode(h, "UTF-8"))
    declared = F.when(k == 0, "text/html; charset=utf-8").when(k == 2, "text/html; charset=ascii").otherwise("text/html")
    return p.select("page_id", F.md5(B.decode_body(body, declared)).alias("text_md5"))


@query("fetch_errors", r"SELECT page_id, CASE WHEN length(u) > 4096 THEN 'length' WHEN NOT regexp_matches(u, '^(?i)https?://') THEN 'scheme' WHEN page_id % 6 IN (2, 3, 4) THEN 'address' END AS error FROM (SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'ftp://x.example/' WHEN 2 THEN 'http://169.254.169.254/x' WHEN 3 THEN 'http://[::ffff:10.0.0.1]/' WHEN 4 THEN 'https://100.64.1.1:443/' WHEN 5 THEN 'http://8.8.8.8/' ELSE url END AS u FROM pages)")
def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages, five of six replaced by other schemes and literal addresses."""
    k = C("page_id") % 6
    u = F.when(k == 1, "ftp://x.example/").when(k == 2, "http://169.254.169.254/x").when(k == 3, "http://[::ffff:10.0.0.1]/").when(k == 4, "https://100.64.1.1:443/").when(k == 5, "http://8.8.8.8/").otherwise(C("url"))
    return pages(spark, sf_dir).select("page_id", B.fetch_error(u).alias("error"))


SAFE = r"'^(https?)://([^/?#@:]+)(?::([0-9]+))?([^?#]*)'"


@query("safe_urls", rf"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN replace(url, '://', '://user@') WHEN 2 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '\1:8080') WHEN 3 THEN regexp_replace(url, '^([a-z]+)://([^/]+)', 'HTTPS://\2.:443') ELSE url END AS u FROM pages)
SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN regexp_replace(lower(regexp_extract(lower(regexp_extract(u, '^[A-Za-z]+://')) || substr(u, strpos(u, '://') + 3), {SAFE}, 2)), '\.$', '') END AS host,
  CASE WHEN page_id % 4 IN (0, 3) THEN regexp_extract(lower(regexp_extract(u, '^[A-Za-z]+://')) || substr(u, strpos(u, '://') + 3), {SAFE}, 4) END AS path FROM u""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of plain URLs; those with credentials or other ports have none."""
    k, u = C("page_id") % 4, C("url")
    u = F.when(k == 1, F.replace(u, F.lit("://"), F.lit("://user@"))).when(k == 2, F.regexp_replace(u, "^([a-z]+://[^/]+)", "$1:8080")).when(k == 3, F.regexp_replace(u, "^([a-z]+)://([^/]+)", "HTTPS://$2.:443")).otherwise(u)
    return pages(spark, sf_dir).select("page_id", B.safe_url(u).alias("s")).select("page_id", "s.host", "s.path")


@query("framed_digests", "SELECT doc_id, sha256(unhex(printf('%016X', octet_length(encode(coalesce(source, ''))))) || encode(coalesce(source, '')) || unhex(printf('%016X', octet_length(encode(text)))) || encode(text)) AS digest FROM documents WHERE text IS NOT NULL")
def framed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", B.framed_sha256(F.coalesce("source", F.lit("")), C("text")).alias("digest"))


KEY = b"fingerprint key"
PADS = ["".join(f"{b ^ x:02X}" for b in KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query("keyed_fingerprints", f"SELECT page_id, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(url)))) AS fingerprint FROM pages")
def keyed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", B.hmac_sha256(KEY, C("url")).alias("fingerprint"))


@query("canonical_json_ids", """SELECT doc_id, CASE WHEN doc_id % 5 <> 4 THEN sha256('{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}') END AS id FROM documents""")
def canonical_json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities from JSON objects written with other key orders and spaces; objects that repeat a key have none."""
    q = lambda c: F.concat(F.lit('"'), C(c), F.lit('"'))
    n = C("n_chars").cast("string")
    body = F.when(C("doc_id") % 5 == 4, F.concat(F.lit('{"n": 1, "n": '), n, F.lit("}"))).otherwise(F.concat(F.lit('{ "source" : '), q("source"), F.lit(', "n":'), n, F.lit(',\n"lang": '), q("lang"), F.lit("}")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(B.canonical_json(body), 256).alias("id"))


@query("token_bounds", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS tokens_at_most FROM documents")
def token_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.token_bound(C("text")).alias("tokens_at_most"))


CODE_SQL = "(CASE WHEN page_id % 4 < 3 THEN '<pre class=x>' || chr(10) || '<code>' || replace(substr(html, 20, 40), '<', '&lt;') || '</code></pre>' ELSE '<pre><code>x &lt; y</code></pre>' END)"
RAW_SQL = "substr(html, 20, 40)"


@query("missing_code", f"""SELECT page_id, CASE WHEN page_id % 4 = 3 OR page_id % 4 = 1 THEN 0 ELSE 1 END AS n_missing, md5(t || CASE WHEN page_id % 4 IN (0, 2) THEN chr(10) || chr(10) || '## Extracted Code' || chr(10) || chr(10) || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) ELSE '' END) AS text_md5
  FROM (SELECT page_id, code, CASE WHEN page_id % 4 = 1 THEN 'text' || chr(10) || '```py' || chr(10) || code || chr(10) || '```' ELSE 'text' END AS t FROM (SELECT page_id, replace(replace({RAW_SQL}, '`', ''), '&', '') AS code FROM pages))""")
def missing_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code blocks of a page that its Markdown lacks are appended; here each page's source is the code, some texts have it, some blocks are trivial."""
    k = C("page_id") % 4
    code = F.replace(F.replace(F.substring("html", 20, 40), F.lit("`"), F.lit("")), F.lit("&"), F.lit(""))
    escaped = F.replace(F.replace(code, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    source = F.when(k < 3, F.concat(F.lit("<pre class=x>\n<code>"), escaped, F.lit("</code></pre>"))).otherwise("<pre><code>x &lt; y</code></pre>")
    text = F.when(k == 1, F.concat(F.lit("text\n```py\n"), code, F.lit("\n```"))).otherwise("text")
    p = pages(spark, sf_dir).select("page_id", source.alias("source"), text.alias("text"))
    return p.select("page_id", F.size(X.missing_code(C("text"), C("source"))).alias("n_missing"), F.md5(X.with_missing_code(C("text"), C("source"))).alias("text_md5"))
