"""Queries over acceptance, routes, provenance and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import page as G
from brookmill.functions import patterns as P
from brookmill.functions.sqltext import lit
from brookmill.operators import gates as A
from brookmill.plans.pages import COUNT, HAS, HOST, PAGE_TYPE, SQUEEZE, TOKENS, VISIBLE, WORDS, BOT, NEEDS_JS, pages
from brookmill.plans.registry import query
from brookmill.sources.tables import spread, table

C = F.col
ARTICLE_SQL = "regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')"
FIRST_SQL = "regexp_replace(regexp_extract(html, '(?is)<p>(.*?)</p>', 1), '<[^>]+>', ' ', 'g')"
SCAN = f"substr(html, 1, {P.SCAN_MOST})"


def article():
    return F.regexp_replace(F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1), r"<[^>]+>", " ")


def first_paragraph():
    return F.regexp_replace(F.regexp_extract("html", r"(?is)<p>(.*?)</p>", 1), r"<[^>]+>", " ")


@query("js_policies", f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN TRUE WHEN page_id % 3 = 1 THEN FALSE ELSE {HAS('url', P.JS_REQUIRED)} END AS render,
  page_id % 3 = 2 AND NOT {HAS('url', P.JS_REQUIRED)} AS conditional FROM pages""")
def js_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendering decisions before a fetch: a third of the requests each ask for it, against it, and not at all."""
    asked = F.when(C("page_id") % 3 == 0, True).when(C("page_id") % 3 == 1, False)
    return pages(spark, sf_dir).select("page_id", G.js_policy(C("url"), asked).alias("p")).select("page_id", "p.render", "p.conditional")


# Source structure that the article's plain text cannot show.
LOSSES_SQL = f"list_filter([CASE WHEN {HAS(SCAN, '(?i)<h[1-6]')} AND NOT {HAS('a', P.MD_HEADING)} THEN 'headings_missing' END, CASE WHEN {HAS(SCAN, '(?i)<li[^n]')} AND NOT {HAS('a', P.MD_LIST_ITEM)} THEN 'lists_missing' END], lambda x: x IS NOT NULL)"
GROUNDED_SQL = f"""
s AS (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest({TOKENS(VISIBLE)}) AS t FROM pages) GROUP BY ALL),
o AS (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest({TOKENS(ARTICLE_SQL)}) AS t FROM pages) GROUP BY ALL),
h AS (SELECT page_id, sum(least(s.n, o.n)) AS hit FROM s JOIN o USING (page_id, t) GROUP BY page_id),
v AS (SELECT page_id, hit::DOUBLE / (SELECT sum(n) FROM s WHERE s.page_id = h.page_id) AS cov, hit::DOUBLE / (SELECT sum(n) FROM o WHERE o.page_id = h.page_id) AS gro FROM h)"""


def grounded(p: DataFrame) -> DataFrame:
    """page_id, coverage and grounding of each page's article."""
    bag = lambda text, n: p.select("page_id", F.explode(G.quality_tokens(text)).alias("t")).groupBy("page_id", "t").agg(F.count("*").alias(n))
    both = bag(G.visible_text(C("html")), "n").join(bag(article(), "m"), ["page_id", "t"], "full_outer").fillna(0, ["n", "m"])
    g = both.groupBy("page_id").agg(F.sum(F.least("n", "m")).alias("hit"), F.sum("n").alias("ns"), F.sum("m").alias("no")).where("hit > 0")
    return g.select("page_id", (C("hit") / C("ns")).alias("coverage"), (C("hit") / C("no")).alias("grounding"))


@query("completeness", f"""
WITH {GROUNDED_SQL},
r AS (SELECT page_id, cov, gro, {WORDS('a')} AS words, {LOSSES_SQL} AS losses, length(html) <= {P.SCAN_MOST} AS whole FROM (SELECT *, {ARTICLE_SQL} AS a FROM pages) LEFT JOIN v USING (page_id))
SELECT page_id, CASE WHEN cov IS NULL THEN 0 ELSE round(greatest(0.0::DOUBLE, least(cov, gro, CASE WHEN words <= 15 THEN 0.5::DOUBLE ELSE 1 END, CASE WHEN whole THEN 1 ELSE 0.99::DOUBLE END) - least(0.35::DOUBLE, len(losses) * 0.08::DOUBLE)), 3) END AS score,
  CASE WHEN cov IS NULL THEN 'unassessed' WHEN whole THEN 'source_full' ELSE 'source_prefix' END AS coverage, round(cov, 4) AS source_coverage, round(gro, 4) AS output_grounding,
  array_to_string(list_concat(CASE WHEN words <= 15 THEN ['sparse_output'] ELSE [] END, losses, CASE WHEN cov IS NULL THEN ['grounding_unavailable'] ELSE [] END, CASE WHEN cov IS NOT NULL AND NOT whole THEN ['grounding_budget_limited'] ELSE [] END,
    CASE WHEN cov < 0.8 THEN ['low_source_coverage'] ELSE [] END, CASE WHEN gro < 0.8 THEN ['low_output_grounding'] ELSE [] END), ',') AS reasons FROM r""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of each page's article against its visible text."""
    p = spread(pages(spark, sf_dir))
    j = p.join(grounded(p), "page_id", "left").withColumn("a", article())
    c = A.completeness(G.count_words(C("a")), F.lit(False), G.structure_losses(C("html"), C("a")), C("coverage"), C("grounding"), F.length("html") <= P.SCAN_MOST)
    return j.select("page_id", c.alias("c")).select("page_id", "c.score", "c.coverage", "c.source_coverage", "c.output_grounding", F.array_join("c.reasons", ",").alias("reasons"))


# Text density stands in for a candidate's confidence.
DENSITY = f"least(1.0::DOUBLE, octet_length(encode({VISIBLE}))::DOUBLE / greatest(1, octet_length(encode(html))))"
SCORE_SQL = f"""(least({COUNT(SCAN, '(?i)<table')}, 2) + (CASE WHEN {COUNT(SCAN, '(?i)<li[^n]')} >= 20 THEN 1 ELSE 0 END) + (CASE WHEN {COUNT(SCAN, '(?i)<a[ >]')} >= 80 THEN 1 ELSE 0 END) + (CASE WHEN {HAS(SCAN, P.MATH_MARKUP)} THEN 1 ELSE 0 END))"""


def density():
    return F.least(F.lit(1.0), F.octet_length(G.visible_text(C("html"))) / F.greatest(F.lit(1), F.octet_length("html")))


@query("adaptive_risk", f"""SELECT page_id, {DENSITY} >= 0.6 OR kind = 'article' AS confident, {DENSITY} >= 0.75 AS confident_adaptive,
  array_to_string(list_concat(CASE WHEN {DENSITY} < 0.75 THEN ['low_confidence'] ELSE [] END, CASE WHEN kind IN ('collection', 'listing', 'product') THEN ['risky_page_type'] ELSE [] END, CASE WHEN {SCORE_SQL} >= 3 THEN ['structural_complexity'] ELSE [] END,
    CASE WHEN len({LOSSES_SQL}) >= 1 THEN list_concat(['structure_loss'], {LOSSES_SQL}) ELSE [] END, CASE WHEN page_id % 4 / 4.0 >= 0.45 THEN ['candidate_disagreement'] ELSE [] END), ',') AS reasons
  FROM (SELECT *, {PAGE_TYPE} AS kind, {VISIBLE} AS a FROM pages)""")
def adaptive_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence gates and reasons for a second opinion; disagreement is given by the page's number."""
    p = pages(spark, sf_dir).select("page_id", "html", G.page_type(C("html"), C("url")).alias("kind"), G.visible_text(C("html")).alias("a"), density().alias("d"))
    words, h = G.count_words(C("a")), C("html")
    why = A.risk(C("kind"), C("d"), G.structure_score(h), G.structure_losses(h, C("a")), F.lit(2), C("page_id") % 4 / 4.0)
    return p.select("page_id", A.confident(words, C("kind"), C("d")).alias("confident"), A.confident(words, C("kind"), C("d"), shortcut=False).alias("confident_adaptive"), F.array_join(why, ",").alias("reasons"))


@query("article_rescue", f"""SELECT page_id, {WORDS('b')} >= 8 AND length(b) <= 3000 AND {WORDS('a')} >= 8 AND length(a) * 4 >= length(b) * 5 AS rescued,
  CASE WHEN {WORDS('a')} > {WORDS('b')} THEN 'article' ELSE 'broad' END AS longest FROM (SELECT page_id, {SQUEEZE(FIRST_SQL)} AS b, {SQUEEZE(ARTICLE_SQL)} AS a FROM pages)""")
def article_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph as a broad candidate against the article: the rescue rule, and the longest of the two (the first of equals)."""
    p = pages(spark, sf_dir).select("page_id", G.squeeze(first_paragraph()).alias("b"), G.squeeze(article()).alias("a"))
    found = F.array(F.struct(G.count_words(C("b")).alias("words"), F.lit(0).alias("before"), F.lit("broad").alias("name")), F.struct(G.count_words(C("a")).alias("words"), F.lit(-1).alias("before"), F.lit("article").alias("name")))
    return p.select("page_id", A.rescue(C("b"), G.count_words(C("b")), C("a"), G.count_words(C("a"))).alias("rescued"), F.array_max(found)["name"].alias("longest"))


@query("quality_gates")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of each page's article in place of its first paragraph; every fifth one is broken in some way."""
    p = spread(pages(spark, sf_dir)).select("page_id", "html", article().alias("a"), first_paragraph().alias("b"), G.page_type(C("html"), C("url")).alias("kind"))
    k = C("page_id") % 25
    text = F.when(k == 0, F.concat("a", F.lit("<script>"))).when(k == 5, F.concat("a", F.lit("\n```"))).when(k == 10, F.substring("a", 1, 20)).when(k == 15, F.reverse("a")).when(k == 20, F.concat_ws("\n\n", "a", "a", "a")).otherwise(C("a"))
    return p.select("page_id", A.quality_rejection(text, G.visible_text(C("html")), C("kind"), F.lit(0.8), G.count_words(C("b")), C("b")).alias("rejected"))


STRATEGIES = ("academic-metadata-crossref", "pypdfium2+academic", "academic-html+pdf", "academic-html", "academic-landing", "github-tree", "text", "")


@query("specialist_routes", """WITH d AS (SELECT doc_id, ['academic-metadata-crossref', 'pypdfium2+academic', 'academic-html+pdf', 'academic-html', 'academic-landing', 'github-tree', 'text', ''][doc_id % 8 + 1] AS s, doc_id % 3 = 0 AS src FROM documents)
SELECT doc_id, CASE WHEN starts_with(s, 'academic-metadata-') THEN 'scholarly_metadata_fallback' WHEN s = 'pypdfium2+academic' THEN 'academic_pdf' WHEN s = 'academic-html+pdf' THEN 'academic_pdf_fallback' WHEN s = 'academic-html' THEN 'academic_html'
  WHEN s = 'academic-landing' THEN 'academic_landing' WHEN starts_with(s, 'github-') THEN 'github_source' WHEN src THEN 'raw_source' ELSE 'specialist' END AS route,
  CASE WHEN starts_with(s, 'academic-metadata-') THEN 'publisher_full_text_unavailable,metadata_only' WHEN s = 'pypdfium2+academic' THEN 'direct_pdf' WHEN s = 'academic-html+pdf' THEN 'academic_landing_detected,pdf_full_text_selected' WHEN s = 'academic-html' THEN 'academic_full_text_detected'
  WHEN s = 'academic-landing' THEN 'full_text_unavailable' WHEN starts_with(s, 'github-') THEN 'github_source_specialist' WHEN src THEN 'non_html_source' WHEN s = '' THEN 'specialist_output' ELSE s END AS reasons FROM d""")
def specialist_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, STRATEGIES)), (C("doc_id") % 8 + 1).cast("int")).alias("s"), F.when(C("doc_id") % 3 == 0, "source").otherwise("page").alias("scope"))
    return d.select("doc_id", A.specialist_route(C("s"), C("scope")).alias("r")).select("doc_id", "r.route", F.array_join("r.reasons", ",").alias("reasons"))


@query("stage_timings", """WITH e AS (SELECT event_id, greatest(0, value * 3 - 5) AS total, greatest(0, value - 2) AS queue, greatest(0, value * 1.5) AS fetched, greatest(0, value % 7 - 1) AS render FROM events),
b AS (SELECT event_id, total, least(queue, total) AS queue, fetched, render, total - least(queue, total) AS work FROM e),
r AS (SELECT *, CASE WHEN fetched + render > work AND fetched + render > 0 THEN work / (fetched + render) ELSE 1 END AS scale, fetched + render AS seen FROM b)
SELECT event_id, round(queue, 3) AS queue_ms, round(fetched * scale, 3) AS fetch_ms, round(render * scale, 3) AS render_ms, round(CASE WHEN seen > work THEN 0 ELSE work - seen END, 3) AS extraction_ms, round(total, 3) AS total_ms FROM r""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage durations made of event values, bounded by the whole."""
    v = C("value")
    t = table(spark, sf_dir, "events").select("event_id", A.stage_timings(v * 3 - 5, v - 2, v * 1.5, v % 7 - 1).alias("t"))
    return t.select("event_id", *[C("t")[k].alias(f"{k}_ms") for k in ("queue", "fetch", "render", "extraction", "total")])


@query("cacheable_results", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN doc_id % 2 = 0 AND doc_id % 7 > 0 AND doc_id % 4 > 0 AND doc_id % 11 BETWEEN 1 AND 8 AND doc_id % 13 > 0 ELSE NOT (doc_id % 6 >= 3 AND doc_id % 2 = 1) END AS cacheable FROM documents""")
def cacheable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results may be cached, over provenance made from document numbers."""
    d, yes = C("doc_id"), F.lit
    m = F.struct(
        (d % 3 == 0).alias("model_assisted"), F.when(d % 5 == 0, "quality_model").otherwise("native_fast_path").alias("route"), yes("trafilatura").alias("strategy"), (d % 2 == 0).alias("quality_succeeded"), (d % 6 >= 3).alias("quality_attempted"),
        (d % 7 > 0).alias("receipt_verified"), yes("source-serialization.v1").alias("receipt_schema"), F.when(d % 4 > 0, F.sha2(d.cast("string"), 256)).otherwise("x").alias("receipt_sha256"), yes(8).alias("items"), (d % 11).alias("selected"),
        F.when(d % 13 > 0, "build-1").otherwise(" ").alias("backend_revision"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", A.cacheable(m).alias("cacheable"))


DOC_WORDS = f"len(regexp_extract_all(text, {lit(P.WORD)}))"


@query("full_text_pages", f"""WITH d AS (SELECT doc_id, [NULL, 'pubmed', 'arxiv', 'pmc', 'journal'][doc_id % 5 + 1] AS src, CASE WHEN doc_id % 2 = 0 THEN '/abs/1' ELSE '/full/1' END AS path, {DOC_WORDS} AS words,
  len(regexp_extract_all(split_part(text, chr(10), 1), '\\S+')) AS abstract, len(list_filter(string_split(text, chr(10)), lambda l: length(l) < 60)) AS sections FROM documents)
SELECT doc_id, CASE WHEN src = 'pubmed' OR (src = 'arxiv' AND contains(path, '/abs/')) THEN FALSE WHEN src = 'pmc' THEN words >= 200 WHEN src IS NULL AND words >= greatest(300, abstract * 2) THEN TRUE ELSE words >= 1000 OR (words >= 400 AND sections >= 2) END AS full_text FROM d""")
def full_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full papers against landing pages: documents by class of host, words, first line and short lines."""
    t, i = C("text"), C("doc_id")
    source = F.when(i % 5 == 1, "pubmed").when(i % 5 == 2, "arxiv").when(i % 5 == 3, "pmc").when(i % 5 == 4, "journal")
    sections = F.size(F.filter(F.split(t, "\n"), lambda x: F.length(x) < 60))
    return table(spark, sf_dir, "documents").select("doc_id", A.full_text(source, F.when(i % 2 == 0, "/abs/1").otherwise("/full/1"), G.count_words(t), F.regexp_count(F.substring_index(t, "\n", 1), F.lit(r"\S+")), sections).alias("full_text"))


@query("request_checks", """WITH r AS (SELECT doc_id, doc_id % 60 AS n, CASE WHEN doc_id % 4 = 0 THEN ['markdown', 'html'] WHEN doc_id % 4 = 1 THEN ['links', 'links'] ELSE ['markdown'] END AS formats, doc_id % 30 + 1 AS max_pages, doc_id % 3 AS depth, n_chars, doc_id % 25 AS schema_depth FROM documents)
SELECT doc_id, CASE WHEN n NOT BETWEEN 1 AND 50 THEN 'urls' WHEN len(list_distinct(formats)) < len(formats) THEN 'formats must not contain duplicates' WHEN depth > 0 AND max_pages < n THEN 'max_pages must be greater than or equal to the number of seed URLs'
  WHEN list_contains(formats, 'html') AND CASE WHEN depth > 0 THEN max_pages ELSE n END > 5 THEN 'html output is limited to 5 URLs per request' WHEN schema_depth > 20 THEN 'json_schema exceeds the maximum depth of 20' END AS error FROM r""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from document numbers, with the first bound that each breaks."""
    i = C("doc_id")
    formats = F.when(i % 4 == 0, F.array(F.lit("markdown"), F.lit("html"))).when(i % 4 == 1, F.array(F.lit("links"), F.lit("links"))).otherwise(F.array(F.lit("markdown")))
    urls = F.array_repeat(F.lit("https://x.example/"), (i % 60).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", A.request_error(urls, formats, i % 30 + 1, i % 3, F.lit("{}"), i % 25).alias("error"))


@query("document_policy", f"""WITH d AS (SELECT host, max(page_id) % 5 <> 0 AS allowed FROM (SELECT page_id, {HOST} AS host FROM pages) GROUP BY host HAVING min(page_id) % 7 <> 0)
SELECT page_id, p.host, coalesce(allowed, FALSE) AS allowed, CASE WHEN allowed IS NULL THEN 'document_policy_failed' WHEN NOT allowed THEN 'robots_disallowed' END AS reason FROM (SELECT page_id, {HOST} AS host FROM pages) p LEFT JOIN d ON p.host = d.host""")
def document_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against decisions per host; hosts without a decision are denied."""
    p = pages(spark, sf_dir).select("page_id", G.host(C("url")).alias("host"))
    d = p.groupBy("host").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low % 7 <> 0").select("host", (C("top") % 5 != 0).alias("allowed"), F.lit("robots_disallowed").alias("reason"))
    return A.decided(p, d, "host")


PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("recursive_policy", f"""SELECT page_id, CASE WHEN NOT (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org') THEN 'out_of_scope' WHEN starts_with(path, '/de/') AND NOT starts_with(path, '/de/1') THEN 'robots_disallowed' END AS denied FROM (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages)""")
def recursive_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of each hop: scope by host, then the longest matching robots rule (Disallow /de/, Allow /de/1)."""
    host, path = G.host(C("url")), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    inside = (host == "example.com") | F.endswith(host, F.lit(".example.com")) | (host == "example.org")
    rules = F.array(F.struct(F.lit(4).alias("length"), F.lit(False).alias("allow"), F.lit("/de/").alias("p")), F.struct(F.lit(5).alias("length"), F.lit(True).alias("allow"), F.lit("/de/1").alias("p")))
    best = F.array_max(F.filter(rules, lambda r: F.startswith(path, r["p"])))
    return pages(spark, sf_dir).select("page_id", F.when(~inside, "out_of_scope").when(~F.coalesce(best["allow"], F.lit(True)), "robots_disallowed").alias("denied"))


@query("discovery_budget", "SELECT page_id, sum(octet_length(encode(html))) OVER (ORDER BY page_id) <= 300000 AS within FROM pages")
def discovery_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in their order until a byte budget is spent; sums go over ranges of ids first."""
    p = pages(spark, sf_dir).select("page_id", F.octet_length("html").alias("b"), F.floor(C("page_id") / 1024).alias("part"))
    sums = p.groupBy("part").agg(F.sum("b").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.sum("b").over(Window.partitionBy("part").orderBy("page_id"))
    return p.withColumn("run", run).join(before, "part").select("page_id", (C("run") + C("before") <= 300_000).alias("within"))


@query("admission", """WITH a AS (SELECT event_id, value, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS active FROM events)
SELECT event_id, CASE WHEN value > 80 THEN 413 WHEN active >= 2 THEN 429 WHEN value > 60 THEN 504 ELSE 200 END AS status FROM a""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of requests: body size, requests of the user still active (those of the last hour), deadline."""
    w = Window.partitionBy("user_id").orderBy(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).rangeBetween(-3_600_000_000, -1)
    v = C("value")
    return table(spark, sf_dir, "events").select("event_id", v, F.count("*").over(w).alias("active")).select("event_id", F.when(v > 80, 413).when(C("active") >= 2, 429).when(v > 60, 504).otherwise(200).alias("status"))


MIMES = ("text/html; charset=utf-8", "text/plain", "application/json", "application/xhtml+xml")


@query("source_results", f"""SELECT page_id, CASE WHEN lower(trim(split_part(m, ';', 1))) IN ('text/html', 'application/xhtml+xml') THEN 'page' ELSE 'source' END AS scope,
  CASE WHEN page_id % 4 IN (1, 2) AND trim(html) <> '' THEN 'raw_source' END AS strategy, CASE WHEN page_id % 4 IN (1, 2) AND trim(html) = '' THEN 'text source is empty' END AS error FROM (SELECT *, ['text/html; charset=utf-8', 'text/plain', 'application/json', 'application/xhtml+xml'][page_id % 4 + 1] AS m FROM pages)""")
def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are no HTML pass through as source; types go round by page number."""
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (C("page_id") % 4 + 1).cast("int"))
    is_html = F.lower(F.trim(F.substring_index(mime, ";", 1))).isin("text/html", "application/xhtml+xml")
    empty = F.trim("html") == ""
    return pages(spark, sf_dir).select("page_id", F.when(is_html, "page").otherwise("source").alias("scope"), F.when(~is_html & ~empty, "raw_source").alias("strategy"), F.when(~is_html & empty, "text source is empty").alias("error"))


@query("crawl_routes", f"""SELECT page_id, CASE WHEN {BOT} THEN 'bot_block' WHEN kind = 'academic' THEN 'academic' WHEN kind = 'repository' THEN 'code_host' WHEN {NEEDS_JS} THEN 'render' WHEN {WORDS(VISIBLE)} <= 15 THEN 'sparse' ELSE 'extracted' END AS route FROM (SELECT *, {PAGE_TYPE} AS kind FROM pages)""")
def crawl_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of each page through the engine, from its signals."""
    h, u = C("html"), C("url")
    kind = G.page_type(h, u)
    return pages(spark, sf_dir).select("page_id", F.when(G.is_bot_block(h), "bot_block").when(kind == "academic", "academic").when(kind == "repository", "code_host").when(G.needs_js(h, u), "render").when(G.count_words(G.visible_text(h)) <= A.SPARSE_WORDS, "sparse").otherwise("extracted").alias("route"))


@query("metadata_fallback", f"""WITH p AS (SELECT page_id, {WORDS(VISIBLE)} AS words FROM pages), doi AS (SELECT item_id AS k, 'doi ' || substr(text, 1, 20) AS title FROM benchmark WHERE item_id % 3 = 0), pii AS (SELECT item_id AS k, 'pii ' || substr(text, 1, 20) AS title FROM benchmark WHERE item_id % 2 = 0)
SELECT page_id, coalesce(doi.title, pii.title) AS title, CASE WHEN doi.k IS NOT NULL THEN 'academic-metadata-doi' WHEN pii.k IS NOT NULL THEN 'academic-metadata-pii' END AS strategy FROM p LEFT JOIN doi ON doi.k = page_id LEFT JOIN pii ON pii.k = page_id WHERE words < 100""")
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pages get a record from the first provider that has one, by DOI, then by article number (benchmark items stand in)."""
    p = pages(spark, sf_dir).where(G.count_words(G.visible_text(C("html"))) < 100).select("page_id")
    b = table(spark, sf_dir, "benchmark")
    found = lambda n, name: b.where(C("item_id") % n == 0).select(C("item_id").alias("page_id"), F.concat(F.lit(f"{name} "), F.substring("text", 1, 20)).alias(name))
    j = p.join(found(3, "doi"), "page_id", "left").join(found(2, "pii"), "page_id", "left")
    return j.select("page_id", F.coalesce("doi", "pii").alias("title"), F.when(C("doi").isNotNull(), "academic-metadata-doi").when(C("pii").isNotNull(), "academic-metadata-pii").alias("strategy"))


@query("paper_fallbacks", f"""WITH a AS (SELECT doc_id, {DOC_WORDS} AS words, n_chars FROM documents), pdf AS (SELECT item_id, length(text) AS n FROM benchmark WHERE item_id % 2 = 0),
t AS (SELECT doc_id, words, list(n ORDER BY k) FILTER (n IS NOT NULL) AS found FROM (SELECT doc_id, words, unnest(range(0, 3)) AS k FROM a WHERE words < 1000) LEFT JOIN pdf ON item_id = (doc_id + k) % 40 GROUP BY ALL)
SELECT doc_id, CASE WHEN words >= 1000 THEN 'academic-html' WHEN len(found) > 0 THEN 'academic-html+pdf' ELSE 'academic-landing' END AS strategy, found[1] AS pdf_chars FROM a LEFT JOIN t USING (doc_id, words)""")
def paper_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing pages try up to three documents in order and take the first that is there; full pages try none."""
    d = table(spark, sf_dir, "documents").select("doc_id", G.count_words(C("text")).alias("words"))
    pdf = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select("item_id", F.length("text").alias("n"))
    tries = d.where("words < 1000").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("item_id", (C("doc_id") + C("k")) % 40)
    first = tries.join(pdf, "item_id").groupBy("doc_id").agg(F.min(F.struct("k", "n")).alias("f"))
    j = d.join(first, "doc_id", "left")
    return j.select("doc_id", F.when(C("words") >= 1000, "academic-html").when(C("f").isNotNull(), "academic-html+pdf").otherwise("academic-landing").alias("strategy"), C("f.n").alias("pdf_chars"))


@query("code_sources", f"""WITH p AS (SELECT page_id, {PATH} AS path, html FROM pages), r AS (SELECT page_id, path, length(html) AS n FROM p WHERE page_id % 3 <> 0)
SELECT p.page_id, regexp_extract(p.path, '[^/]*$') AS name, CASE WHEN r.page_id IS NULL THEN 'page' ELSE 'github-source' END AS strategy, r.n AS source_chars FROM p LEFT JOIN r ON r.page_id = p.page_id""")
def code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the fetched source that belongs to them, where it was fetched; else the page itself."""
    p = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), F.length("html").alias("n"))
    r = p.where("page_id % 3 <> 0").select("page_id", C("n").alias("source_chars"))
    return p.join(r, "page_id", "left").select("page_id", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.when(C("source_chars").isNull(), "page").otherwise("github-source").alias("strategy"), "source_chars")
