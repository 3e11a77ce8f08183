"""Column expressions over raw pages: visible text, routing signals, structure counts. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookmill.functions import patterns as P


def any_in(col: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def visible_text(html: Column, most: int = P.SCAN_MOST) -> Column:
    """Text of a bounded prefix without scripts, styles and tags."""
    scan = F.substring(html, 1, most)
    return F.regexp_replace(F.regexp_replace(scan, P.INVISIBLE, ""), r"<[^>]+>", " ")


def raw_text(html: Column) -> Column:
    """Last-resort text: everything but script, style, noscript, template, head and svg, with white space collapsed."""
    return squeeze(F.regexp_replace(F.regexp_replace(html, P.RAW_DROP, " "), r"<[^>]+>", " "))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.WORD))


def content_units(text: Column) -> Column:
    """Words, or half the CJK characters if these are more."""
    return F.greatest(count_words(text), F.floor(F.regexp_count(text, F.lit(P.CJK)) / 2).cast("int"))


def quality_tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs, single letters dropped, then each CJK character. Lower case, with ss for sharp s."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    runs = F.filter(F.regexp_extract_all(low, F.lit(f"({P.TOKEN})")), lambda t: (F.length(t) > 1) | t.rlike(r"^\p{Nd}$"))
    return F.concat(runs, F.regexp_extract_all(low, F.lit(f"({P.CJK})")))


def host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) URL without userinfo and port; empty otherwise."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def is_news(html: Column) -> Column:
    return F.substring(html, 1, 60000).rlike(P.NEWS_META)


def page_type(html: Column, url: Column) -> Column:
    """Nine kinds of page by ordered signals in the URL and the first 20 000 characters."""
    low, u = F.lower(F.substring(html, 1, 20000)), F.lower(url)
    github = host(url).isin("github.com", "www.github.com", "raw.githubusercontent.com")
    results = F.regexp_count(low, F.lit('class="result')) + F.regexp_count(low, F.lit('class="item'))
    return (
        F.when(any_in(u, P.ACADEMIC_URLS) | low.rlike(P.LATEX), "academic")
        .when(github | any_in(u, P.REPOSITORY_URLS), "repository")
        .when(any_in(u, P.DOCUMENTATION_URLS), "documentation")
        .when(any_in(low, P.ARTICLE_MARKS), "article")
        .when(any_in(low, P.FORUM_MARKS), "forum")
        .when(low.rlike(P.PRODUCT), "product")
        .when(any_in(low, P.LISTING_MARKS) | (results >= 3), "listing")
        .when(low.rlike(P.COLLECTION) & (F.regexp_count(low, F.lit("<img")) >= 3), "collection")
        .otherwise("webpage")
    )


def is_bot_block(html: Column) -> Column:
    head = F.lower(F.substring(html, 1, 3000))
    shown = squeeze(F.regexp_replace(head, r"<[^>]+>", " "))
    return head.rlike(P.BOT_BLOCK) | ((F.length(html) < 500) & (F.length(shown) < 100))


def needs_js(html: Column, url: Column) -> Column:
    """Whether a page has to be rendered: by known sites, by an empty application shell, or by too little visible text."""
    scan = F.trim(F.substring(html, 1, 50000))
    shown = F.length(squeeze(F.regexp_replace(F.regexp_replace(scan, P.INVISIBLE_JS, " "), r"<[^>]+>", " ")))
    bare = ~any_in(scan, ("<p>", "<article", "<main"))
    return (
        F.when(url.rlike(P.STATIC_SITES), False)
        .when(url.rlike(P.JS_REQUIRED), True)
        .otherwise((scan.rlike(P.SPA) & (shown < P.SPA_SHELL_VISIBLE_MOST)) | (shown < 200) | F.lower(scan).rlike(P.CHALLENGE) | (bare & (shown < 500)))
    )


def js_policy(url: Column, requested: Column | None = None, mode: str = "auto") -> Column:
    """struct(render, conditional): an explicit flag, then the mode, then the list of known sites, else decide after fetching."""
    pair = lambda a, b: F.struct(F.lit(a).alias("render"), F.lit(b).alias("conditional"))
    rest = pair(True, False) if mode == "force" else pair(False, False) if mode == "never" else F.when(url.rlike(P.JS_REQUIRED), pair(True, False)).otherwise(pair(False, True))
    return rest if requested is None else F.when(requested, pair(True, False)).when(~requested, pair(False, False)).otherwise(rest)


def is_scholarly(html: Column) -> Column:
    """Structured signs of a paper: citation meta tags, a scholarly JSON-LD type, or LaTeX."""
    low = F.lower(F.substring(html, 1, 100000))
    tag = lambda keys: low.rlike(rf"<meta\b[^>]*(?:{keys})[^>]*>")
    meta = tag("citation_title") & tag("citation_author|citation_doi|citation_journal_title|citation_pdf_url")
    return meta | low.rlike(P.SCHOLARLY_LD) | low.rlike(P.LATEX)


def structure_score(html: Column) -> Column:
    """Coarse complexity of the source: tables, spans, code, math, long lists, many links."""
    scan = F.substring(html, 1, P.SCAN_MOST)
    n = lambda p: F.regexp_count(scan, F.lit(p))
    one = lambda c: F.when(c, 1).otherwise(0)
    tables = n(r"(?i)<table\b")
    return (
        F.least(tables, F.lit(2))
        + one((tables > 0) & scan.rlike(r"(?i)\b(?:rowspan|colspan)\s*="))
        + one((n(r"(?i)<pre\b") >= 2) | (n(r"(?i)<code\b") >= 4))
        + one(scan.rlike(P.MATH_MARKUP))
        + one(n(r"(?i)<li\b") >= 20)
        + one(n(r"(?i)<a\b") >= 80)
    )


def structure_losses(html: Column, markdown: Column) -> Column:
    """Kinds of structure that the source has and the output lacks, as an array of reasons."""
    scan = F.substring(html, 1, P.SCAN_MOST)
    lost = lambda source, output, name: F.when(scan.rlike(source) & ~markdown.rlike(output), F.lit(name))
    return F.array_compact(
        F.array(
            lost(r"(?i)<h[1-6]\b", P.MD_HEADING, "headings_missing"),
            lost(r"(?i)<li\b", P.MD_LIST_ITEM, "lists_missing"),
            lost(r"(?i)<table\b", P.MD_TABLE, "tables_missing"),
            lost(r"(?i)<pre\b|<code\b", P.MD_CODE, "code_missing"),
            lost(P.MATH_MARKUP, P.MD_MATH, "math_missing"),
        )
    )


def markdown_categories(text: Column) -> Column:
    """Kinds of structure that a Markdown text shows."""
    shown = lambda p, name: F.when(text.rlike(p), F.lit(name))
    return F.array_compact(F.array(shown(P.MD_HEADING, "heading"), shown(P.MD_LIST_ITEM, "list"), shown(P.MD_TABLE, "table"), shown(P.MD_CODE, "code"), shown(P.MD_MATH, "math")))


def code_blocks(html: Column) -> Column:
    """Texts of <pre><code> blocks with entities undone, without trivial ones."""
    codes = F.regexp_extract_all(html, F.lit(P.CODE_BLOCK), F.lit(1))
    plain = lambda c: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'")), c)
    return F.filter(F.transform(codes, plain), lambda c: F.length(F.trim(c)) > 10)


def links(html: Column) -> Column:
    """href values in order, without fragments-only and script, mail, phone and data links."""
    found = F.transform(F.regexp_extract_all(html, F.lit(P.LINK), F.lit(1)), F.trim)
    return F.filter(found, lambda h: (h != "") & (F.length(h) <= 4096) & ~h.rlike(r"^(?:javascript|mailto|tel|data):"))


def effective_mime(declared: Column, body: Column) -> Column:
    """Media type by signature of the body, then as declared; null if neither supports it. ``body`` is text or bytes read as Latin-1."""
    low = F.lower(F.trim(declared))
    mime = F.trim(F.substring_index(low, ";", 1))
    head = F.substring(body, 1, 1024)
    control = F.regexp_count(F.substring(body, 1, 8192), F.lit(r"[\x01-\x08\x0e-\x1f]"))
    binary = F.contains(F.substring(body, 1, 8192), F.lit("\x00")) | (control > 0.05 * F.length(F.substring(body, 1, 8192)))
    text = (mime.startswith("text/") & ~mime.isin("text/event-stream", "text/html")) | mime.isin("application/json", "application/xml", "application/javascript")
    return (
        F.when(head.rlike(r"^[\x00\t\n\r\f ]*%PDF-"), F.when(mime == "application/pdf", low).otherwise("application/pdf"))
        .when(head.rlike(r"(?i)^\s*<(?:!doctype\s+html|html|head|body)\b"), F.when(mime.isin("text/html", "application/xhtml+xml"), low).otherwise("text/html"))
        .when(mime.isin("text/html", "application/xhtml+xml", "application/pdf"), low)
        .when(text & ~binary, low)
    )
