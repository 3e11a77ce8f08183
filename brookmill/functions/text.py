"""Column expressions over Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookmill.functions import page as G
from brookmill.functions import patterns as P


def strip_boilerplate(text: Column, most_words: int = 10) -> Column:
    """Drops short lines that begin like share bars, bylines, credits and legal footers."""
    probe = lambda line: F.trim(F.regexp_replace(line, P.LINE_PREFIX, ""))
    short = lambda line: F.regexp_count(probe(line), F.lit(r"\S+")) <= most_words
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~((probe(x) != "") & short(x) & probe(x).rlike(P.BOILERPLATE_LINE))), "\n")


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs of more than 30 characters, without white space around them."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 30)


def dedup_key(paragraph: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(paragraph), r"\s+", " ")), 1, 200)


def with_title(text: Column, title: Column) -> Column:
    """Opens the text with the title as a heading unless it has one; promotes a bare title line."""
    body = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    first = F.trim(F.substring_index(body, "\n", 1))
    name = F.trim(title)
    return (
        F.when((F.coalesce(title, F.lit("")) == "") | (F.trim(text) == "") | first.startswith("#"), text)
        .when(F.lower(first) == F.lower(name), F.concat(F.lit("# "), body))
        .otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), body))
    )


def strip_wiki(text: Column) -> Column:
    return F.regexp_replace(text, P.WIKI_EDIT, "")


def truncated(text: Column, limit: int = P.TEXT_MOST) -> Column:
    """At most ``limit`` characters, cut at the last line or word end of the second half, with a marker."""
    room = max(0, limit - len(P.TRUNCATED))
    head = F.substring(text, 1, room)
    last = lambda c: F.length(head) - F.coalesce(F.nullif(F.locate(c, F.reverse(head)), F.lit(0)), F.length(head) + 1)
    at = F.greatest(last("\n"), last(" "))
    at = F.when(at < room // 2, F.lit(room)).otherwise(at)
    cut = F.concat(F.regexp_replace(F.substr(text, F.lit(1), at), r"\s+$", ""), F.lit(P.TRUNCATED))
    return F.when(F.length(text) <= limit, text).otherwise(F.lit(P.TRUNCATED[:limit]) if limit <= len(P.TRUNCATED) else cut)


def missing_code(text: Column, html: Column) -> Column:
    """Code blocks of the page that no fence of the text has, told by their first 100 characters."""
    begin = lambda c: F.substring(F.regexp_replace(c, r"^\s+|\s+$", ""), 1, 100)
    fences = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), F.lit(1)), begin)
    return F.filter(G.code_blocks(html), lambda c: ~F.array_contains(fences, begin(c)))


def with_missing_code(text: Column, html: Column) -> Column:
    """The text with the page's missing code blocks in fences at its end."""
    blocks = F.transform(missing_code(text, html), lambda c: F.concat(F.lit("\n```\n"), c, F.lit("\n```\n")))
    return F.when(F.size(blocks) > 0, F.concat(text, F.lit("\n\n## Extracted Code\n\n"), F.array_join(blocks, "\n"))).otherwise(text)


def longest_run(text: Column, char: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({char}+)")), F.length)), F.lit(0))


def fenced(code: Column, language: Column) -> Column:
    """A code fence longer than any run of backticks inside."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(code, "`") + 1))
    return F.concat(fence, language, F.lit("\n"), F.regexp_replace(code, r"\n+$", ""), F.lit("\n"), fence)


def inline_code(code: Column) -> Column:
    fence = F.repeat(F.lit("`"), longest_run(code, "`") + 1)
    pad = F.when(code.startswith("`") | code.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, code, pad, fence)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def noise_score(text: Column) -> Column:
    """1 for clean text, less with leaked styles (4), scripts (2) and navigation (1) per thousand characters; code is not counted."""
    prose = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`]+`", " ")
    n = lambda p: F.regexp_count(prose, F.lit(p))
    leaks = n(CSS_RULE) * 4 + n(JS_LEAK) * 2 + n(NAVIGATION)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), leaks * 1000.0 / F.greatest(F.length(text), F.lit(1)))))


# Leaks of styles, scripts and navigation, and languages by file name.
CSS_RULE = r"\{[^{}]*(?:color|margin|padding|font|background|width|display|border)\s*:[^{}]*\}"
JS_LEAK = r"\bfunction\s*\(|\bvar\s+\w+\s*=|\bdocument\.|\bwindow\.|=>\s*\{|\baddEventListener\b"
NAVIGATION = r"(?i)\b(?:skip to (?:main )?content|cookie|accept all|sign in|sign up|subscribe|privacy policy|terms of service|all rights reserved|toggle navigation)\b"
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "rb": "ruby",
    "sh": "bash", "sql": "sql", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "md": "markdown", "html": "html", "css": "css", "xml": "xml", "scala": "scala",
}


def source_language(url: Column) -> Column:
    """Language of a source file by its name."""
    name = F.lower(F.substring_index(F.regexp_extract(url, r"^[^?#]*", 0), "/", -1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(name == "dockerfile", "dockerfile").when(name == "makefile", "makefile").otherwise(F.coalesce(F.element_at(table, F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)), F.lit("")))
