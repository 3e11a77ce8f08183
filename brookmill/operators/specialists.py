"""Specialists: code-host pages, scholarly pages and records. Parsing is per page; choices and joins are columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions import dom
from brookmill.operators.extract import per_page

COMMENTS_MOST, ENTRIES_MOST = 100, 1000
PAPER = "page_id bigint, title string, authors string, doi string, published string, abstract string, pdf_url string, is_full_text boolean"
CODE_PAGE = "page_id bigint, strategy string, title string, text string, n_items bigint, truncated boolean"
DOI = re.compile(r"10\.\d{4,9}/[^\s\"'<>]+", re.IGNORECASE)


def normalize_doi(value: str | None) -> str:
    """The DOI in a URL, field or prose, without punctuation after it and closers that nothing opened."""
    from html import unescape
    from urllib.parse import unquote

    m = DOI.search(unescape(unquote(value or "")).strip())
    doi = m[0].rstrip(".,;:!?") if m else ""
    while doi and any(doi.endswith(c) and doi.count(c) > doi.count(o) for o, c in ("()", "[]", "{}", "<>")):
        doi = doi[:-1]
    return doi


def meta_values(root: dom.Node) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("content", "").strip():
            key = (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop") or "").lower()
            if key:
                out.setdefault(key, []).append(n.attrs["content"].strip())
    return out


def json_ld(root: dom.Node) -> list[dict]:
    """All objects in JSON-LD scripts, with those in @graph and mainEntity."""
    found: list[dict] = []

    def add(x: object) -> None:
        if isinstance(x, list):
            for y in x:
                add(y)
        elif isinstance(x, dict):
            found.append(x)
            add(x.get("@graph", []))
            add(x.get("mainEntity", []))

    for n in root.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", "").lower():
            try:
                add(json.loads(n.text()))
            except ValueError:
                continue
    return found


def date_of(value: str | None) -> str:
    """yyyy[-mm[-dd]] of a date field; the rest of an unusual one is dropped."""
    m = re.match(r"\s*(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?", value or "")
    if not m:
        return ""
    out = m[1]
    for part, most in ((m[2], 12), (m[3], 31)):
        if not part or not 1 <= int(part) <= most:
            break
        out += f"-{int(part):02}"
    return out


def paper(html: str | None) -> Iterator[dict]:
    """The record of a scholarly page from its citation tags and JSON-LD; nothing for other pages."""
    root = dom.parse(html)
    meta = meta_values(root)
    ld = next((x for x in json_ld(root) if "scholarlyarticle" in str(x.get("@type", "")).lower()), {})
    first = lambda *keys: next((v for k in keys for v in meta.get(k, ())), "")
    title = first("citation_title", "dc.title") or str(ld.get("headline") or ld.get("name") or "")
    if not title or not (ld or any(k.startswith("citation_") for k in meta)):
        return
    named = [a.get("name", "") if isinstance(a, dict) else str(a) for a in (ld.get("author") if isinstance(ld.get("author"), list) else [ld["author"]] if ld.get("author") else [])]
    seen: dict[str, str] = {}
    for a in meta.get("citation_author", []) or meta.get("dc.creator", []) or named:
        seen.setdefault(a.casefold().strip(), a.strip())
    words = len(re.findall(r"\w+", dom.prune(root).text()))
    yield {
        "title": dom.squeeze(title), "authors": "; ".join(x for x in seen.values() if x), "doi": normalize_doi(first("citation_doi", "dc.identifier", "prism.doi") or str(ld.get("identifier") or "")),
        "published": date_of(first("citation_publication_date", "citation_date", "dc.date") or str(ld.get("datePublished") or "")), "abstract": dom.squeeze(first("citation_abstract", "dc.description", "description")),
        "pdf_url": first("citation_pdf_url"), "is_full_text": words >= 1000,
    }


def papers(pages: DataFrame) -> DataFrame:
    return per_page(pages, PAPER, paper)


def markdown_body(root: dom.Node) -> dom.Node | None:
    return next((n for n in root.walk() if "markdown-body" in n.attrs.get("class", "").split()), None)


def code_page(html: str | None) -> Iterator[dict]:
    """A code host's page: a thread of comments, a file listing, or a readme, whichever it shows first in this order."""
    root = dom.prune(dom.parse(html))
    title = next((dom.squeeze(n.text()) for n in root.walk() if n.tag in ("h1", "bdi") and dom.squeeze(n.text())), "")
    bodies = [n for n in root.walk() if "comment-body" in n.attrs.get("class", "").split()]
    if bodies:
        seen: dict[str, str] = {}
        for b in bodies:
            text = dom.markdown(b).strip()
            if text:
                seen.setdefault(" ".join(text.lower().split()), text)
        kept = list(seen.values())[:COMMENTS_MOST]
        yield {"strategy": "github-thread", "title": title, "text": f"# {title}\n\n" + "\n\n---\n\n".join(kept), "n_items": len(kept), "truncated": len(seen) > COMMENTS_MOST}
        return
    rows = [a for n in root.walk() if n.tag == "table" and "listing" in n.attrs.get("aria-labelledby", "") + n.attrs.get("class", "") for a in n.walk() if a.tag == "a" and re.match(r"^/[^/]+/[^/]+/(?:tree|blob)/", a.attrs.get("href", ""))]
    if rows:
        names = dict.fromkeys(f"- [{dom.squeeze(a.text())}]({a.attrs['href']})" for a in rows)
        yield {"strategy": "github-tree", "title": title, "text": "\n".join(list(names)[:ENTRIES_MOST]), "n_items": min(len(names), ENTRIES_MOST), "truncated": len(names) > ENTRIES_MOST}
        return
    if body := markdown_body(root):
        yield {"strategy": "github-readme", "title": title, "text": dom.markdown(body).strip(), "n_items": 1, "truncated": False}


# What pages of changes say about themselves.
SUMMARIES = (re.compile(r"(?i)\b\d[\d,]*\s+commits?\b"), re.compile(r"(?i)\b\d[\d,]*\s+files?\s+changed\b"), re.compile(r"(?i)\bLines changed:\s*\d[\d,]*\s+additions?\s*&\s*\d[\d,]*\s+deletions?\b"))
UNAVAILABLE = re.compile(r"(?i)(?:can(?:not|'t|’t)|could(?:\s+not|n't|n’t)|unable\s+to)\s+render\s+(?:this\s+)?comparison|comparison\s+is\s+taking\s+too\s+long\s+to\s+generate|error\s+while\s+loading\s+(?:this\s+|the\s+)?comparison")
DIFF_FILES_MOST, DIFF_LINES_MOST, RELEASES_MOST = 100, 5000, 50
CHANGE = "page_id bigint, strategy string, title string, text string, n_files bigint, reasons string"


def diffs(scope: dom.Node) -> tuple[list[str], list[str]]:
    """A fenced diff per file of a page of changes, and what was cut."""
    out: dict[str, str] = {}
    cut: list[str] = []
    for t in scope.walk():
        named = re.match(r"(?i)Diff for:\s*(.+)$", dom.squeeze(t.attrs.get("aria-label", ""))) if t.tag == "table" else None
        if not named or named[1] in out:
            continue
        if len(out) >= DIFF_FILES_MOST:
            cut.append("github_diff_file_limit")
            break
        lines = []
        for row in t.walk():
            cells = [c for c in row.children if isinstance(c, dom.Node) and c.tag == "td"] if row.tag == "tr" else []
            if cells:
                text = re.sub("[\r\n\u200e\u200f]", "", cells[-1].text())
                lines.append(text.strip() if "diff-hunk-cell" in cells[-1].attrs.get("class", "").split() else text if text[:1] in tuple("+- @") else " " + text)
        if len(lines) > DIFF_LINES_MOST:
            lines = [*lines[:DIFF_LINES_MOST], "... diff truncated at configured line limit ..."]
            cut.append("github_diff_line_limit")
        fence = "`" * max(3, max((len(x) for x in re.findall("`+", "\n".join(lines))), default=0) + 1)
        out[named[1]] = f"{fence}diff\n" + "\n".join(lines) + f"\n{fence}" if lines else "> Diff content was not present in the fetched page."
        cut += [] if lines else ["github_diff_content_missing"]
    return [f"### `{path}`\n\n{body}" for path, body in out.items()], list(dict.fromkeys(cut))


def change_page(html: str | None, compare: bool) -> Iterator[dict]:
    """A commit's or comparison's page: title, summary and diffs, marked as partial where something is missing."""
    root = dom.prune(dom.parse(html))
    scope = next((n for n in root.walk() if n.tag == "main"), root)
    title = next((dom.squeeze(n.text()) for n in root.walk() if n.tag == "h1" and dom.squeeze(n.text())), "")
    shown = " ".join(dom.squeeze(x) for x in _texts(scope) if x.strip())
    summary = [m[0] for p in SUMMARIES[0 if compare else 1 :] if (m := p.search(shown))]
    files = SUMMARIES[1].search(shown)
    sections, reasons = diffs(scope)
    if compare and UNAVAILABLE.search(shown):
        reasons.append("github_comparison_diff_unavailable")
    elif not sections and files is None:
        return
    elif not sections and not files[0].startswith("0 "):
        reasons.append("github_change_diff_unavailable")
    parts = [f"# {title}" if title else "", "## Summary\n\n" + "\n".join(f"- {x}" for x in summary) if summary else "", "> [!WARNING]\n> Partial result: the page does not hold all diffs." if reasons else "", "## Diff\n\n" + "\n\n".join(sections) if sections else ""]
    text = "\n\n".join(filter(None, parts)) + (f"\n\n<!-- partial: reasons={','.join(reasons)} -->" if reasons else "")
    yield {"strategy": f"github-{'compare' if compare else 'commit'}" + ("-partial" if reasons else ""), "title": title, "text": text, "n_files": len(sections), "reasons": ",".join(reasons)}


def _texts(n: dom.Node) -> Iterator[str]:
    for c in n.children:
        if isinstance(c, str):
            yield c
        else:
            yield from _texts(c)


def release_page(html: str | None) -> Iterator[dict]:
    """Bodies of releases, each once."""
    root = dom.prune(dom.parse(html))
    scope = next((n for n in root.walk() if n.tag == "main"), root)
    title = next((dom.squeeze(n.text()) for want in ("release-title", None) for n in scope.walk() if (n.attrs.get("data-testid") == want if want else n.tag == "h1")), "")
    marked = [n for n in scope.walk() if n.attrs.get("data-testid") == "release-body" or {"release-body", "markdown-body"} & set(n.attrs.get("class", "").split())]
    bodies: dict[str, str] = {}
    for n in marked:
        if not any(a in marked for a in n.up()) and (text := dom.markdown(n).strip()):
            bodies.setdefault(" ".join(text.lower().split()), text)
    if bodies:
        yield {"strategy": "github-release", "title": title, "text": f"# {title}\n\n" + "\n\n---\n\n".join(list(bodies.values())[:RELEASES_MOST]), "n_items": min(len(bodies), RELEASES_MOST), "truncated": len(bodies) > RELEASES_MOST}


def raw_url(html: str | None, blob: str) -> str | None:
    """The raw file that a blob's page links to, if it is of the same repository and name on a known host over https."""
    from urllib.parse import urlsplit

    parts = [x for x in urlsplit(blob).path.split("/") if x]
    if len(parts) < 5 or parts[2] != "blob":
        return None
    for n in dom.parse(html).walk():
        href = n.attrs.get("href", "").strip()
        marks = n.tag == "a" and (n.attrs.get("data-testid") == "raw-button" or n.attrs.get("id") == "raw-url" or n.attrs.get("data-hotkey") == "r" or n.attrs.get("aria-label") == "Raw" or "raw.githubusercontent.com" in href)
        if not href or not (marks or (n.tag == "link" and n.attrs.get("rel") == "alternate")):
            continue
        try:
            u = urlsplit("https:" + href if href.startswith("//") else href)
            sound = u.scheme.lower() == "https" and u.username is None and u.password is None and u.port in (None, 443)
        except ValueError:
            continue
        host, own = (u.hostname or "").lower().rstrip("."), [x for x in u.path.split("/") if x]
        same = len(own) >= 4 and [own[0].casefold(), own[1].casefold(), own[-1].casefold()] == [parts[0].casefold(), parts[1].casefold(), parts[-1].casefold()]
        on_site = host in ("github.com", "www.github.com") and len(own) >= 5 and own[2].casefold() == "raw"
        if sound and same and (on_site or host == "raw.githubusercontent.com"):
            return f"https://{'github.com' if on_site else host}{u.path}" + (f"?{u.query}" if u.query else "")
    return None


def code_pages(pages: DataFrame) -> DataFrame:
    return per_page(pages, CODE_PAGE, code_page)


def merge_records(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two records per key as one: the left value unless it is null or empty."""
    names = [c for c in left.columns if c != key]
    r = right.select(key, *[F.col(c).alias(f"__r_{c}") for c in names])
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return left.join(r, key, "full_outer").select(key, *[F.when(empty(c), F.coalesce(f"__r_{c}", F.col(c))).otherwise(F.col(c)).alias(c) for c in names])


def date_parts(parts: Column) -> Column:
    """``[y, m, d]`` as y[-mm[-dd]]: it ends before the first part that is missing, not positive, or out of range."""
    y, m, d = (F.get(parts, F.lit(i)) for i in range(3))
    month, day = m.between(1, 12), d.between(1, 31)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(y > 0, F.when(month & day, F.concat_ws("-", y.cast("string"), two(m), two(d))).when(month, F.concat_ws("-", y.cast("string"), two(m))).otherwise(y.cast("string"))).otherwise("")


def crossref_records(rows: DataFrame) -> DataFrame:
    """Papers from provider payloads (key, payload JSON)."""
    schema = "DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING, name: STRING>>, issued STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, publisher STRING"
    p = rows.select("key", F.from_json("payload", schema).alias("p"))
    names = F.transform("p.author", lambda a: F.coalesce(F.nullif(F.concat_ws(" ", a["given"], a["family"]), F.lit("")), a["name"]))
    return p.select("key", F.get("p.title", F.lit(0)).alias("title"), F.array_join(names, "; ").alias("authors"), F.lower("p.DOI").alias("doi"), date_parts(F.get("p.issued.date-parts", F.lit(0))).alias("published"), (F.lower("p.publisher").rlike(r"\bieee\b")).alias("is_ieee"))
