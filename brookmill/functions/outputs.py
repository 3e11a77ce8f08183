"""What happens to a candidate's Markdown before it is returned: links mended, tables converted and recovered, titles; and the
documentation candidate. Pure Python, one page at a time."""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Callable

from brookmill.functions import dom

# Selectors of documentation pages, in the order in which they are tried; and tables that are no data.
DOC_NOISE = (
    ".wy-nav-side .wy-nav-top .wy-side-nav-search .wy-menu-vertical .sphinxsidebar .sphinxsidebarwrapper .md-sidebar--primary .md-sidebar--secondary .md-header .md-footer .md-tabs .rst-versions "
    ".documentation-breadcrumbs [role=navigation] [role=search] .headerlink .viewcode-link .edit-this-page .theme-switcher .md-source .md-top .md-version .feedback script style noscript iframe template"
).split()
DOC_MAIN = "div[role=main] main article .document .rst-content .md-content .markdown-body .content #content .documentation .doc-content .wy-nav-content".split()
DOC_TITLE = "h1 .documenttitle .page-title title".split()
NO_DATA = re.compile(r"(?i)navbox|infobox|sidebar|metadata|toccolours|vertical|mbox|ambox")
PIPE_TABLE = re.compile(r"\|[-: ]+\|[-: |]*\n")
TABLES_MOST = 10
WORDS_LEAST = 8


@functools.lru_cache(maxsize=1024)
def _selector(selector: str) -> tuple:
    m = re.fullmatch(r"([a-z0-9]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(\*?)=\"?([^\]\"]*)\"?\]|\[([\w-]+)\])?", selector)
    if m is None:
        raise ValueError(selector)
    return m.groups()


def fits(n: dom.Node, selector: str) -> bool:
    """Whether an element fits a selector of the form tag, .class, #id or [attribute=value], or a tag with one of these."""
    tag, cls, ident, attr, part, value, has = _selector(selector)
    if tag and n.tag != tag:
        return False
    if cls:
        return cls in n.attrs.get("class", "").split()
    if ident:
        return n.attrs.get("id") == ident
    if attr:
        found = n.attrs.get(attr)
        return found is not None and (value in found if part else found == value)
    return has is None or has in n.attrs


def selected(root: dom.Node, *selectors: str) -> list[dom.Node]:
    """All elements that fit one of the selectors, each once, in document order."""
    return [n for n in root.walk() if any(fits(n, s) for s in selectors)]


def first(root: dom.Node, selectors: list[str] | tuple[str, ...]) -> dom.Node | None:
    """The first element that fits the earliest selector with any."""
    return next((n for s in selectors for n in root.walk() if fits(n, s)), None)


def without(root: dom.Node, selectors: list[str]) -> dom.Node:
    for n in (root, *root.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or not any(fits(c, s) for s in selectors)]
    return root


def _documented(html: str | None, shown: Callable[[str], str] = str) -> tuple[dom.Node, str]:
    """The main part of a page without noise, and its title: the first one that shows more than five characters."""
    root = without(dom.parse(html), DOC_NOISE)
    main = first(root, DOC_MAIN) or root
    title = ""
    for s in DOC_TITLE:
        found = next((n for n in main.walk() if fits(n, s)), None)
        if found is not None:
            title = found.text().strip()
            if len(shown(title)) > 5:
                break
    return main, title


def documentation(html: str | None) -> dict | None:
    """The documentation candidate: noise out, the main part in, its title; None for too few words."""
    main, title = _documented(html)
    text = dom.markdown(main).strip()
    words = len(re.findall(r"\w+", text))
    return {"text": text, "title": title, "description": title[:300], "word_count": words} if words >= WORDS_LEAST else None


def documentation_title_source(html: str | None) -> str:
    """The documentation candidate's title as the page spells it, its entities not decoded."""
    return _documented((html or "").replace("&", "&amp;"), entities.unescape)[1]


def mended_links(text: str) -> str:
    """Spaces out of link texts that are URLs."""
    return re.sub(r"\[([^\]]+)\]\(([^)]+)\)", lambda m: f"[{m[1].replace(' ', '') if m[1].startswith(('http://', 'https://')) else m[1]}]({m[2]})", text)


def converted_tables(text: str) -> str:
    """HTML tables inside a text as pipe tables; those without rows stay."""

    def convert(m: re.Match[str]) -> str:
        rows = [[re.sub(r"<[^>]+>", "", c).strip() for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", m[0])]
        if not rows:
            return m[0]
        lines = [f"| {' | '.join(r)} |" for r in rows]
        rule = "|" + "|".join([" --- "] * max(map(len, rows))) + "|"
        return "\n" + "\n".join([lines[0], rule, *lines[1:]]) + "\n"

    return re.sub(r"(?is)<table[^>]*>.*?</table>", convert, text)


def with_tables(text: str, html: str | None) -> str:
    """The text with the page's data tables at its end, where it shows none: those of a wiki, or with header cells."""
    if PIPE_TABLE.search(text):
        return text
    found: dict[str, str] = {}
    for t in dom.parse(html).walk():
        if t.tag != "table" or NO_DATA.search(t.attrs.get("class", "")) or t.attrs.get("role") == "presentation":
            continue
        if "wikitable" not in t.attrs.get("class", "") and not any(c.tag == "th" for c in t.walk()):
            continue
        if len(found) < TABLES_MOST and (shown := dom.gfm(t)):
            found.setdefault(shown[:120], shown)
    return f"{text.rstrip()}\n\n## Tables\n\n" + "\n\n".join(found.values()) + "\n" if found else text


# What annotation tools leave in pages.
WRAPPERS = ("marked-text", "marked-tail")
USER_SELECT = ("user-select", "-webkit-user-select", "-moz-user-select", "-ms-user-select")
OUTLINE = re.compile(r"(?:blue|#0d6efd|rgb\(\s*13\s*,\s*110\s*,\s*253\s*\)) dashed (?:1px|2px)(?: !important)?")
ANNOTATION_ATTRIBUTES = re.compile(r"""\s+(?:data-anno-uid|cc-select|data-annotation[\w-]*)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)


def scrubbed_style(value: str) -> tuple[str, int]:
    """An inline style without the marks of annotation tools, and how many there were."""
    kept, gone = [], 0
    for part in filter(None, value.split(";")):
        key, colon, rest = part.partition(":")
        key, rest = key.strip().lower(), re.sub(r"\s+", " ", rest.strip().lower())
        if colon and ((key in USER_SELECT and rest in ("none", "none !important")) or (key == "outline" and OUTLINE.fullmatch(rest))):
            gone += 1
        else:
            kept.append(part)
    text = ";".join(kept)
    return text + ";" * bool(text and value.rstrip().endswith(";")), gone


def scrubbed(html: str) -> tuple[str, dict[str, int]]:
    """A page without annotation attributes, styles and wrappers, and counts of what was taken out; raw text and comments stay."""
    counts = {"wrapper_tags": 0, "attributes": 0, "style_declarations": 0}

    def tag(m: re.Match[str]) -> str:
        if m[1] is None:
            return m[0]
        if m[1].lower() in WRAPPERS:
            counts["wrapper_tags"] += 1
            return ""
        out, n = ANNOTATION_ATTRIBUTES.subn("", m[0])
        counts["attributes"] += n

        def style(s: re.Match[str]) -> str:
            value, gone = scrubbed_style(s[3])
            counts["style_declarations"] += gone
            return s[0] if not gone else f"{s[1]}{s[2]}{value}{s[2]}" if value else ""

        return re.sub(r"""(\sstyle\s*=\s*)(["'])(.*?)\2""", style, out, flags=re.IGNORECASE | re.DOTALL)

    pattern = r"""<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?([A-Za-z][\w-]*)(?:"[^"]*"|'[^']*'|[^'">])*>"""
    out = re.sub(pattern, tag, html, flags=re.DOTALL | re.IGNORECASE)
    return out, counts | {"characters_removed": len(html) - len(out)}
