"""HTML to an ordered tree, to blocks, elements, runs, grids and lists, and to Markdown. Pure Python, one page at a time.

The tree builder follows what browsers do with ordinary pages: void elements, raw-text elements, implied ends of
paragraphs, items, cells and rows, and end tags that close what is open above them. It is not a full HTML5 parser.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Kinds of elements, as the block rules name them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REMOVED = frozenset("head script style template noscript meta link base svg canvas iframe object embed source track input button select option textarea".split())
LANDMARKS = frozenset("main article section nav aside header footer".split())
STRUCTURE = frozenset("table thead tbody tfoot tr ul ol dl".split())
HOLDERS = frozenset("td th li dt dd blockquote pre figure details".split())
ATOMS = frozenset("h1 h2 h3 h4 h5 h6 p code caption figcaption summary address img math".split())
SEMANTIC = LANDMARKS | STRUCTURE | HOLDERS | (ATOMS - {"caption"}) | {"div"}
CELLS = frozenset("td th li dt dd".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre code caption figcaption".split())
CONTAINER_ROLES = frozenset("main article region navigation complementary banner contentinfo feed group".split())
ROLE_OF = {
    "main": "main", "article": "article", "section": "section", "nav": "navigation", "aside": "complementary", "header": "banner", "footer": "contentinfo",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "blockquote": "blockquote", "pre": "preformatted",
    "code": "code", "table": "table", "thead": "rowgroup", "tbody": "rowgroup", "tfoot": "rowgroup", "tr": "row", "td": "cell", "th": "columnheader", "caption": "caption",
    "ul": "list", "ol": "list", "dl": "description-list", "li": "listitem", "dt": "term", "dd": "definition", "figure": "figure", "figcaption": "caption", "details": "details",
    "summary": "summary", "address": "address", "img": "image", "math": "math", "a": "link",
}
BLOCKS = LANDMARKS | STRUCTURE | HOLDERS | frozenset("h1 h2 h3 h4 h5 h6 p div body html caption figcaption summary address hr form center".split())
#: An opening tag that ends an open element of these kinds, unless one of the stops is in between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
MAX_NODES, MAX_DEPTH, MAX_BLOCKS, MAX_BLOCK_TEXT = 100_000, 256, 10_000, 64_000


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)
    parent: "Node | None" = None

    def walk(self) -> Iterator["Node"]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def up(self) -> Iterator["Node"]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at, self.depth, self.count = self.root, 0, 0

    def _close(self, node: Node) -> None:
        while self.at is not node:
            self.at, self.depth = self.at.parent, self.depth - 1
        self.at, self.depth = self.at.parent, self.depth - 1

    def _open(self, tags: set[str] | frozenset[str], stops: set[str]) -> Node | None:
        n = self.at
        while n is not self.root and n.tag not in stops:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        if self.count > MAX_NODES:
            return
        if tag in ENDS_P and (p := self._open({"p"}, {"table", "td", "th", "li", "button"})):
            self._close(p)
        if tag in IMPLIED:
            tags, stops = IMPLIED[tag]
            while n := self._open(tags, stops):
                self._close(n)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < MAX_DEPTH:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self._close(self.at)

    def handle_endtag(self, tag: str) -> None:
        stops = {"table"} if tag in ("li", "p", "div", "a", "span", "b", "i") else set()
        if n := self._open({tag}, stops):
            self._close(n)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def squeeze(text: str) -> str:
    return " ".join(text.replace("\0", "").split())


def hidden(n: Node) -> bool:
    if n.tag in REMOVED or "hidden" in n.attrs or "inert" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true":
        return True
    style = re.sub(r"\s", "", n.attrs.get("style", "")[:1024]).lower()
    return any(x in style for x in ("display:none", "visibility:hidden", "content-visibility:hidden"))


def prune(root: Node) -> Node:
    """The tree without what is not content."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not hidden(c)]
        stack.extend(c for c in n.children if isinstance(c, Node))
    return root


def explicit_role(n: Node) -> str | None:
    words = n.attrs.get("role", "").split()
    role = words[0][:64].lower() if words else ""
    return role if role not in ("", "none", "presentation") else None


def link_leaf(n: Node) -> bool:
    """A link that stands in a cell or item and not inside prose there."""
    for a in n.up():
        if a.tag in CELLS:
            return True
        if a.tag in PROSE:
            return False
    return False


def has_semantic(n: Node) -> bool:
    return any(d.tag in SEMANTIC or (d.tag == "a" and link_leaf(d)) or explicit_role(d) for d in n.walk())


def classify(n: Node) -> str | None:
    """container, leaf (a container to select), atom, or None for no block."""
    if n.tag in LANDMARKS or n.tag in HOLDERS:
        return "container" if has_semantic(n) else "leaf"
    if n.tag in STRUCTURE:
        return "container"
    if n.tag in ATOMS or (n.tag == "a" and link_leaf(n)):
        return "atom"
    if role := explicit_role(n):
        return ("container" if has_semantic(n) else "leaf") if role in CONTAINER_ROLES else "atom"
    return "atom" if n.tag in ("div", "body", "center") and not has_semantic(n) else None


def outer(n: Node) -> str:
    attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in n.attrs.items())
    inner = "".join(outer(c) if isinstance(c, Node) else entities.escape(c, quote=False) for c in n.children)
    return f"<{n.tag}{attrs}>" + ("" if n.tag in VOID else f"{inner}</{n.tag}>")


def blocks(html: str | None) -> list[dict]:
    """Semantic blocks in document order, each with its parent block, features and densities."""
    out: list[dict] = []
    stack = [(c, None, 0) for c in reversed(prune(parse(html)).children) if isinstance(c, Node)]
    while stack and len(out) < MAX_BLOCKS:
        n, parent, depth = stack.pop()
        kind = classify(n)
        if kind:
            keep = n.tag in ("pre", "code")
            raw = n.attrs.get("alt", "") if n.tag == "img" else n.text()
            text = raw.replace("\r\n", "\n").strip("\n") if keep else squeeze(raw)
            if text or n.tag in ("img", "table", "figure", "math", "pre", "code"):
                source = outer(n)
                links = [x for x in (n, *n.walk()) if x.tag == "a" and "href" in x.attrs]
                size, link_size, whole = len(text.encode()), sum(len(squeeze(x.text()).encode()) for x in links), len(source.encode())
                parent_id, parent = parent, f"block-{len(out):06}"
                out.append({
                    "block_id": parent, "ord": len(out), "parent_id": parent_id, "tag": n.tag, "role": explicit_role(n) or ROLE_OF.get(n.tag, "generic"), "atomic": kind == "atom",
                    "selectable": kind != "container", "text": text[:MAX_BLOCK_TEXT], "depth": depth, "word_count": len(text.split()), "text_bytes": size, "html_bytes": whole, "link_count": len(links),
                    "link_text_bytes": link_size, "descendants": sum(1 for _ in n.walk()), "text_density": min(1.0, size / whole) if whole else 0.0, "link_density": min(1.0, link_size / size) if size else 0.0,
                })
        if kind != "atom":
            stack.extend((c, parent, depth + 1) for c in reversed(n.children) if isinstance(c, Node))
    return out


def _number(value: str | None, default: int, least: int = 1) -> int:
    m = re.match(r"\s*(-?\d+)", value or "")
    return int(m[1]) if m and int(m[1]) >= least else default


def table_cells(table: Node, max_columns: int = 256) -> list[dict]:
    """Grid places of a table's cells: row and column spans occupy places, a row span of 0 the rest of its group."""
    groups: list[tuple[str, list[Node]]] = []
    for n in table.walk():
        if n.tag == "tr" and next((a for a in n.up() if a.tag == "table"), None) is table:
            home = n.parent if n.parent.tag in ("thead", "tbody", "tfoot") else table
            if not groups or groups[-1][0] is not home:
                groups.append((home, []))
            groups[-1][1].append(n)
    out, row = [], 0
    for home, rows in groups:
        taken: set[tuple[int, int]] = set()
        for i, tr in enumerate(rows):
            col = 0
            for cell in (c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")):
                while (row + i, col) in taken:
                    col += 1
                down = _number(cell.attrs.get("rowspan"), 1, 0)
                down = min(down or len(rows) - i, len(rows) - i)
                across = _number(cell.attrs.get("colspan"), 1)
                if col + across > max_columns:
                    break
                taken.update((row + i + a, col + b) for a in range(down) for b in range(across))
                out.append({"row_index": row + i, "column_index": col, "row_span": down, "column_span": across, "row_group": home.tag if home is not table else "tbody", "header": cell.tag == "th", "scope": cell.attrs.get("scope", ""), "text": squeeze(cell.text())})
                col += across
        row += len(rows)
    return out


def list_items(lst: Node) -> list[dict]:
    """Items of one list with their ordinals: from start (or the number of items if reversed), reset by value."""
    items = [c for c in lst.children if isinstance(c, Node) and c.tag in ("li", "dt", "dd")]
    depth = sum(a.tag in ("ul", "ol", "dl") for a in lst.up())
    backwards = "reversed" in lst.attrs
    n = _number(lst.attrs.get("start"), len([i for i in items if i.tag == "li"]) if backwards else 1, -(2**31))
    out = []
    for k, item in enumerate(items):
        value = item.attrs.get("value")
        n = _number(value, n, -(2**31)) if value else n
        out.append({"index": k, "kind": {"ol": "ordered", "ul": "unordered", "dl": "description"}[lst.tag], "depth": depth, "ordinal": n if lst.tag == "ol" else None, "text": squeeze(item.text()), "node": item})
        n += -1 if backwards else 1
    return out


def _escape(text: str) -> str:
    return re.sub(r"([\\*_\[\]`])", r"\\\1", text)


def _visible(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\0", ""))


def _run(text: str, char: str = "`") -> int:
    return max(map(len, re.findall(re.escape(char) + "+", text)), default=0)


def gfm(table: Node) -> str | None:
    """A pipe table, ragged rows padded; None for fewer than two rows or columns."""
    grid: dict[int, list[str]] = {}
    for c in table_cells(table):
        grid.setdefault(c["row_index"], []).append(c["text"].replace("|", "\\|"))
    rows = [r for r in grid.values() if any(r)]
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2:
        return None
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "|".join([" --- "] * width) + "|", *lines[1:]])


def language_of(n: Node) -> str:
    for x in (n, *n.walk()):
        if m := re.search(r"(?:^|\s)(?:language|lang)-([\w+#.-]+)", x.attrs.get("class", "")):
            return m[1]
    return ""


def markdown(n: Node, keep_images: bool = False) -> str:
    """Markdown of a subtree: blocks apart by one blank line, code in fences that it cannot close, tables as pipes."""
    if n.tag == "table":
        return gfm(n) or squeeze(n.text())
    if n.tag == "pre":
        code = n.text().strip("\n")
        fence = "`" * max(3, _run(code) + 1)
        return f"{fence}{language_of(n)}\n{code}\n{fence}" if code else ""
    if n.tag == "code":
        code = n.text()
        fence = "`" * (_run(code) + 1)
        return f"{fence}{code}{fence}" if code else ""
    if n.tag == "math":
        tex = next((x.text().strip() for x in n.walk() if x.tag == "annotation" and "tex" in x.attrs.get("encoding", "")), "")
        return (f"$$\n{tex}\n$$" if n.attrs.get("display") == "block" else f"\\({tex}\\)") if tex else squeeze(n.text())
    if n.tag == "img":
        return f"![{_escape(n.attrs.get('alt', ''))}]({n.attrs.get('src', '')})" if keep_images else ""
    if n.tag in ("br", "hr"):
        return "\n" if n.tag == "br" else "---"
    if n.tag in ("ul", "ol"):
        lines = []
        for item in list_items(n):
            body = markdown(item["node"], keep_images).strip()
            mark = f"{item['ordinal']}." if item["ordinal"] is not None else "-"
            lines.append(f"{mark} " + "\n".join(("  " if i and x else "") + x for i, x in enumerate(body.split("\n"))))
        return "\n".join(lines)
    out, was_block = "", False
    for c in n.children:
        part = _escape(_visible(c)) if isinstance(c, str) else markdown(c, keep_images)
        block = isinstance(c, Node) and c.tag in BLOCKS
        if not part or ((block or was_block) and not part.strip()):
            continue
        if out and (block or was_block):
            out = out.rstrip(" ")
            out += "" if out.endswith("\n\n") else "\n" if out.endswith("\n") else "\n\n"
            part = part.lstrip(" ")
        out, was_block = out + part, block
    body = out.strip()
    if not body:
        return " " if out and n.tag not in BLOCKS else ""
    if re.fullmatch("h[1-6]", n.tag):
        return "#" * int(n.tag[1]) + " " + squeeze(body)
    mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "del": "~~", "strike": "~~"}.get(n.tag)
    if mark and "\n\n" not in body:
        return mark + body + mark
    if n.tag == "a" and n.attrs.get("href"):
        return f"[{body}]({n.attrs['href']})"
    if n.tag == "blockquote":
        return "\n".join("> " + x for x in body.split("\n"))
    return body if n.tag in BLOCKS or n.tag == "#root" else out


NOISE_TAGS = frozenset("nav footer aside header form".split())
NOISE_CLASS = re.compile(r"(?i)\b(?:nav|navbar|menu|sidebar|footer|breadcrumbs?|cookie|share|social|related|advert|ad|promo|newsletter|comments?)\b")


def main_content(root: Node, strict: bool = False) -> Node | None:
    """The subtree with the most prose: a main or article landmark, else the element whose direct paragraphs have most
    words, less those in links. ``strict`` asks for half of its text outside links."""
    best, best_score = None, 0.0
    for n in root.walk():
        if n.tag in NOISE_TAGS or any(a.tag in NOISE_TAGS for a in n.up()) or NOISE_CLASS.search(n.attrs.get("class", "")):
            continue
        if n.tag not in ("main", "article", "section", "div", "body", "td"):
            continue
        own = sum(len(squeeze(c.text()).split()) for c in n.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "h1", "h2", "h3"))
        words = len(squeeze(n.text()).split())
        linked = sum(len(squeeze(a.text()).split()) for a in n.walk() if a.tag == "a")
        if strict and words and linked > words / 2:
            continue
        score = own * (1 - linked / words if words else 0) * (2.0 if n.tag in ("main", "article") or n.attrs.get("role") in ("main", "article") else 1.0)
        if score > best_score:
            best, best_score = n, score
    return best


def confidence(words: int, link_share: float, landmark: bool) -> float:
    return round(min(1.0, (0.35 if landmark else 0.1) + 0.45 * min(1.0, words / 200) + 0.2 * (1 - link_share)), 4)


def candidates(html: str | None) -> list[dict]:
    """Deterministic candidates of a page's content: strategy, text, title, words, confidence."""
    raw = parse(html)
    title = next((squeeze(n.text()) for n in raw.walk() if n.tag == "title"), "")
    root = prune(raw)
    out = []

    def add(strategy: str, node: Node | None, text: str | None = None) -> None:
        body = markdown(node).strip() if text is None and node is not None else text or ""
        words = len(re.findall(r"\w+", body))
        if words >= 8:
            linked = sum(len(squeeze(a.text()).split()) for a in node.walk() if a.tag == "a") if node is not None else 0
            sure = confidence(words, min(1.0, linked / max(1, words)), node is not None and node.tag in ("main", "article"))
            out.append({"ord": len(out), "strategy": strategy, "text": body, "title": title, "word_count": words, "confidence": sure})

    main = main_content(root)
    add("rs-trafilatura", main)
    add("trafilatura", main_content(root, strict=True))
    paragraphs = [markdown(n).strip() for n in (main or root).walk() if n.tag == "p" and len(squeeze(n.text())) > 24]
    add("readability", main, "\n\n".join(paragraphs))
    add("markdownify", root)
    add("raw_lxml", None, squeeze(root.text()))
    return out
