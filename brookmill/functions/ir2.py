"""The ordered graph of a page: elements and text runs in one order, with the structures they stand in; math, Markdown of a
selection, source spans, atoms and certificates. Pure Python, one page at a time."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from brookmill.functions import dom
from brookmill.functions.scoring import path_id

# What the graph leaves out, and the attributes it keeps.
EXCLUDED = frozenset("head style template noscript meta link base iframe object embed source track canvas".split())
KEPT_ATTRIBUTES = "alt alttext aria-label class colspan data-latex data-tex display encoding href id lang latex reversed role rowspan scope src start type value xml:lang".split()
TEX_TYPES = ("math/tex", "application/x-tex")
MAX_ELEMENTS, MAX_RUNS, MAX_RUN_BYTES, MAX_MATH_BYTES = 50_000, 100_000, 65_536, 262_144
#: Structures that an element or run is looked up in: name of the field, tags.
WITHIN = {"table_id": ("table",), "cell_id": ("td", "th"), "list_id": ("ul", "ol", "dl"), "item_id": ("li", "dt", "dd"), "code_id": ("pre", "code")}
RAW_TEXT = ("script", "style", "textarea", "title")


def tex_script(n: dom.Node) -> bool:
    return n.tag == "script" and n.attrs.get("type", "").lower().startswith(TEX_TYPES)


def excluded(n: dom.Node) -> bool:
    if n.tag in EXCLUDED or (n.tag == "script" and not tex_script(n)):
        return True
    if "hidden" in n.attrs or "inert" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true":
        return True
    style = re.sub(r"\s", "", n.attrs.get("style", "")[:2048]).lower()
    return "display:none" in style or "visibility:hidden" in style


def language(n: dom.Node) -> str | None:
    stated = n.attrs.get("lang") or n.attrs.get("xml:lang")
    if stated or n.tag not in ("code", "pre"):
        return stated
    return next((c.split("-", 1)[1] for c in n.attrs.get("class", "").split() if c.startswith(("language-", "lang-"))), None)


@dataclass
class Graph:
    root: dom.Node
    elements: list[dict] = field(default_factory=list)
    runs: list[dict] = field(default_factory=list)
    truncated: bool = False
    nodes: dict[str, dom.Node] = field(default_factory=dict)


def graph(html: str | None) -> Graph:
    g = Graph(dom.parse(html))
    used: dict[str, int] = {}

    def name(path: str) -> str:
        base = path_id(path)
        used[base] = used.get(base, 0) + 1
        return base if used[base] == 1 else f"{base}-{used[base] - 1}"

    order = 0
    stack: list[tuple] = [(c, None, 0, "", {}) for c in reversed(_numbered(g.root))]
    while stack:
        (c, k), parent, depth, above, within = stack.pop()
        if isinstance(c, str):
            if c:
                if len(g.runs) >= MAX_RUNS or len(c.encode("utf-8", "surrogatepass")) > MAX_RUN_BYTES:
                    g.truncated = True
                    continue
                g.runs.append({"id": name(f"{above}/text()[{k}]"), "ord": order, "parent_id": parent, "depth": depth, "text": c, **within})
                order += 1
            continue
        if excluded(c):
            continue
        if len(g.elements) >= MAX_ELEMENTS:
            g.truncated = True
            continue
        path = f"{above}/{c.tag}[{k}]"
        own = name(path)
        g.nodes[own] = c
        g.elements.append({
            "id": own, "ord": order, "parent_id": parent, "depth": depth, "tag": c.tag, "path": path, "heading_level": int(c.tag[1]) if re.fullmatch("h[1-6]", c.tag) else None,
            "href": c.attrs.get("href"), "src": c.attrs.get("src"), "alt": c.attrs.get("alt"), "language": language(c), **within,
        })
        order += 1
        inner = within | {f: own for f, tags in WITHIN.items() if c.tag in tags}
        if c.tag == "table":
            inner |= {"cell_id": None, "list_id": None, "item_id": None}
        if c.tag == "math" or tex_script(c):
            inner |= {"math_id": own}
        stack.extend((x, own, depth + 1, path, inner) for x in reversed(_numbered(c)))
    return g


def _numbered(n: dom.Node) -> list[tuple]:
    """Children with their number among those of the same kind; texts that touch are one."""
    out: list[list] = []
    for c in n.children:
        if isinstance(c, str) and out and isinstance(out[-1][0], str):
            out[-1][0] += c
        else:
            out.append([c, 0])
    seen: dict[str, int] = {}
    for x in out:
        kind = "#" if isinstance(x[0], str) else x[0].tag
        seen[kind] = x[1] = seen.get(kind, 0) + 1
    return [tuple(x) for x in out]


def maths(g: Graph) -> Iterator[dict]:
    """Formulas with their TeX: from the script, an attribute, or an annotation; MathML within a budget of bytes for the page."""
    left = MAX_MATH_BYTES
    for e in g.elements:
        n = g.nodes[e["id"]]
        if not (n.tag == "math" or tex_script(n)):
            continue
        notes = [x.text().strip() for x in n.walk() if x.tag == "annotation" and "tex" in x.attrs.get("encoding", "").lower()]
        tex = (n.text().strip("\r\n") if n.tag == "script" else "") or next((n.attrs[a] for a in ("data-tex", "data-latex", "latex") if a in n.attrs), "") or next(filter(None, notes), "")
        markup = dom.outer(n).encode()
        kept = markup[:left].decode(errors="ignore")
        left -= len(kept.encode())
        display = n.attrs.get("display", "").lower() or ("block" if "mode=display" in n.attrs.get("type", "").lower() else "inline")
        yield {
            "node_id": e["id"], "ord": e["ord"], "format": "mathml" if n.tag == "math" else "tex", "display": "block" if display in ("block", "display") else "inline", "tex": tex or None,
            "mathml": kept if n.tag == "math" else None, "alt": n.attrs.get("alttext") or n.attrs.get("aria-label"), "truncated": len(kept.encode()) < len(markup),
        }


def _html_table(table: dom.Node) -> str:
    rows: dict[int, list[str]] = {}
    for c in dom.table_cells(table):
        tag = "th" if c["header"] else "td"
        span = "".join(f' {a}="{c[k]}"' for a, k in (("rowspan", "row_span"), ("colspan", "column_span")) if c[k] > 1)
        rows.setdefault(c["row_index"], []).append(f'<{tag} data-row="{c["row_index"]}" data-column="{c["column_index"]}"{span}>{entities.escape(c["text"], quote=False)}</{tag}>')
    return "<table>\n" + "\n".join(f"<tr>{''.join(r)}</tr>" for _, r in sorted(rows.items())) + "\n</table>"


def joined(blocks: Iterable[str]) -> str:
    """Blocks apart by one blank line; empty ones dropped."""
    return "\n\n".join(b for b in (x.strip("\n") for x in blocks) if b.strip())


def serialized(g: Graph, chosen: Iterable[str] | None = None) -> tuple[str, list[str]]:
    """Markdown of the whole graph, or of the chosen elements (with all in them) and runs (with their ancestors); and unknown ids.

    Tables are HTML with each cell's place; all else is as in ``dom.markdown``.
    """
    parents = {x["id"]: x["parent_id"] for x in (*g.elements, *g.runs)}
    if chosen is None:
        wanted, missing = set(parents), []
    else:
        chosen = list(dict.fromkeys(chosen))
        missing = [c for c in chosen if c not in parents]
        full = {c for c in chosen if c in parents}
        wanted = set()
        for x in sorted((*g.elements, *g.runs), key=lambda x: x["ord"]):
            if x["id"] in full or x["parent_id"] in full:
                if x["id"] in g.nodes:
                    full.add(x["id"])
                at = x["id"]
                while at is not None and at not in wanted:
                    wanted.add(at)
                    at = parents[at]
    copies: dict[str | None, dom.Node] = {None: dom.Node("#root")}
    for x in sorted((*g.elements, *g.runs), key=lambda x: x["ord"]):
        if x["id"] not in wanted:
            continue
        home = copies[x["parent_id"]]
        if x["id"] not in g.nodes:
            home.children.append(x["text"])
            continue
        n = g.nodes[x["id"]]
        copy = dom.Node("math" if tex_script(n) else n.tag, dict(n.attrs), parent=home)
        if tex_script(n):
            copy.children = [dom.Node("annotation", {"encoding": "tex"}, [n.text().strip()], copy)]
            copy.attrs["display"] = "block" if "mode=display" in n.attrs.get("type", "").lower() else "inline"
        home.children.append(copy)
        copies[x["id"]] = copy

    def blocks(n: dom.Node) -> Iterator[str]:
        line: list = []

        def flush() -> Iterator[str]:
            if line:
                yield dom.markdown(dom.Node("p", {}, list(line)), keep_images=True)
                line.clear()

        for c in n.children:
            if isinstance(c, str) or c.tag not in dom.BLOCKS:
                line.append(c)
                continue
            yield from flush()
            if c.tag == "table":
                yield _html_table(c)
            elif c.tag in dom.LANDMARKS or c.tag in ("html", "body", "div", "#root", "figure", "details", "form", "center"):
                yield from blocks(c)
            else:
                yield dom.markdown(c, keep_images=True)
        yield from flush()

    return joined(blocks(copies[None])), missing


def source_elements(source: str) -> Iterator[tuple[str, int, int]]:
    """(tag, begin, end) of every start tag of the source; what stands in comments and raw text is none."""
    at = 0
    tag = re.compile(r"""<!--.*?(?:-->|\Z)|<([A-Za-z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^'">])*>""", re.DOTALL)
    while m := tag.search(source, at):
        at = m.end()
        if m[1] is None:
            continue
        name = m[1].lower()
        yield name, m.start(), m.end()
        if name in RAW_TEXT and (end := re.compile(rf"</{name}\b", re.IGNORECASE).search(source, at)):
            at = end.start()


def mapped_elements(source: str, g: Graph) -> dict[str, tuple[int, int]]:
    """Spans of the start tags of the graph's elements, in order; elements that the parser put in have none."""
    spans = list(source_elements(source))
    out, at = {}, 0
    for e in g.elements:
        ahead = next((k for k in range(at, len(spans)) if spans[k][0] == e["tag"]), None)
        if ahead is not None:
            out[e["id"]], at = spans[ahead][1:], ahead + 1
    return out


def source_text_map(source: str, g: Graph) -> list[tuple[str, int, int]] | None:
    """(run id, begin, end) of the source text of every run, if all of them stand there in order and none is left over; else None.

    The source's texts between tags, without those in left-out elements, decoded and joined where comments part them.
    """
    token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([A-Za-z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^'">])*>""", re.DOTALL)
    texts, at, joins = [], 0, False
    while at < len(source):
        m = token.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            if joins:
                texts[-1] = [texts[-1][0], end, texts[-1][2] + source[at:end]]
            else:
                texts.append([at, end, source[at:end]])
        if not m:
            break
        at = m.end()
        # A comment parts no text; a tag does.
        joins = m[1] is None and bool(texts) and (joins or texts[-1][1] == end)
        if m[1] and not m[0].startswith("</") and m[1].lower() in RAW_TEXT:
            close = re.compile(rf"</{m[1]}\b", re.IGNORECASE).search(source, at)
            at = close.start() if close else len(source)
    out, k = [], 0
    for run in g.runs:
        want = run["text"]
        while k < len(texts) and entities.unescape(texts[k][2]) != want:
            if texts[k][2].strip() and not _left_out(source, texts[k][0]):
                return None
            k += 1
        if k == len(texts):
            return None
        out.append((run["id"], texts[k][0], texts[k][1]))
        k += 1
    return out


def _left_out(source: str, at: int) -> bool:
    """Whether text at this place is in an element that the graph leaves out (near enough: the last such tag before it is open)."""
    for tag in (*EXCLUDED, "title"):
        if source.rfind(f"<{tag}", 0, at) > source.rfind(f"</{tag}", 0, at):
            return True
    return False


def atoms(g: Graph) -> Iterator[dict]:
    """One atom per run that is not blank: the first that holds of math, code, table cell, list item, text; and the element that closes it."""
    for r in g.runs:
        if r["text"].strip():
            kind = next((k for k, f in (("math", "math_id"), ("code", "code_id"), ("table_cell", "cell_id"), ("list_item", "item_id")) if r.get(f)), "text")
            close = {"math": "math_id", "code": "code_id", "table_cell": "cell_id", "list_item": "item_id"}.get(kind, "parent_id")
            yield {"run_id": r["id"], "ord": r["ord"], "kind": kind, "closure_id": r.get(close), "text": r["text"]}


def digest(g: Graph) -> str:
    whole = [[x["id"], x["ord"], x["parent_id"], x.get("tag"), x.get("text")] for x in (*g.elements, *g.runs)]
    return hashlib.sha256(json.dumps(whole, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


def certificate(html: str, chosen: list[str]) -> str | None:
    """A certificate that a selection gives a text: digests of source, graph and output with the ids; None for unknown or repeated ids."""
    g = graph(html)
    text, missing = serialized(g, chosen)
    if missing or not chosen or len(set(chosen)) < len(chosen):
        return None
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    return json.dumps({"graph": digest(g), "output": sha(text), "schema": "selection.v1", "selected": chosen, "source": sha(html)}, separators=(",", ":"))


def replayed(html: str, stated: str) -> str | None:
    """The text that a certificate stands for, made again from the source; None if anything in it does not agree."""
    try:
        found = json.loads(stated)
        chosen = found["selected"]
    except (ValueError, TypeError, KeyError):
        return None
    if not isinstance(chosen, list) or certificate(html, chosen) != stated:
        return None
    return serialized(graph(html), chosen)[0]
