"""Plain text of papers: headings, sections, references, titles, authors, abstracts, and Markdown of a record. Pure Python."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

from brookmill.functions import dom

I = re.IGNORECASE  # noqa: E741
# The words that headings of papers begin with or consist of, evidence of references, and publisher link controls.
NUMBERED = re.compile(r"(?:\d+(?:\.\d+)*\.?\s+|[IVX]+\.\s+)", I)
STRICTLY_NUMBERED = re.compile(r"(?:\d+\.\s+|\d+\.\d+(?:\.\d+)*\.?\s+|[IVX]+\.\s+)", I)
TOPIC = re.compile(
    r"(?:\d+(?:\.\d+)*\.?\s+|[IVX]+\.\s+)?(?:introductions?|background|methods?|experiments?|results?|discussions?|conclusions?|related[\s-]+work|future[\s-]+work|acknowledg(?:e)?ments?|appendix|"
    r"appendices|supplement(?:ary)?|implementations?|evaluations?|analyses?|analysis|approaches?|overviews?|preliminar(?:y|ies)|motivations?|contributions?|problems?|solutions?|"
    r"literature[\s-]+review|surveys?|case[\s-]+stud(?:y|ies)|frameworks?|architectures?|designs?|setups?|limitations?|comparisons?|ablations?)\b",
    I,
)
REFERENCES = re.compile(r"(?:references?|bibliography|works.cited|citations?)\s*", I)
ABSTRACT = re.compile(r"(?:abstract|summary|synopsis)\s*:?\s*", I)
AFTER_KEPT = re.compile(
    r"(?:(?:appendix|appendices)(?:\s+[A-Z0-9][^\n]{0,120})?|supplement(?:ary)?(?:\s+(?:material|information|methods?|data))?(?:\s*[:.-]\s*[^\n]{1,100})?|associated\s+data|acknowledg(?:e)?ments?|(?:data|code)\s+availability)\s*",
    I,
)
AFTER_SKIPPED = re.compile(r"(?:author\s+information|authors?\s+and\s+affiliations|corresponding\s+author|correspondence|ethics\s+declarations?|additional\s+information|publisher(?:'s|’s)?\s+note)\s*", I)
YEAR = re.compile(r"\b(?:18|19|20)\d{2}[a-z]?\b", I)
IDENTIFIER = re.compile(r"\b(?:10\.\d{4,9}/|arxiv\s*:|pmid\s*:|https?://)", I)
CONTROL = r"(?:Article|CAS|PubMed(?: Central)?|Google Scholar|View Article|Crossref|Web of Science|Download PDF|Download references|ADS|MATH|DOI|PMC free article)"
TITLE_NOISE = re.compile(r"provided proper attribution|permission (?:is|to )|all rights reserved|copyright|creative commons|accepted manuscript|preprint submitted|terms (?:and|of) (?:use|service)|downloaded from|^arxiv\s*:|^https?://|^www\.", I)
REFERENCES_MOST = 15_000
CUT = "<!-- references truncated at 15000 characters -->"
ABSTRACT_LABELS = "Background|Objectives|Objective|Methods|Methodology|Principal Findings|Findings|Results|Conclusions|Conclusion|Significance"
TRACKING = frozenset("download downloadformat downloadpdf utm_campaign utm_content utm_medium utm_source utm_term".split())
PREPRINTS = ("biorxiv.org", "medrxiv.org", "chemrxiv.org")


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def is_heading(line: str, generic: bool = True) -> bool:
    """Whether a line reads as a section heading: a known topic, or (where ``generic``) a numbered short line; never a sentence."""
    if re.search(r"[.!?]\s*$", line):
        return False
    words, topic = line.split(), TOPIC.match(line)
    if NUMBERED.match(line):
        if len(words) > 18 or "[[" in line or "]]" in line:
            return False
        if topic or not generic:
            return topic is not None
        number = re.match(r"\d+", line)
        if STRICTLY_NUMBERED.match(line):
            return number is None or int(number[0]) <= 50
        tail = re.match(r"(\d+)\s+(.+)$", line)
        letter = next((c for c in tail[2] if c.isalpha()), "") if tail else ""
        return tail is not None and 1 <= int(tail[1]) <= 20 and letter.isupper() and len(tail[2].split()) <= 12
    if topic is None or len(words) > 6:
        return False
    if line.casefold().startswith(("appendix", "appendices", "supplement")):
        return not re.search(r"[()\[\]?!]", line)
    return not re.search(r"[,:;()\[\]?!]", line) and line.count("-") <= 1


def references_line(lines: list[str]) -> int | None:
    """The line of the References heading that years and identifiers follow most; the last one of equals."""

    def evidence(k: int) -> tuple[int, int]:
        after = "\n".join(lines[k + 1 : k + 161])[:12_000]
        return len(YEAR.findall(after)) + 2 * len(IDENTIFIER.findall(after)), k

    found = [k for k, x in enumerate(lines) if REFERENCES.fullmatch(squeeze(x))]
    return max(found, key=evidence, default=None)


def sections(text: str, title: str = "", abstract: str = "", authors: list[str] | None = None) -> list[dict]:
    """Sections (heading, level, content) of a paper's text, without what is known already, the abstract, references and end matter."""
    lines = [squeeze(x) for x in text.split("\n")]
    refs = references_line(lines)
    known = {squeeze(x).casefold() for x in (title, abstract, *(authors or ())) if x}
    told = squeeze(abstract).casefold()
    seen: dict[str, int] = {}
    for x in lines:
        if x and not NUMBERED.match(x) and is_heading(x, generic=False):
            seen[x.casefold()] = seen.get(x.casefold(), 0) + 1
    out: list[dict] = []
    now: dict = {"heading": "Body", "level": 1, "content": []}
    state, past, appendix = "body", False, False

    def begin(heading: str, level: int = 1) -> None:
        nonlocal now, appendix
        if now["content"]:
            out.append(now)
        now = {"heading": heading[:120], "level": level, "content": []}
        appendix = heading.casefold().startswith(("appendix", "appendices"))

    for k, x in enumerate(lines):
        if not x or x.casefold() in known:
            continue
        if state in ("references", "end"):
            if AFTER_KEPT.fullmatch(x):
                begin(x)
                state = "body"
            elif state == "references" and AFTER_SKIPPED.fullmatch(x):
                state = "end"
            continue
        if k == refs:
            state, past = "references", True
            continue
        if past and AFTER_SKIPPED.fullmatch(x):
            state = "end"
            continue
        if ABSTRACT.fullmatch(x):
            state = "abstract"
            continue
        if len(x) < 150 and is_heading(x, generic=not appendix) and seen.get(x.casefold(), 0) <= 2:
            if state == "abstract" and not NUMBERED.match(x) and not x.casefold().startswith("introduction"):
                continue
            depth = re.match(r"\d+(?:\.\d+)+", x)
            begin(x, min(depth[0].count(".") + 1, 3) if depth else 1)
            state = "body"
            continue
        if state == "abstract":
            if x.casefold() in told:
                continue
            state = "body"
        now["content"].append(x)
    begin("")
    return [s | {"content": "\n".join(s["content"]) + "\n"} for s in out]


def cleaned_references(text: str) -> str:
    """References without the link controls that publishers put after each."""
    out = []
    for raw in text.strip().splitlines():
        x = squeeze(raw)
        if not x or re.fullmatch(rf"(?:{CONTROL}\s*)+", x, I):
            continue
        x = re.sub(rf"\[\s*{CONTROL}\s*\]", "", x, flags=I)
        x = re.sub(rf"(?:(?<!\w)\[?\s*{CONTROL}\s*\]?){{2,}}", " ", x, flags=I)
        x = re.sub(rf"(?:\s+{CONTROL})+\s*$", "", x, flags=I)
        x = squeeze(re.sub(r"(?:(?<=\s)|^)[\[\]](?=\s|$)", " ", re.sub(r"\[\s*\]", "", x)))
        if x:
            out.append(x)
    return "\n".join(out)


def references(text: str) -> str:
    """The references of a paper's text, cleaned, cut at a line, sentence or word near the bound."""
    lines = text.splitlines()
    k = references_line(lines)
    if k is None:
        return ""
    rest = lines[k + 1 :]
    end = next((i for i, x in enumerate(rest) if AFTER_KEPT.fullmatch(x) or AFTER_SKIPPED.fullmatch(x)), len(rest))
    out = cleaned_references("\n".join(rest[:end]))
    if len(out) <= REFERENCES_MOST:
        return out
    room = REFERENCES_MOST - len(CUT) - 2
    head = out[:room]
    ends = (head.rfind("\n\n"), head.rfind("\n"), max((m.end() for m in re.finditer(r"[.!?](?:\s+|$)", head)), default=-1), head.rfind(" "))
    return f"{head[: next((e for e in ends if e >= room // 2), room)].rstrip()}\n\n{CUT}"


def paper_markdown(p: dict) -> str:
    """Markdown of a paper's record: title, authors, identifiers, where it appeared, abstract, sections, references."""
    ids = [f"DOI: [{p['doi']}](https://doi.org/{quote(p['doi'], safe='/')})"] if p.get("doi") else []
    ids += [f"{name}: {p[key]}" for name, key in (("PMID", "pmid"), ("PMCID", "pmcid"), ("arXiv", "arxiv_id")) if p.get(key)]
    journal = p.get("journal", "") + (f" ({p['publication_date']})" if p.get("journal") and p.get("publication_date") else "")
    parts = [
        p.get("title") and f"# {p['title']}\n", p.get("authors") and f"**Authors**: {', '.join(p['authors'])}\n", ids and f"**Identifiers**: {' · '.join(ids)}\n", journal and f"**Published in**: {journal}\n",
        p.get("abstract") and f"## Abstract\n\n{p['abstract']}\n", *(f"{'#' * min(s['level'] + 1, 4)} {s['heading']}\n\n{s['content']}\n" for s in p.get("sections", ())),
        not p.get("sections") and p.get("full_text") and f"## Full Text\n\n{p['full_text']}\n", p.get("references") and f"## References\n\n{p['references']}\n",
    ]
    return "\n".join(x for x in parts if x)


def structured_abstract(text: str) -> str:
    """An abstract with the spaces and colons that serialisers lost between its fields."""
    text = re.sub(r"(?<=[a-z0-9)])\.(?=[A-Z])", ". ", text)
    return squeeze(re.sub(rf"\b({ABSTRACT_LABELS})(?=[A-Z])", r"\1: ", text))


def page_abstract(root: dom.Node) -> str:
    """The abstract that a page marks by id or class."""
    for n in root.walk():
        if n.attrs.get("id") == "abstract" or {"abstract", "abstract-content"} & set(n.attrs.get("class", "").split()):
            text = re.sub(r"(?i)^(?:abstract|summary)\s*:?\s*", "", dom.squeeze(n.text()))
            if len(text) >= 40:
                return text[:10_000]
    return ""


def license_url(root: dom.Node, url: str) -> str:
    for n in root.walk():
        href = n.attrs.get("href", "").strip()
        stated = n.tag in ("link", "a") and "license" in n.attrs.get("rel", "").lower().split()
        if href and (stated or (n.tag == "a" and re.search(r"(?i)creativecommons\.org/(?:licenses|publicdomain)/", href))):
            found = urljoin(url, href)
            if urlsplit(found).scheme in ("http", "https") and urlsplit(found).hostname:
                return found
    return ""


def pdf_key(url: str) -> str:
    """A URL without what only changes how a file is shown or counted."""
    p = urlsplit(url)
    try:
        port = p.port
    except ValueError:
        return url
    host = (p.hostname or "").rstrip(".") + (f":{port}" if port and (p.scheme.lower(), port) not in (("http", 80), ("https", 443)) else "")
    query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.casefold() not in TRACKING))
    return urlunsplit((p.scheme.lower(), host, p.path, query, ""))


def pdf_candidates(root: dom.Node, url: str) -> list[str]:
    """PDF links of a page in order, each once: citation tags, typed links, links that say so; one on preprint servers, else ten."""
    found = [n.attrs["content"] for key in ("citation_pdf_url", "eprints.document_url", "wkhealth_pdf_url") for n in root.walk() if n.tag == "meta" and n.attrs.get("name", "").lower() == key and n.attrs.get("content")]
    found += [n.attrs["href"] for n in root.walk() if n.tag == "link" and "application/pdf" in n.attrs.get("type", "").lower() and "href" in n.attrs]
    for n in root.walk():
        href, label = n.attrs.get("href", "").strip(), dom.squeeze(n.text()).lower()
        if n.tag == "a" and href and not re.search(r"(?i)\b(?:supplement(?:ary)?|supporting|poster|figure|table)\b", f"{href} {label}") and (".pdf" in href.lower() or re.search(r"\b(?:view|download)?\s*pdf\b", label)):
            found.append(href)
    if m := re.search(r"arxiv\.org/(?:abs|pdf|html)/([\w.\-/]+?)(?:v\d+)?(?:\.pdf)?$", url):
        found.append(f"https://arxiv.org/pdf/{m[1]}")
    host = (urlsplit(url).hostname or "").lower()
    most = 1 if any(host == p or host.endswith("." + p) for p in PREPRINTS) else 10
    out: dict[str, str] = {}
    for x in found:
        whole = urljoin(url, x).split("#", 1)[0]
        if urlsplit(whole).scheme in ("http", "https") and urlsplit(whole).hostname and whole != url:
            out.setdefault(pdf_key(whole), whole)
    return list(out.values())[:most]


def plain_title(text: str) -> str:
    """The title of a paper's plain text: the first of its first lines that reads like one."""
    for x in [x.strip() for x in text.split("\n") if x.strip()][:10]:
        if 2 <= len(x.split()) <= 40 and 8 <= len(x) < 300 and not TITLE_NOISE.search(x) and not re.search(r"10\.\d{4,9}/", x) and x.count(",") < 2:
            return x
    return ""


def plain_authors(text: str) -> list[str]:
    """Names before the line with an affiliation, else on the first line with two commas."""
    lines = text[:5000].split("\n")
    place = next((k for k, x in enumerate(lines[:30]) if re.search(r"university|institute|laboratory|@|college", x.lower())), None)
    line = (lines[place - 1] if place else lines[0]) if place is not None else next((x for x in lines[:15] if x.count(",") >= 2 and len(x) < 300), "")
    names = (x.strip() for x in re.split(r",|\band\b", line))
    return [x for x in names if len(x.split()) >= 2 and len(x) < 80 and not re.search(r"university|institute|department|abstract|email", x.lower())][:20]


def plain_abstract(text: str) -> str:
    """The text under the abstract's heading up to the next one; without a heading the first substantial paragraph after the title."""
    lines = text.split("\n")
    k = next((i for i, x in enumerate(lines) if ABSTRACT.fullmatch(x.strip())), None)
    if k is None:
        return next((p.strip()[:3000] for p in re.split(r"\n\s*\n", text[:8000])[1:6] if 100 < len(p.strip()) < 3000), "")
    rest = lines[k + 1 :]
    end = next((i for i, x in enumerate(rest) if TOPIC.match(x) or REFERENCES.fullmatch(x)), len(rest))
    out = "\n".join(rest[:end]).strip()
    return out if end < len(rest) else out[:3000]
