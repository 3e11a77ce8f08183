"""Order-sensitive similarity and normalisation that have no built-in form: pure functions, and Arrow UDFs over them."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 5
WINDOW_RATIOS = ((1, 2), (3, 4), (1, 1), (5, 4), (3, 2), (2, 1))
CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


def normalized(text: str | None) -> str:
    """NFKC, case-folded, NFKC again; ignorable and control characters dropped, white space collapsed."""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    t = " ".join(t.split())
    dropped = {ord(c): None for c in set(t) if unicodedata.category(c).startswith("C")}
    return (t.translate(dropped) if dropped else t).strip()


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits, marks and underscores with apostrophes inside; symbols and CJK characters alone."""
    t = unicodedata.normalize("NFKC", text or "").casefold()
    return re.findall(rf"[{CJK}]|[^\W{CJK}]+(?:['’][^\W{CJK}]+)*|[^\w\s]", t)


def grams(text: str, size: int = GRAM) -> list[str]:
    return [text[i : i + size] for i in range(len(text) - size + 1)]


def multiset_f1(a: list[str], b: list[str]) -> float:
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a and b else 0.0


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def ordered_f1(a: list[str], b: list[str]) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def best_window_f1(text: list[str], reference: list[str]) -> float:
    """The best multiset F1 of a window of the text, over six lengths relative to the reference; counts slide along."""
    if not text or not reference:
        return 0.0
    want = Counter(reference)
    best = 0.0
    for up, down in WINDOW_RATIOS:
        n = min(len(text), max(1, len(reference) * up // down))
        have, hit = Counter(text[:n]), 0
        hit = sum((have & want).values())
        best = max(best, 2 * hit / (n + len(reference)))
        for i in range(n, len(text)):
            old, new = text[i - n], text[i]
            hit -= have[old] <= want[old]
            have[old] -= 1
            have[new] += 1
            hit += have[new] <= want[new]
            best = max(best, 2 * hit / (n + len(reference)))
    return best


def ordered_share(output: list[str], source: list[str]) -> float:
    """Share of the output's tokens found in the source from left to right, each after the last."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(source):
        at.setdefault(t, []).append(i)
    cursor, found = -1, 0
    for t in output:
        places = at.get(t)
        if places is None:
            continue
        k = bisect_right(places, cursor)
        if k < len(places):
            cursor, found = places[k], found + 1
    return found / len(output) if output else 0.0


def titles_match(a: str | None, b: str | None) -> bool:
    """Close in letters (0.92) and in words (0.85)."""
    x, y = (re.sub(r"[^\w ]", "", normalized(t)) for t in (a, b))
    if not x or not y:
        return False
    u, v = set(x.split()), set(y.split())
    return SequenceMatcher(None, x, y).ratio() >= 0.92 and len(u & v) / len(u | v) >= 0.85


def path_id(path: str, prefix: str = "node") -> str:
    """A stable id from a DOM path: 64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in path.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{prefix}-{h:016x}"


def _pairwise(f: Callable[[str, str], float], kind: T.DataType):
    @F.pandas_udf(kind)
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run


same_title = _pairwise(titles_match, T.BooleanType())


def subsequence_length(wanted: list[str], source: list[str]) -> int:
    """How many of the first wanted tokens the source holds one after the other."""
    rest = iter(source)
    n = 0
    for t in wanted:
        if not any(x == t for x in rest):
            break
        n += 1
    return n


def bag_agreement(output: list[str], source: list[str]) -> float:
    """Share of the output's tokens, with multiplicity, that the source has."""
    return sum((Counter(output) & Counter(source)).values()) / len(output) if output else 0.0


def _on_lists(f: Callable[[list[str], list[str]], float], kind: T.DataType):
    @F.pandas_udf(kind)
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([f([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)])

    return run


bag_share = _on_lists(bag_agreement, T.DoubleType())
order_share_of = _on_lists(ordered_share, T.DoubleType())
subsequence = _on_lists(subsequence_length, T.LongType())
