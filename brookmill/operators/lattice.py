"""Best path of compatible text spans of each document: an exact dynamic program per document in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("source", pa.string()), ("s", pa.int64()), ("e", pa.int64())])


@dataclass(frozen=True)
class Weights:
    coverage: float = 0.0
    gap: float = 0.0
    fragment: float = 0.0
    contiguous: int = 0
    heading_body: float = 0.0
    heading_types: tuple[str, ...] = ("heading", "title")
    body_types: tuple[str, ...] = ("body", "paragraph", "list", "table", "code")


def compatible(a: dict, b: dict) -> bool:
    """b may follow a: it begins after a's end, and neither is the other's source, block or ancestor."""
    return a["e"] <= b["s"] and a["source"] != b["source"] and a["block"] != b["block"] and a["block"] not in b["ancestors"] and b["block"] not in a["ancestors"]


def _node(x: dict, w: Weights) -> Fraction:
    return Fraction(x["score"]) + Fraction(w.coverage) * (x["e"] - x["s"])


def _step(a: dict, b: dict, w: Weights) -> Fraction:
    gap = b["s"] - a["e"]
    out = -Fraction(w.gap) * gap - (Fraction(w.fragment) if gap > w.contiguous else 0)
    return out + (Fraction(w.heading_body) if a["type"] in w.heading_types and b["type"] in w.body_types else 0)


def path_key(path: list[dict], w: Weights) -> tuple:
    """Greater is better: score, covered characters, fewer spans, smaller place in the source order."""
    score = sum((_node(x, w) for x in path), Fraction(0)) + sum((_step(a, b, w) for a, b in zip(path, path[1:], strict=False)), Fraction(0))
    return score, sum(x["e"] - x["s"] for x in path), -len(path), tuple(-x["at"] for x in path)


def ordered(spans: list[dict]) -> list[dict]:
    out = sorted(spans, key=lambda x: (x["s"], x["e"], x["source"]))
    return [{**x, "at": i} for i, x in enumerate(out)]


def best_path(spans: list[dict], w: Weights) -> list[dict]:
    """The best path; a state per last span keeps the key of the best path that ends there and the span before it.

    Scores are whole numbers of one common unit, so that sums stay exact; paths are followed back only to settle ties.
    """
    rows = ordered(spans)
    nodes = [_node(x, w) for x in rows]
    unit = math.lcm(*(f.denominator for f in (*nodes, Fraction(w.gap), Fraction(w.fragment), Fraction(w.heading_body))))
    scaled = lambda f: f.numerator * (unit // f.denominator)
    gap, fragment, bonus = (scaled(Fraction(c)) for c in (w.gap, w.fragment, w.heading_body))
    ends, heads = [x["e"] for x in rows], [x["type"] in w.heading_types for x in rows]
    keys: list[tuple[int, int, int]] = []
    before: list[int] = []

    def places(i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(i)
            i = before[i]
        return out[::-1]

    best, last = (0, 0, 0), -1
    for i, x in enumerate(rows):
        s, size, body, own = x["s"], x["e"] - x["s"], x["type"] in w.body_types, scaled(nodes[i])
        key, prior = (own, size, -1), -1
        for j in range(i):
            between = s - ends[j]
            if between < 0:
                continue
            score, covered, fewer = keys[j]
            score += own - gap * between
            if between > w.contiguous:
                score -= fragment
            if body and heads[j]:
                score += bonus
            if score < key[0]:
                continue
            option = (score, covered + size, fewer - 1)
            if option >= key and compatible(rows[j], x) and (option > key or places(j) < (places(prior) if prior >= 0 else [i])):
                key, prior = option, j
        keys.append(key)
        before.append(prior)
        if key > best or (key == best and last >= 0 and places(i) < places(last)):
            best, last = key, i
    return [rows[i] for i in places(last)]


def greedy(spans: list[dict], w: Weights, by_score: bool = True) -> list[dict]:
    """Takes spans that fit, by score or in source order."""
    rows = ordered(spans)
    kept: list[dict] = []
    for x in sorted(rows, key=lambda r: (-_node(r, w), r["at"])) if by_score else rows:
        if _node(x, w) > 0 and all(compatible(a, x) if a["at"] < x["at"] else compatible(x, a) for a in kept):
            kept.append(x)
    return sorted(kept, key=lambda r: r["at"])


def decode(spans: DataFrame, w: Weights) -> DataFrame:
    """Spans (doc_id, source, s, e, block, type, score, ancestors) of each document's best path, numbered by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, found in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = best_path([{**x, "ancestors": set(x["ancestors"] or ())} for x in found.as_py()], w)
                out += ((doc, i, x["source"], x["s"], x["e"]) for i, x in enumerate(path))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(PATH)], schema=PATH)

    whole = [F.col(c).cast("bigint").alias(c) for c in ("s", "e")]
    each = F.struct("source", *whole, "block", "type", "score", "ancestors")
    return spans.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_list(each).alias("spans")).mapInArrow(run, "doc_id bigint, place bigint, source string, s bigint, e bigint")


def brute_force(spans: list[dict], w: Weights) -> list[dict]:
    """All compatible paths; only for tests."""
    rows = ordered(spans)

    def grow(path: list[dict]) -> Iterator[list[dict]]:
        yield path
        for x in rows[path[-1]["at"] + 1 if path else 0 :]:
            if not path or compatible(path[-1], x):
                yield from grow([*path, x])

    return max(grow([]), key=lambda p: path_key(p, w))
