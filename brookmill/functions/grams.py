"""Five-character grams of reference texts as numbers, to find them in other texts and to score these: exact, in NumPy passes.

Only grams that the reference has can count for any score, so that a text is left as the places and numbers of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions import scoring as K
from brookmill.functions.scoring import GRAM, WINDOW_RATIOS

PLACES = 64
#: Positions of a text worked on at once, which bounds memory.
STEP = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rank(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values among sorted known ones from 1 on; 0 for others."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[i] == values, i + 1, 0)


class Reference:
    """The bag of grams of some texts. Codes of grams are exact: numbers in the base of the letters, or, where
    those would pass ``most``, ranks of each prefix."""

    def __init__(self, *texts: str, most: int = 2**62) -> None:
        codes = self._learn(texts, most)
        self.known, self.want = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
        self.order = [np.searchsorted(self.known, c) for c in codes]
        self.size = sum(map(len, codes))
        self.bits = max(10, min(22, 8 + len(self.known).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._cell(self.known)] = True
        self.placed = np.unique(np.concatenate([np.zeros(0, np.int64), *(_placed(np.arange(len(o)), o, len(o)) for o in self.order)]), return_counts=True)

    def _learn(self, texts: tuple[str, ...], most: int) -> list[np.ndarray]:
        points = [_points(t) for t in texts]
        there = np.zeros(max((int(p.max()) + 1 for p in points if len(p)), default=0), bool)
        for p in points:
            there[p] = True
        self.base, self.prefixes = int(there.sum()) + 1, []
        self.wide = self.base**GRAM > most
        self.letters = np.zeros(len(there) + 1, np.uint16 if self.base < 1 << 16 else np.int32)
        self.letters[np.flatnonzero(there)] = np.arange(1, self.base)
        return self._codes([self._numbered(p) for p in points], learn=True)

    def _numbered(self, points: np.ndarray) -> np.ndarray:
        return self.letters[np.minimum(points, len(self.letters) - 1)].astype(np.int64)

    def _codes(self, letters: list[np.ndarray], learn: bool = False) -> list[np.ndarray]:
        codes = [x[: max(0, len(x) - GRAM + 1)] for x in letters]
        for j in range(1, GRAM):
            codes = [c * self.base + x[j : j + len(c)] for c, x in zip(codes, letters, strict=True)]
            if self.wide:
                if learn:
                    self.prefixes.append(np.unique(np.concatenate(codes)))
                codes = [_rank(self.prefixes[j - 1], c) for c in codes]
        return codes

    def _cell(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)

    def find(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of the text's grams, and places and numbers of those that the reference has."""
        points = _points(text)
        n, at, ids = max(0, len(points) - GRAM + 1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, n if len(self.known) else 0, STEP):
            c = self._codes([self._numbered(points[start : start + STEP + GRAM - 1])])[0]
            maybe = np.flatnonzero(self.seen[self._cell(c)])
            i = _rank(self.known, c[maybe])
            at.append(maybe[i > 0] + start)
            ids.append(i[i > 0] - 1)
        return n, np.concatenate(at), np.concatenate(ids)


def bags(texts: list[list[str]], most: int = 2**62) -> np.ndarray:
    """Counts of every gram, a row each, in some bags of texts, a column each."""
    n = len(texts)
    codes = Reference.__new__(Reference)._learn(tuple(t for bag in texts for t in bag), most // n)
    owner = [k for k, bag in enumerate(texts) for _ in bag]
    both, count = np.unique(np.concatenate([np.zeros(0, np.int64), *(c * n + k for c, k in zip(codes, owner, strict=True))]), return_counts=True)
    row = np.cumsum(np.diff(both // n, prepend=-1) > 0) - 1
    out = np.zeros((int(row[-1]) + 1 if len(row) else 0, n), np.int64)
    out[row, both % n] = count
    return out


class References:
    """The references of one task, kept while they are few and short."""

    def __init__(self) -> None:
        self.kept: dict[tuple[str, ...], Reference] = {}
        self.size = 0

    def __call__(self, *texts: str) -> Reference:
        if texts not in self.kept:
            if len(self.kept) >= 512 or self.size > 1_000_000:
                self.kept.clear()
                self.size = 0
            self.kept[texts] = Reference(*texts)
            self.size += self.kept[texts].size
        return self.kept[texts]


def _placed(at: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return ids * PLACES + at * PLACES // max(1, n)


def f1(hit: int, n: int, m: int) -> float:
    return 2 * hit / (n + m) if n and m else 0.0


def bag_hit(ref: Reference, found: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    """Common grams, with multiplicity, of the reference and all texts found."""
    ids, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(f[2] for f in found)]), return_counts=True)
    return int(np.minimum(n, ref.want[ids]).sum())


def placed_hit(ref: Reference, found: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    """Common grams that lie in the same of 64 parts of their text."""
    here, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(_placed(at, ids, size) for size, at, ids in found)]), return_counts=True)
    i = _rank(ref.placed[0], here)
    return int(np.minimum(n[i > 0], ref.placed[1][i[i > 0] - 1]).sum())


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer over the longer side."""
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return 0
    where, order = {}, np.argsort(a, kind="stable")
    mark = np.zeros(len(a), bool)
    cuts = np.flatnonzero(np.diff(a[order])) + 1
    for part in np.split(order, cuts):
        mark[part] = True
        where[int(a[part[0]])] = int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little")
        mark[part] = False
    row = whole = (1 << len(a)) - 1
    for y in b.tolist():
        hit = row & where[y]
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def window_f1(ref: Reference, n: int, at: np.ndarray, ids: np.ndarray) -> float:
    """The best multiset F1 of a window of a text of n grams, over six lengths relative to the reference.

    A gram's occurrence counts in the windows that hold it and fewer than the wanted number of earlier ones: a run of starts.
    """
    if not n or not ref.size or not len(at):
        return 0.0
    order = np.argsort(ids, kind="stable")
    at, ids = at[order], ids[order]
    back = np.arange(len(ids)) - ref.want[ids]
    known = np.maximum(back, 0)
    after = np.where((back >= 0) & (ids[known] == ids), at[known] + 1, 0)
    best = 0.0
    for up, down in WINDOW_RATIOS:
        size = min(n, max(1, ref.size * up // down))
        low, high = np.maximum(after, at - size + 1), np.minimum(at, n - size)
        good = low <= high
        low, high = np.sort(low[good]), np.sort(high[good])
        if len(low):
            best = max(best, 2 * int((np.arange(1, len(low) + 1) - np.searchsorted(high, low)).max()) / (size + ref.size))
    return best


def _fields(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


@F.pandas_udf(_fields(T.DoubleType(), "lcs_f1", "window_f1", "ordered_share"))
def ordered_scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of texts against references, both normalised: subsequence F1, best window F1, and the ordered share of tokens."""
    of = References()
    for texts, references in parts:
        rows = []
        for a, b in zip(texts, references, strict=True):
            ref = of(K.normalized(b))
            n, at, ids = ref.find(K.normalized(a))
            rows.append((f1(common_length(ids, ref.order[0]), n, ref.size), window_f1(ref, n, at, ids), K.ordered_share(K.tokens(a), K.tokens(b))))
        yield pd.DataFrame(rows, columns=["lcs_f1", "window_f1", "ordered_share"])


@F.pandas_udf(_fields(T.DoubleType(), "whole", "positional", "ordered", "best_window").add("leaks", T.ArrayType(T.DoubleType())))
def example_parts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of texts against truths, all normalised: F1 of the whole, by place, of the subsequence and of the best window; the latter against lies."""
    of = References()
    for texts, truths, lies in parts:
        rows = []
        for a, b, others in zip(texts, truths, lies, strict=True):
            a, ref = K.normalized(a), of(K.normalized(b))
            n, at, ids = ref.find(a)
            scores = (bag_hit(ref, [(n, at, ids)]), placed_hit(ref, [(n, at, ids)]), common_length(ids, ref.order[0]))
            leaks = [window_f1(lie, *lie.find(a)) for lie in (of(K.normalized(x)) for x in others)]
            rows.append((*(f1(hit, n, ref.size) for hit in scores), window_f1(ref, n, at, ids), leaks))
        yield pd.DataFrame(rows, columns=["whole", "positional", "ordered", "best_window", "leaks"])


def _overlap(hits: Callable[[Reference, list], int]):
    @F.pandas_udf(_fields(T.LongType(), "hit", "nl", "nr"))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        of = References()
        for lefts, rights in parts:
            rows = []
            for left, right in zip(lefts, rights, strict=True):
                ref = of(*(t for t in right if t is not None))
                found = [ref.find(t) for t in left if t is not None]
                rows.append((hits(ref, found), sum(f[0] for f in found), ref.size))
            yield pd.DataFrame(rows, columns=["hit", "nl", "nr"])

    return run


#: Of arrays of texts on both sides, as they stand: common grams, the left's and the right's.
overlap = _overlap(bag_hit)
placed_overlap = _overlap(placed_hit)
