"""Classes of near-equal token sequences: sketches, candidate components, exact comparison in bounded blocks.

1. Equal sequences (128-bit digest) are one class with one representative.
2. Representatives that share a sketch key are compared by signature within the key, in blocks; components of these
   links are the candidates. Keys held by one representative are dropped before anything else is moved.
3. Within each candidate component all representatives are compared exactly, in blocks; components of these links are
   the classes.

A key or component with more members than a chunk is first compared with one of them, its hub: members that link with the
hub are settled, and only the open ones are compared with all others, as two settled ones are of one class already. So a
group of copies of one text costs as many comparisons as it has members, however large it is, and no link is left out.
The open members, and those that they are compared with, are cut into chunks, and each pair of chunks is one block: a block
yields one root per member that it links, never a list of pairs, so the rows that leave a block are at most those that enter it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm._common import IDS_MOST, Scratch, cache_of_task, connected_components, map_arrow, small_or_plain

SHINGLE = 5
SIMILARITY = 0.8
#: A block compares at most about twice so many signatures, or labels (a row counts as ROW_LABELS more).
SIGNATURES, LABELS, ROW_LABELS = 1024, 512_000, 1000
WORDS_KEPT, WORD_KEPT = 120_000, 64

_words: dict[str, int] = {}
cache_of_task(_words.clear)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    """One 64-bit hash per word, through a bounded cache."""
    if len(_words) > WORDS_KEPT:
        _words.clear()
    known, long = _words, []
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(w) > WORD_KEPT:
            long.append(w)
    out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    for w in long:
        del known[w]
    return out


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in text order; of all words together if there are fewer (none: none)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - size + 1 + j]
    return mix64(out)


def labelled(grams: np.ndarray) -> np.ndarray:
    """The grams with their occurrence number mixed in: no two are equal, and the k-th of one text is that of another."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return mix64(grams)
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty_like(grams)
    with np.errstate(over="ignore"):
        out[order] = mix64(s + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def digest(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def longest_increasing(values: np.ndarray) -> int:
    """Length of the longest strictly increasing run of picks."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Banded alignment of two sequences of distinct labels: matches in order, over all labels of both.

    Matches further off the diagonal than the band cannot be part of an alignment of at least ``least``: of lengths n
    and m it has at least least * (n + m) / (1 + least) matches, which leaves n + m minus twice as many to shift by.
    """
    both = len(a) + len(b)
    if not both:
        return 1.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < least * (both - len(ia)):
        return len(ia) / (both - len(ia))
    band = both - 2 * least * both / (1 + least) + 1
    inside = np.abs(ia - ib) <= band
    order = np.argsort(ia[inside])
    m = longest_increasing(ib[inside][order])
    return m / (both - m)


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def lists_of(column: pa.Array) -> list:
    """Values of an Arrow column; lists as arrays without a copy."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]


def _hub_links(big: DataFrame, payload: list[str], kernel: Callable, weight: Column, name: str) -> DataFrame:
    """(grp, id, hub, w, settled) for the rows of large groups (grp, id, hub, *payload)."""
    heads = big.where("id = hub").select("grp", *[F.col(c).alias(f"hub_{c}") for c in payload])
    faced = big.where("id <> hub").join(heads, "grp").select("grp", "id", "hub", weight.cast("bigint").alias("w"), *payload, *[f"hub_{c}" for c in payload])
    k = len(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [lists_of(c) for c in batch.columns]
            rows = list(zip(*cols, strict=True))
            hit = [False] * len(rows)
            at = 0
            while at < len(rows):
                # Rows of one group that stand together are compared with their hub in one call.
                end = at + 1
                while end < len(rows) and rows[end][0] == rows[at][0] and end - at < 256:
                    end += 1
                for y in (y for _, y in kernel([(rows[at][2], *rows[at][4 + k :])], [(r[1], *r[4 : 4 + k]) for r in rows[at:end]], False)):
                    hit[at + y] = True
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hit, pa.bool_())], ["grp", "id", "hub", "w", "settled"])

    return Scratch(map_arrow(faced, run, "grp bigint, id bigint, hub bigint, w bigint, settled boolean"), name).df


def compare_groups(rows: DataFrame, payload: list[str], kernel: Callable[[list, list, bool], Iterator[tuple[int, int]]], weight: Column, chunk: int, name: str) -> DataFrame:
    """Links (a, b) within the groups of ``rows`` (grp bigint, id bigint, *payload; a written table); ids of a group are distinct.

    ``weight`` tells what a row takes in a task's memory; a chunk has rows of about ``chunk`` together.

    kernel(left, right, same) gets two lists of rows (id, *payload) in the order of id, or one list twice, and yields
    numbered links between them; the links of a block are reduced to one root per row. Facing a single row on the left,
    it must yield every link.
    """
    size = Scratch(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), F.min("id").alias("hub")).where("n > 1"), f"{name}-sizes")
    large = size.df.where(F.col("w") > chunk).select("grp", "hub")
    few = rows.join(small_or_plain(size, IDS_MOST).where(F.col("w") <= chunk).select("grp"), "grp", "left_semi")
    few = few.select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("c"), "id", *payload)
    cells, found = few, None
    if not large.isEmpty():
        big = rows.join(small_or_plain(large, IDS_MOST), "grp")
        faced = _hub_links(big, payload, kernel, weight, f"{name}-hub")
        found = faced.where("settled").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        state = faced.select("grp", "id", "settled", "w").unionByName(big.where("id = hub").select("grp", "id", F.lit(True).alias("settled"), weight.cast("bigint").alias("w")))
        state = Scratch(state, f"{name}-state").df
        of = lambda open_: F.ceil(F.sum(F.when(F.col("settled") != open_, F.col("w")).otherwise(0)) / chunk).cast("int")
        chunks = Scratch(state.groupBy("grp").agg(of(True).alias("co"), of(False).alias("cs")).where("co > 0"), f"{name}-open")
        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        still = state.join(small_or_plain(chunks), "grp").select("grp", "id", F.when(F.col("settled"), F.col("co") + part(F.col("cs"))).otherwise(part(F.col("co"))).alias("c"), "settled", "co", "cs")
        # Open chunks come first; each faces all chunks, a chunk of settled members only the open ones.
        still = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("settled"), F.col("co")).otherwise(F.col("co") + F.col("cs")) - 1)))
        still = still.select("grp", "id", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c")
        cells = few.unionByName(still.join(rows, ["grp", "id"]).select("grp", "i", "j", "c", "id", *payload))
    names = ["grp", "i", "j", "c", "id", *payload]
    cells = cells.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id")

    def block(held: list, i: int, j: int) -> list[tuple[int, int]]:
        same = i == j
        left = [r[4:] for r in held if r[3] == i]
        right = left if same else [r[4:] for r in held if r[3] == j]
        both = left if same else left + right
        forest = Forest(len(both))
        shift = 0 if same else len(left)
        for x, y in kernel(left, right, same):
            if x is None:
                continue
            forest.join(x, y + shift)
        first: dict[int, int] = {}
        for k, r in enumerate(both):
            root = forest.find(k)
            first[root] = min(first.get(root, r[0]), r[0])
        return [(r[0], first[forest.find(k)]) for k, r in enumerate(both) if first[forest.find(k)] != r[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(lists_of(batch.column(k)) for k in range(len(names))), strict=True):
                if row[:3] != cell:
                    if len(held) > 1:
                        out += block(held, cell[1], cell[2])
                        if len(out) > 20_000:
                            yield flush()
                    cell, held = row[:3], []
                held.append(row)
        if len(held) > 1:
            out += block(held, cell[1], cell[2])
        if out:
            yield flush()

    links = Scratch(map_arrow(cells, run, "a bigint, b bigint"), name).df
    return links if found is None else links.unionByName(found)


def by_signature(matches_least: int, similarity: float) -> Callable:
    """Kernel for rows (id, n, signature): as many equal places of the signature as asked for, and lengths that allow the similarity."""

    def kernel(left: list, right: list, same: bool) -> Iterator[tuple[int, int]]:
        a, b = np.array([r[2] for r in left]), np.array([r[2] for r in right])
        na, nb = np.array([r[1] for r in left], float), np.array([r[1] for r in right], float)
        if not len(a) or not len(b):
            return
        hit = np.zeros((len(a), len(b)), np.int16)
        for k in range(a.shape[1]):
            hit += a[:, k, None] == b[None, :, k]
        ok = (hit >= matches_least) & (np.minimum(na[:, None], nb[None]) >= similarity * np.maximum(na[:, None], nb[None]) - 1e-9)
        if same:
            ok = np.triu(ok, 1)
        # One link per row to the first partner, and one per column, tie the rest together; the others only where they add.
        forest = Forest(len(a) + (0 if same else len(b)))
        shift = 0 if same else len(a)
        for x, y in zip(*np.nonzero(ok), strict=True):
            if forest.find(int(x)) != forest.find(int(y) + shift):
                forest.join(int(x), int(y) + shift)
                yield int(x), int(y)

    return kernel


def by_labels(similarity: float, close: Callable[[np.ndarray, np.ndarray], bool]) -> Callable:
    """Kernel for rows (id, labels): Jaccard similarity of the label sets by matrix products over tiles of labels, then ``close`` for pairs that pass and are not yet linked."""

    def kernel(left: list, right: list, same: bool) -> Iterator[tuple[int, int]]:
        rows = [r[1].astype(np.int64) for r in (left if same else left + right)]
        if len(rows) < 2:
            return
        if len(left) == 1:
            hub = np.sort(rows[0])
            for y, x in enumerate(rows[1:]):
                shared = int((hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] == x).sum()) if len(hub) else 0
                if shared >= similarity * (len(hub) + len(x) - shared) - 1e-4 and close(rows[0], x):
                    yield 0, y
            return
        n = np.array([len(x) for x in rows], float)
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), n.astype(int))
        order = np.argsort(flat, kind="stable")
        s, o = flat[order], owner[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        number = np.cumsum(new) - 1
        df = np.bincount(number)
        keep = df[number] > 1
        number = (np.cumsum(df > 1) - 1)[number[keep]]
        o = o[keep]
        cut = 0 if same else len(left)
        la = len(left)
        shared = np.zeros((la, len(right)), np.float32)
        tile = 4096
        edges = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + tile, tile))
        for t, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            m = np.zeros((len(rows), tile), np.float32)
            m[o[a:b], number[a:b] - t * tile] = 1
            shared += m[:la] @ m[cut:].T
        nb = n[cut:]
        ok = shared >= similarity * (n[:la, None] + nb[None] - shared) - 1e-4
        if same:
            ok = np.triu(ok, 1)
        forest = Forest(len(rows))
        for x, y in zip(*np.nonzero(ok), strict=True):
            x, y = int(x), int(y)
            if forest.find(x) != forest.find(y + cut) and close(rows[x], rows[y + cut]):
                forest.join(x, y + cut)
                yield x, y

    return kernel


def near_classes(sketches: DataFrame, labels_of: Callable[[DataFrame], DataFrame], close: Callable[[np.ndarray, np.ndarray], bool], matches_least: int, name: str, similarity: float = SIMILARITY) -> DataFrame:
    """(id, cls) for each row of ``sketches`` (id, digest, n, keys, signature; a written table, ids not null and distinct).

    labels_of(ids) gives (id, labels) for a written table of ids. cls is the id of one row of the class.
    """
    copies = Scratch(sketches.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), f"{name}-copies")
    reps = Scratch(sketches.select("id", "digest").join(small_or_plain(copies, IDS_MOST), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep")), f"{name}-reps").df
    spots = sketches.join(small_or_plain(reps.where("id <> rep").select("id"), IDS_MOST), "id", "left_anti").select("id", F.explode(F.array_distinct("keys")).alias("grp"))
    met = spots.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
    shared = Scratch(spots.join(met, "grp", "left_semi"), f"{name}-spots")
    holders = Scratch(shared.df.select("id").distinct(), f"{name}-holders")
    facts = sketches.join(small_or_plain(holders, IDS_MOST), "id", "left_semi").select("id", "n", "signature")
    held = Scratch(shared.df.join(facts, "id"), f"{name}-facts")
    loose = compare_groups(held.df, ["n", "signature"], by_signature(matches_least, similarity), F.lit(1), SIGNATURES, f"{name}-loose")
    candidates = connected_components(loose, f"{name}-cand")
    labels = labels_of(Scratch(candidates.df.select(F.col("node").alias("id")), f"{name}-wanted").df)
    rows = Scratch(candidates.df.select(F.col("node").alias("id"), F.col("component").alias("grp")).join(labels, "id"), f"{name}-labels")
    tight = compare_groups(rows.df, ["labels"], by_labels(similarity, close), F.size("labels") + ROW_LABELS, LABELS, f"{name}-tight")
    classes = connected_components(tight, f"{name}-cls").df.select(F.col("node").alias("rep"), F.col("component").alias("cls"))
    for table in (shared, holders, held, rows):
        table.drop()
    return reps.join(classes, "rep", "left").select("id", F.coalesce("cls", "rep").alias("cls"))


def named_classes(classes: DataFrame, names: DataFrame) -> DataFrame:
    """(id, cls, doc_id, class_id): class_id is the smallest doc_id of each class of ``classes`` (id, cls); ``names`` has (id, doc_id)."""
    own = classes.join(names, "id").select("id", "cls", "doc_id")
    many = Scratch(own.groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "class-names")
    return own.join(small_or_plain(many, IDS_MOST), "cls", "left").select("id", "cls", "doc_id", F.coalesce("first", "doc_id").alias("class_id"))
