"""Embedding near-deduplication by spherical-cap filters.

Filters are caps around unit directions with a product structure: after a random rotation the dimensions are cut into
blocks, each with a random code, and a direction is one code word per block. A vector is listed under every direction
whose inner product with it exceeds a bound; these are found by list decoding, which extends partial choices block by
block and drops those that the best remaining words cannot lift over the bound. Vectors that share a filter are
compared exactly, in double precision. The bound and the number of directions follow the number of vectors: about
PER_VECTOR filters a vector (more once filters are rare), and about BACKGROUND vectors a filter by chance.

Identical vectors are compared as one with a multiplicity. Vectors alone in a filter are dropped before any vector is
moved, and so are those that differ from every other one of the filter in more than SIGNS_MOST of 64 random signs: at a
cosine of 0.95 about 6.5 of them differ, and more than SIGNS_MOST with a chance of under 1e-7. Small filters are checked in one
expression, large ones in blocks of signs; the outcome is the same. A filter with many vectors is cut into chunks, and pairs of
chunks are compared as blocks by matrix products: a block gives a number of links and a root per vector, never a list of
pairs. A pair that shares several filters is counted in the first. Components join the roots.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without vec_id,
link with nothing; vectors of different lengths do not link; rows repeated under one vec_id count as vectors of their
own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm._common import Scratch, connected_components, map_arrow
from brookmill.llm._near import lists_of

THRESHOLD = 0.95
#: Many rotations with few directions each even out how a vector's length falls to the blocks.
ROTATIONS = 32
PER_VECTOR = 64.0
BACKGROUND = 1.0
CHUNK = 1024
FEW = 32
SIGNS_MOST = 22
WORDS_MOST = 256


class CapFilters:
    """Random product codes for one dimension; directions are numbered rotation by rotation, then word by word."""

    def __init__(self, dim: int, bound: float, blocks: int, words: int, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, dim])
        self.bound, self.words = bound, words
        blocks = max(1, min(blocks, dim))
        self.edges = [dim * b // blocks for b in range(blocks + 1)]
        self.turns, self.codes = [], []
        for _ in range(ROTATIONS):
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            self.turns.append(q * np.sign(np.diag(r)))
            code = []
            for a, b in zip(self.edges, self.edges[1:], strict=False):
                c = rng.standard_normal((words, b - a))
                code.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
            self.codes.append(code)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of ``unit`` the numbers of all directions with an inner product of at least the bound."""
        owner_all, code_all = [], []
        blocks = len(self.edges) - 1
        for t, (turn, code) in enumerate(zip(self.turns, self.codes, strict=True)):
            x = unit @ turn
            scores = [x[:, a:b] @ c.T for (a, b), c in zip(zip(self.edges, self.edges[1:], strict=False), code, strict=True)]
            best = np.array([s.max(1) for s in scores])
            left = np.vstack([best[::-1].cumsum(0)[::-1][1:], np.zeros(len(unit))]) if blocks > 1 else np.zeros((1, len(unit)))
            owner, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
            for b in range(blocks):
                s = total[:, None] + scores[b][owner]
                i, w = np.nonzero(s >= (self.bound - left[b][owner])[:, None])
                owner, number, total = owner[i], number[i] * self.words + w, s[i, w]
            owner_all.append(owner)
            code_all.append(number + t * self.words**blocks)
        owner, number = np.concatenate(owner_all), np.concatenate(code_all)
        order = np.lexsort((number, owner))
        return np.split(number[order], np.cumsum(np.bincount(owner, minlength=len(unit)))[:-1])


def tuned(count: int, dim: int, seed: int = 12, tries: int = 128) -> CapFilters:
    """Filters for so many vectors: directions so rare that BACKGROUND vectors meet in one by chance, as many of them as
    list each vector under PER_VECTOR, and the bound at which random directions on the sphere get lists of that length."""
    p = min(0.002, BACKGROUND / max(1, count))
    length = PER_VECTOR * max(1.0, -math.log10(p) - 3.7)
    directions = length / ROTATIONS / p
    blocks = max(1, min(dim, math.ceil(math.log(directions) / math.log(WORDS_MOST))))
    words = math.ceil(directions ** (1 / blocks))
    x = np.random.default_rng([seed, dim]).standard_normal((tries, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    low, high = 0.0, 1.0
    guess = -NormalDist().inv_cdf(p) / math.sqrt(dim)
    for _ in range(14):
        got = sum(map(len, CapFilters(dim, guess, blocks, words).decode(x))) / tries
        low, high = (guess, high) if got > length else (low, guess)
        # Short steps from above: far too low a bound would list nearly every direction.
        guess = max((low + high) / 2, guess - 0.03) if low else max(0.0, guess - 0.03)
    return CapFilters(dim, (low or guess), blocks, words)


def _usable(v: "F.Column") -> "F.Column":
    zero = F.lit(0.0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != zero)


def _block(a: dict, b: dict, same: bool, number: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two chunks of a filter: for the rows of a and b the linked multiplicity first met in this filter, and their roots."""
    hit = (a["x"] @ b["x"].T) / np.outer(a["n"], b["n"]) >= threshold
    if same:
        np.fill_diagonal(hit, False)
    used = np.unique(np.concatenate([*(f[f < number] for f in a["f"]), *(f[f < number] for f in b["f"])])) if hit.any() else np.zeros(0, np.int64)
    first = hit
    if used.size:
        def marks(part: dict) -> np.ndarray:
            m = np.zeros((len(part["f"]), used.size), np.float32)
            for i, f in enumerate(part["f"]):
                m[i, np.searchsorted(used, f[f < number])] = 1
            return m

        ma = marks(a)
        first = hit & ~((ma @ (ma if same else marks(b)).T) > 0)
    la, lb = first @ b["m"], np.zeros(len(b["m"])) if same else a["m"] @ first
    ra, rb = a["id"].copy(), (a["id"] if same else b["id"]).copy()
    big = np.iinfo(np.int64).max
    while True:
        to_b = np.where(hit, ra[:, None], big).min(0, initial=big)
        nb = np.minimum(rb, to_b)
        na = np.minimum(ra, np.where(hit, nb[None, :], big).min(1, initial=big))
        if same:
            nb = na
        if (na == ra).all() and (nb == rb).all():
            return la, lb, ra, rb
        ra, rb = na, nb


def _cells(spots: DataFrame) -> DataFrame:
    """``spots`` (rep, chunks, ...) once for each pair (i, j) of chunks that the row's own chunk c is part of."""
    t = spots.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return t.withColumns({"i": F.least("c", "other"), "j": F.greatest("c", "other")}).drop("other")


def _with_near_signs(spots: DataFrame) -> DataFrame:
    """Of the rows (rep, dim, filter, chunks, signs) of large filters those with another one of nearly the same signs."""
    names = ["rep", "dim", "filter", "chunks", "signs", "c", "i", "j"]
    rows = _cells(spots).select(*names).repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(held: list[np.ndarray]) -> pa.RecordBatch:
            t = np.concatenate(held, axis=1)
            i, j = t[6][0], t[7][0]
            a, b = np.flatnonzero(t[5] == i), np.flatnonzero(t[5] == j)
            x, y = t[4][a].view(np.uint64), t[4][b].view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= SIGNS_MOST
            if i == j:
                np.fill_diagonal(near, False)
            sure = np.unique(np.concatenate([a[near.any(1)], b[near.any(0)]]))
            return pa.RecordBatch.from_arrays([pa.array(t[0][sure]), pa.array(t[1][sure], pa.int32()), pa.array(t[2][sure]), pa.array(t[3][sure], pa.int32())], names[:4])

        held: list[np.ndarray] = []
        for batch in batches:
            t = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(names))])
            cell = t[[1, 2, 6, 7]]
            edges = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1, [t.shape[1]]])
            for a, b in zip(edges, edges[1:], strict=False):
                part = t[:, a:b]
                if held and (held[-1][[1, 2, 6, 7], 0] != part[[1, 2, 6, 7], 0]).any():
                    yield result(held)
                    held = []
                held.append(part)
        if held:
            yield result(held)

    return map_arrow(rows, run, "rep bigint, dim int, filter bigint, chunks int").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least ``threshold``), component_id, kept."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    v = v.withColumn("ok", F.col("vec_id").isNotNull() & _usable(F.col("v")))
    key = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)
    keyed = v.select("vec_id", F.when(F.col("ok"), key).alias("key"), F.when(F.col("ok"), F.col("v")).alias("v"))
    keyed = Scratch(keyed, "vectors").df
    reps = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("v").alias("v"))
    reps = Scratch(reps, "vector-reps").df
    shape = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    count = shape["n"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CapFilters] = {}
        for batch in batches:
            reps_, vs = np.array(batch.column(0).to_pylist(), np.int64), lists_of(batch.column(1))
            for at in range(0, len(vs), 256):
                part = vs[at : at + 256]
                for dim in sorted({len(x) for x in part}):
                    rows = [i for i, x in enumerate(part) if len(x) == dim]
                    x = np.array([part[i] for i in rows], float)
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if dim not in made:
                        made[dim] = tuned(count, dim)
                    lists = made[dim].decode(x)
                    plane = np.random.default_rng([13, dim]).standard_normal((dim, 64))
                    signs = np.packbits(x @ plane > 0, axis=1).view(np.int64)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(reps_[at : at + 256][rows]), pa.array([dim] * len(rows), pa.int32()), pa.array(signs), pa.array(lists, pa.list_(pa.int64()))], ["rep", "dim", "signs", "filters"])

    lists = Scratch(map_arrow(reps.select("rep", "v"), listed, "rep bigint, dim int, signs bigint, filters array<bigint>"), "vector-filters").df
    spots = lists.select("rep", "dim", "signs", F.explode("filters").alias("filter"))
    met = spots.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = Scratch(met.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "vector-met").df
    shared = spots.join(met, ["dim", "filter"])
    near = lambda x, y: (x["rep"] != y["rep"]) & (F.bit_count(x["signs"].bitwiseXOR(y["signs"])) <= SIGNS_MOST)
    few = shared.where(F.col("n") <= FEW).groupBy("dim", "filter", "chunks").agg(F.collect_list(F.struct("rep", "signs")).alias("all"))
    few = few.select("dim", "filter", "chunks", F.explode(F.filter("all", lambda x: F.exists("all", lambda y: near(x, y)))).alias("x"))
    many = _with_near_signs(shared.where(F.col("n") > FEW).select("rep", "dim", "filter", "chunks", "signs"))
    shared = few.select("x.rep", "dim", "filter", "chunks").unionByName(many)
    shared = Scratch(shared, "vector-shared").df
    # The filters that a vector shares with another one; of these the first two have in common counts their link.
    own = shared.groupBy("rep").agg(F.sort_array(F.collect_list("filter")).alias("fs"))
    full = Scratch(reps.select("rep", "m", "v").join(own, "rep"), "vector-full").df
    # Chunks anew, as few of a large filter's vectors may be left.
    left = shared.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = left.select("dim", "filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    cells = _cells(shared.drop("chunks").join(left, ["dim", "filter"])).select("rep", "dim", "filter", "c", "i", "j")
    rows = cells.join(full, "rep").repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "dim", "filter", "c", "i", "j", "m", "v", "fs"]

        def result(cell: tuple, held: list) -> pa.RecordBatch | None:
            _, number, i, j = cell
            parts = []
            for c in dict.fromkeys((i, j)):
                own = [h for h in held if h[3] == c]
                x = np.array([h[7] for h in own], float).reshape(len(own), cell[0])
                x = x / np.abs(x).max(1, keepdims=True) if len(own) else x
                parts.append({"id": np.array([h[0] for h in own], np.int64), "x": x, "n": np.linalg.norm(x, axis=1), "m": np.array([h[6] for h in own], float), "f": [h[8] for h in own]})
            a, b = parts[0], parts[-1]
            la, lb, ra, rb = _block(a, b, i == j, number, threshold)
            ids, links, roots = (a["id"], la, ra) if i == j else (np.r_[a["id"], b["id"]], np.r_[la, lb], np.r_[ra, rb])
            sure = (links > 0) | (roots != ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[sure]), pa.array(links[sure].astype(np.int64)), pa.array(roots[sure])], ["rep", "links", "root"])

        cell, held = None, []
        for batch in batches:
            for row in zip(*(lists_of(batch.column(batch.schema.get_field_index(n))) for n in names), strict=True):
                now = (row[1], row[2], row[4], row[5])
                if now != cell:
                    if len(held) > 1:
                        yield result(cell, held)
                    cell, held = now, []
                held.append(row)
        if len(held) > 1:
            yield result(cell, held)

    found = Scratch(map_arrow(rows, compared, "rep bigint, links bigint, root bigint"), "vector-links").df
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-cc").df.withColumnRenamed("node", "rep")
    facts = reps.select("key", "rep", "m").join(links, "rep", "left").join(parts, "rep", "left")
    facts = facts.select("key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "key").join(facts, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
