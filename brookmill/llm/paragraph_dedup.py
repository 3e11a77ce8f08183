"""Substring deduplication by paragraph MinHash banding.

Two kinds of text units are compared. Paragraphs (lines) of at least LEAST_WORDS words get a MinHash signature of
their five-word shingles, cut into BANDS bands of ROWS: at a similarity of 0.8 a pair meets in at least one band with a
probability of over 0.997. Paragraphs that collide are joined, verified by the exact Jaccard similarity of their
shingle sets, and clustered by components. Passages that are set into a paragraph's midst are found by passage
windows: of WINDOW words each, begun at words picked by their content so that any shared run of LEAST_WORDS words holds
at least one equal window; for these, a single band over the whole window is exact.

A window that stands in more than one document is extended word by word to the ends of the run that its documents share.
Only the windows near the ends of a chain of them need that; a run of LEAST_WORDS words has a window within REACH words
of either end. Of the documents whose chains end there, and the first and last that hold the window, the words beside it are sorted: each
shares most with a neighbour in that order, which tells how far its run goes.

Chains of overlapping windows and runs of fewer than LEAST_WORDS words are not reported: short phrases recur in unrelated texts.
Units that stand in more than one document are repeats. The smallest doc_id of a unit's class keeps it, the others remove
it; only then are a document's removed units merged into spans, without the text of units that it keeps, and its kept
units into others. Of exact runs only the windows themselves are kept against other exact runs: the words around them that a
smaller doc_id holds too are removed, and stand there.

Words are runs of non-white space, compared lower-cased. Whole texts count. The bound for paragraphs is a parameter and may be
as small as one shingle.

Defined cases: null and empty texts have no units; a paragraph of fewer words is compared by windows only, as part of
the document's words; repeats within one document alone are not reported; rows without doc_id are not compared; rows
under one doc_id count as one document, and each of its texts has spans of its own (text_hash tells them apart); an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.llm._common import IDS_MOST, Scratch, map_arrow, small_or_plain
from brookmill.llm._near import SHINGLE, SIMILARITY, digest, mix64, near_classes, shingles, word_hashes

LEAST_WORDS = 50
WINDOW = 36
#: Words by which a shared run of LEAST_WORDS words can go on beyond its first or last window.
REACH = LEAST_WORDS - WINDOW
BANDS, ROWS = 8, 3
#: Of 24 places that many at least must agree; at a similarity of 0.8 fewer do with a chance of under 1e-4.
MATCHES_LEAST = 11
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(33))


#: An odd multiplier and its inverse modulo 2**64, for hashes of all windows from one running sum.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Which of the first code points str.split() takes as white space; there are none beyond.
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each run of WINDOW words, from differences of one polynomial running sum."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)))])
        return mix64((total[WINDOW:] - total[:-WINDOW]) * powers(INVERSE, n))


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the passage windows: those of the smallest hash among LEAST_WORDS - WINDOW + 1 neighbours."""
    grams = window_hashes(words)
    n, reach = len(grams), LEAST_WORDS - WINDOW + 1
    if not n:
        return np.zeros(0, np.int64), grams
    if n <= reach:
        at = np.array([int(np.argmin(grams))])
        return at, grams[at]
    view = np.lib.stride_tricks.sliding_window_view(grams, reach)
    at = np.unique(np.arange(n - reach + 1) + view.argmin(1))
    return at, grams[at]


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (code points) of the words that str.split() gives."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate([[False], ~SPACES[np.minimum(points, len(SPACES) - 1)], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def bands(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (a row per paragraph) and signatures of paragraphs whose shingles stand in ``grams`` from ``starts`` on."""
    # All seeds in one step for ordinary documents, one by one for very long ones.
    parts = np.split(SEEDS, len(SEEDS) if len(grams) > 50_000 else 1)
    low = np.concatenate([np.minimum.reduceat(mix64(grams[None, :] ^ s[:, None]), starts, axis=1) for s in parts])
    key = np.broadcast_to(SEEDS[:BANDS, None], (BANDS, len(starts)))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + low.reshape(BANDS, ROWS, -1)[:, k])
    return np.ascontiguousarray(key.T).view(np.int64), np.ascontiguousarray((low >> np.uint64(33)).T).astype(np.int32)


UNIT_ROWS = "doc_id bigint, text_hash bigint, start bigint, end bigint, at bigint, words bigint, key bigint, digest binary, n int, keys array<bigint>, signature array<int>"


def paragraphs(text: str, begin: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the first word, and of the word after the last, of each line with at least so many words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.searchsorted(np.flatnonzero(points == 10), begin)
    cuts = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(begin)]]) if len(begin) else np.zeros(1, int)
    pairs_ = np.stack([cuts[:-1], cuts[1:]], axis=1)
    return pairs_[pairs_[:, 1] - pairs_[:, 0] >= least]


def _unit_rows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of passage windows (with a key) and of paragraphs (with a digest and a sketch) from one reading of each text."""
    names = ["doc_id", "text_hash", "start", "end", "at", "words", "key", "digest", "n", "keys", "signature"]
    own = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def lists(rows: list[np.ndarray], width: int, kind: pa.DataType) -> pa.Array:
        flat = np.concatenate(rows).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys = [], []
            paras, digests, counts, band_keys, signatures = [], [], [], [], []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                begin, end = word_spans(text)
                hashes = word_hashes(text.lower().split())
                at, windowed = windows(hashes)
                n = len(at)
                if n:
                    found.append(np.stack([np.full(n, doc), np.full(n, text_hash), begin[at], end[at + WINDOW - 1], at, np.full(n, WINDOW)]).astype(np.int64))
                    keys.append(windowed.view(np.int64))
                spots = paragraphs(text, begin, least)
                if not len(spots):
                    continue
                # A paragraph's shingles are those of the whole text that lie in it.
                whole = shingles(hashes)
                parts = [whole[a : b - SHINGLE + 1] for a, b in spots.tolist()]
                k, s = bands(np.concatenate(parts), np.cumsum([0, *(len(x) for x in parts[:-1])]))
                m = len(spots)
                paras.append(np.stack([np.full(m, doc), np.full(m, text_hash), begin[spots[:, 0]], end[spots[:, 1] - 1], spots[:, 0], spots[:, 1] - spots[:, 0]]).astype(np.int64))
                digests += [digest(hashes[a:b]) for a, b in spots.tolist()]
                counts += [len(np.unique(x)) for x in parts]
                band_keys.append(k)
                signatures.append(s)
            if found:
                flat = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, flat), pa.array(np.concatenate(keys)), *(pa.nulls(flat.shape[1], t) for t in own)], names)
            if paras:
                flat = np.concatenate(paras, axis=1)
                sketch = [pa.array(digests, own[0]), pa.array(counts, own[1]), lists(band_keys, BANDS, pa.int64()), lists(signatures, BANDS * ROWS, pa.int32())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, flat), pa.nulls(flat.shape[1], pa.int64()), *sketch], names)

    return run


CONTEXT_ROWS = "doc_id bigint, text_hash bigint, key bigint, left boolean, at bigint, start bigint, end bigint, words array<int>, edges array<int>"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the wanted windows of each document, what stands beside them: up to REACH words outward, and where each ends."""
    names = ["doc_id", "text_hash", "key", "left", "at", "start", "end", "words", "edges"]
    steps = np.arange(REACH)
    for batch in batches:
        offsets = batch.column(3).offsets.to_numpy()
        keys, places, lefts, rights = (f.to_numpy(zero_copy_only=False) for f in batch.column(3).values.flatten())
        plain, words, edges, sizes = [], [], [], []
        for k, (doc, text_hash, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
            text = text.as_py() or ""
            begin, end = word_spans(text)
            # 32 bits of each word's hash tell neighbours apart well enough.
            hashes = (word_hashes(text.lower().split()) >> np.uint64(33)).astype(np.int32)
            own = slice(offsets[k], offsets[k + 1])
            for is_left, wanted, edge in ((True, lefts[own], begin), (False, rights[own], end)):
                at, key = places[own][wanted], keys[own][wanted]
                if not len(at):
                    continue
                beside = at[:, None] - 1 - steps if is_left else at[:, None] + WINDOW + steps
                there = (beside >= 0) & (beside < len(hashes))
                words.append(hashes[beside[there]])
                edges.append(edge[beside[there]].astype(np.int32))
                sizes.append(there.sum(1))
                n = len(at)
                plain.append(np.stack([np.full(n, doc), np.full(n, text_hash), key, np.full(n, is_left), at, begin[at], end[at + WINDOW - 1]]).astype(np.int64))
        if plain:
            flat = np.concatenate(plain, axis=1)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (words, edges)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2]), pa.array(flat[3].astype(bool)), *map(pa.array, flat[4:]), *lists], names)


def of_texts(texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``texts`` joined with ``wanted`` (doc_id, text_hash, ...); where few documents are wanted, the others' texts are not moved."""
    wanted = Scratch(wanted, name).df
    ids = Scratch(wanted.select("doc_id").distinct(), f"{name}-ids").df
    if ids.count() <= IDS_MOST:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts.join(wanted, ["doc_id", "text_hash"])


def extended(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Windows ``hits`` (doc_id, text_hash, key, at, first_doc, last) with the words beside them that other documents share: the columns of units.

    A chain of windows is extended at its ends only, against the other documents whose chains end at the same window and
    the smallest and largest that hold it. The first document of a group gets a row too, with the most that it shares
    with one of the others.
    """
    w = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    # Where another window overlaps this one and reaches REACH words further, the two cover all that this one can gain.
    flags = {"left": F.max("at").over(w.rangeBetween(-WINDOW, -REACH)).isNull(), "right": F.max("at").over(w.rangeBetween(REACH, WINDOW)).isNull()}
    cols = ["doc_id", "text_hash", "key", "at", "left", "right"]
    own = Scratch(hits.withColumns(flags).where("left OR right").select(*cols), "window-ends").df
    wanted = Scratch(own.groupBy("key").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right")), "window-end-keys")
    outer = hits.where("doc_id = first_doc OR doc_id = last").join(small_or_plain(wanted, IDS_MOST), "key").select(*cols)
    by_doc = own.unionByName(outer).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "at", "left", "right")).alias("hits"))
    found = of_texts(texts, by_doc, "window-wanted").select("doc_id", "text_hash", "text", "hits")
    rows = map_arrow(found, _context_rows, CONTEXT_ROWS)
    # Contexts that share nothing need not meet: the first word beside the window deals them out, which splits a window that very many hold.
    rows = rows.where(F.size("words") > 0).withColumn("next", F.get("words", F.lit(0)))
    rows = rows.repartition("key", "left", "next").sortWithinPartitions("key", "left", "words", "doc_id").drop("next")
    return map_arrow(rows, _shared_rows, SHARED_ROWS)


SHARED_ROWS = "doc_id bigint, text_hash bigint, start bigint, end bigint, at bigint, words bigint, first_doc bigint"


def _matrix(column: pa.Array, fill: int) -> np.ndarray:
    """A column of lists as a matrix of REACH columns."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.full((len(column), REACH), fill, np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


#: Contexts of one group that are compared at a time, and rows that wait for the rest of their group.
HELD_MOST, HELD_LEAST = 200_000, 4096


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts in the order of (key, left, words, doc_id): how far each goes on like another document's, and the smallest of these.

    In this order the contexts that begin with the same words stand together: the run goes on as far as they are of more
    than one document. Of a group with more than HELD_MOST contexts so many are compared at a time: then words beside
    a window may stay in several documents, and are lost in none.
    """
    none = np.iinfo(np.int64).min

    def result(flat: np.ndarray, words: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        docs, n = flat[:, 0], len(flat)
        same = (words[1:] == words[:-1]) & (words[1:] != none) & (flat[1:, 2:4] == flat[:-1, 2:4]).all(1)[:, None]
        alike = np.concatenate([[0], np.cumprod(same, axis=1).sum(1)])
        most, first = np.zeros(n, np.int64), docs.copy()
        for length in range(1, REACH + 1):
            begins = alike < length
            at, block = np.flatnonzero(begins), np.cumsum(begins) - 1
            low, high = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
            several = (low != high)[block]
            if not several.any():
                break
            most[several], first[several] = length, low[block][several]
        keep = np.flatnonzero(most > 0)
        f, m = flat[keep], most[keep]
        edge, left = edges[keep, m - 1], f[:, 3] == 1
        cols = [f[:, 0], f[:, 1], np.where(left, edge, f[:, 5]), np.where(left, f[:, 6], edge), np.where(left, f[:, 4] - m, f[:, 4]), m + WINDOW, first[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_hash", "start", "end", "at", "words", "first_doc"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        flat = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1)
        new = [flat, _matrix(batch.column(7), none), _matrix(batch.column(8), 0)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        n = len(held[0])
        if n < HELD_LEAST:
            continue
        group = np.concatenate([held[0][:, 2:4], held[1][:, :1]], axis=1)
        ends = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        cut = int(ends[-1]) if len(ends) else n if n > HELD_MOST else 0
        if cut:
            yield result(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield result(*held)


#: Kinds of units: near-equal paragraphs, windows, and windows extended to the run that is shared.
NEAR, EXACT, RUN = 0, 1, 2


def doc_spans(doc: int, units: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """Disjoint spans (start, end, first_doc, removed) of one document from its units (start, end, first_doc, kind).

    Text of a unit first held here is kept, whatever removed units lie over it. Only a run gives way beyond its windows
    to exact copies of smaller documents, and so does a window inside one such copy: its document holds the window too,
    but picked others there. Pieces that meet leave the white space between them to neither, so removal
    joins no words.
    """
    copied: dict[int, list[list[int]]] = {}
    for start, end, first, kind in sorted(units):
        if first != doc and kind != NEAR:
            own = copied.setdefault(first, [])
            if own and start < own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([start, end])
    events: dict[int, list[tuple[int, int, int]]] = {}
    for start, end, first, kind in units:
        if first == doc and kind == EXACT and any(a <= start and end <= b for own in copied.values() for a, b in own):
            kind = RUN
        events.setdefault(start, []).append((1, first, kind))
        events.setdefault(end, []).append((-1, first, kind))
    active: Counter[tuple[int, int]] = Counter()
    out: list[list] = []
    for at, stop in pairwise(sorted(events)):
        for step, first, kind in events[at]:
            active[first, kind] += step
        active = +active
        if not active:
            continue
        copies = [first for first, kind in active if first != doc and kind != NEAR]
        if (doc, NEAR) in active or (doc, EXACT) in active or ((doc, RUN) in active and not copies):
            first = doc
        else:
            first = min(first for first, _ in active if first != doc)
        removed = first != doc
        if out and out[-1][3] == removed and at <= out[-1][1] + 1:
            out[-1][1], out[-1][2] = stop, min(out[-1][2], first)
            continue
        begin = at
        if out and out[-1][1] == at:
            # A unit that ends here has white space after it, one that begins here has it before.
            if any(step < 0 for step, _, _ in events[at]):
                begin += 1
            else:
                out[-1][1] -= 1
        out.append([begin, stop, first, removed])
    return [(a, b, first, removed) for a, b, first, removed in out if a < b]


def long_enough(units: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, end, first_doc, kind, at, words) without those windows and runs whose chain of overlapping ones has fewer than ``least`` words."""
    near = units[:, 3] == NEAR
    u = units[~near]
    if not len(u):
        return units
    u = u[np.argsort(u[:, 4], kind="stable")]
    reach = np.maximum.accumulate(u[:, 4] + u[:, 5])
    begins = np.concatenate([[True], u[1:, 4] > reach[:-1]])
    chain = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(u)) - 1
    return np.concatenate([units[near], u[(reach[last] - u[first, 4] >= least)[chain]]])


def merged(doc: int, units: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Rows (start, end, first_doc, kind) with those of one other first document that overlap as one: they cover the same text."""
    mine = (units[:, 2] == doc) | (units[:, 3] == NEAR)
    out = list(map(tuple, units[mine].tolist()))
    u = units[~mine]
    u = u[np.lexsort((u[:, 0], u[:, 2]))]
    if len(u):
        reach = np.empty(len(u), np.int64)
        change = np.flatnonzero(u[1:, 2] != u[:-1, 2]) + 1
        for a, b in zip([0, *change], [*change, len(u)], strict=True):
            reach[a:b] = np.maximum.accumulate(u[a:b, 1])
        begins = np.concatenate([[True], (u[1:, 2] != u[:-1, 2]) | (u[1:, 0] >= reach[:-1])])
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(u)) - 1
        out += [(a, b, f, EXACT) for a, b, f in zip(u[at, 0].tolist(), reach[last].tolist(), u[at, 2].tolist(), strict=True)]
    return out


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        rows = []
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        every = np.stack([f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.values.flatten()], axis=1)
        for k, (doc, text_hash) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            units = long_enough(every[offsets[k] : offsets[k + 1]])
            rows += [(doc, text_hash, *span) for span in doc_spans(doc, merged(doc, units[:, :4]))]
        cols = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "text_hash", "start", "end", "first_doc", "removed"])


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = [], []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            hashes = word_hashes((text.as_py() or "").lower().split())
            for w in wanted:
                ids.append(w["id"])
                lists.append(np.unique(shingles(hashes[w["at"] : w["at"] + w["words"]])).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["id", "labels"])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text; the hash is 0 for a doc_id with one text alone, and so takes no room where ids are unique."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id IS NOT NULL")
    several = texts.groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("several"))
    several = Scratch(several, "ids-of-several-texts")
    if several.df.isEmpty():
        return texts.withColumn("text_hash", F.lit(0).cast("bigint"))
    told = texts.join(small_or_plain(several, IDS_MOST), "doc_id", "left")
    return told.select("doc_id", F.when(F.col("several"), F.col("text_hash")).otherwise(0).alias("text_hash"), "text")


def repeated_units(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """Units that stand in more than one document: doc_id, text_hash, start, end (code points), at, words (their place and number
    in words), first_doc (the smallest doc_id of the class) and kind."""
    texts = identified(docs)
    units = map_arrow(texts, _unit_rows(max(SHINGLE, least_words)), UNIT_ROWS)
    units = Scratch(units.withColumn("id", F.monotonically_increasing_id()), "units").df
    place = ["doc_id", "text_hash", "start", "end", "at", "words"]
    # Few of the units are paragraphs; read once, they are a small table of their own.
    paras = Scratch(units.where("digest IS NOT NULL").select("id", *place, "digest", "n", "keys", "signature"), "paragraphs").df

    def labels_of(ids: DataFrame) -> DataFrame:
        spots = paras.select("id", *place).join(ids, "id").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("id", "at", "words")).alias("wanted"))
        return map_arrow(of_texts(texts, spots, "para-wanted").select("text", "wanted"), _label_rows, "id bigint, labels array<bigint>").dropDuplicates(["id"])

    classes = near_classes(paras.select("id", "digest", "n", "keys", "signature"), labels_of, lambda a, b: True, MATCHES_LEAST, "para", similarity)
    placed = Scratch(classes.join(paras.select("id", *place), "id"), "para-classes").df
    shared = placed.groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc <> last").drop("last")
    near = placed.join(small_or_plain(Scratch(shared, "para-shared"), IDS_MOST), "cls").select(*place, "first_doc", F.lit(NEAR).alias("kind"))

    # Read twice: to find keys of more than one document, then their places.
    rows = units.where("key IS NOT NULL").select(*place[:-1], F.lit(WINDOW).cast("bigint").alias("words"), "key")
    twice = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc <> last")
    hits = Scratch(rows.join(small_or_plain(Scratch(twice, "window-keys"), IDS_MOST), "key"), "window-hits").df
    exact = hits.select(*place, "first_doc", F.lit(EXACT).alias("kind"))
    runs = extended(texts, hits.select("doc_id", "text_hash", "key", "at", "first_doc", "last")).withColumn("kind", F.lit(RUN))
    return near.unionByName(exact).unionByName(runs)


def repeated_spans(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per repeated span: doc_id, text_hash, start, end, first_doc, removed. Paragraphs of at least ``least_words`` words are compared.

    A unit is removed where its first_doc is another document. Overlapping or touching removed units are one span, whose
    first_doc is the smallest of theirs; units first held by the document itself are kept whole, in spans of their own.
    """
    units = repeated_units(docs, similarity, least_words).groupBy("doc_id", "text_hash")
    units = units.agg(F.collect_set(F.struct("start", "end", "first_doc", "kind", "at", "words")).alias("units"))
    return map_arrow(units, _span_rows, "doc_id bigint, text_hash bigint, start bigint, end bigint, first_doc bigint, removed boolean")
