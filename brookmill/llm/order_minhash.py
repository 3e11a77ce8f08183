"""Near-deduplication by Order MinHash.

A document's five-word shingles are labelled with their occurrence number. For each of SKETCHES hash functions the
PICKS labelled shingles with the smallest hashes are put back into text order and hashed together: a key that two
documents share the more likely the smaller their edit distance is, as both content and order must agree. Documents
that share a key are candidates if the smallest hashes themselves agree often enough (at a similarity of 0.8 a pair
fails this with a chance of some 3e-6, and shares no key with one of about 2e-5). Candidates are verified by banded
alignment of their labelled shingles: matches in order over all shingles of both must reach 0.8. Documents joined by
such links, directly or through others, are a class.

Words are runs of non-white space, lower-cased. Whole texts count.

Defined cases: null and empty texts, and texts of white space, are equal to each other and to nothing else; a text of
under five words is one shingle; equal texts are one class without further comparison; different texts under one doc_id
are each judged by their own text, and the row that stays of a class is the first of its smallest doc_id's; rows repeated
with doc_id and text are copies, of which one stays; rows without doc_id are left alone (class null, kept); an empty table
gives an empty result; other columns are not looked at, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm._common import IDS_MOST, Scratch, map_arrow, small_or_plain
from brookmill.llm._near import SIMILARITY, aligned_similarity, digest, labelled, mix64, named_classes, near_classes, shingles, word_hashes

SKETCHES, PICKS = 16, 3
MATCHES_LEAST = 5
SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) << np.uint64(40))


def sketch(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and signature of a document's labelled shingles (empty without shingles)."""
    if not len(labels):
        return np.zeros(0, np.int64), np.zeros(SKETCHES, np.int32)
    rows = []
    with np.errstate(over="ignore"):
        # All hash functions at once for ordinary documents, one by one for very long ones.
        for seeds in np.split(SEEDS, SKETCHES if len(labels) > 50_000 else 1):
            h = mix64(labels[None, :] ^ seeds[:, None])
            at = np.argpartition(h, PICKS, axis=1)[:, :PICKS] if h.shape[1] > PICKS else np.broadcast_to(np.arange(h.shape[1]), h.shape)
            key = seeds
            for x in labels[np.sort(at, axis=1)].T:
                key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + x)
            rows.append((key, np.take_along_axis(h, at, axis=1).min(1)))
    keys, signature = (np.concatenate(c) for c in zip(*rows, strict=True))
    return keys.view(np.int64), (signature >> np.uint64(33)).astype(np.int32)


def text_labels(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = word_hashes((text or "").lower().split())
    return words, labelled(shingles(words))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "digest", "n", "keys", "signature"]
    types = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        rows = []
        for text in batch.column(2):
            words, labels = text_labels(text.as_py())
            rows.append((digest(words), len(labels), *sketch(labels)))
        cols = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [text_labels(t.as_py())[1].view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["id", "labels"])


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """(id, cls, doc_id, class_id, text_hash) for every row with a doc_id.

    A text is known by its doc_id and a 64-bit hash, so that it can be read again.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id IS NOT NULL")
    sketches = map_arrow(texts, _sketches, "doc_id bigint, text_hash bigint, digest binary, n int, keys array<bigint>, signature array<int>")
    sketches = Scratch(sketches.withColumn("id", F.monotonically_increasing_id()), "omh-sketches").df
    names = sketches.select("id", "doc_id", "text_hash")

    def labels_of(ids: DataFrame) -> DataFrame:
        wanted = small_or_plain(Scratch(names.join(ids, "id"), "omh-wanted"), IDS_MOST)
        return map_arrow(texts.join(wanted, ["doc_id", "text_hash"]).select("id", "text"), _labels, "id bigint, labels array<bigint>").dropDuplicates(["id"])

    classes = near_classes(sketches, labels_of, lambda a, b: aligned_similarity(a, b, similarity) >= similarity, MATCHES_LEAST, "omh", similarity)
    return Scratch(named_classes(classes, names), "omh-classes").df.join(names.select("id", "text_hash"), "id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), kept (doc_id is class_id)."""
    found = _classes(docs, similarity).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    lost = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(lost)


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay, one per class, with all their columns."""
    all_ = Scratch(_classes(docs, similarity), "omh-all").df
    # Of a class's rows with its smallest doc_id, one text stays.
    heads = all_.where("doc_id = class_id").groupBy("cls").agg(F.min("text_hash").alias("head"), F.max("text_hash").alias("last"))
    twice = Scratch(heads.where("head <> last").drop("last"), "omh-twice")
    gone = all_.join(small_or_plain(twice, IDS_MOST), "cls", "left").where("doc_id <> class_id OR text_hash <> head")
    gone = small_or_plain(Scratch(gone.select(F.col("doc_id").alias("__bm_id"), F.col("text_hash").alias("__bm_hash")).distinct(), "omh-gone"), IDS_MOST)
    same = (F.col("doc_id") == F.col("__bm_id")) & (F.xxhash64("text") == F.col("__bm_hash"))
    out = docs.join(gone, same, "left_anti")
    again = all_.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = Scratch(again.select(F.col("doc_id").alias("__bm_id"), F.col("text_hash").alias("__bm_hash")), "omh-again")
    if again.df.isEmpty():
        return out
    # Rows that repeat a doc_id with its text: any one of them stays.
    again = small_or_plain(again)
    once = out.join(again, same, "left_anti")
    many = out.join(again, same, "left_semi").groupBy(F.col("doc_id").alias("__bm_id"), F.xxhash64("text").alias("__bm_hash"))
    return once.unionByName(many.agg(F.any_value(F.struct(*[F.col(c) for c in docs.columns])).alias("__bm_row")).select("__bm_row.*"))
