"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the words of a text and the letter sequences in them (what inflected insults share). Beside the
usual loss it has a term for counterfactuals, the squared difference of the scores (before the sigmoid) of two sentences that
differ only in the group they name. Where a labelled sentence names a group, the other sentence names another one of
its kind. Where it names none, the sentence is a template: it is paired with itself naming one group and another, or one
group and none. So there are pairs for any language and any data, and naming a group neither raises nor lowers a score. The
model carries the mean difference over the pairs with and without the penalty.

Fitting takes a bounded sample: at most POSITIVES_MOST toxic and NEGATIVES_MOST other labelled rows (drawn by a hash of
the id, then weighted back to the true shares of the labels). Features are screened by a distributed count over the
sample, and only the FEATURES_MOST strongest reach the driver, with the sampled rows as lists of these. Scoring covers
every document and its whole text.

Defined cases: null and empty texts have no features and get the model's base score; null labels and ids are not
learned from; a doc_id with several labels counts as toxic if one of them says so; of several texts under a drawn doc_id one
is learned from; repeated documents are scored one by one; without any labelled row of both kinds every score is the share of toxic rows (0.0 without labels); other columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm._common import Scratch, hash32, map_arrow, small_or_plain

POSITIVES_MOST, NEGATIVES_MOST = 3000, 6000
FEATURES_MOST = 2048
SCREEN_LEAST = 4  # labelled rows that must have a feature
GRAMS = (4, 5, 6)
CACHE_MOST = 100_000
WORD_KEPT = 64
WORD = re.compile(r"[^\W_]+")

# Terms that name groups, by kind; a term is swapped only for another one of its kind.
GROUPS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("black", "white", "asian", "african", "european", "american", "latino", "hispanic", "arab", "indian", "mexican"),
    ("blacks", "whites", "asians", "africans", "europeans", "americans", "latinos", "arabs", "indians", "mexicans"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "heterosexual", "homosexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "migrants", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten", "katholiken", "protestanten"),
    ("ausländer", "flüchtlinge", "migranten", "deutsche", "türken", "polen", "franzosen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées", "catholiques", "protestants"),
    ("étrangers", "réfugiés", "migrants", "français", "arabes", "africains", "allemands"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos", "católicos", "protestantes"),
    ("extranjeros", "refugiados", "migrantes", "españoles", "árabes", "africanos", "gitanos"),
)
SWAPS = {t: tuple(x for x in g if x != t) for g in GROUPS for t in g}


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows that labels are not learned from: crc32 of the id as text divides by ``parts``."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == 0, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def grams_of(word: str) -> set[str]:
    """A word's features: itself and the letter sequences in it, with its beginning marked."""
    marked = "^" + word
    return {f"={word}"} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    #: Counterfactual pairs that the fit saw, and the mean difference of their scores without and with the penalty.
    pairs: int = 0
    gap_without: float = 0.0
    gap: float = 0.0
    cache: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict, repr=False)

    def hits(self, word: str) -> tuple[tuple[str, float], ...]:
        got = self.cache.get(word)
        if got is None:
            got = tuple((g, self.weights[g]) for g in grams_of(word) if g in self.weights)
            if len(self.cache) > CACHE_MOST:
                self.cache.clear()
            if len(word) <= WORD_KEPT:
                self.cache[word] = got
        return got

    def score(self, text: str | None) -> float:
        found: dict[str, float] = {}
        hits = self.hits
        for word in words_of(text):
            if h := hits(word):
                found.update(h)
        z = self.base + sum(found[k] for k in sorted(found))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int]]], features: list[str], shares: tuple[int, int], l1: float = 2e-4, fair: float = 20.0, steps: int = 400) -> Model:
    """Proximal gradient descent with momentum on: weighted log-loss + l1 * |w| + fair * mean((w.x - w.x')**2).

    rows: (label, feature numbers); pairs: feature numbers of a sentence and of its counterfactual; shares: labelled
    rows without and with label 1, of which ``rows`` are a sample.
    """
    y = np.array([r[0] for r in rows], float)
    total = sum(shares)
    if not rows or y.min() == y.max():
        p = shares[1] / total if total else 0.0
        return Model({}, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    m = len(features)
    at = np.concatenate([np.array(r[1], np.int64) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    weight = np.where(y == 1, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum())) / total
    # Half the weight to either label: a rare label is learned as well as a common one; the base is set right below.
    balance = np.where(y == 1, total / 2 / max(1, shares[1]), total / 2 / max(1, shares[0])) * weight
    # Only what differs between the two sentences of a pair takes part.
    signed = [(sorted(set(a) - set(b)), sorted(set(b) - set(a))) for a, b in pairs]
    d_at = np.concatenate([np.array(a + b, np.int64) for a, b in signed]) if pairs else np.zeros(0, np.int64)
    d_of = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in signed])
    d_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in signed]) if pairs else np.zeros(0)
    gaps = lambda w: np.bincount(d_of, d_sign * w[d_at], len(pairs))
    per_row = np.bincount(of, minlength=len(rows)) + 1
    smooth = float(min(0.25 * (balance * per_row).sum(), 0.25 * per_row.max()))
    steep = 0.0
    if pairs:
        # The largest eigenvalue of the penalty's matrix, from above by a few steps of the power method.
        x = np.random.default_rng(17).standard_normal(m)
        for _ in range(30):
            x = np.bincount(d_at, d_sign * gaps(x / max(np.linalg.norm(x), 1e-300))[d_of], m) if len(d_at) else np.zeros(m)
        steep = 2.2 * float(np.linalg.norm(x)) / len(pairs)

    def descend(fair: float) -> tuple[np.ndarray, float]:
        w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
        lipschitz = smooth + fair * steep
        for _ in range(steps):
            z = c + np.bincount(of, v[at], len(rows))
            g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(at, g[of], m)
            if pairs and fair:
                grad += 2 * fair / len(pairs) * np.bincount(d_at, d_sign * gaps(v)[d_of], m)
            new = v - grad / lipschitz
            new = np.sign(new) * np.maximum(0, np.abs(new) - l1 / lipschitz)
            new_b = c - g.sum() / lipschitz
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
            w, b, t = new, new_b, t2
        return w, b

    w, b = descend(fair)
    mean_gap = lambda x: float(np.abs(gaps(x)).mean()) if pairs else 0.0
    without = mean_gap(descend(0.0)[0]) if pairs and fair else mean_gap(w)
    return Model({f: float(x) for f, x in zip(features, w, strict=True) if x}, float(b), len(pairs), without, mean_gap(w))


def counterfactuals(found: set[str]) -> Iterator[tuple[set[str], set[str]]]:
    """Pairs of word sets that differ in the group they name, from the words of one labelled sentence or text."""
    named = sorted(found & SWAPS.keys())
    for term in named:
        others = SWAPS[term]
        yield found, found - {term} | {others[len(found) % len(others)]}
    if not named:
        # Which groups a template names follows from its words, so reruns agree.
        pick = zlib.crc32(" ".join(sorted(found)).encode("utf-8", "surrogatepass"))
        group = GROUPS[pick % len(GROUPS)]
        first, second = group[pick // 64 % len(group)], group[(pick // 64 + 1) % len(group)]
        yield found | {first}, found | {second}
        yield found | {first}, found


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the rows of ``labels`` (doc_id, toxic) that are not held out, and their documents' texts."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    shares = (n.get(0, 0), n.get(1, 0))
    if not all(shares):
        return fit([], [], [], shares)
    keep = F.when(F.col("y") == 1, F.lit(POSITIVES_MOST / shares[1])).otherwise(F.lit(NEGATIVES_MOST / shares[0]))
    drawn = known.where(hash32(F.col("doc_id"), seed="toxicity") < keep * F.lit(float(2**32)))
    # The draw is about POSITIVES_MOST + NEGATIVES_MOST rows for any input; it is counted before it is broadcast.
    drawn = small_or_plain(Scratch(drawn, "toxic-drawn"))
    texts = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "y", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(words_of(x.as_py())) for x in b.column(2)], pa.list_(pa.string()))], ["doc_id", "y", "words"])

    bagged = map_arrow(texts, bags, f"doc_id {kind}, y int, words array<string>")
    sample = Scratch(bagged.groupBy("doc_id", "y").agg(F.min("words").alias("words")).select("y", "words"), "toxic-sample")
    by_label = [F.sum(F.when(F.col("y") == v, 1).otherwise(0)).alias(f"n{v}") for v in (0, 1)]
    seen = sample.df.agg(*by_label).first()
    words = sample.df.select("y", F.explode("words").alias("word")).groupBy("word").agg(*by_label)
    marked = F.concat(F.lit("^"), F.col("word"))
    grams = F.flatten(F.array(*[F.when(F.length(marked) >= k, F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i, k=k: F.substr(marked, i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in GRAMS]))
    per_word = words.select("n0", "n1", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), F.col("word"))), grams))).alias("f"))
    a, b = float(seen["n1"] or 0), float(seen["n0"] or 0)
    # Rows with a feature, at most: its words' rows. Good enough to screen; fitting counts presence itself.
    k1, k0 = F.least(F.lit(a), F.col("k1")), F.least(F.lit(b), F.col("k0"))
    share = lambda k, of: (k + F.lit(0.5)) / F.lit(of + 1.0)
    p1, p0, p = share(k1, a), share(k0, b), share(k1 + k0, a + b)
    gain = F.lit(a) * (p1 * F.log(p1 / p) + (1 - p1) * F.log((1.000001 - p1) / (1.000001 - p))) + F.lit(b) * (p0 * F.log(p0 / p) + (1 - p0) * F.log((1.000001 - p0) / (1.000001 - p)))
    screened = per_word.groupBy("f").agg(F.sum("n1").cast("double").alias("k1"), F.sum("n0").cast("double").alias("k0")).where(F.col("k1") + F.col("k0") >= SCREEN_LEAST)
    best = [r["f"] for r in screened.orderBy(F.round(gain, 6).desc(), "f").limit(FEATURES_MOST).collect()]
    features = sorted({*best, *(f"={t}" for t in SWAPS)})
    number = {f: i for i, f in enumerate(features)}

    def ids(found: set[str]) -> list[int]:
        return sorted({number[g] for w in found for g in grams_of(w) if g in number})

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(bag or ())
                own = ids(found)
                rows.append((y, own, None))
                rows += [(y, ids(a), ids(b)) for a, b in counterfactuals(found)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32()))], ["y", "x", "swapped"])

    got = map_arrow(sample.df, lists, "y int, x array<int>, swapped array<int>").collect()
    sample.drop()
    rows = sorted((r["y"], r["x"]) for r in got if r["swapped"] is None)
    pairs = sorted((r["x"], r["swapped"]) for r in got if r["swapped"] is not None)
    return fit(rows, pairs, features, shares)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id and score (0 to 1)."""
    weights, base = model.weights, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, base)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(x.as_py()) for x in b.column(1)], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose text scores below the threshold, with all their columns and unchanged."""
    weights, base = model.weights, model.base
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, base)
        for b in batches:
            yield b.filter(pa.array([m.score(x.as_py()) < threshold for x in b.column(position)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
