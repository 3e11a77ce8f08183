"""Exact, near and substring deduplication and embeddings against plain loops, on small hostile tables."""

import hashlib
import random
from collections import defaultdict
from itertools import count

import numpy as np
import pytest

from pyspark.sql import functions as F

from brookmill.llm import _common, _near, embedding_dedup, exact_dedup, order_minhash, paragraph_dedup

DOCS = "doc_id long, text string, source string, rid string, digest string, __x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "r", "d", 1) for i, t in rows], DOCS).repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_exact_groups(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a\tb\x0b "), (3, "a\tb\x0b "), (4, None), (5, ""), (6, " \n"), (None, "ab"), (7, "a\xa0b"), (8, "x" * 300_000)]
    df = docs(spark, rows)
    got = exact_dedup.copy_groups(df, heavy_share=0.3).collect()
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for key, members in groups.items():
        sha = hashlib.sha256(key.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        best = min(members)
        assert {(r.keep_id, r.group_size) for r in own} == {(None if best[1] else best[2], len(members))}
        assert sum(r.kept for r in own) == 1
    kept = exact_dedup.exact_dedup(df).collect()
    assert len(kept) == len(groups) and kept[0].__fields__ == df.columns
    assert exact_dedup.copy_groups(df.limit(0)).count() == 0 and exact_dedup.exact_dedup(df.limit(0)).count() == 0


def near_rows(rng):
    base = words(rng, 120)
    rows = [(1, base), (2, base.upper()), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, words(rng, 80))]
    for i in range(10, 40):
        w = base.split()
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    half = base.split()
    rows.append((50, " ".join(half[60:] + half[:60])))
    rows.append((51, "again and again " * 40))
    rows.append((52, "again and again " * 41))
    return rows


def classes_by_loop(rows, similarity=0.8):
    labels = {i: order_minhash.text_labels(t)[1] for i, t in rows}
    up = {i: i for i, _ in rows}

    def find(x):
        return x if up[x] == x else find(up[x])

    texts = {i: (t or "").lower().split() for i, t in rows}
    for a in up:
        for b in up:
            if a < b and (texts[a] == texts[b] or (len(labels[a]) and len(labels[b]) and _near.aligned_similarity(labels[a], labels[b], similarity) >= similarity)):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_near_classes_equal_all_pairs(spark):
    rows = near_rows(random.Random(4))
    df = docs(spark, [*rows, (None, "left alone")])
    got = order_minhash.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes_by_loop(rows)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    kept = order_minhash.without_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(classes_by_loop(rows).values())) + 1
    assert order_minhash.near_duplicates(df.limit(0)).count() == 0


def test_alignment_is_an_lcs():
    rng = random.Random(8)
    for _ in range(200):
        a = np.array(rng.sample(range(30), rng.randint(1, 12)), np.uint64)
        b = np.array(rng.sample(range(30), rng.randint(1, 12)), np.uint64)
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        want = t[-1][-1] / (len(a) + len(b) - t[-1][-1])
        got = _near.aligned_similarity(a, b, 0.5)
        assert got == pytest.approx(want) if want >= 0.5 else got < 0.5


def test_labels_count_occurrences():
    g = np.array([5, 7, 5, 5, 7], np.uint64)
    assert len(set(_near.labelled(g).tolist())) == 5
    assert set(_near.labelled(g[:3]).tolist()) < set(_near.labelled(g).tolist())


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    rng = random.Random(11)
    passage = words(rng, 51)
    rows = [(i, words(rng, rng.randint(0, 90)) + " " + passage + " " + words(rng, rng.randint(0, 90))) for i in range(1, 7)]
    rows += [(20, words(rng, 200)), (21, None), (22, ""), (23, "same line\n" * 50), (24, words(rng, 49))]
    para = words(rng, 70)
    edited = para.split()
    edited[30] = "other"
    rows += [(30, words(rng, 60) + "\n" + para), (31, " ".join(edited) + "\n" + words(rng, 60))]
    df = docs(spark, [*rows, (None, passage)])
    got = paragraph_dedup.repeated_spans(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 30, 31}
    assert all(r.removed == (r.doc_id != r.first_doc) for r in got)
    assert {r.first_doc for r in got if r.doc_id < 20} == {1} and {r.first_doc for r in got if r.doc_id >= 30} == {30}
    texts = dict(rows)
    for r in got:
        if r.doc_id < 20:
            assert len(texts[r.doc_id][r.start : r.end].split()) >= paragraph_dedup.WINDOW
    assert paragraph_dedup.repeated_spans(df.limit(0)).count() == 0


def test_windows_guarantee():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**62, 50).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**62, rng.integers(0, 40)).astype(np.uint64), shared, rng.integers(0, 2**62, rng.integers(0, 40)).astype(np.uint64)]) for _ in range(2))
        assert set(paragraph_dedup.windows(a)[1].tolist()) & set(paragraph_dedup.windows(b)[1].tolist())


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 64))
    rows = [(i, (centers[i % 6] + 0.02 * (i % 5) * rng.standard_normal(64)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 64), (302, [float("nan")] + [1.0] * 63), (303, [float("inf")] + [1.0] * 63), (304, []), (305, [None] + [1.0] * 63), (306, rows[1][1][:32]), (200, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, label int, key string").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    good = [(i, np.array(v)) for i, v in rows if i < 300]
    up = {i: i for i, _ in good}

    def find(x):
        return x if up[x] == x else find(up[x])

    links = defaultdict(int)
    for k, (i, a) in enumerate(good):
        for m, (j, b) in enumerate(good):
            if k != m and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[k] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    for k, (i, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k], find(i), i == find(i))
    for i in range(300, 307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_filters_share_at_the_threshold():
    f = embedding_dedup.tuned(50_000, 64)
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((400, 64))
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    shared = [len(np.intersect1d(x, y)) for x, y in zip(f.decode(a), f.decode(b), strict=True)]
    assert np.mean(np.array(shared) > 0) >= 0.99


def without_removed(texts, spans):
    out = {i: list(t or "") for i, t in texts.items()}
    for r in spans:
        if r.removed:
            out[r.doc_id][r.start : r.end] = "\0" * (r.end - r.start)
    return {i: "".join(t).replace("\0", "") for i, t in out.items()}


def test_every_repeated_paragraph_stays_in_its_first_document(spark):
    rng = random.Random(12)
    p, q = words(rng, 55), words(rng, 60)
    texts = {1: words(rng, 20) + "\n" + p, 2: p + "\n" + q, 3: q + "\n" + words(rng, 20)}
    got = paragraph_dedup.repeated_spans(docs(spark, list(texts.items()))).collect()
    left = without_removed(texts, got)
    assert [[x in left[i] for i in texts] for x in (p, q)] == [[True, False, False], [False, True, False]]
    assert all(r.removed == (r.doc_id != r.first_doc) for r in got)


def test_spans_of_units_by_loop():
    rng = random.Random(13)
    for _ in range(300):
        # Words of one letter: they begin at even places and end at odd ones.
        units = [(2 * a, 2 * (a + rng.randint(2, 9)) - 1, rng.choice([1, 2, 5]), paragraph_dedup.NEAR) for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 6)))]
        kept = {i for a, b, first, _ in units if first == 5 for i in range(a, b, 2)}
        gone = {i for a, b, first, _ in units if first != 5 for i in range(a, b, 2)} - kept
        spans = paragraph_dedup.doc_spans(5, units)
        for want, removed in ((kept, False), (gone, True)):
            assert {i for a, b, _, r in spans if r == removed for i in range(a, b) if i % 2 == 0} == want
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)) and all((f != 5) == r for _, _, f, r in spans)


def test_spans_reach_the_ends_of_shared_runs(spark):
    rng = random.Random(14)
    number = count()
    fresh = lambda n: [f"w{next(number)}" for _ in range(n)]
    lists = [fresh(n) for n in (50, 51, 58, 70, 90)]
    texts = {}
    for i in range(1, 25):
        own = lambda: fresh(rng.randint(0, 60))
        w = own()
        for p in rng.sample(lists, 2):
            # Some copies stop short, so that a run's ends differ from document to document.
            w += (p[rng.randint(0, 15) :] if rng.random() < 0.4 else p[: len(p) - rng.randint(0, 15)] if rng.random() < 0.4 else p) + own()
        texts[i] = w
    got = paragraph_dedup.repeated_spans(docs(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()
    seen, gone = ({i: [False] * len(w) for i, w in texts.items()} for _ in range(2))
    for r in got:
        text = " ".join(texts[r.doc_id])
        a, n = len(text[: r.start].split()), len(text[r.start : r.end].split())
        assert text[r.start : r.end] == " ".join(texts[r.doc_id][a : a + n])
        for k in range(a, a + n):
            seen[r.doc_id][k], gone[r.doc_id][k] = True, r.removed
    runs = {i: [False] * len(w) for i, w in texts.items()}
    short = {i: [False] * len(w) for i, w in texts.items()}
    for i, x in texts.items():
        for j, y in texts.items():
            where = {w: k for k, w in enumerate(y)}
            a = 0
            while i != j and a < len(x):
                n = 0
                while a + n < len(x) and where.get(x[a + n], -n - 9) == where.get(x[a], -9) + n:
                    n += 1
                for k in range(a, a + n):
                    runs[i][k] |= n >= paragraph_dedup.LEAST_WORDS
                    short[i][k] |= n >= paragraph_dedup.WINDOW
                a += max(n, 1)
    for i in texts:
        assert all(s or not r for s, r in zip(seen[i], runs[i], strict=True)) and all(r or not s for s, r in zip(seen[i], short[i], strict=True))
    left = {w for i, x in texts.items() for k, w in enumerate(x) if not gone[i][k]}
    assert left == {w for x in texts.values() for w in x}


def test_a_passage_of_51_words_is_reported_whole(spark):
    rng = random.Random(15)
    passage = words(rng, 51)
    texts = {i: words(rng, rng.randint(1, 90)) + " " + passage + " " + words(rng, rng.randint(1, 90)) for i in range(1, 7)}
    got = paragraph_dedup.repeated_spans(docs(spark, list(texts.items()))).collect()
    assert [(r.doc_id, texts[r.doc_id][r.start : r.end], r.first_doc) for r in sorted(got)] == [(i, passage, 1) for i in texts]


def test_groups_of_any_size_lose_no_link(spark):
    """Chains, copies of a hub and strangers in one group that is far larger than a chunk, against all pairs."""
    rng = random.Random(21)
    base = [rng.getrandbits(60) for _ in range(40)]
    rows = [(1, 1, base)]
    for i in range(2, 60):
        own = list(rng.choice([r for _, _, r in rows])) if i % 3 else [rng.getrandbits(60) for _ in range(40)]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(40)] = rng.getrandbits(60)
        rows.append((1, i, own))
    rows += [(2, 100, base), (2, 101, base[:-1]), (3, 102, base)]
    df = _common.Scratch(spark.createDataFrame(rows, "grp long, id long, labels array<long>"), "t").df
    got = _near.compare_groups(df, ["labels"], _near.by_labels(0.8, lambda a, b: True), F.size("labels"), 200, "t")
    links = _near.connected_components(got, "t").df.collect()
    up = {i: i for _, i, _ in rows}

    def find(x):
        return x if up[x] == x else find(up[x])

    for g, i, a in rows:
        for h, j, b in rows:
            shared = len(set(a) & set(b))
            if g == h and i < j and shared >= 0.8 * (len(set(a)) + len(set(b)) - shared):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in links} == {i: find(i) for i in up if sum(find(j) == find(i) for j in up) > 1}
    assert got.count() <= 4 * len(rows)


def test_different_texts_under_one_doc_id(spark):
    rng = random.Random(22)
    a, b = words(rng, 90), words(rng, 70)
    near = " ".join(["other", *a.split()[1:]])
    rows = [(5, a), (5, b), (1, near), (5, a), (7, b), (9, words(rng, 50)), (9, words(rng, 50))]
    kept = order_minhash.without_near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, near), (5, b), *rows[-2:]])
    spans = paragraph_dedup.repeated_spans(docs(spark, [(1, words(rng, 60)), (1, a), (2, near)])).collect()
    assert {(r.doc_id, r.first_doc, r.removed) for r in spans} == {(1, 1, False), (2, 1, True)}


def test_letter_case_and_short_paragraphs(spark):
    rng = random.Random(23)
    passage = words(rng, 55)
    rows = [(i, words(rng, 20) + " " + (passage if i % 2 else passage.upper()) + " " + words(rng, 20)) for i in range(1, 5)]
    got = paragraph_dedup.repeated_spans(docs(spark, rows)).collect()
    assert {(r.doc_id, r.first_doc) for r in got} == {(i, 1) for i in range(1, 5)}
    short = words(rng, 45).split()
    rows = [(1, " ".join(short) + "\n" + words(rng, 9)), (2, words(rng, 7) + "\n" + " ".join(["x", *short[1:]])), (3, words(rng, 45))]
    assert paragraph_dedup.repeated_spans(docs(spark, rows)).count() == 0
    assert {(r.doc_id, r.first_doc) for r in paragraph_dedup.repeated_spans(docs(spark, rows), least_words=5).collect()} == {(1, 1), (2, 1)}


def test_runs_of_under_fifty_words_are_left_alone(spark):
    rng = random.Random(24)
    for n, found in ((49, 0), (50, 2)):
        run = words(rng, n)
        rows = [(i, words(rng, 60) + " " + run + " " + words(rng, 60)) for i in (1, 2)]
        assert paragraph_dedup.repeated_spans(docs(spark, rows)).count() == found


def test_large_filters_lose_no_link(spark, monkeypatch):
    """With small bounds every filter takes the way of the large ones."""
    monkeypatch.setattr(embedding_dedup, "FEW", 2)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 7)
    test_embeddings_equal_all_pairs(spark)
