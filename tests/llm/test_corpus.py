"""Mixing, sharding, URL filter, toxicity and the pipeline on small tables."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from brookmill.llm import mixing, sharding, toxicity, url_filter
from brookmill.llm._common import Scratch


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, src string, size int").repartition(3)


def hostile():
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "b", "é", None])) for i in range(300)]
    return [*rows, (300, None, "a"), (301, "", "c"), (302, " \t\n", "c"), (5, rows[5][1], rows[5][2]), (None, "q q", "b"), (303, "v " * 30_000, "d")]


def test_mix_meets_targets_and_follows_the_tree(spark):
    rows = hostile()
    got = mixing.mix(table(spark, rows).drop("src", "size")).collect()
    assert len(got) == len(rows)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + n(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) * 1.5 - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: float(2 * sizes[s]) if s in full else share[s] for s in names}
    taken, longest, blocks, shards = {}, {}, {}, {}
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.size * len(r.draws)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        for d in r.draws:
            blocks.setdefault((r.source, d.block), set()).add(d.shard)
            shards[d.shard] = shards.get(d.shard, 0) + r.size
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in names)
    # A block goes to one shard, and a source's shards follow each other along its blocks.
    assert all(len(x) == 1 for x in blocks.values())
    for s in names:
        line = [min(blocks[s, b]) for b in sorted(b for x, b in blocks if x == s)]
        assert line == sorted(line)
    assert len(shards) == mixing.SHARDS
    again = mixing.mix(table(spark, rows).drop("src", "size").repartition(5)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    out = mixing.mixed_documents(table(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "src", "size"]
    assert sum(n(r.text) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0 and mixing.mixed_documents(table(spark, rows).limit(0)).count() == 0


def tree_by_loop(blocks, shards, seed):
    """Shard of each (source, block), by the same hashes without windows."""
    h = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)

    def deal(tickets, lo, hi, level):
        if hi - lo <= 1:
            return {t: lo for t in tickets}
        mid = lo + (hi - lo) // 2
        ranked = sorted(tickets, key=lambda t: (h(f"{seed}-tree{level}", *t), *t))
        cut = len(tickets) * (mid - lo) // (hi - lo)
        return deal(ranked[:cut], lo, mid, level + 1) | deal(ranked[cut:], mid, hi, level + 1)

    leaf = deal([(s, i) for s, n in blocks.items() for i in range(n)], 0, shards, 0)
    return {(s, b): shard for s, n in blocks.items() for b, shard in enumerate(sorted(v for (x, _), v in leaf.items() if x == s))}


def test_tree_equals_a_loop(spark):
    blocks = {"0a": 50, "0b": 7, "1": 1}
    got = mixing.split_tree(spark.createDataFrame(list(blocks.items()), "src string, blocks int"), 16, "mix").collect()
    assert {(r.src, b): r.shard for r in got for b in range(r.first, r.first + r.n)} == tree_by_loop(blocks, 16, "mix")


def test_shards_hold_the_mixture(spark):
    rows = hostile()
    sized = Scratch(sharding.row_sizes(table(spark, rows)), "t").df
    got = sharding.stratified_shards(sized, 7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["__bm_shard"], []).append(r)
    counts = [len(v) for v in by.values()]
    assert set(by) == set(range(7)) and max(counts) - min(counts) <= 1
    for v in by.values():
        assert sorted(r["__bm_slot"] for r in v) == list(range(len(v)))
    for s in {r.source for r in got}:
        per = [sum(r.source == s for r in v) for v in by.values()]
        assert max(per) - min(per) <= 2
    texts = {(i, (t or "")) for i, t, _ in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts}
    assert sharding.stratified_shards(Scratch(sharding.row_sizes(table(spark, rows).limit(0)), "t").df, 7).count() == 0


def test_urls_and_rules(spark):
    urls = ["http://Sub.Example.ORG/es/x", "http://example.org/en/12", "http://example.org/en/2?q", "https://a.com/fr/1#x", "https://a.com/de/1", "https://b.net/de/1", None, "no scheme", "x://h", "x://h?/es/", "://org/es/", "http://é.ORG/É"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.score_urls(df).collect()}
    want = [("sub.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("a.com", "/fr/1", "com/fr/", "allow"), ("a.com", "/de/1", "com/de/", "block"), ("b.net", "/de/1", None, None), ("", "", None, None), ("", "", None, None), ("h", "", None, None), ("h", "", None, None), ("org", "/es/", "org/", "allow"), ("é.org", "/É", "org/", "allow")]
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[6].score == 0.0
    assert url_filter.score_urls(df.limit(0)).count() == 0


def test_counterfactual_penalty_evens_out_group_terms():
    rng = random.Random(2)
    features = ["=idiot", "=women", "=men", "=fine"]
    rows, pairs = [], []
    for _ in range(400):
        toxic = rng.random() < 0.5
        x = [0 if toxic else 3] if rng.random() < 0.6 else []
        if rng.random() < (0.6 if toxic else 0.1):
            x = sorted({*x, 1})
            pairs.append((x, sorted({*x, 2} - {1})))
        rows.append((int(toxic), x))
    gap = lambda m: abs(m.weights.get("=women", 0) - m.weights.get("=men", 0))
    plain, fair = (toxicity.fit(rows, pairs, features, (200, 200), fair=f) for f in (0.0, 20.0))
    assert gap(plain) > 0.1 and gap(fair) < 0.2 * gap(plain)
    assert fair.score("you idiot") > 0.5 > fair.score("women are fine")


def test_every_sentence_has_counterfactuals():
    pairs = list(toxicity.counterfactuals({"the", "women", "sang"}))
    assert len(pairs) == 1 and pairs[0][0] - pairs[0][1] == {"women"} and pairs[0][1] - pairs[0][0] <= set(toxicity.SWAPS["women"])
    (a, b), (c, d) = toxicity.counterfactuals({"prose", "invented"})
    assert a - b < toxicity.SWAPS.keys() and b - a < set(toxicity.SWAPS[min(a - b)]) and c == a and d == {"prose", "invented"}


def test_penalty_evens_out_letters_that_insults_and_groups_share(spark):
    """Group terms of which letters occur in insults: their mentions score alike only with the penalty."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        w = ["".join(rng.choice("kptbdg") + rng.choice("aiou") for _ in range(3)) for _ in range(30)]
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(["qumusli", "qulesbi"]) + "".join(rng.choice("kptbdg") for _ in range(3))
        docs.append((i, " ".join(w), "s"))
        labels.append((i, int(i % 3 == 0)))
    model = toxicity.train(table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.pairs > 300 and model.gap < 0.6 * model.gap_without
    scores = [model.score(f"{t} sang well") for t in toxicity.SWAPS]
    assert max(scores) - min(scores) < 0.3
    assert sum((model.score(t) >= 0.5) != bool(y) for (_, t, _), (_, y) in zip(docs, labels, strict=True)) <= 60


def labelled(n=240):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("aeioutrsn") for _ in range(5)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(vocab) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(["zzscum", "zzvile"])
        docs.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxic_words_are_learned(spark):
    rows, marks = labelled()
    docs = table(spark, [*rows, (900, None, "a"), (901, "", None)])
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    wrong = [i for i, y in marks if (got[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 6 and got[900] == got[901] < 0.5
    assert toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0))).where("score > 0.5").count() == 0


def test_pipeline_against_loops(spark, tmp_path):
    rows, marks = labelled()
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(100))
    extra = [(1000, base, "s0"), (1001, base + " ", "s1"), (1002, base.replace(base.split()[7], "changed"), "s2"), (1003, None, None)]
    spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in [*rows, *extra]], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(stage(spark, docs, str(tmp_path)), "t").df
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    first = {r.doc_id for r in kept["toxicity"]}
    assert {1000, 1001, 1002, 1003} <= first and len(first - {i for i, y in marks if y}) >= 0.95 * (len(marks) * 0.75 + 4)
    assert {r.doc_id for r in kept["exact_dedup"]} & {1000, 1001} == {1001}
    assert {r.doc_id for r in kept["near_dedup"]} & {1001, 1002} == {1001}
    n = lambda t: len((t or "").split())
    words = sum(n(r.text) for r in kept["near_dedup"])
    assert sum(n(r.text) for r in kept["mixing"]) == pytest.approx(1.5 * words, abs=3 * 60)
    pieces = kept["packing"]
    assert sum(r.length for r in pieces) > 0 and {r.doc_id for r in pieces} == {r.doc_id for r in kept["mixing"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
