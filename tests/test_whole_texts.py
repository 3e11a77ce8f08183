"""Scores of texts beyond 4000 characters, against plain loops."""

import random
from collections import Counter

import pytest

from brookmill.functions import scoring as K
from brookmill.plans import registry


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(4)) for _ in range(n))
    items = [words(300), words(1500)]
    docs = [words(1000) + " " + items[0], words(1200) + " " + items[1], "abc", ""]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(docs)], "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path), {i: (t, items[i % 2]) for i, t in enumerate(docs)}


def placed(text):
    g = K.grams(text)
    return [(i * 64 // len(g), x) for i, x in enumerate(g)]


@pytest.mark.parametrize("name,score,items", [("gram5_dice", "dice", K.grams), ("positional_f1", "f1", placed)])
def test_grams_of_whole_texts(spark, small, name, score, items):
    path, texts = small
    got = {r.doc_id: r for r in registry.queries()[name](spark, path).collect()}
    assert set(got) == set(texts)
    for i, (a, b) in texts.items():
        x, y = items(a), items(b)
        assert got[i].overlap_grams == sum((Counter(x) & Counter(y)).values())
        assert got[i][score] == pytest.approx(K.multiset_f1(x, y))


def test_ordered_scores_of_whole_texts(spark, small):
    path, texts = small
    got = {r.doc_id: r for r in registry.queries()["ordered_scores"](spark, path).collect()}
    for i, (a, b) in texts.items():
        x, y = K.grams(K.normalized(a)), K.grams(K.normalized(b))
        assert (got[i].lcs_f1, got[i].window_f1, got[i].ordered_share) == (K.ordered_f1(x, y), K.best_window_f1(x, y), K.ordered_share(K.tokens(a), K.tokens(b)))
    assert got[0].window_f1 > 0.99
