"""What the second round found: queries over larger and odder tables than the shared ones."""

import random
import time

import duckdb
import pytest

from brookmill.functions import grams as N
from brookmill.functions import outputs as O
from brookmill.functions import scoring as K
from brookmill.operators import lattice as L
from brookmill.plans import registry


def test_best_path_of_many_spans_in_time():
    w = L.Weights(coverage=0.01, gap=0.001, fragment=0.1, contiguous=8, heading_body=0.2)
    spans = [{"doc_id": 1, "source": f"s{i}", "s": i * 10, "e": i * 10 + 9, "block": f"b{i}", "type": "paragraph", "score": 0.37, "ancestors": set()} for i in range(600)]
    began = time.process_time()
    assert L.best_path(spans, w) == L.ordered(spans)
    assert time.process_time() - began < 10


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Long documents against a reference of half their length, all of few letters, so that most grams recur."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("ab") for _ in range(3)) for _ in range(n))
    items = [words(1500), words(40), words(5)]
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = [items[i % 3][:100] + words(3000) if i < 60 else ["", "abc", None][i % 3] for i in range(63)]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(docs)], "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path), docs, items


def test_grams_as_numbers_equal_loops(monkeypatch):
    rng = random.Random(3)
    placed = lambda g: [(i * 64 // len(g), x) for i, x in enumerate(g)]
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh ", "äöü日本語😀x "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for sizes in ((0, 4, 5, 30, 300), (0, 3, 5, 40, 90)))
        monkeypatch.setattr(N, "STEP", rng.choice([7, 1 << 20]))
        ref = N.Reference(b, most=rng.choice([2**62, 10]))
        (n, at, ids), x, y = ref.find(a), K.grams(a), K.grams(b)
        assert (n, ref.size) == (len(x), len(y))
        assert N.f1(N.bag_hit(ref, [(n, at, ids)]), n, ref.size) == K.multiset_f1(x, y)
        assert N.f1(N.placed_hit(ref, [(n, at, ids)]), n, ref.size) == K.multiset_f1(placed(x), placed(y))
        assert N.f1(N.common_length(ids, ref.order[0]), n, ref.size) == K.ordered_f1(x, y)
        assert N.window_f1(ref, n, at, ids) == K.best_window_f1(x, y)


def test_ordered_scores_normalise_once_and_run_one_python_pass(spark, long_texts):
    path, docs, items = long_texts
    q = registry.queries()["ordered_scores"](spark, path)
    assert q._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in q.where("doc_id > 56").collect():
        a, b = docs[r.doc_id], items[r.doc_id % 3]
        x, y = K.grams(K.normalized(a)), K.grams(K.normalized(b))
        assert (r.lcs_f1, r.window_f1, r.ordered_share) == (K.ordered_f1(x, y), K.best_window_f1(x, y), K.ordered_share(K.tokens(a), K.tokens(b)))


@pytest.fixture(scope="module")
def odd_pairs(spark, tmp_path_factory):
    """Repeated ids with equal and other texts, on both sides; null, short and far-off letters."""
    path = tmp_path_factory.mktemp("odd")
    docs = [(0, "abcdefg abcdefg"), (1, "hello world"), (1, "hello world"), (1, "other hello"), (2, "日本語日本語😀😀"), (3, None), (4, ""), (5, "abcd"), (6, "abcdefgh"), (6, "abcdefgh"), (7, "abcdef"), (None, "lost")]
    items = [(0, "abcdefg"), (1, "hello hello world"), (1, "a hello"), (2, "日本語日本語😀")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "s", "en") for i, t in docs], "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["gram5_dice", "positional_f1"])
def test_gram_scores_shuffle_no_grams_and_follow_their_sql_on_repeated_ids(spark, odd_pairs, long_texts, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd_pairs}/{t}.parquet/*.parquet'")
    q = registry.queries()[name](spark, odd_pairs)
    want = con.execute(f"SELECT {', '.join(q.columns)} FROM ({registry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert sorted(map(tuple, q.collect())) == want and len(want) > 8
    plan = registry.queries()[name](spark, long_texts[0])._jdf.queryExecution().executedPlan().toString()
    assert "Explode" not in plan.split("ArrowEvalPython")[-1] and "hashpartitioning" not in plan


def odd_pages(spark, path):
    html = ["<h1>A title</h1><article><p>first words of a page</p><p>more words of it</p></article>", "<p>no article but words</p> and <b>others</b>", "<article>abc</article>", "", "<p>日本語のテキスト😀</p><article>日本語のテキスト😀</article>"]
    html[3:3] = ["<article><p>" + "the words " * 40 + "</p></article>unrelated words only unrelated words only"]
    rows = [(i, f"https://a.example/{i}", h) for i, h in enumerate(html)] + [(1, "https://a.example/x", html[0]), (0, "https://a.example/y", html[0]), (9, "https://a.example/9", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path)


def by_sql(name, path, *names):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    return con.execute(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]}) ORDER BY ALL").fetchall()


def test_medoid_shuffles_no_grams_and_follows_its_sql_on_odd_pages(spark, tmp_path):
    path = odd_pages(spark, tmp_path)
    q = registry.queries()["text_medoid"](spark, path)
    got = sorted(map(tuple, q.collect()))
    assert got == by_sql("text_medoid", path, *q.columns) and len(got) >= 3
    plan = registry.queries()["text_medoid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Explode" not in plan and "Generate" not in plan and "hashpartitioning" not in plan


def test_example_scores_run_one_python_pass(spark, long_texts):
    path, docs, items = long_texts
    q = registry.queries()["example_scores"](spark, path)
    assert q._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    g = lambda t: K.grams(K.normalized(t))
    for r in q.where("doc_id > 56").collect():
        leaks = [K.best_window_f1(g(docs[r.doc_id]), g(items[(r.doc_id + k) % 3])) for k in (1, 2)]
        assert r.leakage == max(leaks) and r.lie_index == leaks.index(max(leaks))


def test_cache_misses_follow_their_sql_where_pages_share_a_url(spark, tmp_path):
    rows = [(i, f"https://a.example/{i % 4}" if i % 5 else None, "<p>x") for i in range(40)] + [(3, "https://a.example/3", "<p>again"), (3, "https://b.example/3", "<p>moved"), (0, None, "<p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = registry.queries()["cache_misses"](spark, str(tmp_path))
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(map(tuple, q.collect()), key=key) == sorted(by_sql("cache_misses", tmp_path, *q.columns), key=key)


def test_calendar_signatures_follow_their_sql_on_long_page_numbers(spark, tmp_path):
    rows = [(i, "https://a.example/", "<p>") for i in (0, 3, 9, 9999, 10000, 10003, 123456, 20240101, 987654321011)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = registry.queries()["calendar_signatures"](spark, str(tmp_path))
    assert sorted(map(tuple, q.collect()), key=str) == sorted(by_sql("calendar_signatures", tmp_path, *q.columns), key=str)


def test_documentation_titles_follow_their_sql_on_other_entities(spark, tmp_path):
    titles = ["A &quot;quoted&quot; title", "Cut in an entity &amp;&amp", "Twice &amp;amp; and &amp;lt;b&amp;gt;", "Plain &amp; simple", "No entity here", "A number &#38; a name &eacute;"]
    rows = [(i, "https://a.example/", f"<main><article><h1>{t}</h1><p>{'some words of text ' * 5}</p></article></main>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = registry.queries()["documentation_pages"](spark, str(tmp_path))
    assert sorted(map(tuple, q.collect())) == by_sql("documentation_pages", tmp_path, *q.columns)
    assert O.documentation(rows[0][2])["title"] == 'A "quoted" title'
