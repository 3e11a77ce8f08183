"""Post-processing, documentation, papers, changes, bodies and scores against plain expectations."""

import gzip
import hmac
import json
import math
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from brookmill.functions import bodies as B
from brookmill.functions import dom
from brookmill.functions import ir2 as R
from brookmill.functions import outputs as O
from brookmill.functions import papers as A
from brookmill.functions import scoring as K
from brookmill.operators import specialists as Sp
from brookmill.operators import studies as U
from brookmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_decoding_order():
    assert B.decoded("é".encode("utf-16"), "text/html; charset=utf-8") == "é"
    assert B.decoded("é€".encode("cp1252"), "text/html; charset=ISO-8859-1") == "é€"
    assert B.decoded('<meta charset="koi8-r">Ж'.encode("koi8-r"), None).endswith("Ж")
    assert B.decoded(b"\xff\x81", "text/html; charset=base64") == "ÿ\x81" and B.decoded(None, "x") is None and B.decoded(b"", None) == ""


def test_inflation_is_bounded():
    body = gzip.compress(b"x" * 1000)
    assert B.inflated(body, 1000) == b"x" * 1000
    assert B.inflated(body, 999) is B.inflated(body[:-9], 5000) is B.inflated(b"\x1f\x8bjunk", 10) is None
    assert B.inflated(b"plain", 5) == b"plain" and B.inflated(b"plain", 4) is None


@pytest.mark.parametrize("url,want", [("http://127.0.0.1/", "address"), ("http://[::1]/", "address"), ("http://[::ffff:8.8.8.8]/", None), ("http://224.0.0.1/", "address"), ("//x", "scheme"), ("https:///x", "host"), ("http://x.example/" + "a" * 5000, "length"), ("http://[bad/", "malformed"), ("http://localhost/", "address"), ("http://x.example/", None)])
def test_addresses(url, want):
    assert B.address_error(url) == want


def test_strict_and_closed_json():
    assert B.strict_object('{"a": [1, {"b": 2}]}') == {"a": [1, {"b": 2}]}
    assert [B.strict_object(t) for t in ('{"a":1,"a":2}', '{"a":{"b":1,"b":1}}', '{"a":NaN}', "[1]", "", None)] == [None] * 6
    assert B.canonical('{"b":1, "a":"é"}') == '{"a":"é","b":1}'
    closed = B.closed_schema({"type": "object", "properties": {"x": {"type": "array", "items": {"properties": {}}}}})
    assert closed["additionalProperties"] is closed["properties"]["x"]["items"]["additionalProperties"] is False
    assert B.embedded_object('var m = {"a": {"b": 1}}; x', "var m") == {"a": {"b": 1}} and B.embedded_object("x", "m") == B.embedded_object("m {", "m") == {}


def test_keyed_digest_is_hmac(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(B.hmac_sha256(b"k", F.lit("é")).alias("x")).first()[0]
    assert got == hmac.new(b"k", "é".encode(), "sha256").hexdigest()


def test_links_tables_and_documentation():
    assert O.mended_links("[https://a. b](u) [c d](v)") == "[https://a.b](u) [c d](v)"
    html = "<table class=navbox><tr><th>n<td>n<tr><td>1<td>2</table><table><tr><th>a<th>b<tr><td>1<td>2</table><table><tr><td>p<td>q<tr><td>1<td>2</table>"
    assert O.with_tables("t", html * 2).count("| --- | --- |") == 1 and O.with_tables("| a |\n| --- |\n", html) == "| a |\n| --- |\n"
    page = '<div class="wy-nav-side">menu</div><div role="main"><h1>A title<a class="headerlink">#</a></h1><p>' + "word " * 9 + "</p></div><p>outside</p>"
    found = O.documentation(page)
    assert found["title"] == "A title" and "menu" not in found["text"] and "outside" not in found["text"] and O.documentation("<p>few") is None


def test_scrubbing_keeps_what_is_shown():
    html = '<p data-anno-uid="1" style="color:red;user-select:none;" class=x><marked-text>a</marked-text></p><script>"<marked-text>"</script><!-- <marked-text> -->'
    out, n = O.scrubbed(html)
    assert out == '<p style="color:red;" class=x>a</p><script>"<marked-text>"</script><!-- <marked-text> -->'
    assert (n["wrapper_tags"], n["attributes"], n["style_declarations"], n["characters_removed"]) == (2, 1, 1, len(html) - len(out))


PAPER = """A Study of Things
A B, C D, E F
Abstract
We study things here.
1. Introduction
Text one (Smith 2001).
2.1 Methods
Text two.
Results show much.
3 Results
Text three.
References
[1] A. 1999. 10.1000/x [PubMed] [Google Scholar]
Article
Appendix A
More text."""


def test_paper_parts():
    got = A.sections(PAPER, title="A Study of Things", abstract="We study things here.", authors=["A B, C D, E F"])
    assert [(s["heading"], s["level"]) for s in got] == [("1. Introduction", 1), ("2.1 Methods", 2), ("3 Results", 1), ("Appendix A", 1)]
    assert got[1]["content"] == "Text two.\nResults show much.\n"
    assert A.references(PAPER) == "[1] A. 1999. 10.1000/x" and A.references("none") == ""
    assert A.references("References\n" + "\n".join(f"Item {i} 2001." for i in range(3000))).endswith(A.CUT)
    assert A.plain_title(PAPER) == "A Study of Things" and A.plain_authors(PAPER) == ["A B", "C D", "E F"] and A.plain_abstract(PAPER) == "We study things here."
    assert A.structured_abstract("BackgroundWe did.ResultsMuch") == "Background: We did. Results: Much"
    md = A.paper_markdown({"title": "T", "authors": ["A"], "doi": "10.1/(x)", "abstract": "a", "sections": got, "references": "r"})
    assert md.startswith("# T\n\n**Authors**: A\n\n**Identifiers**: DOI: [10.1/(x)](https://doi.org/10.1/%28x%29)\n") and "### 2.1 Methods" in md and md.endswith("## References\n\nr\n")
    for line, want in (("Results show much.", False), ("Related work", True), ("12 Monkeys and things", True), ("99 monkeys", False), ("Methods: a, b", False), ("Appendix", True)):
        assert A.is_heading(line) == want
    root = dom.parse('<div class="abstract">Abstract: ' + "x" * 50 + '</div><a rel="license" href="/l">l</a>')
    assert A.page_abstract(root) == "x" * 50 and A.license_url(root, "https://a.example/p") == "https://a.example/l"


def test_change_release_and_raw():
    html = '<main><h1>Fix</h1><p>2 files changed</p><table aria-label="Diff for: a.py"><tbody><tr><td>1<td>+x = 1<tr><td class="diff-hunk-cell"> @@ 1 @@ </table></main>'
    (got,) = Sp.change_page(html, compare=False)
    assert got["strategy"] == "github-commit" and "```diff\n+x = 1\n@@ 1 @@\n```" in got["text"] and "- 2 files changed" in got["text"]
    (got,) = Sp.change_page("<main><h1>C</h1>3 files changed", compare=True)
    assert (got["strategy"], got["reasons"]) == ("github-compare-partial", "github_change_diff_unavailable")
    assert not list(Sp.change_page("<h1>only a title</h1>", compare=False))
    (got,) = Sp.release_page('<h1>v1</h1><div class="release-body"><div class="markdown-body"><p>Notes</p></div></div><div class="markdown-body"><p>notes</p></div>')
    assert (got["title"], got["n_items"]) == ("v1", 1)
    blob = "https://github.com/o/r/blob/a/b/f.py"
    assert Sp.raw_url('<a id="raw-url" href="https://github.com/o/r/raw/a/b/f.py">', blob) == "https://github.com/o/r/raw/a/b/f.py"
    for href in ("https://evil.example/o/r/raw/a/f.py", "http://github.com/o/r/raw/a/f.py", "https://github.com/o/other/raw/a/f.py", "https://github.com/o/r/blob/a/f.py", "https://u@github.com/o/r/raw/a/f.py"):
        assert Sp.raw_url(f'<a id="raw-url" href="{href}">', blob) is None


HTML = '<html lang="en"><head><title>t</title></head><body><!-- c --><h1>A &amp; B</h1><p>one <b>two</b> <a href="/x">three</a></p><table><tr><th>h<td rowspan=2>1<tr><td>2</table><ul><li>i<li hidden>no</ul><pre class="language-py">x = 1</pre><math display="block"><annotation encoding="application/x-tex">x^2</annotation></math><script type="math/tex">y</script><script>var z</script></body></html>'


def test_graph_order_structures_and_selection():
    g = R.graph(HTML)
    every = sorted((*g.elements, *g.runs), key=lambda x: x["ord"])
    assert [x["ord"] for x in every] == list(range(len(every))) and len({x["id"] for x in every}) == len(every)
    tags = [e["tag"] for e in g.elements]
    assert "head" not in tags and tags.count("script") == 1 and tags.count("li") == 1
    kinds = Counter(a["kind"] for a in R.atoms(g))
    assert kinds["table_cell"] == 3 and kinds["list_item"] == 1 and kinds["code"] == 1 and kinds["math"] == 2
    assert [(m["format"], m["display"], m["tex"]) for m in R.maths(g)] == [("mathml", "block", "x^2"), ("tex", "inline", "y")]
    text, missing = R.serialized(g)
    assert missing == [] and text.startswith("# A & B\n\none **two** [three](/x)\n\n<table>") and 'data-row="1" data-column="0"' in text and "```py\nx = 1\n```" in text and "$$\nx^2\n$$" in text
    run = next(r["id"] for r in g.runs if r["text"] == "two")
    assert R.serialized(g, [run, "node-x"]) == ("**two**", ["node-x"])
    h1 = next(e["id"] for e in g.elements if e["tag"] == "h1")
    assert R.serialized(g, [h1])[0] == "# A & B"
    made = R.certificate(HTML, [h1])
    assert R.replayed(HTML, made) == "# A & B" and R.replayed(HTML + " ", made) is R.replayed(HTML, made.replace(h1, run)) is R.replayed(HTML, "x") is R.certificate(HTML, ["node-x"]) is None


def test_source_spans():
    g = R.graph(HTML)
    assert [t for t, _, _ in R.source_elements('<a title="<b>"><script>"<i>"</script><!-- <u> --><P>')] == ["a", "script", "p"]
    spans = R.mapped_elements(HTML, g)
    assert all(HTML[a:b].lower().startswith("<" + e["tag"]) for e in g.elements if e["id"] in spans for a, b in [spans[e["id"]]])
    found = R.source_text_map("<p>a &amp; b</p><p>c<!-- x -->d</p>", R.graph("<p>a &amp; b</p><p>c<!-- x -->d</p>"))
    assert found is not None and len(found) == 2


@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
def test_alignment_is_a_longest_common_subsequence(a, b):
    got = U.alignment(a, b)
    assert len(got) == K.lcs_length(a, b) and all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    n = 0
    for t in b:
        n += n < len(a) and a[n] == t
    assert K.subsequence_length(a, b) == n


def test_structure_scores():
    t = "# A\n- x\n1. y\n```\ncode\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    assert U.markdown_structure(t) == {"headings": ["1:A"], "items": ["x", "y"], "code": ["code"], "tables": [[["a", "b"], ["1", "2"]]]}
    assert set(U.structure_score(t, t).values()) == {1.0} and U.structure_score(t, "plain")["structure_score"] is None
    assert U.structure_score("# A", t)["heading_f1"] == 1.0 and U.structure_score("# A", t)["list_f1"] == 0.0


def test_bootstrap_is_antisymmetric_and_covers():
    rng = random.Random(1)
    rows = [(lang, f"{lang}{c}", str(u), rng.random(), rng.random() * 0.8) for lang in "ab" for c in range(6) for u in range(5)]
    one = U.clustered_bootstrap(rows, 100, b"s")
    other = U.clustered_bootstrap([(a, b, c, y, x) for a, b, c, x, y in rows], 100, b"s")
    assert one == pytest.approx([-x for x in other])
    by = {}
    for a, b, _, x, y in rows:
        by.setdefault(a, {}).setdefault(b, []).append(x - y)
    want = sum(sum(sum(v) / len(v) for v in c.values()) / len(c) for c in by.values()) / len(by)
    assert sum(one) / len(one) == pytest.approx(want, abs=0.05) and U.clustered_bootstrap(rows[::-1], 100, b"s") == one


def visible(spark):
    from pyspark.sql import functions as F

    from brookmill.functions import page as G
    from brookmill.plans.gates import article, first_paragraph

    p = spark.read.parquet(f"{SF}/pages.parquet")
    return {r.page_id: r for r in p.select("page_id", G.quality_tokens(article()).alias("a"), G.quality_tokens(G.visible_text(F.col("html"))).alias("b"), G.count_words(first_paragraph()).alias("n")).collect()}


def test_subsequences_and_gates_by_loop(spark):
    rows = visible(spark)
    for r in registry.queries()["subsequences"](spark, SF).collect():
        x = rows[r.page_id]
        assert (r.n_in_order, r.n_aligned, r.n_tokens) == (K.subsequence_length(x.a, x.b), len(U.alignment(x.a, x.b)), len(x.a))
    got = {r.page_id: r.rejected for r in registry.queries()["quality_gates"](spark, SF).collect()}
    for i, x in rows.items():
        least = max(8, x.n // 2) if x.n >= 80 else 8
        if i % 25 not in (0, 5, 10, 15, 20) and len(x.a) > 1.5 * least:
            assert got[i] is None
        if i % 25 == 0 and len(x.a) > 1.5 * least:
            assert got[i] == "unsafe_structure"
        if i % 25 == 5 and len(x.a) > 1.5 * least:
            assert got[i] == "unbalanced_code_fence"
        if i % 25 == 15 and len(x.a) > 1.5 * least:
            assert got[i] in ("ungrounded_content", "insufficient_content")


def test_example_scores_by_loop(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(3)) for _ in range(n))
    items = [words(20) for _ in range(4)]
    docs = [items[0], items[1][:40] + words(10), words(15), "", items[0] + " " + items[1]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(docs)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    g = lambda t: K.grams(K.normalized(t))
    place = lambda x: [(i * 64 // len(x), y) for i, y in enumerate(x)]
    for r in registry.queries()["example_scores"](spark, str(tmp_path)).collect():
        x, y = g(docs[r.doc_id]), g(items[r.doc_id % 4])
        parts = [K.multiset_f1(x, y), K.multiset_f1(place(x), place(y)), K.ordered_f1(x, y), K.best_window_f1(x, y)]
        quality = 0.0 if 0 in parts else 4 / sum(1 / p for p in parts)
        leaks = [K.best_window_f1(x, g(items[(r.doc_id % 4 + k) % 4])) for k in (1, 2)]
        assert r.quality == pytest.approx(quality) and r.leakage == pytest.approx(max(leaks)) and r.lie_index == leaks.index(max(leaks))
        assert r.utility == pytest.approx(quality * (1 - max(leaks))) and not math.isnan(r.margin)


def test_finished_results_keep_each_page(spark):
    got = registry.queries()["finished_results"](spark, SF).collect()
    assert {r.route for r in got} <= {"native_fast_path", "deterministic_fallback"} and len({r.page_id for r in got}) == len(got)
    assert all(0 <= r.completeness <= 1 and r.word_count >= 8 for r in got)
    assert json.dumps(sorted(r.reasons for r in got))
