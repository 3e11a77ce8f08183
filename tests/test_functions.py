import itertools
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookmill.functions import dom
from brookmill.functions import url as U
from brookmill.operators import lattice as L
from brookmill.streaming import frontier as SF


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.COM:80/a/../b?x=1#f", "http://example.com/b?x=1"),
        ("https://example.com:443", "https://example.com/"),
        ("https://ex.com/%7euser/%2f?q=%c3%a9", "https://ex.com/~user/%2F?q=%C3%A9"),
        ("https://bücher.example/ä", "https://xn--bcher-kva.example/%C3%A4"),
        ("https://[::1]:8080/", "https://[::1]:8080/"),
        ("https://ex.com/a//b/./c/..", "https://ex.com/a//b/"),
    ],
)
def test_canonical_forms(raw, want):
    assert U.canonicalize(raw) == want and U.canonicalize(want) == want


@pytest.mark.parametrize(("raw", "why"), [("", "invalid_url"), ("ftp://a.b/", "unsupported_scheme"), ("http://u:p@a.b/", "userinfo_not_allowed"), ("http://a.b:/", "invalid_url"), ("http://a.b/%zz", "invalid_url"), (" http://a.b/", "invalid_url"), ("http://a..b/", "invalid_url"), ("http://[a.b]/", "invalid_url")])
def test_rejections(raw, why):
    with pytest.raises(U.Rejected, match=why):
        U.canonicalize(raw)


@settings(max_examples=300)
@given(st.text(alphabet="ab./?#%&=:~é2F", max_size=30))
def test_canonicalize_is_idempotent(tail):
    try:
        once = U.canonicalize("https://ex.com/" + tail)
    except U.Rejected:
        return
    assert U.canonicalize(once) == once


def test_plain_form_equals_exact_form(spark):
    from pyspark.sql import functions as F

    parts = itertools.product(["http", "HTTPS"], ["a.example", "A.b-c.Example", "a..b", "127.0.0.1", "x_y.example"], ["", ":80", ":443", ":8080", ":080"], ["", "/", "/p;x=1/~q", "/a/../b", "/%41", "/é"], ["", "?a=1&a=2", "?x=%20"], ["", "#f"])
    urls = ["".join((s, "://", *rest)) for s, *rest in parts]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.canonical_plain(F.col("url")).alias("plain"), U.canonicalize_exact(F.col("url")).alias("exact"))
    rows = df.collect()
    assert sum(r.plain is not None for r in rows) > 50
    for r in rows:
        if r.plain is not None:
            assert r.plain == r.exact.canonical, r.url


PAGE = "<main><h1>T</h1><p>some <a href=/x>link</a> text</p><ul><li>one<li>two</ul><pre><code>a  b</code></pre><table><tr><td>c</table><script>x</script><p aria-hidden=true>no</p></main>"


def test_blocks_in_order_with_parents():
    b = dom.blocks(PAGE)
    assert [x["tag"] for x in b] == ["main", "h1", "p", "ul", "li", "li", "pre", "code", "table", "tr", "td"]
    assert [x["tag"] for x in b if x["selectable"]] == ["h1", "p", "li", "li", "code", "td"]
    assert b[0]["block_id"] == "block-000000" and all(x["parent_id"] == "block-000000" for x in b if x["tag"] in ("h1", "p", "ul", "pre", "table"))
    assert b[2]["link_text_bytes"] == 4 and b[2]["text"] == "some link text"


def test_blocks_of_nothing():
    assert dom.blocks(None) == [] and dom.blocks("") == [] and dom.candidates("<<>&") == []


def test_grid_spans_and_lists():
    html = "<table><tr><th rowspan=2>h<th colspan=2>w<tr><td>1<td>2</table>"
    cells = dom.table_cells(next(n for n in dom.parse(html).walk() if n.tag == "table"))
    assert [(c["row_index"], c["column_index"], c["row_span"], c["column_span"], c["text"]) for c in cells] == [(0, 0, 2, 1, "h"), (0, 1, 1, 2, "w"), (1, 1, 1, 1, "1"), (1, 2, 1, 1, "2")]
    lst = next(n for n in dom.parse("<ol start=3><li>a<li value=8>b<li>c</ol>").walk() if n.tag == "ol")
    assert [i["ordinal"] for i in dom.list_items(lst)] == [3, 8, 9]


def test_markdown():
    html = "<h2>A <em>b</em></h2><p>x*y <b>z</b></p><ul><li>i<ul><li>j</ul><li>k</ul><pre><code class=language-py>a```\nb</code></pre><table><tr><th>p<th>q<tr><td>1<td>2</table><math><annotation encoding=application/x-tex>x^2</annotation></math>"
    assert dom.markdown(dom.parse(html)).strip() == "## A *b*\n\nx\\*y **z**\n\n- i\n\n  - j\n- k\n\n````py\na```\nb\n````\n\n| p | q |\n| --- | --- |\n| 1 | 2 |\n\n\\(x^2\\)"


def test_lattice_equals_brute_force():
    rng = random.Random(5)
    w = L.Weights(coverage=0.05, gap=0.02, fragment=0.3, contiguous=1, heading_body=0.5)
    for _ in range(150):
        spans = []
        for i in range(rng.randint(0, 8)):
            s = rng.randint(0, 20)
            spans.append({"doc_id": 1, "source": f"s{rng.randint(0, 5)}", "s": s, "e": s + rng.randint(1, 6), "block": f"b{rng.randint(0, 5)}", "type": rng.choice(["heading", "paragraph", "nav"]), "score": rng.choice([-0.5, 0.25, 0.5, 1.0]), "ancestors": {f"b{rng.randint(0, 5)}"} if rng.random() < 0.3 else set()})
        best, brute = L.best_path(spans, w), L.brute_force(spans, w)
        assert L.path_key(best, w)[0] == L.path_key(brute, w)[0]
        assert L.path_key(L.greedy(spans, w), w)[0] <= L.path_key(brute, w)[0]


def test_host_state_machine():
    h = SF.Host(delay=1.0, most_attempts=2)
    assert h.admit("a", 1, 1, 0.0) and h.admit("b", 5, 2, 0.0) and not h.admit("a", 9, 3, 0.0)
    first = h.claim(0.0)
    assert first.url == "a" and h.claim(5.0) is None
    assert h.fail("a", 7, 0.5, True) == "stale"
    assert h.fail("a", 1, 1.0, True, 10.0) == "retry" and h.claim(2.0) is None
    assert h.claim(11.0).url == "a" and h.fail("a", 2, 11.5, True) == "retry_exhausted"
    assert h.claim(12.0).url == "b" and h.succeed("b", 1) == "succeeded" and h.succeed("b", 1) == "stale"
    assert SF.Host.load(h.dump()).entries["b"].reason == "succeeded"


def test_stream_equals_batch(spark, tmp_path):
    cols = ["host", "kind", "url", "priority", "ord", "at", "attempt", "retryable", "retry_after"]
    rows = []
    for host in ("x", "y"):
        for i in range(4):
            rows.append((host, "admit", f"{host}{i}", i % 2, i, float(i), 0, False, None))
        rows.append((host, "succeed", f"{host}0", 0, 10, 5.0, 1, False, None))
        rows.append((host, "tick", None, 0, 11, 8.0, 0, False, None))
    spark.createDataFrame(rows, SF.COMMANDS).coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    stream = SF.frontier(spark.readStream.schema(SF.COMMANDS).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.host, r.url, r.outcome) for r in spark.table("leases").collect()}
    want = set()
    for host in ("x", "y"):
        own = pd.DataFrame([r for r in rows if r[0] == host], columns=cols)
        want |= {(host, u, o) for u, _, _, o in SF.apply(SF.Host(), own)}
    assert got == want and any(o == "leased" for *_, o in got)


def test_token_bucket_against_a_loop(spark):
    from brookmill.operators.frontier import token_bucket

    rng = random.Random(3)
    rows = [(h, round(rng.random() * 6, 3)) for h in "ab" for _ in range(30)]
    got = {}
    for r in token_bucket(spark.createDataFrame(rows, "host string, at double")).collect():
        got.setdefault(r.host, []).append((r.at, r.start))
    for h in "ab":
        tokens, clock, want = 5.0, 0.0, []
        for at in sorted(a for k, a in rows if k == h):
            now = max(clock, at)
            tokens = min(5.0, tokens + (now - clock) * 2.0)
            begin, tokens = (now, tokens - 1) if tokens >= 1 else (now + (1 - tokens) / 2.0, 0.0)
            clock = begin
            want.append((at, begin))
        assert [(a, round(s, 6)) for a, s in sorted(got[h], key=lambda x: (x[1], x[0]))] == [(a, round(s, 6)) for a, s in want]
