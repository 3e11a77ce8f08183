from hypothesis import given
from hypothesis import strategies as st

from brookmill.functions import scoring as K
from brookmill.operators.specialists import normalize_doi

words = st.lists(st.sampled_from("abcd"), max_size=14)


@given(words, words)
def test_subsequence_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert K.lcs_length(a, b) == t[-1][-1]
    assert K.ordered_f1(a, b) <= K.multiset_f1(a, b) + 1e-12


@given(words, words)
def test_best_window(text, ref):
    best = 0.0
    for up, down in K.WINDOW_RATIOS:
        n = min(len(text), max(1, len(ref) * up // down)) if ref else 0
        for i in range(len(text) - n + 1) if n else ():
            best = max(best, K.multiset_f1(text[i : i + n], ref))
    assert abs(K.best_window_f1(text, ref) - best) < 1e-12


def test_normalisation():
    assert K.normalized(" Straße​  ﬁ\n") == "strasse fi" and K.tokens("Don't x_1 漢字!") == ["don't", "x_1", "漢", "字", "!"]
    assert normalize_doi("see https://doi.org/10.1000/a(b)c). ") == "10.1000/a(b)c"
    assert K.path_id("") == "node-cbf29ce484222325"
