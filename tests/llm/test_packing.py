import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookmill.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")
tok = packing.ChunkTokenizer(FILE, cache_most=50)


def plain_ids(text):
    return tok.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="aZéßİσΣ 's.,!\n\t\x1c\x85 　́<|endoftext|>09"), st.lists(st.sampled_from(["Hello,", "don't", "<|endoftext|>", "x<|startoftext|>y", "Ünï", "é́", "ΑΣ", "３", "ß."])).map(" ".join)))
def test_ids_equal_the_whole_pipeline(text):
    assert np.frombuffer(tok.ids(text), "<u4").tolist() == plain_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 12))
def test_windows_hold_each_token_once(sizes, most):
    done = []
    w = packing.SumOfSquares(16, done.append, most)
    for doc, n in enumerate(sizes):
        ids = np.arange(n, dtype="<u4").tobytes()
        for at in range(0, n, 16):
            w.place([doc, at, n, ids[4 * at : 4 * (at + 16)]])
    w.close()
    seen = {d: [] for d in range(len(sizes))}
    for box in done:
        length = sum(len(p[3]) // 4 for p in box)
        assert length == 16 or length & (length - 1) == 0
        for doc, start, total, ids in box:
            got = np.frombuffer(ids, "<u4").tolist()
            assert got == list(range(start, start + len(got))) and total == sizes[doc]
            seen[doc] += got
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(sizes))


def test_choice_minimises_the_sum_of_squares():
    done = []
    w = packing.SumOfSquares(10, done.append)
    put = lambda n: w.place([0, 0, n, b"\0" * 4 * n])
    for n in (6, 6, 3):
        put(n)
    # Levels: two windows at 6; 3 on top of one gives levels 6 and 9 (1 + 1), a new one 6, 6 and 3 (4 + 1).
    assert {h: len(b) for h, b in w.at.items() if b} == {6: 1, 9: 1}


def test_query_round_trip(spark):
    rows = [(1, "Hello, wide world."), (2, None), (3, ""), (4, "ab " * 6000), (4, "ab " * 6000), (None, "x")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, ids string").repartition(2)
    got = packing.pack(docs, FILE).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        assert at <= 4096
    total = sum(len(plain_ids(t or "")) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total
    one = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == 1)
    assert np.frombuffer(b"".join(b for _, b in one), "<u4").tolist() == plain_ids("Hello, wide world.") + [2]
    assert packing.pack(docs.limit(0), FILE).count() == 0
