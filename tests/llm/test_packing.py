import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import packing as P

ENC = P.Encoder(P.vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sdt  \n\t\r.,!?_0189é ñ\xa0\x85-Ω½²\x1c字"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_tokenizer(text):
    assert ENC(text).tolist() == ENC.whole.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_text():
    t = "a <|endoftext|> b"
    assert ENC(t).tolist() == ENC.whole.encode(t, add_special_tokens=False).ids


def gap(n, length):
    return 0 if n == length else min(length - n, P.SHORT if n & (n - 1) == 0 and n * 8 >= length else length)


def test_windows_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        length = 16
        ends = np.cumsum(rng.integers(1, 9, rng.integers(1, 40)))
        pen = rng.integers(0, 5, len(ends))
        pen[-1] = 0

        def total(cuts):
            c, low = 0, 0
            for h in cuts:
                n = h - low
                assert 0 < n <= length
                c += (gap(n, length)) + int(pen[list(ends).index(h)])
                low = h
            return c

        pos = [0, *ends.tolist()]
        best = [0] + [10**9] * len(ends)
        for j in range(1, len(pos)):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= length:
                    best[j] = min(best[j], best[i] + gap(n, length) + int(pen[j - 1]))
        assert total(P.windows(ends, pen, length)) == best[-1]


def test_round_trip(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta.", "gamma!", "étude", "x1", "\n"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 900)))), 7) for i in range(150)]
    docs += [(1000, None, 7), (1001, "", 7), (1002, "word " * 30000, 7), (1003, "z" * 9000, 7), (None, "no id", 7), (3, docs[3][1], 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int").repartition(3)
    got = P.pack(df, P.vocabulary(), with_ids=True).collect()
    by = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length > 0
        by.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    want = {}
    for i, t, _ in docs:
        want.setdefault(i, []).append(ENC.whole.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(by) == set(want)
    for i, parts in by.items():
        if i != 3:
            parts.sort(key=lambda p: p[0])
            assert [x for p in parts for x in p[1].tolist()] == want[i][0] and all(p[2] == len(want[i][0]) for p in parts)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    pad = total = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
        total += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad < 0.02 * total + 3 * 2048


def test_blocks_are_carried(spark, monkeypatch):
    assert P.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(i, "some words. " * 40000) for i in range(3)], "doc_id long, text string").coalesce(1)
    got = P.query(one).collect()
    assert sum(r.length for r in got) == 3 * (len(ENC("some words. " * 40000)) + 1)
