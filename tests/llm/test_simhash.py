import numpy as np
import pytest
from pyspark.sql import GroupedData

from quarry.llm import simhash as S
from quarry.llm.common import forest


def brute(texts):
    import xxhash

    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    return fps


def labels(ids, fps):
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if bin(a ^ b).count("1") <= 3:
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_code_is_perfect():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 5000)
    again = (x ^ S._ERROR[S._HALVES[0][x & 0xFFF] ^ S._HALVES[1][x >> 12]])
    assert (np.bitwise_count(x ^ again) <= 3).all()
    assert (S._HALVES[0][again & 0xFFF] ^ S._HALVES[1][again >> 12] == 0).all()


def test_no_link_is_lost():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = [base]
    for k in (1, 2, 3, 4):
        flip = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in base], object)
        fps.append(np.array([int(a) ^ int(f) for a, f in zip(base, flip)], dtype=np.uint64))
    fps = np.unique(np.concatenate(fps))
    p, of, a, by = S.keys(fps)
    got = S.linked(p, fps[of], a, fps[by])
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    i, j = np.nonzero(np.triu(d, 1))
    want = forest(fps[i], fps[j])
    assert sorted(zip(*map(list, got))) == sorted(zip(*map(list, want)))


def test_all_ways_that_three_bits_lie():
    """From each of some fingerprints to all others within three bits, whatever segments hold the bits."""
    from itertools import combinations

    for base in np.random.default_rng(4).integers(0, 1 << 63, 2, dtype=np.uint64).tolist():
        near = np.array([base ^ sum(1 << b for b in bits) for k in (1, 2, 3) for bits in combinations(range(64), k)], np.uint64)
        p, of, _, _ = S.keys(near)
        _, _, a, _ = S.keys(np.array([base], np.uint64))
        assert len(np.unique(of[np.isin(p, a)])) == len(near)


def test_few_meet_by_chance():
    fps = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    p, of, a, by = S.keys(fps)
    p.sort()
    met = np.searchsorted(p, a, "right") - np.searchsorted(p, a, "left")
    assert (len(p) + len(a)) / len(fps) < 75 and met.sum() - 7 * len(fps) < 20


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(vocab, 200))))
    for i in range(60, 120):
        t = rows[i - 60][1].split(" ")
        t[int(rng.integers(0, 200))] = "Changed"
        rows.append((i, "\t".join(t)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a b"), (206, rows[3][1]), (207, "é É ß" * 3), (208, "x " * 70000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(df).collect()}
    fps = brute([t for _, t in rows])
    want = labels([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", want[i]) for (i, _), f in zip(rows, fps)}
    assert sum(i != c for i, (_, c) in got.items()) > 20
    kept = {r.doc_id for r in S.deduplicated(df).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_empty_nulls_and_repeats(spark):
    assert S.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.query(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]


def test_wider_links_are_refused(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 1, 4)


def test_one_row_of_a_component_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a, 1), (5, b, 1), (3, b, 1), (None, a, 1), (None, "alone", 1), (None, "alone", 1), (7, "twice", 2), (7, "twice", 1)], "doc_id long, text string, x int")
    got = sorted(((r.doc_id, r.text) for r in S.deduplicated(df).collect()), key=str)
    assert got == sorted([(5, a), (3, b), (None, "alone"), (7, "twice")], key=str)


def test_wide_keys_meet_up_to_five_bits():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    k0, w0 = S.wide_keys(base)
    assert len(k0) < 90 * len(base) and k0.max() < 1 << 26
    for bits in (1, 2, 3, 4, 5):
        near = np.array([int(a) ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for a in base], np.uint64)
        k1, w1 = S.wide_keys(near)
        pairs = set(zip(k0.tolist(), w0.tolist()))
        assert {w for k, w in zip(k1.tolist(), w1.tolist()) if (k, w) in pairs} == set(range(len(base)))


def test_met_are_the_nearest():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in base], np.uint64) for k in (2, 6, 9)]))
    key, of = S.wide_keys(fps)
    held = {}
    for k, w in zip(key.tolist(), of.tolist()):
        held.setdefault(k, []).append(int(fps[w]))
    want = {}
    for k, group in held.items():
        for a in group:
            for b in group:
                if a != b and (a ^ b).bit_count() <= S.WIDE:
                    at = (k >> 24, int(b > a), a)
                    want[at] = min(want.get(at, (99, 0)), ((a ^ b).bit_count(), b))
    t, side, a, b, d = S.met(key.astype(np.uint32), fps[of])
    got = {(int(x), int(s), int(i)): (int(n), int(j)) for x, s, i, j, n in zip(t, side, a, b, d)}
    assert len(got) > 300 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((i ^ j).bit_count() == n for (_, _, i), (n, j) in got.items())


def test_fingerprints_of_hashes():
    import xxhash

    words = [f"w{i}".encode() for i in range(70_000)]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    assert S.of_hashes(h) == S.fingerprint(b" ".join(words).decode()) and S.of_hashes(h[:0]) == 0


def test_rows_of_meeting_grow_with_the_group(spark, monkeypatch):
    made, run = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda *a: made.append(run(*a)) or made[-1])
    rng = np.random.default_rng(8)
    near = np.unique(np.uint64(0x1234_5678_9ABC_DEF0) ^ (np.uint64(1) << rng.integers(0, 64, (4, 1600), dtype=np.uint64)).sum(axis=0, dtype=np.uint64))
    found, rows = [], []
    for m, per in ((300, 8 << 20), (300, 1 << 10), (1200, 1 << 10)):  # the same with few buckets and with many
        monkeypatch.setattr(S, "BUCKET_BYTES", per)
        df = spark.createDataFrame([(0, int(x)) for x in near[:: len(near) // m][:m].view(np.int64)], "kind int, fp long")
        found.append(sorted(map(tuple, S.nearest(df, 200 * m).collect())))
        rows.append(made[-1].count())
    assert found[0] == found[1] and len(found[0]) >= 300
    assert rows[1] <= 36 * 300 and rows[2] <= 36 * 1200 and rows[2] <= 4.4 * rows[1]
