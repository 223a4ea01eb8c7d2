import numpy as np

import corpus_pipeline as C
from quarry.llm import near_copies as N


def brute(rows):
    """Ids that stay: the least of each component of Jaccard >= 0.8, over all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and comp[i] != comp[j]:
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    return sorted(min(r[0] for r, c in zip(rows, comp) if c == k) for k in set(comp))


def texts():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    common = list(rng.choice(vocab, 60))
    rows = []
    for i in range(40):
        w = list(rng.choice(vocab, int(rng.integers(8, 250)))) + (common if i % 3 else [])
        rows.append((i, " ".join(w)))
        for k in range(1, 5):  # similarities on both sides of 0.8
            near = list(w)
            for at in rng.choice(len(w), min(len(w), k * max(1, len(w) // 90)), replace=False):
                near[at] = "Changed"
            rows.append((100 * k + i, "\t".join(near)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b")]


def test_stage_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = brute(rows)
    assert 46 < len(want) < len(rows) - 60
    assert sorted(r.doc_id for r in C.near_deduplication(spark, df, "").collect()) == want


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(N.frequent(df.selectExpr("xxhash64(text) h", "text"), len(rows))[0]) > 40
    assert sorted(r.doc_id for r in N.deduplicated(df).collect()) == brute(rows)
    monkeypatch.setattr(N, "FREQUENT", 1)
    monkeypatch.setattr(N, "LARGE", 3)
    monkeypatch.setattr(N, "EACH", 1)
    monkeypatch.setattr(N, "FEW", 1)
    assert sorted(r.doc_id for r in N.deduplicated(df).collect()) == brute(rows)


def test_one_row_of_a_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a, 1), (5, b, 1), (3, b, 1), (None, a, 1), (None, "alone", 1), (None, "alone", 1), (7, "twice", 2), (7, "twice", 1)], "doc_id long, text string, x int")
    got = sorted(((r.doc_id, r.text) for r in N.deduplicated(df).collect()), key=str)
    assert got == sorted([(5, a), (3, b), (None, "alone"), (7, "twice")], key=str)


def test_simhash_alone_finds_near_copies(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("stars", "rest"):
        monkeypatch.setattr(N, name, lambda posts: posts.selectExpr("key as a", "key as b").filter("false"))
    left, want = {r.doc_id for r in N.deduplicated(df).collect()}, set(brute(rows))
    # what is verified is never wrong, and the exact check has little left to find
    assert want <= left and len(left - want) <= 0.1 * (len(rows) - len(want))


def test_sets_with_equal_fingerprints_meet(spark, monkeypatch):
    monkeypatch.setattr(N.simhash, "of_hashes", lambda h: 7)
    for name in ("stars", "rest"):
        monkeypatch.setattr(N, name, lambda posts: posts.selectExpr("key as a", "key as b").filter("false"))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i])) for i in range(4)]
    sets = spark.createDataFrame([(i, 5, 7, 7) for i in range(4)], "key long, n int, f long, g long")
    assert sorted(map(tuple, N.golay(sets, N.Scratch(spark, "test")).collect())) == [(0, 1), (0, 2), (0, 3)]
    assert [r.doc_id for r in N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
