from collections import Counter

import duckdb
import numpy as np

from quarry.llm import maxscore, permutation_index

SCHEMA = "vec_id long, embedding array<double>, label int, dim string, score int"


def rows(n=900, d=24, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[300:600] = v[0]  # a third are copies
    out = [(i, x.tolist(), 0, "z", 1) for i, x in enumerate(v)]
    # rows of queries again, the same vector and others, near and far
    out += [(0, v[0].tolist(), 0, "z", 1)] * 2 + [(100, v[700].tolist(), 0, "z", 1), (100, (v[100] + 0.01).tolist(), 0, "z", 1), (200, (-v[200]).tolist(), 0, "z", 1)]
    out += [(400, (v[0] + 0.001 * i).tolist(), 0, "z", 1) for i in range(40)]
    bad = [(1000, None), (1100, [0.0] * d), (1200, [float("nan")] * d), (1300, [None] + [1.0] * (d - 1)), (1400, [float("inf")] * d), (1500, []), (1600, [1.0, 2.0]), (1601, [1.0, 2.5]), (None, [1.0] * d)]
    return out + [(i, x, 0, "z", 1) for i, x in bad] + [(7, v[7].tolist(), 0, "z", 1)]


def valid(rs, zero):
    return [(i, np.array(x)) for i, x, *_ in rs if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and (zero or any(x))]


def brute(rs, every, k):
    """By query id: (distance, vec_id) of the k nearest rows, each at its distance from the nearest of the id's vectors."""
    ok, want = valid(rs, False), {}
    for q in {i for i, _ in ok if i % every == 0}:
        mine = [x for i, x in ok if i == q]
        some = [(min(float(np.sqrt(((x - y) ** 2).sum())) for x in mine if len(x) == len(y)), i) for i, y in ok if i != q and any(len(x) == len(y) for x in mine)]
        want[q] = sorted(some)[:k]
    return want


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_neighbours_recall_and_order(spark, monkeypatch):
    rs = rows()
    for shard in (permutation_index.SHARD, 150):  # one shard, and several met in rounds
        monkeypatch.setattr(permutation_index, "SHARD", shard)
        got, want = found(permutation_index.neighbours(spark.createDataFrame(rs, SCHEMA))), brute(rs, 100, 10)
        assert set(got) == set(want) == {0, 100, 200, 300, 400, 500, 600, 700, 800, 1600}
        assert all(len(got[q]) == len(want[q]) and got[q] == sorted(got[q]) for q in want)
        close = lambda q: Counter((round(d, 9), i) for d, i in q)
        assert sum((close(got[q]) & close(want[q])).total() for q in want) > 0.95 * sum(map(len, want.values()))
        # of the copies the smallest ids, as often as their rows occur
        assert [i for d, i in got[0] if d == 0] == list(range(300, 310)) and [i for d, i in got[300] if d == 0][:3] == [0, 0, 0]


def test_recall_on_clusters_and_sphere(spark, monkeypatch):
    """Where the share counts: shards of far more vectors than are ranked again, on clustered and on uniform data."""
    monkeypatch.setattr(permutation_index, "SHARD", 2500)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 32))
    near = centre[rng.integers(0, 30, 5000)] + 0.2 * rng.normal(size=(5000, 32))
    sphere = rng.normal(size=(5000, 32))
    for v in (near, sphere / np.linalg.norm(sphere, axis=1)[:, None]):
        rs = [(i, x.tolist(), 0, "z", 1) for i, x in enumerate(v)]
        got = found(permutation_index.neighbours(spark.createDataFrame(rs, SCHEMA)))
        hit = 0
        for q in range(0, 5000, 100):
            d = np.sqrt(((v - v[q]) ** 2).sum(1))
            d[q] = np.inf
            hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for _, i in got[q]})
        assert hit >= 0.9 * 500


def test_footrule():
    """The walk over files gives the footrule of the permutations' heads."""
    rng = np.random.default_rng(3)
    v, pivots = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    first, twin, begin, posted, place = permutation_index.build(pivots, np.concatenate([v, v[:5]]))
    assert len(first) == 40 and (twin[40:] == twin[:5]).all()
    order = np.argsort(((v[:, None] - pivots[None]) ** 2).sum(2), axis=1, kind="stable")
    assert (permutation_index.nearest(v, pivots, 128) == order[:, :128]).all()
    for p in range(300):
        files = {(int(twin[i]), int(np.nonzero(order[i] == p)[0][0])) for i in range(40) if p in order[i, :128]}
        assert files == set(zip(posted[begin[p] : begin[p + 1]].tolist(), place[begin[p] : begin[p + 1]].tolist()))


def test_maxscore_is_exact(spark, tmp_path, monkeypatch):
    rs = rows()
    df = spark.createDataFrame(rs, SCHEMA)
    got = sorted(tuple(r) for r in maxscore.query(df).collect())
    monkeypatch.setattr(maxscore, "SHARD", 70)  # rounds of shards
    assert got == sorted(tuple(r) for r in maxscore.query(df).collect())
    df.select("vec_id", "embedding").coalesce(1).write.parquet(str(tmp_path / "e"))
    duckdb.sql(f"create or replace view embeddings as select * from '{tmp_path}/e/*.parquet'")
    assert got == sorted(duckdb.sql(maxscore.SQL).fetchall())
    best = {}
    ok = valid(rs, True)
    for q in {i for i, _ in ok if i % 20 == 0}:
        mine = [np.floor(64 * x).astype(int) for i, x in ok if i == q]
        some = [(-max(int(x @ np.floor(64 * y).astype(int)) for x in mine if len(x) == len(y)), i) for i, y in ok if i != q and any(len(x) == len(y) for x in mine)]
        best[q] = [(n, i, -s) for n, (s, i) in enumerate(sorted(some)[:20], 1)]
    assert got == sorted((q, *r) for q, rs_ in best.items() for r in rs_)


def test_probing_and_wide_numbers():
    rng = np.random.default_rng(1)
    for scale, sparse in ((1, 0.9), (1e5, 0), (1e6, 0)):
        q, c = rng.normal(size=(30, 40)) * scale, rng.normal(size=(2000, 40)) * scale
        c[rng.random(c.shape) < sparse] = 0
        c[:, :8] *= 30
        qi, ci = np.arange(30) * 20, np.arange(2000)
        got = maxscore.cell(20)(qi, q, ci, c, None, {})
        got = qi[got[0]], ci[got[1]], got[2]
        a, b = np.floor(q * 64).astype(object), np.floor(c * 64).astype(object)
        a, b = np.vectorize(int, otypes=[object])(a), np.vectorize(int, otypes=[object])(b)
        want = []
        for i, s in zip(qi, a @ b.T):
            want += [(i, j, t) for t, j in sorted(((-x, j) for j, x in enumerate(s) if j != i))[:20]]
        assert [(i, j, -s) for i, j, s in zip(*map(list, got))] == want


def test_huge_scores_and_thresholds():
    ids = np.arange(1, 4) * 20
    got = maxscore.cell(20)(np.array([0]), np.array([[1e35]]), ids, np.array([[-1e35], [-2e35], [3.0]]), None, {})
    assert [(int(ids[j]), int(s)) for j, s in zip(got[1], got[2])] == [(60, maxscore.TOP), (20, -maxscore.TOP), (40, -maxscore.TOP)]
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(9, 12)), rng.normal(size=(500, 12))
    whole = maxscore.cell(5)(np.arange(9), q, np.arange(500), c, None, {})
    for k in range(9):  # with its own k-th best score as the line a query finds the same, with a better one only what reaches it
        s = whole[2][whole[0] == k]
        for line in (int(s[-1]), int(s[1])):
            got = maxscore.cell(5)(np.array([k]), q[k : k + 1], np.arange(500), c, None, {k: line})
            assert got[2].tolist() == [x for x in s.tolist() if x >= line]


def test_split_is_where_no_vector_passes_by_the_rest():
    assert maxscore.split(np.array([5, 3, 2, 1]), 4) == 2 and maxscore.split(np.array([5, 3, 2, 1]), 3) == 3
    assert maxscore.split(np.array([5, 3]), 100) == 0 and maxscore.split(np.array([5, 3]), 0) == 2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert permutation_index.query(df).count() == 0 and maxscore.query(df).count() == 0
