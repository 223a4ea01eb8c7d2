"""Approximate nearest neighbours by a permutation index.

Each vector is stood for by the order in which it sees PIVOTS reference vectors, nearest first. It is posted under the POSTED nearest of them: the
index of a shard holds an inverted file for each pivot, with the vectors posted there and the place that each gives the pivot. A query
walks the files of the ASKED pivots nearest to it and adds up |its place - theirs| (Spearman's footrule; POSTED for a vector that isn't in
the file). The vectors of least footrule, a SHARE of the shard and LEAST at least, are ranked again by exact Euclidean distance in double
precision. The index is built once and kept with the shard.

A walk meets POSTED * ASKED / PIVOTS postings for each vector of a shard, and the reranking SHARE of its vectors; comparing all would take as
many multiplications as the vectors have components. SHARE is one of a shard and not of the table, so recall doesn't fall as the table grows.

Pivots come from a bounded sample (the PIVOTS usable vectors of least hash of vec_id, distinct, per dimension); every vector is indexed.
Equal vectors of a shard count once among those that are ranked again, so many copies can't crowd others out; all of them are ranked then.

Defined cases: vectors null, zero or with null or non-finite components neither ask nor answer; so do null ids. Fewer than k candidates:
all. Ties go to the smaller vec_id. A vec_id that occurs with several vectors is as many candidates, and one query: each candidate counts once, at
its distance from the nearest of them. A row that occurs n times is n candidates and asks once. A query never answers itself or its namesakes.
Very long vectors are taken whole, a shard of them in memory at once. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.vectors import best, search, usable

PIVOTS, POSTED, ASKED, SHARD, SHARE, LEAST = 1024, 128, 64, 8192, 0.08, 256


def nearest(v: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """(n, m): the m nearest pivots of each vector, nearest first, ties to the earlier pivot."""
    out, m = [], min(m, len(pivots))
    for k in range(0, len(v), 2048):
        d = (pivots**2).sum(1)[None] - 2 * v[k : k + 2048] @ pivots.T
        near = np.sort(np.argpartition(d, m - 1, axis=1)[:, :m], axis=1)
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, m), np.int64)


def build(pivots: np.ndarray, v: np.ndarray) -> tuple:
    """Of a shard's vectors: the first of each distinct one, the class of each, and the inverted files (where each begins, classes, places)."""
    _, first, twin = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    near = nearest(v[first], pivots, POSTED)
    order = np.argsort(near.ravel(), kind="stable")
    begin = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))
    return first.astype(np.int32), twin.astype(np.int32), begin, (order // near.shape[1]).astype(np.int32), (order % near.shape[1]).astype(np.int16)


def cell(pivots: dict[int, np.ndarray], k: int, share: float, least: int):
    def run(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, index: tuple, line: dict):
        first, twin, begin, posted, place = index
        own, n = c[first], len(first)
        size = np.bincount(twin, minlength=n)
        by_twin = np.argsort(twin, kind="stable")  # ids ascend within a class, as cid does
        start = np.cumsum(size) - size
        ask = max(least, k, round(share * n))
        walk = nearest(q, pivots[c.shape[1]], ASKED)
        out: tuple[list, list, list] = ([], [], [])
        for i in range(len(q)):
            gain = np.zeros(n, np.int32)  # what the footrule is less than for a vector in none of the files
            for t, p in enumerate(walk[i].tolist()):
                a, b = begin[p], begin[p + 1]
                gain[posted[a:b]] += POSTED - np.abs(place[a:b] - np.int16(t))
            names = twin[np.searchsorted(cid, qid[i]) : np.searchsorted(cid, qid[i], "right")]
            gain[names[size[names] == 1]] = -1
            near = np.sort(np.argpartition(-gain, ask)[:ask]) if n > ask else np.arange(n)
            d = np.sqrt(((own[near] - q[i]) ** 2).sum(1))
            # k + 1 members of a class are enough, of which one may be a namesake
            many = np.minimum(size[near], k + 1)
            at = by_twin[np.repeat(start[near], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            d = np.repeat(d, many)
            ok = (cid[at] != qid[i]) & (d <= line.get(int(qid[i]), np.inf))
            at, d = at[ok], d[ok]
            x = best(-d, cid[at], k)
            out[0].append(np.full(len(x), i)), out[1].append(at[x]), out[2].append(d[x])
        return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])

    return run


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, share: float = SHARE, least: int = LEAST) -> DataFrame:
    good = usable(vectors, zero=False)
    found: dict[int, dict] = {}
    for r in good.select("dim", "v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect():
        found.setdefault(r.dim, {})[tuple(r.v)] = None
    pivots = {d: np.array(list(rows)) for d, rows in found.items()}
    # a length of which the sample holds none has one pivot, so that nothing is told apart but by the distances
    of = lambda v: pivots.setdefault(v.shape[1], np.zeros((1, v.shape[1])))
    run = cell(pivots, k, share, least)

    def meet(qid, q, cid, c, index, line):
        of(c)
        return run(qid, q, cid, c, index, line)

    return search(good, every, k, "double", True, SHARD, meet, lambda v: build(of(v), v))


def query(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors)
