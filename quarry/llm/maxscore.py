"""Exact top-k by integer inner product: MaxScore over shards, merged.

Component t of a vector x weighs floor(64 * x). The postings of term t are the weights of all of a shard's vectors there, term by term (vectors
without zeros have a posting under every term). A query's term can add at most its bound on a shard, the greater of q * max and q * min of
the weights there, and at least the lesser. Each query sorts its terms by the spread between the two and splits them at its own threshold:
the last terms are non-essential as long as their spreads add up to less than the threshold is above the sum of what all terms add at
least, as no vector can be among the k by these alone. Essential postings are traversed; the others are probed, GROUP by GROUP, only for
vectors whose partial score plus the bounds still open reaches the threshold. While more than FEW of the vectors stay competitive, a group is
traversed instead of probed. The threshold is the k-th best score that the query has from shards before, or from a few vectors of this one.
No candidate is dropped that could be among the k, ties included, so results are exact.

Arithmetic is exact: floats while all sums stay below 2^24 or doubles below 2^53, else 64-bit integers, else Python's. Scores beyond a long are
clamped to +-(2^63 - 1) before they are ranked, so those that are clamped tie.

Defined cases: null vectors or ids, and vectors with null or non-finite components, take no part; zero vectors do (score 0). Vectors of
another length don't meet. Fewer than k candidates: all. Ties go to the smaller vec_id. A vec_id that occurs with several vectors is as many
candidates, and one query: each candidate counts once, with the best of their scores. A row that occurs n times is n candidates and asks once.
Very long vectors are taken whole, a shard of them in memory at once. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.vectors import best, search, usable

SCALE, SHARD, GROUP = 64, 16384, 8
#: Share of the vectors up to which those left are probed one by one.
FEW = 0.05
TOP = (1 << 63) - 1


def weights(v: np.ndarray, other: np.ndarray) -> np.ndarray:
    """floor(64 x) in a type in which inner products with ``other`` (also raw) are exact."""
    most = (np.abs(v).max(initial=0) * SCALE + 1) * (np.abs(other).max(initial=0) * SCALE + 1) * v.shape[1]
    if most < 2**52:
        return np.floor(v * SCALE).astype(np.float32 if most < 2**23 else np.float64)
    if most < 2**61:
        return np.floor(v * SCALE).astype(np.int64)
    return np.array([[math.floor(SCALE * int(x)) if abs(x) > 2**60 else math.floor(x * SCALE) for x in row] for row in v.tolist()], object).reshape(v.shape)


def clamped(s: np.ndarray) -> np.ndarray:
    return np.array([max(-TOP, min(TOP, x)) for x in s.tolist()], np.int64) if s.dtype == object else s.astype(np.int64)


def split(spread: np.ndarray, room) -> int:
    """Of terms by falling spread, how many are essential: those behind them add up to less than ``room``."""
    behind = np.cumsum(spread[::-1])[::-1]  # of each term and those behind it
    return int(np.count_nonzero(behind >= room))


def cell(k: int):
    def run(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, index, line: dict):
        a, b = weights(q, c), weights(c, q)
        high, low = b.max(axis=0), b.min(axis=0)
        few, posting = b[: max(4 * k, 256)], np.ascontiguousarray(b.T)
        out: tuple[list, list, list] = ([], [], [])
        for i, x in enumerate(a):
            far = line.get(int(qid[i]))
            if far is None:
                known = clamped(few @ x)[cid[: len(few)] != qid[i]]
                far = int(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else None
            if far is not None and far <= -TOP:
                far = None  # what is clamped ties
            most, least = np.maximum(x * high, x * low), np.minimum(x * high, x * low)
            order = np.argsort(least - most, kind="stable")
            open_ = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # bounds of each term and those behind it
            at = len(order) if far is None else split((most - least)[order], far - least.sum())
            part, live = x[order[:at]] @ posting[order[:at]] if at else np.zeros(len(b), b.dtype), None
            while True:
                if far is not None:
                    may = part + open_[at] >= far
                    if live is not None:
                        live, part = live[may], part[may]
                    elif np.count_nonzero(may) <= FEW * len(b):
                        live = np.nonzero(may)[0]
                        part = part[live]
                if at == len(order):
                    break
                terms = order[at : at + GROUP]
                part = part + (x[terms] @ posting[terms] if live is None else x[terms] @ posting[terms[:, None], live[None]])
                at += len(terms)
            j = np.arange(len(b)) if live is None else live
            s = clamped(part)
            ok = cid[j] != qid[i]
            if far is not None:
                ok &= s >= far
            j, s = j[ok], s[ok]
            top_ = best(s, cid[j], k)
            out[0].append(np.full(len(top_), i)), out[1].append(j[top_]), out[2].append(s[top_])
        return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])

    return run


def top(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    return search(usable(vectors, zero=True), every, k, "long", False, SHARD, cell(k))


def query(vectors: DataFrame) -> DataFrame:
    return top(vectors)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) w, row_number() over () r from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.r, any_value(c.vec_id) vec_id,
    max(cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint)) score
  from (select distinct vec_id, w from v where vec_id % 20 = 0) q join v c on q.vec_id <> c.vec_id and len(q.w) = len(c.w) group by 1, 2
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank", vec_id, score
from s qualify "rank" <= 20
"""
