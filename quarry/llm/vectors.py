"""Vectors in cells: every block of queries meets every shard of candidates once, in one task with bounded memory.

A query set of its own against all rows is stated work. Rows alike in id and vector are one candidate with a count, and one query; queries are
dealt to blocks and candidates to shards by hashes of id and vector, so that neither a hot id nor a hot vector gathers in one task. Blocks and
shards are packed, each into one row. Vectors of different length aren't comparable and meet only their own kind.

Shards are met in rounds of STEP times as many as before. What a round finds for a query is merged with what was known, and the k-th best score
goes with the query into the next round as a line: candidates beyond it can't be among the k, so a round gives about STEP * k rows a query
however many shards it has. Each candidate counts once for a query id, with its best score if the id has several vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch

BLOCK, STEP = 1024, 8


def usable(rows: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>, dim, n): distinct, n how often each occurs. Without null vectors or ids, null or non-finite components and,
    unless ``zero``, zero vectors."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    if not zero:
        ok = ok & F.exists("v", lambda x: x != 0)
    return v.filter(ok).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v"))


def matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    lists = t.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


def packed(rows: DataFrame, part: str, index: Callable[[np.ndarray], Any] | None = None) -> DataFrame:
    """Of rows (vec_id, key, dim, v, part): a row for each dim and part, with ids, keys and vectors in the order of ids, and what index makes of
    the vectors."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("key", "ascending")])
        cols = [t.column(c).to_numpy() for c in ("vec_id", "key")]
        x = matrix(t)
        blobs = [*(np.ascontiguousarray(c).tobytes() for c in (*cols, x)), pickle.dumps(index(x) if index else None)]
        return pa.table([pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("dim", part)] + [pa.array([c], pa.binary()) for c in blobs], ["dim", part, "ids", "keys", "x", "index"])

    return rows.groupBy("dim", part).applyInArrow(pack, f"dim int, {part} int, ids binary, keys binary, x binary, index binary")


Cell = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Any, dict], tuple]


def search(good: DataFrame, every: int, k: int, score: str, smallest: bool, shard: int, cell: Cell, index: Callable[[np.ndarray], Any] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score). cell(query ids, query vectors, candidate ids, candidate vectors, their index, line by query id): for each
    find the place of its query and of its candidate, and its score."""
    spark, scratch = good.sparkSession, Scratch(good.sparkSession, "vectors")
    good = scratch.cut(good.withColumn("key", F.xxhash64("v")), "good")
    asking = good.filter(F.col("vec_id") % every == 0)
    n, q = good.count(), asking.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-q // BLOCK))
    deal = lambda seed, m: F.pmod(F.xxhash64("vec_id", "key", F.lit(seed)), F.lit(m)).cast("int")
    left = scratch.cut(packed(asking.withColumn("block", deal(1, blocks)), "block"), "blocks")
    right = scratch.cut(packed(good.withColumn("shard", deal(2, shards)), "shard", index), "shards")
    kind = pa.float64() if score == "double" else pa.int64()

    def run(batches):
        for b in batches:
            for one in range(b.num_rows):
                r = b.slice(one, 1).to_pylist()[0]
                qid, cid, key = (np.frombuffer(r[c], np.int64) for c in ("ids", "c_ids", "c_keys"))
                x, y = (np.frombuffer(r[c]).reshape(-1, r["dim"]) for c in ("x", "c_x"))
                line = dict(zip(np.frombuffer(r["asked"] or b"", np.int64).tolist(), np.frombuffer(r["lines"] or b"", np.float64 if score == "double" else np.int64).tolist()))
                i, j, s = cell(qid, x, cid, y, pickle.loads(r["c_index"]), line)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(cid[j]), pa.array(key[j]), pa.array(s, kind)], ["query_id", "vec_id", "key", "score"])

    def lines(t: pa.Table) -> pa.Table:
        cols = [pa.array([np.ascontiguousarray(t.column(c).to_numpy()).tobytes()], pa.binary()) for c in ("query_id", "score")]
        return pa.table([pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("dim", "block")] + cols, ["dim", "block", "asked", "lines"])

    order = F.col("score").asc() if smallest else F.col("score").desc()
    place = Window.partitionBy("query_id").orderBy(order, "vec_id", "key")
    known, at, width, turn = None, 0, 1, 0
    while at < shards:
        asked = left
        if known is not None:
            # what a query id has found reaches every block that holds one of its vectors
            full = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), (F.max if smallest else F.min)("score").alias("score")).filter(F.col("m") >= k)
            where = asking.select(F.col("vec_id").alias("query_id"), "dim", deal(1, blocks).alias("block")).distinct()
            told = where.join(full.select("query_id", "score"), "query_id").groupBy("dim", "block").applyInArrow(lines, "dim int, block int, asked binary, lines binary")
            asked = left.join(told, ["dim", "block"], "left")
        else:
            asked = left.withColumn("asked", F.lit(None).cast("binary")).withColumn("lines", F.lit(None).cast("binary"))
        some = right.filter(f"shard >= {at} and shard < {at + width}").select("dim", "shard", F.col("ids").alias("c_ids"), F.col("keys").alias("c_keys"), F.col("x").alias("c_x"), F.col("index").alias("c_index"))
        # a cell's number is the key of both sides, so that cells spread evenly
        met = min(width, shards - at)
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(at), F.lit(at + met - 1))))
        some = some.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = asked.join(some.hint("shuffle_merge"), ["dim", "block", "shard"]).select("dim", "ids", "x", "asked", "lines", "c_ids", "c_keys", "c_x", "c_index").mapInArrow(run, f"query_id long, vec_id long, key long, score {score}")
        best = found if known is None else found.unionByName(known.select("query_id", "vec_id", "key", "score"))
        best = best.groupBy("query_id", "vec_id", "key").agg((F.min if smallest else F.max)("score").alias("score"))
        known = scratch.cut(best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("rank"), f"known{turn}")
        at, width, turn = at + width, width * (STEP - 1) if turn else STEP - 1, turn + 1
    copies = good.select("vec_id", "key", F.least("n", F.lit(k)).cast("int").alias("n"))
    rows = known.join(copies, ["vec_id", "key"]).withColumn("copy", F.explode(F.expr("sequence(1, n)")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id", "key")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to smaller ids, best first."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.nonzero(score >= least)[0]
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]
