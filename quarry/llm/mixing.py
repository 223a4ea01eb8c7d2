"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them; for plain documents, the one). Sources get targets: shares
of FACTOR times all tokens by weight, held to MOST times the source's own tokens, the excess shared again by weight until none is above.
Tokens flow from patterns to the sources in them: a pattern's first use costs 1 a token, its second 3 (convex costs: nothing is
repeated while something unused is left that may serve), each use limited by the pattern's tokens. Targets are rounded to whole tokens, so the
flow is one of whole tokens. Successive shortest paths find it; the graph has a node for each pattern and each source, not for documents, and is
the one thing here that is held on the driver (a row for each pattern that occurs).

What a pattern gives is then taken from its documents: whole rounds of all of them, and for the rest those that come first in the order of
a seeded hash, up to the nearest whole document. The order is cut by a histogram of BUCKETS hash ranges; only the documents of the range in
which a pattern's rest ends are ranked, so a pattern with a third of all rows is never sorted. What is told to all tasks is a row for each pattern.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; null ids and repeated rows count as
rows. Sources whose size is 0 get target 0. An empty table gives an empty mix. The result depends on seed, ids and sizes alone; of documents alike
in these, which one the rest ends at is open. Very long texts are counted like any; a document is taken whole or not at all in each round.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, Scratch

WEIGHTS, FACTOR, MOST, SEED, BUCKETS = (5.0, 2.0, 1.0), 1.5, 2.0, "mix", 4096


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> dict[str | None, float]:
    """Sources by code point, null last, get the weights in turn."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, mass = factor * sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):  # the sources that stop first, first
        if not out or len(out) < len(names):
            if most * sizes[s] <= left / mass * weight[s]:
                out[s] = most * sizes[s]
                left, mass = left - out[s], mass - weight[s]
            else:
                break
    return {s: out.get(s, left / mass * weight[s] if mass else 0.0) for s in names}


def flow(supply: list[tuple[tuple, int]], target: dict, most: float = MOST, costs: tuple[int, ...] = (1, 3)) -> list[int]:
    """Tokens that each pattern (its sources, its tokens) gives: a maximum flow of least cost, by successive shortest paths."""
    names = {s: i for i, s in enumerate(target)}
    begin, end, first = 0, 1, 2
    source, pattern = first, first + len(names)
    arcs: list[list[int]] = []
    of: list[list[int]] = [[] for _ in range(pattern + len(supply))]

    def arc(u: int, v: int, room: int, cost: int) -> None:
        of[u].append(len(arcs)), arcs.append([v, room, cost])
        of[v].append(len(arcs)), arcs.append([u, 0, -cost])

    whole = {s: math.floor(t + 0.5) for s, t in target.items()}
    for s, i in names.items():
        arc(source + i, end, whole[s], 0)
    for i, (sources, size) in enumerate(supply):
        for k, cost in enumerate(costs):
            arc(begin, pattern + i, math.floor(size * min(1.0, max(0.0, most - k))), cost)
        for s in sources:
            arc(pattern + i, source + names[s], sum(whole.values()), 0)
    while True:
        far, via, waiting, inside = [math.inf] * len(of), [-1] * len(of), deque([begin]), {begin}
        far[begin] = 0
        while waiting:
            u = waiting.popleft()
            inside.discard(u)
            for a in of[u]:
                v, room, cost = arcs[a]
                if room and far[u] + cost < far[v]:
                    far[v], via[v] = far[u] + cost, a
                    if v not in inside:
                        inside.add(v), waiting.append(v)
        if via[end] < 0:
            break
        path, v = [], end
        while v != begin:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        room = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= room
            arcs[a ^ 1][1] += room
    given = [0] * len(supply)
    for a in of[begin]:
        given[arcs[a][0] - pattern] += arcs[a ^ 1][1]
    return given


def mix(rows: DataFrame, sources: Column, size: Column, key: Column, factor: float = FACTOR, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """rows with the added columns mix_size, mix_target (the sum of its sources' targets), mix_source_size and mix_times (how often it is taken).

    sources: array of the sources that hold the row; key: what tells rows apart, for the seeded order. Columns of rows that are named as the
    added ones give way to them; others of any name pass.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "mix")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    added = ["mix_size", "mix_target", "mix_source_size", "mix_times"]
    own = [F.col(f"mix_row.`{c}`") for c in rows.columns if c not in added]
    r = rows.select(F.struct("*").alias("mix_row"), F.array_sort(F.array_distinct(sources)).alias("mix_pattern"), F.coalesce(size.cast("long"), F.lit(0)).alias("mix_size"), h.alias("mix_hash"))
    r = r.withColumn("mix_bucket", F.substring("mix_hash", 1, 3))
    bins = scratch.cut(r.groupBy("mix_pattern", "mix_bucket").agg(F.sum("mix_size").alias("n")), "bins")  # BUCKETS rows for each pattern
    totals = bins.groupBy("mix_pattern").agg(F.sum("n").alias("n")).collect()  # a row for each pattern
    supply = [(tuple(t.mix_pattern), t.n) for t in totals]
    sizes: dict = {}
    for p, n in supply:
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, factor, most)
    plan = []
    for (p, n), t, given in zip(supply, totals, flow(supply, goal, most)):
        whole = given // n if n else 0
        plan.append((t.mix_pattern, whole, given - whole * n, float(sum(goal[s] for s in p)), sum(sizes[s] for s in p)))
    plan = spark.createDataFrame(plan, "mix_pattern array<string>, whole int, rest long, mix_target double, mix_source_size long")
    # of each pattern the bucket in which its rest ends, and what comes before it
    w = Window.partitionBy("mix_pattern").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = bins.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(plan), "mix_pattern")
    ends = at.filter("before < rest and before + n > rest").select("mix_pattern", F.col("mix_bucket").alias("edge"), "before")
    # a rest that ends between two buckets has no such bucket: its documents are those of the buckets before
    full = at.filter("before + n <= rest and n > 0").groupBy("mix_pattern").agg(F.max("mix_bucket").alias("last"))
    told = plan.join(ends, "mix_pattern", "left").join(full, "mix_pattern", "left").collect()
    plan = spark.createDataFrame([tuple(t) for t in told], f"{_ddl(plan)}, edge string, before long, last string")
    scratch.drop("bins")
    told = r.join(F.broadcast(plan), "mix_pattern")
    edge = F.coalesce(F.col("mix_bucket") == F.col("edge"), F.lit(False))
    sure = told.filter(~edge).withColumn("more", F.coalesce(F.col("mix_bucket") < F.col("edge"), F.col("mix_bucket") <= F.col("last"), F.lit(False)).cast("int"))
    run = Window.partitionBy("mix_pattern", "mix_bucket").orderBy("mix_hash", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    last = told.filter(edge).withColumn("sofar", F.col("before") + F.coalesce(F.sum("mix_size").over(run), F.lit(0)))
    last = last.withColumn("more", (F.col("sofar") + F.col("mix_size") / 2 <= F.col("rest")).cast("int")).drop("sofar")
    return sure.unionByName(last).withColumn("mix_times", F.col("whole") + F.col("more")).select(*own, *added)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def query(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    # cut, so that texts are read and counted once
    rows = Scratch(docs.sparkSession, "sizes").cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "rows")
    got = mix(rows, F.array("source"), F.col("size"), F.col("doc_id"))
    return got.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_times")).alias("taken"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix: each as often as it is taken, columns as they were."""
    got = mix(docs.select(F.struct("*").alias("doc")), F.array("doc.source"), F.regexp_count(F.col("doc.text"), F.lit(WORD)), F.col("doc.doc_id"), **params)
    return got.filter("mix_times > 0").select("doc", F.explode(F.expr("sequence(1, mix_times)"))).select("doc.*")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) h from documents
), s as (
  select source, sum(size)::bigint n, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w from d group by source
), c as (
  select *, 2.0::double * n most,
    1.5::double * sum(n) over () - coalesce(sum(2.0::double * n) over (order by 2.0::double * n / w, source rows between unbounded preceding and 1 preceding), 0) l,
    sum(w) over () - coalesce(sum(w) over (order by 2.0::double * n / w, source rows between unbounded preceding and 1 preceding), 0) m,
    row_number() over (order by 2.0::double * n / w, source) k from s
), f as (select min(k) k from c where most > l / m * w),
t as (
  select source, n, case when f.k is null or c.k < f.k then most else (select l / m from c where c.k = (select k from f)) * w end target from c, f
), g as (
  select *, floor(target + 0.5)::bigint given from t
), o as (
  select d.*, n source_size, target, case when n > 0 then given // n else 0 end whole, given - n * (case when n > 0 then given // n else 0 end) rest,
    coalesce(sum(size) over (partition by d.source order by h, size rows between unbounded preceding and 1 preceding), 0) before
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target, (size * (whole + case when before < rest and before + size / 2 <= rest then 1 else 0 end))::bigint taken from o
"""
