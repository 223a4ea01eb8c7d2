import itertools
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quarry.llm import mixing as M


def test_targets_reshare_what_is_above():
    t = M.targets({"a": 10, "b": 1000, "c": 1000, None: 0})
    assert t["a"] == 20 and t[None] == 0 and abs(sum(t.values()) - 1.5 * 2010) < 1e-6
    assert abs(t["b"] / t["c"] - 2) < 1e-9 or t["b"] == 2000
    assert M.targets({}) == {}
    assert M.targets({"a": 0}) == {"a": 0}


def test_flow_prefers_fresh_tokens_and_serves_all():
    # b may draw on the shared pattern; a can't be served without repeats
    supply = [(("a",), 100), (("a", "b"), 100), (("b",), 50)]
    got = M.flow(supply, {"a": 150, "b": 100})
    assert abs(sum(got) - 250) < 1e-6 and max(g - n for g, (_, n) in zip(got, supply)) < 1e-6
    got = M.flow(supply, {"a": 300, "b": 150})
    assert abs(sum(got) - 450) < 1e-6 and all(g <= 2 * n + 1e-6 for g, (_, n) in zip(got, supply))


def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)) + "\t\n", "hot" if i % 3 else f"s{i % 7}", 5) for i in range(900)]
    rows += [(1000, None, "hot", 5), (1001, "", "empty", 5), (1002, "x y", None, 5), (1003, "x y z", None, 5), (5, "x", "hot", 5), (5, "x", "hot", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_query_equals_sql(spark, tmp_path):
    df = docs(spark)
    got = sorted((tuple(r) for r in M.query(df).collect()), key=str)
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    assert got == sorted(duckdb.sql(M.SQL).fetchall(), key=str)
    assert got == sorted((tuple(r) for r in M.query(df.repartition(5)).collect()), key=str)
    assert all(r[4] <= 2 * r[1] for r in got)
    by = {}
    for r in M.query(df).join(df.select("doc_id", "source"), "doc_id").filter("doc_id <> 5").collect():
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(t - n) <= 100 for t, n in by.values())


def best(supply, target, most=2):
    """Of all amounts that can be routed, the greatest total and its least cost. Amounts can be routed if no set of patterns gives more than
    the sources in it take."""
    top = (-1, 0)
    sets = [c for k in range(1, len(supply) + 1) for c in itertools.combinations(range(len(supply)), k)]
    for g in itertools.product(*(range(most * n + 1) for _, n in supply)):
        if all(sum(g[i] for i in c) <= sum(target[s] for s in {s for i in c for s in supply[i][0]}) for c in sets):
            top = max(top, (sum(g), -sum(min(x, n) + 3 * max(0, x - n) for x, (_, n) in zip(g, supply))))
    return top


def test_flow_is_the_greatest_and_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        names = "abc"[: rng.randint(1, 3)]
        supply = [(tuple(sorted(rng.sample(names, rng.randint(1, len(names))))), rng.randint(0, 3)) for _ in range(rng.randint(1, 4))]
        supply = list(dict(supply).items())
        target = {s: rng.randint(0, 8) for s in names}
        got = M.flow(supply, target)
        assert (sum(got), -sum(min(x, n) + 3 * max(0, x - n) for x, (_, n) in zip(got, supply))) == best(supply, target)
        assert all(isinstance(g, int) and 0 <= g <= 2 * n for g, (_, n) in zip(got, supply))


def test_overlapping_sources(spark):
    """What the documents of each pattern give in all is what the flow asks of it, to the nearest document."""
    held = [["a", "b"], ["a"], ["b", "c"], ["c"], ["c"], ["c"]]
    rows = [(i, held[i % 6], 3 + i % 17) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, n int")
    got = M.mix(df, F.col("sources"), F.col("n"), F.col("doc_id")).collect()
    size, sizes = Counter(), Counter()
    for _, s, n in rows:
        size[tuple(s)] += n
        for x in s:
            sizes[x] += n
    supply = sorted(size.items())
    want = dict(zip([p for p, _ in supply], M.flow(supply, M.targets(sizes))))
    given = Counter()
    for r in got:
        given[tuple(r.sources)] += r.n * r.mix_times
    assert len(got) == 1200 and all(abs(given[p] - want[p]) <= 10 for p in want)


def test_the_flow_decides(spark, monkeypatch):
    monkeypatch.setattr(M, "flow", lambda supply, *a: [0] * len(supply))
    assert {r.taken for r in M.query(docs(spark)).collect()} == {0}


def test_mixed_and_empty(spark):
    df = docs(spark)
    want = sum(r.mix_times for r in M.mix(df.withColumn("mix_words", F.regexp_count("text", F.lit(M.WORD))), F.array("source"), F.col("mix_words"), F.col("doc_id")).collect())
    got = M.mixed(df)
    assert got.columns == df.columns and got.count() == want
    assert M.query(df.filter("false")).count() == 0 and M.mixed(df.filter("false")).count() == 0
