import math

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.session import Engine


@pytest.fixture(scope="module")
def e(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("tables")))


def test_rows_collect_and_group(e):
    data = [{"i": i} for i in range(10)]
    rdd = e.parallelize(data).toRDD()
    assert rdd.collect().execute() == data
    pairs = rdd.map(lambda x: x["i"]).filter(lambda i: i > 2).map(lambda i: (i % 2 == 0, i)).groupByKey()
    for _ in range(2):  # a second run sees nothing of the first
        got = {k: sorted(v) for k, v in pairs.collect().execute()}
        assert got == {False: [3, 5, 7, 9], True: [4, 6, 8]} and all(isinstance(k, bool) for k in got)


def test_with_column_replaces(e):
    df = e.parallelize([{"x": 1, "y": 1, "z": 1}, {"x": 2, "y": 2, "z": 2}]).toDF()
    df = df.withColumn("w", df["y"] + df["z"], int)
    df = df.withColumn("w", df["w"] * 2, int)
    assert df.collect().execute() == [{"x": 1, "y": 1, "z": 1, "w": 4}, {"x": 2, "y": 2, "z": 2, "w": 8}]


def test_schema_is_that_of_the_first_row(e):
    assert e.parallelize([]).toDF().execute() == []
    assert e.parallelize([], "a int").toDF().cols == ["a"]
    df = e.parallelize([{"a": 1, "n": None}, {"a": 2, "b": 5}]).toDF()
    assert df.cols == ["a", "n"] and df.execute() == [{"a": 1, "n": None}, {"a": 2, "n": None}]
    with pytest.raises(KeyError):
        df["b"]


def test_floor_division(e):
    rows = [{"a": a, "b": b} for a in (-7, 7, 0, 2**53 + 1) for b in (2, -2, 3, -3)]
    df = e.parallelize(rows).toDF()
    assert [r["q"] for r in df.withColumn("q", df["a"] // df["b"]).execute()] == [r["a"] // r["b"] for r in rows]
    zero = e.parallelize([{"a": 5, "x": 5.0, "b": 0}]).toDF()
    assert zero.withColumn("q", zero["a"] // zero["b"]).withColumn("r", zero["x"] // zero["b"]).execute()[0]["r"] is None
    f = e.parallelize([{"x": -7.5}]).toDF()
    assert f.withColumn("q", f["x"] // 2).execute()[0]["q"] == math.floor(-7.5 / 2)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.floats(), st.floats()), min_size=400, max_size=400))
def test_floor_division_of_floats(spark, pairs):
    from quarry.operators.frame import Frame

    pairs += [(a, b) for a in (1e300, -1e300, 1.0, -1.0, float("nan"), float("inf"), 2.0**53 + 2) for b in (7.0, 0.1, -0.1, 0.0, float("inf"), 3e-300)]
    f = Frame(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double"))
    for r in f.withColumn("q", f["a"] // f["b"]).execute():
        want = None if r["b"] == 0 else r["a"] // r["b"]
        assert r["q"] == want or math.isnan(r["q"]) and math.isnan(want) or abs(want) > 2**53 and math.isclose(r["q"], want, rel_tol=1e-15) or math.isinf(r["q"]) and (math.isnan(want) or math.isinf(want)), r


def test_whole_numbers_widen(e, spark):
    from quarry.operators.frame import Frame

    f = Frame(spark.createDataFrame([(2147483647,)], "i int"))
    assert f.withColumn("j", f["i"] + f["i"]).execute()[0]["j"] == 2 * 2147483647
    assert f.withColumn("j", f["i"] & 255).execute()[0]["j"] == 255


def test_nulls_nan_and_order(e, spark):
    from quarry.operators.frame import Frame

    f = Frame(spark.createDataFrame([(3, 1.0, "b"), (None, None, None), (1, float("nan"), "a"), (3, 2.0, "c")], "i int, x double, s string"))
    assert [r["i"] for r in f.sort("i", "s").execute()] == [1, 3, 3, None]
    assert [r["s"] for r in f.sort(f["i"].desc(), f["s"].desc()).execute()] == ["c", "b", "a", None]
    assert len(f.filter(f["i"] > 1).execute()) == 2 and len(f.filter(f["x"].isNull()).execute()) == 1
    assert len(f.filter(f["i"].isin([1, 9]) | f["s"].contains("c")).execute()) == 2
    assert f.filter(f["i"] > 100).execute() == [] and f.count().execute() == 4
    with pytest.raises(TypeError):
        f["i"].startswith("a")
    with pytest.raises(TypeError):
        f["s"] - 1
    with pytest.raises(TypeError):
        bool(f["i"] == 1)


def test_group_join_limit_sample(e):
    a = e.parallelize([{"k": i % 3, "v": i} for i in range(30)]).toDF()
    b = e.parallelize([{"k": 1, "w": "x"}]).toDF()
    assert a.join(b, "k").count().execute() == 10 and a.join(b, "k").cols == ["k", "v", "w"]
    with pytest.raises(ValueError):
        a.join(a, "k")
    groups = a.groupBy("k").rows().execute()
    assert sorted((g["k"], len(g["rows"])) for g in groups) == [(0, 10), (1, 10), (2, 10)]
    assert len(a.limit(4).execute()) == 4 and a.select("k").distinct().count().execute() == 3
    assert a.sample("v", 1.0, 3).cols == ["v"]
    assert a.groupBy(a["v"] > 14).agg(F.max("v").alias("m")).count().execute() == 2


def test_files(e, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n,b\n")
    assert e.csv(str(tmp_path / "a.csv")).toDF().execute() == [{"x": "1", "y": "a"}, {"x": None, "y": "b"}]
    assert e.csv(str(tmp_path / "a.csv"), infer=True).toDF().schema["x"].dataType.typeName() == "integer"
    (tmp_path / "t.txt").write_text('one\n\n"two"')
    assert [r["col_0"] for r in e.text(str(tmp_path / "*.txt")).toDF().execute()] == ["one", "", '"two"']
    assert e.text(str(tmp_path / "t.txt")).toRDD().collect().execute() == ["one", "", '"two"']
    assert e.stats(str(tmp_path), "text")["files"] == 2 and e.stats(str(tmp_path / "a.csv"), "csv")["rows"] == 2
    with pytest.raises(ValueError):
        e.parquet(str(tmp_path / "none"))
    two = e.parallelize([{"a": 1, "b": 2}]).toDF()
    with pytest.raises(ValueError):
        two.toText("x")


def test_push_down_is_seen(e, tmp_path):
    e.parallelize([{"a": i, "b": i, "c": str(i)} for i in range(10)]).toDF().toParquet(str(tmp_path / "p")).execute()
    f = e.parquet(str(tmp_path / "p")).toDF()
    r = f.filter(f["a"] > 5).select("b").explain()
    assert "GreaterThan(a,5)" in r.pushed_filters and set(r.read_columns) == {"a", "b"} and r.shuffles == 0 and not r.python


COLS = {"i": st.integers(-5, 25), "x": st.sampled_from([0.0, 1.5, 9.0]), "s": st.sampled_from(["a", "b", "zz"]), "c": st.sampled_from(["u", "v"]), "p": st.sampled_from(["k", "l"]), "y": st.integers(0, 5)}


@pytest.fixture(scope="module")
def table(e):
    rows = [{"i": i * 7 % 20, "x": i % 4 * 1.5, "s": "ab"[i % 2], "c": "uv"[i % 3 == 0], "p": "kl"[i % 5 == 0], "y": i % 6, "a": [i]} for i in range(300)]
    e.parallelize(rows).toDF().toTable(e.tables, "t", ["p"], ["c", "s"]).execute()
    return e.tables.get("t")


@settings(max_examples=8, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.data())
def test_index_equals_scan(table, data):
    f = table.toDF()

    def leaf():
        c = data.draw(st.sampled_from(sorted(COLS)))
        op = data.draw(st.sampled_from(["<", "<=", ">", ">=", "==", "in", "between"]))
        v = data.draw(COLS[c])
        x = f[c]
        return {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v, "==": x == v, "in": x.isin([v]), "between": x.between((v, v))}[op]

    def tree(depth):
        if depth == 0 or data.draw(st.booleans()):
            return leaf()
        a, b = tree(depth - 1), tree(depth - 1)
        return a & b if data.draw(st.booleans()) else a | b

    pred = tree(2)
    scan = sorted(map(str, f.filter(pred).execute()))
    assert sorted(map(str, f.filter(pred, use_index=True).execute())) == scan
    assert table.rid_count(pred).first()[0] == len(scan)


def test_catalog_and_stale_indexes(e, table, spark):
    assert set(e.tables.list()) >= {"t"} and table.fresh() and table.kind("c") == "bitmap" and table.kind("p") is None and table.kind("a") is None
    e.parallelize([{"i": 1, "j": 2}]).toDF().toTable(e.tables, "v", index_cols=["i"]).execute()
    v = e.tables.get("v")
    assert v.indexes() == {"i": "sorted"}
    f = v.toDF()
    assert f.filter(f["j"] == 2, use_index=True).count().execute() == 1 and v.indexes() == {"i": "sorted", "j": "sorted"}
    assert v.rids((f["i"] == 1) | (f["j"] == 9), columns=True).drop("rid").first().asDict() == {"i": 1, "j": 2}
    with pytest.raises(KeyError):
        e.tables.get("none")
    e.parallelize([{"i": 1}]).toDF().toTable(e.tables, "u").execute()
    u = e.tables.get("u")
    u.data.withColumn("i", F.col("i") + 1).write.mode("append").parquet(u.at + "/data")
    f = u.toDF()
    assert not u.fresh() and f.filter(f["i"] == 2, use_index=True).execute() == [{"i": 2}]
    assert u.rids(f["i"] == 2) is None and u.rid_count(f["i"] > 0).first()[0] == 2


def test_files_without_a_row_are_not_read(e, spark):
    from quarry.operators.frame import Frame

    Frame(spark.range(100).repartitionByRange(5, "id")).toTable(e.tables, "w").execute()
    w = e.tables.get("w")
    f = w.toDF()
    got = f.filter(f["id"] < 10, use_index=True)
    assert len(w.files) == 5 and len(got.df.inputFiles()) < len(w.files) and sorted(r["id"] for r in got.execute()) == list(range(10))
    assert f.filter(f["id"] < 0, use_index=True).execute() == []
    seen = spark.sparkContext.accumulator(0)
    f.foreach(lambda r: seen.add(1)).execute()
    assert seen.value == 100
