"""The engine's operators as queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.frame import Frame
from quarry.session import Engine, shared_dir

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = Engine(spark, f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex[:12]}")
            return f(e, lambda t: e.parquet(f"{sf_dir}/{t}.parquet").toDF())

        Q[name] = run
        if sql:
            SQL[name] = sql
        return f

    return keep


query("scan_parquet", "select * from nation")(lambda e, t: t("nation").df)
query("select", "select l_orderkey, l_quantity from lineitem")(lambda e, t: t("lineitem").select("l_orderkey", "l_quantity").df)
query("startswith", "select p_partkey from part where starts_with(p_name, 'b')")(lambda e, t: (p := t("part")).filter(p["p_name"].startswith("b")).select("p_partkey").df)
query("endswith", "select p_partkey from part where ends_with(p_name, 't')")(lambda e, t: (p := t("part")).filter(p["p_name"].endswith("t")).select("p_partkey").df)
query("contains", "select p_partkey from part where contains(p_name, 'wid')")(lambda e, t: (p := t("part")).filter(p["p_name"].contains("wid")).select("p_partkey").df)
query("between", "select * from part where p_size between 5 and 10")(lambda e, t: (p := t("part")).filter(p["p_size"].between((5, 10))).df)
query("eq", "select * from part where p_size = 7")(lambda e, t: (p := t("part")).filter(p["p_size"] == 7).df)
query("ne", "select p_partkey from part where p_size <> 7")(lambda e, t: (p := t("part")).filter(p["p_size"] != 7).select("p_partkey").df)
query("isin", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")(lambda e, t: (o := t("orders")).filter(o["o_orderpriority"].isin(["1-URGENT", "2-HIGH"])).select("o_orderkey").df)
query("distinct", "select distinct l_returnflag, l_linestatus from lineitem")(lambda e, t: t("lineitem").select("l_returnflag", "l_linestatus").distinct().df)
query("count", 'select count(*) as "count" from lineitem')(lambda e, t: t("lineitem").count().df)
query("limit", "select o_orderkey from orders order by o_orderkey limit 17")(lambda e, t: t("orders").select("o_orderkey").sort("o_orderkey").limit(17).df)
query("map_udf", "select p_partkey, reverse(p_name) r from part")(lambda e, t: (p := t("part")).withColumn("r", p["p_name"].map(lambda s: s[::-1], str)).select("p_partkey", "r").df)
query("substr", "select p_partkey, substr(p_name, 2, 3) s from part")(lambda e, t: (p := t("part")).withColumn("s", p["p_name"].substr(2, 3)).select("p_partkey", "s").df)
query("concat", "select p_partkey, p_brand || p_type bt from part")(lambda e, t: (p := t("part")).withColumn("bt", p["p_brand"] + p["p_type"]).select("p_partkey", "bt").df)
query("floordiv", "select c_custkey, floor(c_acctbal / 7) q, cast(floor(c_nationkey / 4) as bigint) k from customer")(
    lambda e, t: (c := t("customer")).withColumn("q", c["c_acctbal"] // 7).withColumn("k", c["c_nationkey"] // 4).select("c_custkey", "q", "k").df
)
query("filter_andor", "select l_orderkey, l_quantity from lineitem where (l_quantity > 45 and l_discount <= 0.02) or l_tax >= 0.08")(
    lambda e, t: (x := t("lineitem")).filter(((x["l_quantity"] > 45) & (x["l_discount"] <= 0.02)) | (x["l_tax"] >= 0.08)).select("l_orderkey", "l_quantity").df
)
query("less", "select l_orderkey from lineitem where l_quantity < 3")(lambda e, t: (x := t("lineitem")).filter(x["l_quantity"] < 3).select("l_orderkey").df)


@query("sample", "select true of_the_table, true about_a_tenth")
def sample(e, t):
    """A sample differs from run to run of other engines; what it must hold is that its values occur, about as often as asked."""
    x = t("lineitem")
    both = x.sample("l_quantity", 0.1, 7).df.withColumn("drawn", F.lit(1)).unionByName(x.df.select("l_quantity", F.lit(0).alias("drawn")))
    by = both.groupBy("l_quantity").agg(F.sum("drawn").alias("n"), F.sum(1 - F.col("drawn")).alias("m"))
    return by.agg((F.min("m") > 0).alias("of_the_table"), (F.abs(F.sum("n") / F.sum("m") - 0.1) < 0.02).alias("about_a_tenth"))


@query("arith", "select l_orderkey, l_linenumber, l_linenumber + l_orderkey a, l_orderkey - l_linenumber b, cast(l_linenumber as bigint) * 2 m from lineitem")
def arith(e, t):
    x = t("lineitem")
    return x.withColumn("a", x["l_linenumber"] + x["l_orderkey"], int).withColumn("b", x["l_orderkey"] - x["l_linenumber"]).withColumn("m", x["l_linenumber"] * 2).select("l_orderkey", "l_linenumber", "a", "b", "m").df


@query("isnull", "select n_nationkey, r_name is null is_null from nation left join (select * from region where r_regionkey < 2) on n_regionkey = r_regionkey")
def isnull(e, t):
    r = t("region")
    few = r.filter(r["r_regionkey"] < 2).df
    f = Frame(t("nation").df.join(few, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return f.withColumn("is_null", f["r_name"].isNull()).select("n_nationkey", "is_null").df


@query("groupby_rows", "select n_regionkey, array_to_string(list_transform(list_sort(list(n_nationkey)), lambda x: cast(x as varchar)), ',') members from nation group by 1")
def groupby_rows(e, t):
    rows = t("nation").groupBy("n_regionkey").rows().df
    return rows.select("n_regionkey", F.concat_ws(",", F.transform(F.array_sort("rows.n_nationkey"), lambda x: x.cast("string"))).alias("members"))


@query("groupby_count", 'select l_returnflag, count(*) as "count" from lineitem group by 1')
def groupby_count(e, t):
    return t("lineitem").groupBy("l_returnflag").count().df


@query("groupby_agg", "select o_orderstatus, count(*) n, min(o_orderkey) low, max(o_orderkey) high from orders group by 1")
def groupby_agg(e, t):
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).df


@query("join", "select n_regionkey, n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join(e, t):
    region = t("region")
    return t("nation").join(region.withColumn("n_regionkey", region["r_regionkey"]).select("n_regionkey", "r_name"), "n_regionkey").select("n_regionkey", "n_nationkey", "n_name", "r_name").df


@query("join_large", "select o_orderkey, o_custkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def join_large(e, t):
    x = t("lineitem")
    return t("orders").join(x.withColumn("o_orderkey", x["l_orderkey"]).select("o_orderkey", "l_quantity"), "o_orderkey").select("o_orderkey", "o_custkey", "l_quantity").df


@query("sort", "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) pos from orders")
def sort(e, t):
    return _numbered(t("orders").select("o_orderkey", "o_totalprice").sort("o_totalprice", "o_orderkey"))


@query("sort_desc", "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc nulls last, o_orderkey desc nulls last) pos from orders")
def sort_desc(e, t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return _numbered(o.sort(o["o_totalprice"].desc(), o["o_orderkey"].desc()))


def _numbered(f: Frame) -> DataFrame:
    """Positions in a sorted frame without bringing it to one task: sorted partitions are counted, and each starts where those before it end."""
    rows = f.df.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    at = f"{shared_dir(f.df.sparkSession)}/quarry-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(at)
    rows = f.df.sparkSession.read.parquet(at)
    n = rows.groupBy("part").count()  # a row for each partition
    begin = n.withColumn("begin", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "begin")
    within = F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)
    return rows.join(begin, "part").withColumn("pos", F.col("begin") + within + 1).drop("part", "at", "begin")


@query("csv_roundtrip", "select cast(n_nationkey as varchar) n_nationkey, n_name, cast(n_regionkey as varchar) n_regionkey from nation")
def csv_roundtrip(e, t):
    t("nation").toCSV(f"{e.tables.root}/csv").execute()
    return e.csv(f"{e.tables.root}/csv").toDF().df


@query("text_roundtrip", "select p_name col_0 from part")
def text_roundtrip(e, t):
    t("part").select("p_name").toText(f"{e.tables.root}/text").execute()
    return e.text(f"{e.tables.root}/text").toDF().df


@query("parquet_roundtrip", "select * from supplier")
def parquet_roundtrip(e, t):
    t("supplier").toParquet(f"{e.tables.root}/parquet").execute()
    return e.parquet(f"{e.tables.root}/parquet").toDF().df


@query("rdd_pipeline", "select o_orderstatus k, count(*) n, cast(sum(o_orderkey) as bigint) total from orders where o_orderkey > 100 group by 1")
def rdd_pipeline(e, t):
    pairs = t("orders").select("o_orderstatus", "o_orderkey").toRDD().filter(lambda r: r["o_orderkey"] > 100).map(lambda r: (r["o_orderstatus"], r["o_orderkey"])).groupByKey()
    return e.spark.createDataFrame(pairs.map(lambda kv: (kv[0], len(kv[1]), sum(kv[1]))).rdd, "k string, n long, total long")


def _table(e, t, name="lineitem", **cols):
    t(name).toTable(e.tables, name, **cols).execute()
    f = e.tables.get(name).toDF()
    return f


@query("table_partitioned", "select * from lineitem where l_returnflag = 'R'")
def table_partitioned(e, t):
    f = _table(e, t, partition_cols=["l_returnflag"])
    return f.filter(f["l_returnflag"] == "R").select(*t("lineitem").cols).df


@query("index_filter", "select * from lineitem where l_quantity < 5 or l_orderkey = 7")
def index_filter(e, t):
    f = _table(e, t)
    return f.filter((f["l_quantity"] < 5) | (f["l_orderkey"] == 7), use_index=True).df


@query("index_filter_and", "select * from lineitem where l_quantity < 5 and l_orderkey < 700 and l_tax + l_discount > 0.05")
def index_filter_and(e, t):
    f = _table(e, t)
    return f.filter((f["l_quantity"] < 5) & (f["l_orderkey"] < 700) & (f["l_tax"] + f["l_discount"] > 0.05), use_index=True).df


@query("index_rid_count", "select count(*) n from lineitem where l_quantity > 49")
def index_rid_count(e, t):
    f = _table(e, t)
    return e.tables.get("lineitem").rid_count(f["l_quantity"] > 49)


@query("bitmap_filter", "select * from lineitem where l_returnflag = 'R' and l_linestatus = 'F'")
def bitmap_filter(e, t):
    f = _table(e, t, categorical_cols=["l_returnflag", "l_linestatus"])
    return f.filter((f["l_returnflag"] == "R") & (f["l_linestatus"] == "F"), use_index=True).df


@query("tables_list", "select 'nation' as table_name union all select 'region'")
def tables_list(e, t):
    for n in ("nation", "region"):
        t(n).toTable(e.tables, n).execute()
    return e.spark.createDataFrame([(n,) for n in e.tables.list()], "table_name string")


@query("file_stats", "select 'rows' as name, count(*) as value from nation union all select 'sample_rows', least(100, count(*)) from nation union all select 'files', 1 union all select 'sized', 1")
def file_stats(e, t):
    Frame(t("nation").df.coalesce(1)).toParquet(f"{e.tables.root}/stats").execute()
    told = e.stats(f"{e.tables.root}/stats")
    sized = int(told["bytes"] > 0 and told["chunks"] > 0 and told["average_row"] > 0 and told["sample_bytes"] > 0)
    return e.spark.createDataFrame([("rows", told["rows"]), ("sample_rows", told["sample_rows"]), ("files", told["files"]), ("sized", sized)], "name string, value long")


@query("floordiv_edge", "select o_orderkey, floor(-o_totalprice / 3) q, 1e300 big, 'NaN'::double nan, null::double zero from orders")
def floordiv_edge(e, t):
    o = t("orders")
    big, nan = Frame(o.df.withColumn("huge", F.lit(1e300)).withColumn("nan", F.lit(float("nan")))), "nan"
    f = big.withColumn("q", big["o_totalprice"] * -1 // 3).withColumn("big", big["huge"] // 1).withColumn("zero", big["o_totalprice"] // 0).withColumn("nan", big[nan] // 7)
    return f.select("o_orderkey", "q", "big", "nan", "zero").df


@query("rid_count_stale", "select 2 * count(*) n from lineitem where l_quantity > 49")
def rid_count_stale(e, t):
    _table(e, t, index_cols=["l_quantity"])
    table = e.tables.get("lineitem")
    t("lineitem").df.write.mode("append").parquet(f"{table.at}/data")
    table = e.tables.get("lineitem")
    return table.rid_count(table.toDF()["l_quantity"] > 49)


@query("index_columns", "select l_quantity, l_tax from lineitem where l_quantity > 48 and l_tax < 0.02")
def index_columns(e, t):
    f = _table(e, t)
    return e.tables.get("lineitem").rids((f["l_quantity"] > 48) & (f["l_tax"] < 0.02), columns=True).select("l_quantity", "l_tax")


@query("scan_partitioned", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 2")
def scan_partitioned(e, t):
    t("nation").df.write.mode("overwrite").partitionBy("n_regionkey").parquet(f"{e.tables.root}/parts")
    f = e.parquet(f"{e.tables.root}/parts").toDF()
    return f.filter(f["n_regionkey"] == 2).select("n_nationkey", "n_name", "n_regionkey").df


@query("sort_asc", "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice nulls last, o_orderkey desc nulls last) pos from orders")
def sort_asc(e, t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return _numbered(o.sort(o["o_totalprice"].asc(), o["o_orderkey"].desc()))


@query("isin_columns", "select l_orderkey, l_linenumber from lineitem where l_linenumber in (l_suppkey, l_partkey, 3)")
def isin_columns(e, t):
    x = t("lineitem")
    return x.filter(x["l_linenumber"].isin([x["l_suppkey"], x["l_partkey"], 3])).select("l_orderkey", "l_linenumber").df


@query("map_batches", "select s_suppkey, s_acctbal * 2 twice from supplier")
def map_batches(e, t):
    def double(batches):
        for b in batches:
            yield b.assign(twice=b["s_acctbal"] * 2)[["s_suppkey", "twice"]]

    return t("supplier").map_batches(double, "s_suppkey long, twice double").df


@query("path_glob", "select r_regionkey, r_name from region")
def path_glob(e, t):
    t("region").toParquet(f"{e.tables.root}/some-region").execute()
    t("nation").toParquet(f"{e.tables.root}/other").execute()
    return e.parquet(f"{e.tables.root}/some-*/*.parquet").toDF().select("r_regionkey", "r_name").df


@query("collect", "select r_regionkey, r_name from region")
def collect(e, t):
    rows = t("region").select("r_regionkey", "r_name").collect().execute()
    return e.parallelize(rows, "r_regionkey int, r_name string").toDF().df
