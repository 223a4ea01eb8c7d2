"""Managed tables with secondary indexes that answer filters with exactly the rows of a scan.

root/name/data holds the rows, root/name/index beside it the indexes, root/name/manifest the data files they were built from; if those
have changed since, filters scan. A row's id is its file and its place in it. An index is built when its column is first asked for, or with
the table where that is asked for.

Sorted index of a column: (value, file, row), ranged and sorted by value, so Parquet's own minima and maxima are the search tree.
Bitmap index of a categorical column: for each value and bucket of row numbers the bits of its rows; conditions on several such
columns meet as bitmap_and_agg and bitmap_or_agg before any row is touched.
"""

from __future__ import annotations

import json
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.expr import COMPARISONS, Expr, column, to_column
from quarry.operators.frame import Frame
from quarry.sources import files, sinks

#: Rows of a file come before 2^SHIFT.
SHIFT = 40


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def list(self) -> dict[str, Table]:
        return {n: Table(self.spark, f"{self.root}/{n}") for n in files.folders(self.spark, self.root)}

    def get(self, name: str) -> Table:
        if not files.exists(self.spark, f"{self.root}/{name}/data"):
            raise KeyError(name)
        return Table(self.spark, f"{self.root}/{name}")

    def write(self, df: DataFrame, name: str, partition_cols: list[str] | tuple = (), categorical_cols: list[str] | tuple = (), index_cols: list[str] | tuple = ()) -> Table:
        """Indexes of index_cols are built now. Every other column but those of the partitions gets its own when it is first asked for."""
        at = f"{self.root}/{name}"
        files.remove(self.spark, f"{at}/index")
        files.remove(self.spark, f"{at}/manifest")
        sinks.parquet(df, f"{at}/data", tuple(partition_cols))
        table = Table(self.spark, at)
        manifest = json.dumps({"files": files.marks(self.spark, table.files), "partition": list(partition_cols), "categorical": list(categorical_cols)})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
        for c in index_cols:
            table.index(c)
        return table


class Table:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    @property
    def data(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/data")

    @property
    def files(self) -> list[str]:
        return sorted(self.data.inputFiles())

    def toDF(self) -> Frame:
        return Frame(self.data, self)

    @cached_property
    def manifest(self) -> dict | None:
        """What the table was written with; None if it wasn't written here."""
        if not files.exists(self.spark, f"{self.at}/manifest"):
            return None
        return json.loads(self.spark.read.text(f"{self.at}/manifest").first()[0])

    def fresh(self) -> bool:
        """Whether the files are those that the table was written with, by name, size and time of change."""
        return self.manifest is not None and self.manifest["files"] == files.marks(self.spark, self.files)

    def kind(self, c: str) -> str | None:
        """Of a column that can have an index, which kind."""
        t = self.data.schema[c].dataType if c in self.data.columns else None
        if self.manifest is None or t is None or c in self.manifest["partition"] or isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            return None
        return "bitmap" if c in self.manifest["categorical"] else "sorted"

    def index(self, c: str) -> DataFrame:
        """The index of a column, built if it isn't there: one scan of that column. Only for files that are as they were written."""
        kind = self.kind(c)
        if kind is None:
            raise ValueError(f"no index of {c}")
        at = f"{self.at}/index/{kind}/{c}"
        if not files.exists(self.spark, f"{at}/_SUCCESS"):
            ids = self.with_ids(c)
            if kind == "bitmap":
                rid = F.col("rid") + 1
                sinks.parquet(ids.groupBy(F.col(f"`{c}`").alias("value"), F.bitmap_bucket_number(rid).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(rid)).alias("bits")), at)
            else:
                sinks.parquet(ids.select(F.col(f"`{c}`").alias("value"), "rid").repartitionByRange("value").sortWithinPartitions("value"), at)
        return self.spark.read.parquet(at)

    def with_ids(self, *columns: str, numbers: list[int] | None = None) -> DataFrame:
        """data (all of it, or some columns) with rid: the file's number above SHIFT bits, the row's below. numbers: of the files to read. The files'
        numbers are a small table joined by name below data (partitions hold files of the same last name)."""
        paths = self.files
        data = self.data
        if numbers is not None and len(numbers) < len(paths):
            data = self.spark.read.schema(data.schema).option("basePath", f"{self.at}/data").parquet(*[paths[i] for i in numbers]) if numbers else data.limit(0)
        names = self.spark.createDataFrame([(f.rpartition("/data/")[2], i) for i, f in enumerate(paths)], "file_name string, file_id long")
        data = data.select(*[F.col(f"`{c}`") for c in columns or data.columns], F.substring_index("_metadata.file_path", "/data/", -1).alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
        rid = F.shiftleft(F.col("file_id"), SHIFT) + F.col("row_index")
        return data.join(F.broadcast(names), "file_name").withColumn("rid", rid).drop("file_name", "file_id", "row_index")

    def indexes(self) -> dict[str, str]:
        """Those that are built."""
        return {c: kind for kind in ("sorted", "bitmap") for c in files.folders(self.spark, f"{self.at}/index/{kind}")}

    def rids(self, pred: Expr, columns: bool = False) -> DataFrame | None:
        """(rid) of the rows that hold pred, from the indexes alone; None if they can't tell. columns: with pred's columns, from the indexes too."""
        if not self.fresh() or (found := self._rids(pred)) is None:
            return None
        for c in sorted(pred.columns()) if columns else ():
            found = found.join(self.index(c).withColumnRenamed("value", c), "rid")
        return found

    def _rids(self, pred: Expr) -> DataFrame | None:
        if pred.op in ("&", "|") and pred.kind != "int":
            a, b = (self._rids(x) for x in pred.args)
            if a is None or b is None:
                return None
            return a.join(b, "rid", "left_semi") if pred.op == "&" else a.union(b).distinct()
        c = self._leaf(pred)
        if c is None or self.kind(c) != "sorted":
            return None
        return self.index(c).filter(to_column(self._on_value(pred))).select("rid")

    def rid_count(self, pred: Expr) -> DataFrame:
        """(n): how many rows hold pred, from the indexes where they can tell and the files are as they were written, else from a scan."""
        r = self.rids(pred)
        return (self.data.filter(to_column(pred)) if r is None else r).agg(F.count(F.lit(1)).alias("n"))

    def bits(self, pred: Expr) -> DataFrame | None:
        """(bucket, bits) of the rows that hold pred, from bitmap indexes alone; None if they can't tell."""
        return self._bits(pred) if self.fresh() else None

    def _bits(self, pred: Expr) -> DataFrame | None:
        if pred.op in ("&", "|") and pred.kind != "int":
            a, b = (self._bits(x) for x in pred.args)
            if a is None or b is None:
                return None
            both = a.union(b).groupBy("bucket")
            if pred.op == "|":
                return both.agg(F.bitmap_or_agg("bits").alias("bits"))
            return both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).filter("n = 2").select("bucket", "bits")
        c = self._leaf(pred)
        if c is None or self.kind(c) != "bitmap":
            return None
        return self.index(c).filter(to_column(self._on_value(pred))).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def filtered(self, pred: Expr) -> DataFrame:
        """The rows of a scan. Conjuncts that indexes can answer pick row ids, and the files that hold any; the others filter what is fetched."""
        data = self.data
        if not self.fresh():
            return data.filter(to_column(pred))
        by_rid, by_bits, rest = None, None, []
        for c in pred.conjuncts():
            if (b := self._bits(c)) is not None:
                by_bits = (c, b) if by_bits is None else (by_bits[0] & c, self._bits(by_bits[0] & c))
            elif (r := self._rids(c)) is not None:
                by_rid = r if by_rid is None else by_rid.join(r, "rid", "left_semi")
            else:
                rest.append(c)
        if by_rid is None and by_bits is None:
            return data.filter(to_column(pred))
        numbers = None
        if by_rid is not None and len(self.files) > 1:
            # a row for each file at most; files without a row that the index found aren't read
            numbers = [r[0] for r in by_rid.select(F.shiftright("rid", SHIFT).alias("f")).distinct().orderBy("f").collect()]
        out = self.with_ids(numbers=numbers)
        for c in rest:
            out = out.filter(to_column(c))
        if by_rid is not None:
            # what the index answers is asked of the rows too, so that Parquet's own minima and maxima skip row groups
            out = out.filter(to_column(reduce(lambda x, y: x & y, [c for c in pred.conjuncts() if self._rids(c) is not None]))).join(by_rid, "rid", "left_semi")
        if by_bits is not None:
            at = F.bitmap_bit_position(F.col("rid") + 1)
            byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
            out = out.withColumn("bit", at).withColumn("bucket", F.bitmap_bucket_number(F.col("rid") + 1)).join(by_bits[1], "bucket")
            out = out.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0)
        return out.select(*[F.col(f"`{c}`") for c in data.columns])

    def _leaf(self, pred: Expr) -> str | None:
        """The column of a comparison with literals."""
        if pred.op in COMPARISONS | {"between", "isin", "isNull"} and pred.args[0].op == "col" and all(a.op == "lit" for a in pred.args[1:]):
            return pred.args[0].args[0]
        return None

    def _on_value(self, pred: Expr) -> Expr:
        return Expr(pred.op, (column("value", self.data.schema[pred.args[0].args[0]].dataType), *pred.args[1:]), pred.kind)
