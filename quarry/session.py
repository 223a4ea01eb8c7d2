"""The engine: where data comes in."""

from __future__ import annotations

import datetime
import decimal
import os
import tempfile
import zipfile
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quarry.operators.frame import Frame
from quarry.operators.rows import Rows
from quarry.sources import files
from quarry.sources.tables import Tables

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application; without it they need it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(here)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder that was set for checkpoints. Where neither is, a local
    session gets one of its own, for all its engines; a cluster has no folder that could be guessed, so it is an error there."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        sc = spark.sparkContext
        own = sc._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
            own = sc._jsc.sc().getCheckpointDir()
        told = own.get()
    return told.rstrip("/")


def type_of(v: Any) -> T.DataType:
    """The Spark type of a Python value; null and the unknown are strings."""
    for kind, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampType()), (datetime.date, T.DateType()), (decimal.Decimal, T.DecimalType(38, 18))):
        if isinstance(v, kind):
            return t
    if isinstance(v, (list, tuple)):
        return T.ArrayType(type_of(v[0]) if v else T.StringType())
    if isinstance(v, dict):
        return T.MapType(*(map(type_of, next(iter(v.items()))) if v else (T.StringType(), T.StringType())))
    return T.StringType()


class Dataset:
    """A source: a frame, or rows."""

    def __init__(self, df, rows=None):
        self._df, self._rows = df, rows

    def toDF(self) -> Frame:
        return Frame(self._df)

    def toRDD(self) -> Rows:
        return Rows(self._rows() if self._rows else self._df.rdd.map(lambda r: r.asDict()))


class Engine:
    def __init__(self, spark: SparkSession, table_root: str | None = None):
        self.spark = spark
        self.tables = Tables(spark, table_root or f"{shared_dir(spark)}/quarry-tables")

    def parallelize(self, rows: list[dict], schema: str | T.StructType | None = None) -> Dataset:
        """The schema is that of the first row: later keys are dropped, missing ones are null. An empty list needs a schema."""
        if schema is None:
            schema = T.StructType([T.StructField(str(k), type_of(v)) for k, v in (rows[0] if rows else {}).items()])
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows] if isinstance(schema, T.StructType) else rows, schema)
        return Dataset(df, lambda: self.spark.sparkContext.parallelize(rows))

    def csv(self, path: str, infer: bool = False) -> Dataset:
        """Comma-separated with a header; all strings unless inferred."""
        files.expand(self.spark, path)
        return Dataset(self.spark.read.option("header", True).option("inferSchema", infer).csv(path))

    def text(self, path: str) -> Dataset:
        """A row for each line, blank ones too, as col_0."""
        files.expand(self.spark, path)
        df = self.spark.read.text(path).toDF("col_0")
        return Dataset(df, lambda: df.rdd.map(lambda r: r[0]))

    def parquet(self, path: str) -> Dataset:
        """A file, a glob or a folder, with partition folders (column=value) below it or not."""
        files.expand(self.spark, path, deep=True)
        return Dataset(self.spark.read.parquet(path))

    def stats(self, path: str, kind: str = "parquet") -> dict[str, int]:
        """kind: parquet, text or csv."""
        return files.stats(self.spark, path, kind)
