"""Frames: a lazy facade over DataFrames. Terminal methods build a Pending; nothing runs before ``execute``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import DECLARED, Expr, column
from quarry.plans.report import Report


class Pending:
    """A terminal step. df: the plan behind it; execute() runs it."""

    def __init__(self, df: DataFrame, run: Callable[[DataFrame], Any]):
        self.df, self._run = df, run

    def execute(self) -> Any:
        return self._run(self.df)


class Grouped:
    def __init__(self, df: DataFrame, keys: list):
        self._df, self._keys = df, keys

    def agg(self, *exprs) -> Frame:
        return Frame(self._df.groupBy(*self._keys).agg(*exprs))

    def count(self) -> Frame:
        return Frame(self._df.groupBy(*self._keys).count())

    def rows(self) -> Frame:
        """One row for each key with all its rows, as an array of structs; a key's rows come to one task, as the result asks."""
        return self.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in self._df.columns])).alias("rows"))


class Frame:
    def __init__(self, df: DataFrame, table=None):
        self.df, self._table = df, table

    def __getitem__(self, name: str) -> Expr:
        if name not in self.df.columns:
            raise KeyError(name)
        return column(name, self.df.schema[name].dataType)

    @property
    def cols(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    def select(self, *names: str) -> Frame:
        return Frame(self.df.select(*[f"`{n}`" for n in names]))

    def withColumn(self, name: str, expr: Expr, data_type: type | str | None = None) -> Frame:
        """Adds or replaces; a declared type is cast to."""
        c = expr.to_column()
        return Frame(self.df.withColumn(name, c if data_type is None else c.cast(DECLARED.get(data_type, data_type))))

    def filter(self, expr: Expr, use_index: bool = False) -> Frame:
        """use_index: for a table's own frame, through its indexes where they can answer; the rows are those of the scan."""
        if use_index and self._table is not None:
            return Frame(self._table.filtered(expr))
        return Frame(self.df.filter(expr.to_column()), self._table if self._table and not use_index else None)

    def distinct(self) -> Frame:
        return Frame(self.df.distinct())

    def groupBy(self, *keys: str | Expr) -> Grouped:
        return Grouped(self.df, [k.to_column() if isinstance(k, Expr) else F.col(f"`{k}`") for k in keys])

    def join(self, rhs: Frame, on: str | list[str]) -> Frame:
        """Inner equi-join; the keys come once. Spark picks the strategy: small sides are broadcast by measured size, others are merged,
        with skewed keys split."""
        on = [on] if isinstance(on, str) else list(on)
        if clash := (set(self.cols) & set(rhs.cols)) - set(on):
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        return Frame(self.df.join(rhs.df, on, "inner"))

    def limit(self, n: int) -> Frame:
        return Frame(self.df.limit(n))

    def sort(self, *cols: str | Expr) -> Frame:
        """Total order, nulls last; names sort ascending."""
        return Frame(self.df.orderBy(*[(c if c.op in ("asc", "desc") else c.asc()).to_column() if isinstance(c, Expr) else F.col(f"`{c}`").asc_nulls_last() for c in cols]))

    def sample(self, col: str, ratio: float, seed: int | None = None) -> Frame:
        """With replacement; about ratio of the rows."""
        return Frame(self.df.select(f"`{col}`").sample(True, ratio, seed))

    def map_batches(self, func, schema) -> Frame:
        return Frame(self.df.mapInPandas(func, schema))

    def foreach(self, func) -> Pending:
        return Pending(self.df, lambda df: df.foreach(func))

    def agg(self, *exprs) -> Frame:
        return Frame(self.df.agg(*exprs))

    def count(self) -> Pending:
        return Pending(self.df.agg(F.count(F.lit(1)).alias("count")), lambda df: df.first()[0])

    def collect(self) -> Pending:
        return Pending(self.df, lambda df: [r.asDict(recursive=True) for r in df.collect()])

    def execute(self) -> list[dict]:
        return self.collect().execute()

    def toRDD(self):
        from quarry.operators.rows import Rows

        return Rows(self.df.rdd.map(lambda r: r.asDict()))

    def toCSV(self, path: str) -> Pending:
        from quarry.sources import sinks

        return Pending(self.df, lambda df: sinks.csv(df, path))

    def toText(self, path: str) -> Pending:
        from quarry.sources import sinks

        if len(self.cols) != 1:
            raise ValueError("a text file has one column")
        return Pending(self.df, lambda df: sinks.text(df, path))

    def toParquet(self, path: str) -> Pending:
        from quarry.sources import sinks

        return Pending(self.df, lambda df: sinks.parquet(df, path))

    def toTable(self, tables, name: str, partition_cols: list[str] | None = None, categorical_cols: list[str] | None = None, index_cols: list[str] | None = None) -> Pending:
        """index_cols: columns whose indexes are built now; those of the others are built when a filter first asks for them."""
        return Pending(self.df, lambda df: tables.write(df, name, partition_cols or [], categorical_cols or [], index_cols or []))

    def explain(self) -> Report:
        return Report(self.df)
