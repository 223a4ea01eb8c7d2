"""What Catalyst made of a plan: the evidence for push-down, pruning and fusion, read from the formatted plan."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame


class Report:
    def __init__(self, df: DataFrame):
        self._df = df

    @cached_property
    def text(self) -> str:
        jdf = self._df._jdf
        return jdf.queryExecution().explainString(self._df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    @property
    def pushed_filters(self) -> list[str]:
        return [x for m in re.findall(r"PushedFilters: \[(.*?)\]\n", self.text) for x in re.findall(r"\w+\([^()]*\)", m)]

    @property
    def read_columns(self) -> list[str]:
        return [x.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>\n", self.text) for x in m.split(",") if x]

    @property
    def partition_filters(self) -> list[str]:
        return [m for m in re.findall(r"PartitionFilters: \[(.*?)\]\n", self.text) if m]

    @property
    def shuffles(self) -> int:
        return len(re.findall(r"^\(\d+\) Exchange\b", self.text, re.M))

    @property
    def python(self) -> bool:
        return bool(re.search(r"Python|Pandas|Arrow", self.text))

    def __str__(self) -> str:
        return self.text
