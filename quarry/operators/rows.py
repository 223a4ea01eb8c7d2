"""Rows: an untyped pipeline over an RDD of Python objects, lazy until ``execute``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Rows:
    def __init__(self, rdd, finish: Callable | None = None):
        self.rdd, self._finish = rdd, finish

    def map(self, func: Callable[[Any], Any]) -> Rows:
        return Rows(self.rdd.map(func))

    def filter(self, func: Callable[[Any], Any]) -> Rows:
        return Rows(self.rdd.filter(func))

    def groupByKey(self) -> Rows:
        """(key, value) pairs to (key, [values]); keys keep their types, the order of groups and values is open."""
        return Rows(self.rdd.groupByKey().mapValues(list))

    def collect(self) -> Rows:
        return Rows(self.rdd, lambda rdd: rdd.collect())

    def execute(self) -> Any:
        return (self._finish or (lambda rdd: rdd.collect()))(self.rdd)
