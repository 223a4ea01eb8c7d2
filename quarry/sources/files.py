"""Paths as Hadoop sees them, so that local folders and remote stores are treated alike."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Rows that are looked at for what a row takes.
SAMPLE = 100


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _seen(name: str) -> bool:
    return name[0] not in "._"


def expand(spark: SparkSession, path: str, deep: bool = False) -> list[str]:
    """A glob, a folder (its files, without hidden ones; those of subfolders only if deep) or one file, sorted by name; ValueError if there are none."""
    p, fs = _fs(spark, path)
    waiting, out = [(s, True) for s in fs.globStatus(p) or []], []
    while waiting:
        s, top = waiting.pop()
        if s.isFile():
            out.append(s.getPath().toString())
        elif top or deep:
            waiting += [(x, False) for x in fs.listStatus(s.getPath()) if _seen(x.getPath().getName())]
    if not out:
        raise ValueError(f"no files at {path}")
    return sorted(out)


def marks(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, bytes and time of change of each file."""
    out = []
    for f in paths:
        p, fs = _fs(spark, f)
        s = fs.getFileStatus(p)
        out.append([f, s.getLen(), s.getModificationTime()])
    return out


def folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def stats(spark: SparkSession, path: str, kind: str = "parquet") -> dict[str, int]:
    """Of all files at path: how many, bytes, rows, the chunks that Spark deals them out in, and the bytes and lines of a sample (the first
    SAMPLE rows). Rows of Parquet come from the footers, those of text and CSV from a scan."""
    found = expand(spark, path, deep=True)
    sizes = [m[1] for m in marks(spark, found)]
    df = spark.read.parquet(path) if kind == "parquet" else spark.read.text(path)
    rows = df.count()
    lines = rows - (len(found) if kind == "csv" else 0)
    some = df.limit(SAMPLE).select(F.to_json(F.struct("*")).alias("value") if kind == "parquet" else F.col("value"))
    sample = some.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).first()
    return {"files": len(found), "bytes": sum(sizes), "rows": max(0, lines), "chunks": df.rdd.getNumPartitions(), "sample_rows": sample.n, "sample_bytes": sample.bytes, "average_row": sum(sizes) // max(1, rows)}
