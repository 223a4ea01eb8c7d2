"""What the training-data operators share: tables, durable cuts of lineage, hashes, connected components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

#: Words of the contracts: runs of bytes that are neither blank nor a control blank (x20, x09-x0D), as bytes.split() cuts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents whose crc32 leaves this remainder are held out of all training.
FOLDS = 5
#: Text bytes that a Python worker turns into objects at once.
BATCH_BYTES = 8 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation.

    Tables that a returned DataFrame still reads must stay; ``drop`` removes those that are used up.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quarry-{what}-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """by: columns whose values get folders of their own. The write's shuffles go with it: what follows reads the table."""
        was = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_CLEAN, was)
        return self.again(df.schema, name)

    def again(self, schema, name: str) -> DataFrame:
        """What is left of a table that was cut."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], *columns: str | int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of ``columns`` (strings or bytes) take no more than ``most`` bytes in each, but for single longer ones."""
    for b in batches:
        size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        part = np.cumsum(size) // most
        edge = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), b.num_rows]
        for low, high in zip(edge, edge[1:]):
            if high > low:
                yield b.slice(low, high - low)


def held_out(doc_id) -> F.Column:
    """crc32 of the id's decimal text leaves 0 by FOLDS; a null id is held out, since it can't be shown to be a training row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of undirected edges: each node that isn't its component's least, and that least node."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(u, root) for each node u of the edges (a, b) but the roots: alternating large and small stars until nothing moves.

    Every round is two hash aggregates with map-side minima and two joins; a star's hot centre is spread by the adaptive skew join.
    """

    def turn(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.unionByName(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
    at = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0")
    was, k = state(at), 0
    while was[0]:
        k += 1
        at = scratch.cut(turn(at), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        if (now := state(at)) == was:
            break
        was = now
    return at.select(F.col("a").alias("u"), F.col("b").alias("root"))


def buckets(spark: SparkSession, amount: int, per: int) -> int:
    """How many groups to deal ``amount`` into: one for each ``per``; where that is less than the session's partitions, up to sixteen for each."""
    return max(1, -(-amount // per), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * amount // per)))


def one_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of docs, exactly one row of each group: the one of the least doc_id (null last), then text hash. groups: (doc_id, h, root), a row for
    each row of docs; h is xxhash64 of the text. Of rows alike in id and text, the one whose other columns hash least stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    same = groups.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    stay = same.groupBy("root").agg(F.min_by(F.struct("doc_id", "h", "n"), place).alias("s")).select("s.*")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(stay, F.expr("id <=> doc_id and hash = h")).select("row", "id", "hash", "n")
    many = kept.filter("n > 1").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.filter("n = 1").select("row").unionByName(many.select("row")).select("row.*")
