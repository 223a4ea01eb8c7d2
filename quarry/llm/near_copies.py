"""Near copies by SimHash and word shingles: the groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come by SimHash and Golay keys: a set has two fingerprints of 64 bits, of its hashes and of these mixed, and meets the nearest sets
up to simhash.WIDE bits off that share codewords with it (simhash.nearest). Each candidate is verified by its shingles.

Similar sets may have fingerprints that lie further apart, and a set meets only its nearest, so an exact check follows for what is in
different groups by then. It is a join by prefix filtering: in any one order of all shingles, two sets that similar share one among the first n - ceil(0.8 n) + 1
of each (n shingles). The order is by hash, but shingles that are frequent in a bounded sample come last, the rarest first; the sample
decides what is compared, never what is found. Sets are posted under the shingles of their prefixes, dealt to buckets by hash; sets that meet
and whose sizes allow 0.8 are compared: first by the parities of their hashes' low bits, of which no more can differ than the sets have
shingles apart (so no link is lost), and what passes in full.

Steps: documents of equal sets are one class; classes meet; pairs that met are joined to their parities, and those left to their sets, and
verified; components follow. This is done in three turns: by Golay keys; by shingles, each set with a few others for each of its shingles;
and all sets with a shingle in common that are in different groups by then, since all pairs of a group would be the square of its size. What is in one group
already needs no link, so none is lost that would change a group.
Sets hold 64-bit hashes (XXH64, seed 42), and classes are told apart by a 64-bit hash of the set.

Defined cases: a text of fewer than five words is one shingle; texts without words (null, blank) have the empty set and are one class. Which
row of a group stays is common.one_each's choice (least doc_id, null last; ties by text hash, then by the other columns). Very long texts are
shingled whole. An empty table gives an empty one. Extra columns pass, of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, simhash
from quarry.llm.common import Scratch, components, pieces

SHINGLE = 5
#: Similarity asked for, as a fraction.
OVER, UNDER = 4, 5
#: Texts of the sample, how often a shingle must occur in it to be frequent, and how many frequent ones are kept.
SAMPLE, OFTEN, FREQUENT = 8000, 6, 50_000
#: How many sets those of a shingle meet before all that are then still in different groups meet; which shingles add others.
FEW, LARGE, EACH = 2, 32, 2


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n, h = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(line[p:q], 42) for p, q in zip((end - size)[:n].tolist(), end[-n:].tolist())), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (OVER + UNDER) * both >= OVER * (len(a) + len(b))


def parities(s: np.ndarray) -> bytes:
    """Of how many shingles have each value of their low bits: a bit each, two to four bits a shingle."""
    size = 8 << max(0, len(s) // 4).bit_length()
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def marks(s: np.ndarray) -> np.ndarray:
    """The parities for seven low bits, as two signed numbers."""
    return np.packbits(np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1, bitorder="little").view(np.int64)


def possible(a: bytes, b: bytes, m: int, n: int) -> bool:
    """Whether sets of m and n shingles with these parities can be similar."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (OVER + UNDER) <= (UNDER - OVER) * (m + n)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of a set, what it is posted under, in the order of all shingles. frequent: hashes, ascending; rank: their place in the order, from 1."""
    n = len(s)
    if not n:
        return s
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        s = s[np.argsort(np.where(frequent[at] == s, rank[at], 0), kind="stable")]
    return s[: n - -(-OVER * n // UNDER) + 1]


def frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample of about SAMPLE of n texts (columns h, text), ascending, and their ranks by rising frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            got = [shingles(t).view(np.int64) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], ["s"])

    some = texts.filter(F.pmod("h", F.lit(max(1, n // SAMPLE))) == 0).select("text").distinct().mapInArrow(run, "s long")
    top = some.groupBy("s").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    hashes = np.array([r.s for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(top) - np.arange(len(top)))[order]


#: Whether sets of these sizes can be similar, of which so many shingles are left from the first common one on, and of whose hashes' last seven
#: bits the parities are p and q.
FITS = f"{OVER + UNDER} * least(a_left, b_left) >= {OVER} * (a_n + b_n) and {OVER + UNDER} * (bit_count(a_p ^ b_p) + bit_count(a_q ^ b_q)) <= {UNDER - OVER} * (a_n + b_n)"


def golay(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): sets (classes: key, n, f, g) whose fingerprints are equal or near, by SimHash and Golay keys; each with a few, of equal ones with the first."""
    prints = classes.filter("n > 0").select("key", F.posexplode(F.array("f", "g")).alias("kind", "fp"))
    heads = scratch.cut(prints.groupBy("kind", "fp").agg(F.min("key").alias("one")), "heads")
    end = lambda c: heads.select("kind", F.col("fp").alias(c), F.col("one").alias(f"{c}_one"))
    near = simhash.nearest(heads, heads.count()).join(end("a"), ["kind", "a"]).join(end("b"), ["kind", "b"]).select("a_one", "b_one")
    met = near.unionByName(prints.join(heads, ["kind", "fp"]).select(F.col("key").alias("a_one"), F.col("one").alias("b_one"))).filter("a_one <> b_one")
    return met.select(F.least("a_one", "b_one").alias("a"), F.greatest("a_one", "b_one").alias("b")).distinct()


def stars(posts: DataFrame) -> DataFrame:
    """(a, b): of each shingle (posts: s, key) a few sets, each with all the others. FEW are the least by hashes that are the same for all shingles,
    so copies mostly meet the same ones; where more than LARGE sets have the shingle, one in EACH shingles adds as many by hashes of its own,
    so that what is far from the first meets others, different ones for each shingle."""
    salts = [F.lit(i * 0x5851F42D4C957F2D & (1 << 63) - 1) for i in range(1, FEW + 1)] + [F.xxhash64("s", F.lit(i)) for i in range(FEW)]
    least = [F.min(F.col("key").bitwiseXOR(x)).alias(f"m{i}") for i, x in enumerate(salts)]
    ones = F.array(*[F.col(f"m{i}").bitwiseXOR(x) for i, x in enumerate(salts)])
    many = (F.col("c") > LARGE) & (F.pmod("s", F.lit(EACH)) == 0)
    lead = posts.groupBy("s").agg(*least, F.count(F.lit(1)).alias("c")).select("s", F.array_distinct(F.when(many, ones).otherwise(F.slice(ones, 1, FEW))).alias("ones"))
    met = posts.select("s", "key").join(lead, "s").select("key", F.explode("ones").alias("one")).filter("key <> one")
    return met.select(F.least("key", "one").alias("a"), F.greatest("key", "one").alias("b")).distinct()


def rest(posts: DataFrame) -> DataFrame:
    """(a, b): all pairs of sets with a shingle in common that are of different groups and fit (posts: s, key, n, left, p, q, root)."""
    size = posts.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    # what is of a shingle's largest group meets only what isn't, so that a large group doesn't meet itself
    main = size.groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("s", "main")
    known = posts.join(main, "s")
    side = lambda c: known.select("s", "main", *[F.col(x).alias(f"{c}_{x}") for x in ("key", "n", "left", "p", "q", "root")])
    both = side("a").filter("a_root <> main").join(side("b").drop("main"), "s").filter(f"a_root <> b_root and {FITS}")
    return both.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root): h is the text's hash, root names the group of documents that links of 0.8 or more lead to."""
    scratch = Scratch(docs.sparkSession, "copies")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    order = frequent(rows.select("h", "text"), rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            key = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            pre = pa.array([prefix(s, *order).view(np.int64) for s in sets], pa.list_(pa.int64()))
            par = pa.array([parities(s) for s in sets], pa.binary())
            p, q = np.array([marks(s) for s in sets], np.int64).reshape(-1, 2).T
            f, g = (pa.array(np.array([simhash.of_hashes(s) for s in side], np.uint64).view(np.int64)) for side in (sets, map(simhash.mixed, sets)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array([len(s) for s in sets], pa.int32()), pre, par, pa.array(p), pa.array(q), f, g], ["doc_id", "h", "key", "n", "prefix", "odd", "p", "q", "f", "g"])

    found = scratch.cut(rows.mapInArrow(run, "doc_id long, h long, key long, n int, prefix array<long>, odd binary, p long, q long, f long, g long"), "found")
    classes = scratch.cut(found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "odd", "p", "q", "f", "g")], F.min("h").alias("h")), "classes")
    posts = classes.select("key", "n", "p", "q", F.posexplode("prefix").alias("at", "s")).select("s", "key", "n", (F.col("n") - F.col("at")).alias("left"), "p", "q")
    # most shingles are one set's own; written, so that the join may split what is frequent
    often = scratch.cut(posts.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("s"), "often")
    posts = scratch.cut(posts.join(often, "s"), "posts")
    scratch.drop("often")
    side = lambda t, c, *cols: t.select(F.col("key").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [possible(*x) for x in zip(*(b.column(c).to_pylist() for c in ("a_odd", "b_odd", "a_n", "b_n")))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["key", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "a_set", "b_set"):
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("a_set").to_pylist(), b.column("b_set").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links, root = None, None
    for turn in range(3):
        if turn == 0:
            met = golay(classes, scratch)
        elif turn == 1:
            met = stars(posts)
        else:
            own = posts.join(root.withColumnRenamed("u", "key"), "key", "left")
            met = rest(own.select("s", "key", "n", "left", "p", "q", F.coalesce("root", "key").alias("root")))
        if root is not None:
            end = lambda c: root.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
            met = met.join(end("a"), "a", "left").join(end("b"), "b", "left").filter("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
        apart = met.join(side(classes, "a", "n", "odd"), "a").join(side(classes, "b", "n", "odd"), "b").filter(f"{UNDER} * least(a_n, b_n) >= {OVER} * greatest(a_n, b_n)")
        pairs = scratch.cut(apart.mapInArrow(sift, "a long, b long"), f"pairs{turn}")
        # written, so that its size is known: texts needn't be shuffled where it is small enough to be told to all
        needed = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        needed = scratch.cut(needed.join(classes.select("key", "h"), "key"), f"needed{turn}")
        whole = scratch.cut(rows.join(needed, "h").select("key", "text").dropDuplicates(["key"]).mapInArrow(sets, "key long, set binary"), f"sets{turn}")
        new = scratch.cut(pairs.join(side(whole, "a", "set"), "a").join(side(whole, "b", "set"), "b").mapInArrow(verify, "a long, b long"), f"links{turn}")
        scratch.drop(f"pairs{turn}", f"needed{turn}", f"sets{turn}")
        links = new if links is None else links.unionByName(new)
        root = components(links, scratch, f"cc{turn}_")
    scratch.drop("posts", "classes", "heads", "links0", "links1", "links2")
    return found.select("doc_id", "h", "key").join(root, F.col("key") == F.col("u"), "left").select("doc_id", "h", F.coalesce("root", "key").alias("root"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies."""
    return common.one_each(docs, labelled(docs))
