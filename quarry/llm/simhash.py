"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit i is 1 if more than half of the shingles' XXH64 values (seed 42) have bit i set. Fingerprints link at
MOST or fewer differing bits; documents' components are those of the links.

Candidates come from the perfect binary Golay code (23, 12, 7). The fingerprint is cut in three segments of 22, 21 and 21 bits. A segment's
codewords are those next to it or to it with one bit flipped (about 5 of 12 bits each); if two segments differ in at most one bit, the codeword
next to either is among the other's. Three differing bits lie in one of two ways:
- no segment holds more than one. Then one fingerprint's codewords of segments 1 and the own codewords of 2 and 3 (under which it is posted)
  meet the other's own codeword of 1 and codewords of 2 and 3 (under which it asks): 36 bits.
- one segment holds two or three. Then of the other two one is equal and the other differs in one bit at most: the equal one's bits with the
  other's codeword, for each of the six pairs, 33 or 34 bits.
So each distinct fingerprint is posted under about 11 keys and asks under about 60; every link meets under a key, and is verified on all 64
bits. Neither step has a cap, and fingerprints that are not near meet by chance once in some 2^25 pairs (counted on random ones).

Defined cases: null or blank text has no words, hence fingerprint zero, linked as any other. Null doc_ids keep their rows; they never name
a component unless no document of it has an id (then component_id is null). Repeated rows stay repeated. Extra columns are ignored.

``nearest`` looks further, for near copies that are verified by their shingles: fingerprints meet where two segments share a codeword each,
both theirs or those next to them. Segments with at most two differing bits surely do, so two fingerprints of up to 5 differing bits surely
meet and most of up to WIDE; it finds the nearest of those met, not all. Keys are dealt to buckets by their second codeword alone, of which
a segment has at most six: a bucket gives two rows at most for a fingerprint and two segments, so that a fingerprint has no more than 36 in
all, however many others it meets and however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import Scratch, components, forest, pieces

MOST = 3
#: Fixed values of the code: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and the bits of each segment.
GENERATOR = 0b110001110101
CUTS = ((0, 22), (22, 21), (43, 21))
#: Bytes of postings that one task brings together, and pairs that it verifies at once.
BUCKET_BYTES, PAIRS = 8 << 20, 1 << 21
PIECE = 1 << 16
#: Of the wider search: differing bits, and how many others a fingerprint meets on either side under one key.
WIDE, CROWD = 12, 128
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """As an unsigned number; memory is bounded by PIECE shingles besides the text itself."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first, last = (end - size)[:n].tolist(), end[-n:].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, PIECE):
        got = np.array([h(line[p:q], 42) for p, q in zip(first[k : k + PIECE], last[k : k + PIECE])], np.uint64)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of hashes (uint64); zero of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), PIECE):
        ones += np.unpackbits(h[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """Other hashes of hashes (uint64)."""
    x = x * _MIX
    return (x ^ x >> np.uint64(32)) * _MIX


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of x^i by the generator, for 23 bits; and by remainder the error of least weight."""
    rest = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        rest.append(r)
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[rest[i]] = 1 << i
        for j in range(i):
            error[rest[i] ^ rest[j]] = 1 << i | 1 << j
            for k in range(j):
                error[rest[i] ^ rest[j] ^ rest[k]] = 1 << i | 1 << j | 1 << k
    halves = np.zeros((2, 4096), np.int64)
    for i in range(23):
        halves[i // 12] ^= np.where(np.arange(4096) >> i % 12 & 1, rest[i], 0)
    return halves, error


_HALVES, _ERROR = _tables()


def decode(x: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the one codeword within three bits of each 23-bit word."""
    return (x ^ _ERROR[_HALVES[0][x & 0xFFF] ^ _HALVES[1][x >> 12]]) >> 11


def _product(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the codewords of several segments (flat, with each fingerprint's number of them): all combinations, 12 bits each, and whose they are."""
    key, count = parts[0]
    shift = 0
    for value, n in parts[1:]:
        shift += 12
        total = count * n
        who = np.repeat(np.arange(len(n)), total)
        at = np.arange(len(who)) - np.repeat(np.cumsum(total) - total, total)
        start, other = np.cumsum(count) - count, np.cumsum(n) - n
        key = key[start[who] + at // n[who]] | value[other[who] + at % n[who]] << shift
        count = total
    return key, np.repeat(np.arange(len(count)), count)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in CUTS]


def _near(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The codewords next to segments of w bits or to them with one bit flipped: flat, with each segment's number of them."""
    all_ = np.sort(np.stack([decode(x)] + [decode(x ^ (1 << i)) for i in range(w)], axis=1), axis=1)
    fresh = np.ones(all_.shape, bool)
    fresh[:, 1:] = all_[:, 1:] != all_[:, :-1]
    return all_[fresh], fresh.sum(axis=1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints (uint64): the keys they are posted under and whose those are (indices); the keys they ask under and whose those are."""
    seg = _segments(fp)
    one = np.ones(len(fp), np.int64)
    own, near = [(decode(x), one) for x in seg], [_near(x, w) for x, (_, w) in zip(seg, CUTS)]
    posted, asked = [_product(near[0], own[1], own[2])], [_product(own[0], near[1], near[2])]
    tag = 0
    for i, same in enumerate(seg):
        for j in range(3):
            if i != j:
                tag += 1
                for out, (code, who) in ((posted, _product(own[j])), (asked, _product(near[j]))):
                    out.append((same[who] | code << 22 | tag << 36, who))
    (pk, pw), (ak, aw) = ([np.concatenate(x) for x in zip(*side)] for side in (posted, asked))
    return pk, pw, ak, aw


def linked(posted: np.ndarray, of: np.ndarray, asked: np.ndarray, by: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints that meet under a key. PAIRS at once, so a full key costs time, not memory."""
    order = np.argsort(posted, kind="stable")
    posted, of = posted[order], of[order]
    lo, hi = np.searchsorted(posted, asked, "left"), np.searchsorted(posted, asked, "right")
    met = hi > lo
    lo, n, by = lo[met], (hi - lo)[met], by[met]
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    done, total = 0, np.cumsum(n)
    while done < len(n):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        m, start = n[done:stop], lo[done:stop]
        for skip in range(0, int(m.max()), PAIRS):  # more than PAIRS only for a lone asker under a very full key
            part = np.clip(m - skip, 0, PAIRS)
            who = np.repeat(np.arange(len(m)), part)
            at = np.arange(len(who)) - np.repeat(np.cumsum(part) - part, part) + skip
            x, y = by[done:stop][who], of[start[who] + at]
            ok = (x < y) & (np.bitwise_count(x ^ y) <= most)
            if ok.any():
                a, b = forest(np.concatenate([a, x[ok]]), np.concatenate([b, y[ok]]))
        done = stop
    return a, b


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as signed long, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            got = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """(a, b): spanning forests of the links between distinct fingerprints (column fp), by Golay keys."""
    if most > MOST:
        raise ValueError("three segments of a code that mends one bit each find links of up to 3 bits")
    buckets = common.buckets(distinct.sparkSession, n * 72 * 12, BUCKET_BYTES)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 20_000):
                own = fp[k : k + 20_000]
                posted, of, asked, by = keys(own)
                parts = []
                for key, val in ((posted, own[of]), (asked, own[by])):
                    mixed = key.view(np.uint64) * _MIX
                    mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX
                    at = ((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(at, kind="stable")
                    parts.append(((mixed >> np.uint64(32)).astype(np.uint32)[order], val[order], np.searchsorted(at[order], np.arange(buckets + 1))))
                (pk, pv, ps), (ak, av, as_) = parts
                used = np.nonzero((np.diff(ps) > 0) | (np.diff(as_) > 0))[0].tolist()
                rows = [(i, pk[ps[i] : ps[i + 1]].tobytes(), pv[ps[i] : ps[i + 1]].tobytes(), ak[as_[i] : as_[i + 1]].tobytes(), av[as_[i] : as_[i + 1]].tobytes()) for i in used]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 5)], ["bucket", "pk", "pv", "ak", "av"])

    def meet(t: pa.Table) -> pa.Table:
        col = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        a, b = linked(col("pk", np.uint32), col("pv", np.uint64), col("ak", np.uint32), col("av", np.uint64), most)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    posts = distinct.select("fp").mapInArrow(post, "bucket int, pk binary, pv binary, ak binary, av binary")
    return posts.groupBy("bucket").applyInArrow(meet, "a long, b long")


def wide_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints (uint64): the keys that near ones share (two segments' codewords, and in bits 24 and 25 which two) and whose those are."""
    near = [_near(x, w) for x, (_, w) in zip(_segments(fp), CUTS)]
    out = [_product(near[i], near[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.concatenate([k | tag << 24 for tag, (k, _) in enumerate(out)]), np.concatenate([w for _, w in out])


def met(key: np.ndarray, fp: np.ndarray, most: int = WIDE, crowd: int = CROWD) -> tuple[np.ndarray, ...]:
    """(what key >> 24 is, side, a, b, d): for each fingerprint a the nearest lesser (side 0) and greater (side 1) b, d bits off, of those with a key of its.

    Under a key, each meets the next ``crowd`` of an order by hash that differs from key to key.
    """
    order = np.lexsort((mixed(fp ^ mixed(key.astype(np.uint64))), key))
    key, fp = key[order], fp[order]
    far = np.full((2, len(key)), most + 1, np.uint8)
    best = np.zeros((2, len(key)), np.uint64)
    at = np.arange(len(key))
    for step in range(1, crowd + 1):
        at = at[: np.searchsorted(at, len(key) - step)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        d = np.bitwise_count(fp[at] ^ fp[at + step])
        hit = d <= most
        i, d = at[hit], d[hit]
        for me, other in ((i, i + step), (i + step, i)):
            side = (fp[other] > fp[me]).astype(np.int64)
            less = d < far[side, me]
            side, to, of = side[less], me[less], other[less]
            far[side, to], best[side, to] = d[less], fp[of]
    out = []
    for side in range(2):
        i = np.nonzero(far[side] <= most)[0]
        t, a, b, d = key[i] >> 24, fp[i], best[side][i], far[side][i]
        order = np.lexsort((b, d, a, t))
        t, a, b, d = t[order], a[order], b[order], d[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1])
        out.append((t[first], np.full(first.sum(), side), a[first], b[first], d[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: one for all of a kind, two segments and the second's codeword, as their fingerprints are much the same."""
    return ((mixed((key >> 12).view(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def nearest(distinct: DataFrame, n: int) -> DataFrame:
    """(kind, a, b): of n distinct fingerprints (columns kind from 0, fp), each with the nearest of its kind up to WIDE bits off that it meets by
    Golay keys: a lesser and a greater one for each two segments."""
    buckets = common.buckets(distinct.sparkSession, n * 85 * 12, BUCKET_BYTES)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                kind, own = (b.column(c).slice(k, 20_000).to_numpy(zero_copy_only=False) for c in range(2))
                key, of = wide_keys(own.view(np.uint64))
                key |= kind.astype(np.int64)[of] << 26
                at = dealt(key, buckets)
                order = np.argsort(at, kind="stable")
                key, val, start = key.astype(np.uint32)[order], own[of][order], np.searchsorted(at[order], np.arange(buckets + 1))
                used = np.nonzero(np.diff(start))[0].tolist()
                cut = lambda x: pa.array([x[start[i] : start[i + 1]].tobytes() for i in used], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), cut(key), cut(val)], ["bucket", "k", "v"])

    def meet(t: pa.Table) -> pa.Table:
        col = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        tag, side, a, b, d = met(col("k", np.uint32), col("v", np.uint64))
        return pa.table({"t": tag.astype(np.int32), "side": side.astype(np.int32), "a": a.view(np.int64), "b": b.view(np.int64), "d": d.astype(np.int32)})

    posts = distinct.select(F.col("kind").cast("int"), "fp").mapInArrow(post, "bucket int, k binary, v binary")
    found = posts.groupBy("bucket").applyInArrow(meet, "t int, side int, a long, b long, d int")
    least = found.groupBy("t", "side", "a").agg(F.min(F.struct("d", "b")).alias("m"))
    return least.select(F.shiftright("t", 2).alias("kind"), F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def _named(found: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints of found (doc_id, fp): the smallest doc_id that has it, and its component."""
    classes = scratch.cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    root = components(links(classes, classes.count(), most), scratch)
    return classes.join(root, classes.fp == root.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = MOST) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id that links of at most ``most`` bits lead to."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.cut(fingerprints(docs, shingle), "fp")
    named = _named(found, scratch, most)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(label, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, most: int = MOST) -> DataFrame:
    """One row of each component: that of the least doc_id (null last), then text hash."""
    scratch = Scratch(docs.sparkSession, "simhash")
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    found = scratch.cut(fingerprints(texts.select(F.col("h").alias("doc_id"), "text").distinct(), shingle), "fp")
    named = _named(found, scratch, most)
    hashes = found.join(named, "fp").select(F.col("doc_id").alias("h"), "root").distinct()
    groups = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).join(hashes, "h").select("doc_id", "h", "root")
    return common.one_each(docs, groups)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
