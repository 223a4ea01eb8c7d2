"""Exact substring dedup: bytes covered by a LENGTH-byte string that also starts in a document of smaller doc_id are removed.

1. Anchors. Of the 32 hashed 19-grams in a window of 50 bytes, the least is its anchor (the first, if several are). Equal windows have
   equal anchors at equal places, so a window can only repeat where its anchor does. Documents are dealt to groups by a hash. A batch of documents
   settles itself which anchors two of its documents hold, tells their groups, and sends only the anchor on; the other anchors go with their
   document's id. A bucket of anchors tells the groups which of these occur in two documents of different ids. So an anchor that very many
   documents hold costs its bucket an entry a batch.
2. Contexts. The windows of one anchor are consecutive; the bytes they span are a context. Each group of documents sends its distinct
   contexts of repeated anchors, with the least doc_id of each. A passage that very many documents hold is sent once a group.
3. Repeats. A bucket of anchors has every context of its anchors. An anchor with one distinct context is settled: all its windows first
   occur in that context's least document. The others' contexts become strings of bytes, in which the anchor itself is one symbol, so all
   windows have WIDE = 32 symbols. A string is read in blocks of BLOCK = 8 symbols, once from each of its first eight places, so every
   window is a run of four blocks; the block is the letter of what follows. These strings are sorted in shards; the shards'
   Burrows-Wheeler transforms are merged pairwise by refining the interleave one letter at a time, which tells after four rounds which
   suffixes share WIDE symbols, without sorting them again. Each such interval's least doc_id is its windows' first document.
4. Removal. Groups of documents get back, for each context they sent, the first document of each of its windows; what first occurs in a
   document of smaller id is covered, and the rest is kept.

Nothing is capped or sampled; steps 1 and 3 only compare what has the same hash, step 3 and 4 compare bytes.

Defined cases: a null text is empty. A null doc_id counts as the greatest: it is searched, but takes nothing from others. Documents of equal id
take nothing from each other. Texts under LENGTH bytes are kept whole. Repeated rows are repeated in the result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, buckets, pieces

LENGTH, GRAM, BLOCK = 50, 19, 8
WIDE = LENGTH - GRAM + 1
#: Text bytes in a group of documents, in one of its rows (longer if a document is) or behind a bucket of anchors; contexts in a shard; null ids.
GROUP_BYTES, PIECE_BYTES, BUCKET_BYTES, SHARD, LAST = 4 << 20, 1 << 19, 32 << 20, 1 << 12, (1 << 63) - 1
#: Text bytes that are dealt out at once: the more, the better they compress.
DEALT = 32 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n consecutive items, by doubling."""
    w = 1
    while 2 * w <= n:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (n - w)], x[n - w :]) if n > w else x


def hashes(raw: bytes) -> np.ndarray:
    """Of every GRAM bytes."""
    h, have, w = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), {}, 1
    have[1] = h
    while 2 * w <= GRAM:
        h = h[:-w] * _power(w) + h[w:]
        w *= 2
        have[w] = h
    n, at, out = len(raw) - GRAM + 1, 0, None
    for w in sorted(have, reverse=True):
        if GRAM - at >= w and GRAM & w:
            part = have[w][at : at + n]
            out = part if out is None else out * _power(w) + part
            at += w
    out = out ^ out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams; and of the windows of LENGTH bytes, the least hash in each."""
    h = hashes(raw)
    return h, _slide(h, WIDE, np.minimum)


def contexts(h: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first window, last window, place of the anchor."""
    # the first gram of each window that has its least hash: step on from each window's start over places that could be anchors
    top = _slide(np.concatenate([np.zeros(WIDE - 1, np.uint64), least, np.zeros(WIDE - 1, np.uint64)]), WIDE, np.maximum)
    could = top == h
    place = np.nonzero(could)[0]
    at = (np.cumsum(could) - could)[: len(least)]
    while True:
        wrong = np.nonzero(h[place[at]] != least)[0]
        if not len(wrong):
            break
        at[wrong] += 1
    own = place[at]
    first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
    return first, np.concatenate([first[1:], [len(own)]]) - 1, own[first]


def _changes(x: np.ndarray) -> np.ndarray:
    """The first of each run of equal items."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def codes(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket above 32 bits, the rest of the hash below."""
    return (h >> np.uint64(32)) % np.uint64(n) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^32."""
    return np.sort(key.astype(np.int64) << 32 | np.arange(len(key))) & 0xFFFFFFFF


def _ranks(key: np.ndarray) -> np.ndarray:
    """Of each item, the number of distinct smaller ones."""
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(key) else 0
    return out


class Transform:
    """The Burrows-Wheeler transform of strings that each end in a letter 0 of their own, in the order of the strings."""

    def __init__(self, last: np.ndarray, place: np.ndarray, strings: int):
        #: last[i]: the letter before the i-th suffix (0 before a string's start); place[i]: where that suffix starts; ends first.
        self.last, self.place, self.strings = last, place, strings

    @classmethod
    def of(cls, text: np.ndarray, begin: int) -> Transform:
        """text: letters, each string's 0 behind it; places are counted from begin."""
        n = len(text)
        ends = np.nonzero(text == 0)[0]
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            behind = np.zeros(n, np.int64)
            behind[: n - step] = rank[step:] + 1
            rank = _ranks(rank * (int(rank.max()) + 2 + n) + behind)
            if int(rank.max()) == n - 1:
                break
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return cls(np.concatenate([[0], text[:-1]])[order], order + begin, len(ends))


def merge(a: Transform, b: Transform, rounds: int, final: bool = False) -> tuple[Transform, np.ndarray]:
    """The transform of both collections, and for each suffix its interval: those that share ``rounds`` letters have the same number.

    Each round puts every suffix where its letter and the last round's order say (a stable sort of single letters); the interleave is final
    when a round moves nothing (a final merge, of which only the intervals are asked, ends with ``rounds``). Intervals part where the letters or the last round's intervals differ; string ends equal nothing.
    """
    n, ends = len(a.last) + len(b.last), a.strings + b.strings
    side = np.zeros(n, bool)
    side[len(a.last) :] = True
    part = np.zeros(n, np.int64)
    shared, k = None, 0
    head = np.concatenate([np.zeros(a.strings, bool), np.ones(b.strings, bool)])
    while True:
        letter = np.empty(n, np.int64)
        letter[~side], letter[side] = a.last, b.last
        order = _order(letter)[ends:]  # zeros first: what stands there are the ends, in the strings' order
        new = np.concatenate([head, side[order]])
        s, p = letter[order], part[order]
        fresh = np.ones(n, bool)
        fresh[ends + 1 :] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
        now = np.cumsum(fresh)
        k += 1
        if k == rounds:
            shared = now
        still = n == 0 or bool((new == side).all()) and now[-1] == part[-1]
        side, part = new, now
        if k >= rounds and (still or final):
            break
    last, place = np.empty(n, np.int64), np.empty(n, np.int64)
    last[~side], last[side] = a.last, b.last
    place[~side], place[side] = a.place, b.place
    # intervals were numbered in the order of that round; suffixes that moved since stayed within their interval
    return Transform(last, place, ends), shared


def repeats(strings: list[np.ndarray], shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings of symbols from 1 below 2^16: starts of the strings in their concatenation, each with a 0 behind it; its suffixes, and
    their intervals of WIDE symbols."""
    size = np.array([len(s) for s in strings])
    return intervals(np.concatenate(strings), size, shard)


def intervals(symbols: np.ndarray, size: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As repeats, of strings that follow each other without ends."""
    begin = np.cumsum(size + 1) - size - 1
    start = np.append(begin, begin[-1] + size[-1] + 1)
    n = int(start[-1])
    text = np.zeros(n, np.uint64)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(size)), size)] = symbols
    j, many = np.arange(n) - np.repeat(begin, size + 1), np.repeat(size, size + 1)
    # the letter at each place that has BLOCK symbols, by doubling; 0 at those that have fewer
    wide = np.concatenate([text, np.zeros(BLOCK, np.uint64)])
    wide = wide[:-1] << np.uint64(16) | wide[1:]
    wide = _ranks(wide[:-2] << np.uint64(32) | wide[2:])
    w = 4
    while w < BLOCK:
        wide = _ranks(wide[:-w] << 32 | wide[w:])
        w *= 2
    letter = np.where(j + BLOCK <= many, wide[:n] + 1, 0)
    # a string read from its first, second, ... place: what those before it take, then a place for each block
    f, to = j % BLOCK, np.repeat(begin, size + 1)
    to += f * ((many + 1) // BLOCK) + np.minimum(f, (many + 1) % BLOCK) + j // BLOCK
    laid, source = np.empty(n, np.int64), np.empty(n, np.int64)
    laid[to], source[to] = letter, np.arange(n)
    pieces = max(2, -(-len(size) // shard))
    cut = [int(start[len(size) * i // pieces]) for i in range(pieces + 1)]
    parts = [Transform.of(laid[a:b], a) for a, b in zip(cut, cut[1:]) if b > a]
    interval = None
    while len(parts) > 1 or interval is None:
        if len(parts) == 1:
            parts.append(Transform(np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
        pairs = [merge(parts[i], parts[i + 1], WIDE // BLOCK, len(parts) == 2) for i in range(0, len(parts) - 1, 2)]
        interval = pairs[0][1]
        parts = [p for p, _ in pairs] + parts[len(parts) & ~1 :]
    return start, source[parts[0].place], interval


def first_documents(found: dict[bytes, int]) -> dict[bytes, int | np.ndarray]:
    """found: contexts (a byte for the anchor's place, then the bytes) and the least doc_id of each. Of each context the least doc_id of
    each of its windows; one number where that is the same for all because no other context has its anchor."""
    by: dict[bytes, list[bytes]] = {}
    for c in found:
        by.setdefault(c[1 + c[0] : 1 + c[0] + GRAM], []).append(c)
    out: dict[bytes, int | np.ndarray] = {}
    # an anchor's symbol is one above the bytes'; anchors have nothing in common, so they are settled in turns of about two shards
    symbol, mine, marks = 256, [], []
    for group in by.values():
        if len(group) == 1:
            out[group[0]] = found[group[0]]
            continue
        if symbol >= 65_000 or len(mine) >= 2 * SHARD:
            out.update(_turn(mine, marks, found))
            symbol, mine, marks = 256, [], []
        symbol += 1
        mine += group
        marks += [symbol] * len(group)
    if mine:
        out.update(_turn(mine, marks, found))
    return out


def _turn(mine: list[bytes], marks: list[int], found: dict[bytes, int]) -> dict[bytes, np.ndarray]:
    raw = np.frombuffer(b"".join(mine), np.uint8)
    long = np.array([len(c) for c in mine])
    head = np.cumsum(long) - long
    at, size, windows = raw[head].astype(np.int64), long - GRAM, long - LENGTH
    # a context's symbols: its bytes before the anchor, the anchor's symbol, the bytes behind it
    which = np.repeat(np.arange(len(mine)), size)
    off = np.arange(len(which)) - (np.cumsum(size) - size)[which]
    symbols = raw[head[which] + 1 + off + np.where(off > at[which], GRAM - 1, 0)].astype(np.uint16) + np.uint16(1)
    symbols[np.cumsum(size) - size + at] = np.array(marks, np.uint16)
    start, place, interval = intervals(symbols, size)
    which = np.searchsorted(start, np.arange(start[-1]), "right")[place] - 1
    off = place - start[which]
    ok = off < windows[which]
    which, off, interval = which[ok], off[ok], interval[ok]
    ids = np.array([found[c] for c in mine], np.int64)
    least = np.full(int(interval.max()) + 1, LAST, np.int64)
    np.minimum.at(least, interval, ids[which])
    first = np.cumsum(windows) - windows
    flat = np.empty(int(windows.sum()), np.int64)
    flat[first[which] + off] = least[interval]
    return {c: flat[a : a + n] for c, a, n in zip(mine, first.tolist(), windows.tolist())}


def _blobs(bucket: np.ndarray, cols: list[np.ndarray]) -> Iterator[tuple]:
    """(bucket, bytes of each column) for the buckets that have rows."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edge = np.nonzero(np.concatenate([[True], b[1:] != b[:-1]]))[0] if len(b) else np.zeros(0, np.int64)
    cols = [c[order] for c in cols]
    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
        yield (int(b[s]), *(c[s:e].tobytes() for c in cols))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names)


def _from(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


#: A context's first byte: where its anchor starts.
_BYTE = [bytes((i,)) for i in range(WIDE)]


def _packed(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.int32)


def spans(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row; with_kept: also kept (binary), starts and ends (of what is removed)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, many = buckets(spark, size, GROUP_BYTES), buckets(spark, size, BUCKET_BYTES)
    rows = rows.withColumn("d", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    tail = ["kept", "starts", "ends"] * with_kept

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of three kinds: b < 0 codes of repeated anchors for group d; else anchors for bucket b, with documents or (id null) known to repeat."""
        for b in pieces(batches, "text", most=DEALT):
            ids = b.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            d = b.column("d").to_numpy(zero_copy_only=False).astype(np.int32)
            all_, count = [np.zeros(0, np.uint64)], []
            for t in b.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                got = np.unique(codes(_changes(anchors(raw)[1]), many)) if len(raw) >= LENGTH else all_[0]
                all_.append(got), count.append(len(got))
            code, who = np.concatenate(all_), np.repeat(np.arange(len(ids)), count)
            if not len(code):
                continue
            order = np.argsort(code, kind="stable")
            sorted_ = code[order]
            start = np.nonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))[0]
            repeats = np.minimum.reduceat(ids[who[order]], start) != np.maximum.reduceat(ids[who[order]], start)
            twice = np.zeros(len(code), bool)
            twice[order] = np.repeat(repeats, np.diff(start, append=len(code)))
            known = sorted_[start][repeats]
            out = [(k, c, None, None, None) for k, c in _blobs((known >> np.uint64(32)).astype(np.int64), [known.astype(np.uint32)])]
            for k, c, r in _blobs((code[~twice] >> np.uint64(32)).astype(np.int64), [code[~twice].astype(np.uint32), who[~twice]]):
                r = np.frombuffer(r, np.int64)
                edge = np.nonzero(np.concatenate([[True], r[1:] != r[:-1]]))[0]
                out.append((k, c, ids[r[edge]].tobytes(), d[r[edge]].tobytes(), np.diff(edge, append=len(r)).astype(np.uint32).tobytes()))
            for k, c in _blobs(d[who[twice]], [code[twice]]):
                out.append((-1 - k % many, np.unique(np.frombuffer(c, np.uint64)).tobytes(), None, np.int32(k).tobytes(), None))
            yield _batch(out, ["b", "h", "id", "d", "n"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's documents of each group in one row, compressed before they are dealt out."""
        for b in pieces(batches, "text", most=DEALT):
            doc, raw = b.column("doc_id"), [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            cols = [doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), np.array(list(map(len, raw)), np.int64), np.arange(len(raw))]
            out = []
            for d, *mine, which in _blobs(b.column("d").to_numpy(zero_copy_only=False), cols):
                out.append((d, *mine, _packed(b"".join([raw[i] for i in np.frombuffer(which, np.int64).tolist()]))))
            yield _batch(out, ["d", "ids", "none", "sizes", "x"])

    def unbundled(t: pa.Table) -> Iterator[tuple[int | None, bytes]]:
        """Id and bytes of each document."""
        for ids, none, sizes, x in zip(*(t.column(c).to_pylist() for c in ("ids", "none", "sizes", "x"))):
            x, at = zstandard.ZstdDecompressor().decompress(x), 0
            for i, missing, n in zip(*(np.frombuffer(c, k).tolist() for c, k in ((ids, np.int64), (none, bool), (sizes, np.int64)))):
                yield None if missing else i, x[at : at + n]
                at += n

    def shared(t: pa.Table) -> pa.Table:
        k = t.column("b")[0].as_py()
        if k < 0:
            told: dict[bytes, list[bytes]] = {}
            for d, c in zip(t.column("d").to_pylist(), t.column("h").to_pylist()):
                told.setdefault(d, []).append(c)
            out = [(int(np.frombuffer(d, np.int32)[0]), np.unique(np.frombuffer(b"".join(c), np.uint64)).tobytes()) for d, c in told.items()]
            return pa.Table.from_batches([_batch(out, ["d", "h"])])
        none = t.column("id").is_null()
        known, t = _from(t.filter(none), "h", np.uint32), t.filter(pc.invert(none))
        n = _from(t, "n", np.uint32)
        h, ids, d = _from(t, "h", np.uint32), np.repeat(_from(t, "id", np.int64), n), np.repeat(_from(t, "d", np.int32), n)
        if not len(h):
            return pa.Table.from_batches([_batch([], ["d", "h"])])
        order = np.lexsort((ids, h))
        h, ids, d = h[order], ids[order], d[order]
        start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        # sorted by id within a hash: two documents if the first isn't the last
        ends = np.append(start[1:], len(h)) - 1
        twice = np.repeat((ids[start] != ids[ends]) | np.isin(h[start], known), ends - start + 1)
        code = np.uint64(k) << np.uint64(32) | h[twice].astype(np.uint64)
        return pa.Table.from_batches([_batch([(g, np.unique(np.frombuffer(c, np.uint64)).tobytes()) for g, c in _blobs(d[twice], [code])], ["d", "h"])])

    def cut(a: pa.Table, b: pa.Table) -> pa.Table:
        """Rows of three kinds: 0 a document that keeps everything; 1 those of a group with repeated anchors; 2 contexts for a bucket.

        A group numbers its distinct contexts; its documents and its rows for buckets refer to them by number.
        """
        code = np.unique(_from(b, "h", np.uint64))
        out: list[tuple] = []
        found: dict[bytes, int] = {}
        owner, bucket = [], []
        held: list[tuple] = []
        d = a.column("d")[0].as_py() if a.num_rows else 0

        def flush() -> None:
            doc, raw, lo, wide, use = zip(*held)
            about = [[LAST if i is None else i for i in doc], [i is None for i in doc], map(len, raw), map(len, lo)]
            lo, use = np.concatenate(lo), np.array([u for us in use for u in us])
            out.append((1, d, None, None, None, _packed(b"".join(raw)), _packed(_steps(lo)), _packed(np.concatenate(wide).astype(np.uint8)), _packed(_steps(use)), _packed(np.array([list(x) for x in about], np.int64))))
            held.clear()

        pending = 0
        for doc, raw in unbundled(a):
            lo = np.zeros(0, np.int64)
            if len(code) and len(raw) >= LENGTH:
                h, least = anchors(raw)
                lo, hi, at = contexts(h, least)
                got = codes(h[at], many)
                ok = code[np.minimum(np.searchsorted(code, got), len(code) - 1)] == got
                lo, hi, at, got = lo[ok], hi[ok], at[ok], got[ok]
            if not len(lo):
                out.append((0, 0, doc, len(raw), hashlib.sha256(raw).hexdigest(), raw if with_kept else None, None, None, None, None))
                continue
            least_id, use = LAST if doc is None else doc, []
            for s, e, p, g in zip(lo.tolist(), (hi + LENGTH).tolist(), (at - lo).tolist(), (got >> np.uint64(32)).tolist()):
                c = _BYTE[p] + raw[s:e]
                u = found.setdefault(c, len(owner))
                if u == len(owner):
                    owner.append(least_id), bucket.append(g)
                elif least_id < owner[u]:
                    owner[u] = least_id
                use.append(u)
            held.append((doc, raw, lo, hi - lo, use))
            pending += len(raw)
            if pending > PIECE_BYTES:
                flush()
                pending = 0
        if held:
            flush()
        by: dict[int, list] = {}
        for u, c in enumerate(found):
            x = by.setdefault(bucket[u], ([], [], [], []))
            x[0].append(c), x[1].append(owner[u]), x[2].append(len(c)), x[3].append(u)
        for g, (cs, ids, sizes, us) in by.items():
            out.append((2, g, d, None, None, _packed(b"".join(cs)), _packed(np.array(ids, np.int64)), _packed(np.array(sizes, np.uint8)), _packed(_steps(np.array(us))), None))
        cols = list(zip(*out)) or [()] * 10
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "k", "id", "n", "sha", "x", "y", "z", "w", "v"])

    def settle(t: pa.Table) -> pa.Table:
        found: dict[bytes, int] = {}
        sent = []
        for d, x, y, z, w in zip(*(t.column(c).to_pylist() for c in ("id", "x", "y", "z", "w"))):
            x, cs, at = _unpacked(x, np.uint8).tobytes(), [], 0
            for n in _unpacked(z, np.uint8).tolist():
                cs.append(x[at : at + n])
                at += n
            ids = _unpacked(y, np.int64).tolist()
            sent.append((d, cs, ids, np.cumsum(_unpacked(w, np.int32)).tolist()))
            for c, i in zip(cs, ids):
                if i < found.get(c, LAST + 1):
                    found[c] = i
        first = first_documents(found)
        out = []
        for d, cs, ids, us in sent:
            # what first occurs in the group itself, the group knows; the rest is told in runs of windows
            key, value, count = [], [], []
            for c, i, u in zip(cs, ids, us):
                f = first[c]
                if isinstance(f, int):
                    if f < i:
                        key.append(u), value.append(f), count.extend((1, len(c) - LENGTH))
                elif int(f.min()) < i:
                    edge = [*(np.nonzero(f[1:] != f[:-1])[0] + 1).tolist(), len(f)]
                    key.append(u), value.extend(f[e - 1] for e in edge), count.extend((len(edge), *edge))
            if key:
                out.append((d, _packed(_steps(np.array(key))), _packed(np.array(value, np.int64)), _packed(bytes(count))))
        return pa.Table.from_batches([_batch(out, ["d", "key", "first", "n"])])

    def remove(a: pa.Table, b: pa.Table) -> pa.Table:
        docs = [(x, *(_unpacked(c, k) for c, k in zip(cs, (np.int32, np.uint8, np.int32, np.int64)))) for x, *cs in zip(*(a.column(c).to_pylist() for c in "xyzwv"))]
        docs = [(x, np.cumsum(y, dtype=np.int64), z.astype(np.int64), np.cumsum(w, dtype=np.int64), v.reshape(4, -1)) for x, y, z, w, v in docs]
        # the first document of each context, where it is one for all its windows; several: the others
        whole = np.full(max((int(w.max()) + 1 for _, _, _, w, _ in docs), default=0), LAST, np.int64)
        for _, _, _, use, about in docs:
            np.minimum.at(whole, use, np.repeat(about[0], about[3]))
        several: dict[int, tuple[list[int], list[int]]] = {}
        for key, first, n in zip(*(b.column(c).to_pylist() for c in ("key", "first", "n"))):
            first, n, v, u = _unpacked(first, np.int64).tolist(), _unpacked(n, np.uint8).tolist(), 0, 0
            for i in np.cumsum(_unpacked(key, np.int32)).tolist():
                if n[u] == 1:
                    whole[i] = first[v]
                else:
                    several[i] = first[v : v + n[u]], n[u + 1 : u + 1 + n[u]]
                v, u = v + n[u], u + 1 + n[u]
        mixed = np.zeros(len(whole), bool)
        mixed[list(several)] = True
        out = []
        for x, lo, wide, use, (ids, null, sizes, counts) in docs:
            x, p, q = _unpacked(x, np.uint8), 0, 0
            for own, none, n, m in zip(ids.tolist(), null.tolist(), sizes.tolist(), counts.tolist()):
                raw, s, e, u = x[p : p + n], lo[q : q + m], wide[q : q + m] + LENGTH, use[q : q + m]
                p, q = p + n, q + m
                hit = (whole[u] < own) & ~mixed[u]
                begin, end = [s[hit]], [s[hit] + e[hit]]
                for i in np.nonzero(mixed[u])[0].tolist():
                    at = 0
                    for f, to in zip(*several[int(u[i])]):
                        if f < own:
                            begin.append(s[i : i + 1] + at), end.append(s[i : i + 1] + to - 1 + LENGTH)
                        at = to
                step = np.bincount(np.concatenate(begin), minlength=n + 1) - np.bincount(np.concatenate(end), minlength=n + 1)
                over = np.cumsum(step[:-1]) > 0
                edge = np.diff(over.astype(np.int8), prepend=0, append=0)
                kept = raw[~over].tobytes()
                start = np.nonzero(edge == 1)[0]
                more = (kept, start.astype(np.int64).tolist(), np.nonzero(edge == -1)[0].astype(np.int64).tolist()) if with_kept else ()
                out.append((None if none else own, n, int(over.sum()), len(start), hashlib.sha256(kept).hexdigest(), *more))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())] * with_kept
        cols = list(zip(*out)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *tail])

    posts = rows.mapInArrow(post, "b int, h binary, id binary, d binary, n binary")
    told = scratch.cut(posts.groupBy("b").applyInArrow(shared, "d int, h binary"), "shared")
    schema = "kind int, k int, id long, n long, sha string, x binary, y binary, z binary, w binary, v binary"
    texts = rows.mapInArrow(bundle, "d int, ids binary, none binary, sizes binary, x binary")
    mid = scratch.cut(texts.groupBy("d").cogroup(told.groupBy("d")).applyInArrow(cut, schema), "contexts", "kind")
    scratch.drop("shared")
    first = scratch.cut(mid.filter("kind = 2").groupBy("k").applyInArrow(settle, "d int, key binary, first binary, n binary"), "first")
    scratch.drop("contexts/kind=2")  # the contexts are settled: only documents are still read
    mid = scratch.again(mid.schema, "contexts")
    ends = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, starts array<long>, ends array<long>" * with_kept
    some = mid.filter("kind = 1").groupBy("k").cogroup(first.groupBy("d")).applyInArrow(remove, ends)
    none = mid.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *([F.col("x").alias("kept"), F.array().cast("array<long>").alias("starts"), F.array().cast("array<long>").alias("ends")] * with_kept))
    return some.unionByName(none)


def query(docs: DataFrame) -> DataFrame:
    return spans(docs)
