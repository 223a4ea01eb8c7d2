"""Line dedup by content-defined chunks of lines, extended line by line to whole passages.

A text's lines are hashed; a rolling hash over WINDOW line hashes ends a chunk where it is 0 modulo EVERY, so boundaries move with the content
and not with its place. A passage seldom begins and ends at chunks' ends, and a short one holds no chunk, so chunks are joined by seams: a seam
is LEAST adjacent lines with words (and the blank lines between them), wherever they are. Chunks and seams are units. Units that occur again
anywhere (in other documents or the same) are removed but for the first occurrence, by doc_id, then place. Units that share a hash are
compared byte for byte (they are grouped by their bytes, without the end of the last line). So of a passage of LEAST lines or more that an earlier document holds, nothing stays.

Blank lines don't count as content: a unit needs LEAST lines that hold a word. Chunks longer than LONGEST lines are cut, by the same rule.
Units overlap: a line goes if any of the units that cover it does. Each line that goes has an equal line at an earlier place, so the first stays;
a run of one line goes but for the first (LEAST - 1) lines.

Steps: hashes of all units are counted (8 bytes each, no text); only documents with a repeated hash take part further, each with the short
list of its repeated units; only those units' bytes are grouped, with map-side minima; the removals go back to the documents by id.
A passage that a third of all documents share costs one row a document and unit, and joins on its key can be split. Documents and lists are
merged at every size, since the lists grow with the documents.

Defined cases: null text stays null (no lines); empty text has one blank line and is kept. Rows with a null or a repeated doc_id are told apart
by a row key of id and text hash; exact repeats of a row stay repeated rows with equal treatment, as one document. Of equal units the one of
the least (id, null last; text hash; place) stays. Blank lines behind a text's last words go only with a chunk that repeats with them. A very long
text is cut, hashed and rebuilt by itself in one worker, in memory in proportion to it. An empty table gives an empty one. Extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Scratch, pieces

WINDOW, EVERY, LEAST, LONGEST = 2, 4, 2, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(text: bytes) -> tuple[list[int], list[int], list[int], int]:
    """Starts, ends (bytes, with the line's end) and hashes of the units: chunks of LEAST lines with words or more, and seams; the number of lines.

    In the order of starts, then ends; a seam with the start and bytes of a chunk is that chunk.
    """
    lines = text.split(b"\n")
    n = len(lines)
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, n)
    size = np.fromiter(map(len, lines), np.int64, n) + 1
    end = np.cumsum(size)
    word = np.fromiter((bool(x) and not x.isspace() for x in lines), bool, n)
    full = np.cumsum(word)
    roll = h * _MIX
    for k in range(1, WINDOW):
        roll[k:] = roll[k:] ^ (h[:-k] * (_MIX + np.uint64(2 * k)) >> np.uint64(k))
    stop = (roll >> np.uint64(33)) % np.uint64(EVERY) == 0
    stop[-1] = True
    cut = np.nonzero(stop)[0]
    if len(cut) and np.diff(cut, prepend=-1).max() > LONGEST:
        more, low = [], -1
        for c in cut.tolist():
            more += [*range(low + LONGEST, c, LONGEST), c]
            low = c
        cut = np.array(more)
    first = np.concatenate([[0], cut[:-1] + 1])
    words = full[cut] - np.where(first > 0, full[first - 1], 0)
    ok = words >= LEAST
    start, ends = (end[first] - size[first])[ok].tolist(), np.minimum(end[cut], len(text))[ok].tolist()
    at = np.nonzero(word)[0]
    low, high = at[: max(0, len(at) - LEAST + 1)], at[LEAST - 1 :]
    chunk = {a: len(body(text, a, b)) for a, b in zip(start, ends)}
    seams = zip((end[low] - size[low]).tolist(), np.minimum(end[high], len(text)).tolist())
    units = sorted([*zip(start, ends), *((a, b) for a, b in seams if chunk.get(a) != len(body(text, a, b)))])
    start, ends = [a for a, _ in units], [b for _, b in units]
    return start, ends, [xxhash.xxh64_intdigest(body(text, a, b)) for a, b in zip(start, ends)], n


def body(text: bytes, start: int, end: int) -> bytes:
    """A unit without the end of its last line, which the last line of a text lacks: what is hashed and compared."""
    return text[start : end - 1] if text.endswith(b"\n", start, end) else text[start:end]


def place(start: int, end: int) -> int:
    """Start and length of a unit in one number, in the order of starts; a text has less than 2 GB."""
    return start << 32 | end - start


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h, cut): of the document with that id and text hash, the units to remove, as place() has them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            ids, hs, out = b.column(0).to_pylist(), b.column(1).to_pylist(), ([], [], [], [])
            for i, h, t in zip(ids, hs, b.column(2).to_pylist()):
                start, ends, got, _ = chunks(t.encode("utf-8", "surrogatepass"))
                out[0].extend([i] * len(start)), out[1].extend([h] * len(start)), out[2].extend(map(place, start, ends)), out[3].extend(got)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(np.array(out[3], np.uint64).view(np.int64))], ["id", "h", "at", "k"])

    all_ = scratch.cut(rows.mapInArrow(cut, "id long, h long, at long, k long"), "chunks")
    # places that differ, of which copies of a row are one: by the ends of a hash of the place, which partitions combine before the shuffle
    place_ = F.xxhash64("id", "h", "at")
    # written, so that the join may split a hash that very many documents have
    often = scratch.cut(all_.groupBy("k").agg(F.min(place_).alias("a"), F.max(place_).alias("b")).filter("a <> b").select("k"), "often")
    marked = scratch.cut(all_.join(often, "k").groupBy("id", "h").agg(F.collect_set("at").alias("at")), "marked")
    scratch.drop("chunks", "often")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out = []
            for i, h, t, at in zip(*(b.column(c).to_pylist() for c in ("id", "h", "text", "at"))):
                raw, want = t.encode("utf-8", "surrogatepass"), set(at)
                out += [(i, h, place(s, e), body(raw, s, e)) for s, e in zip(*chunks(raw)[:2]) if place(s, e) in want]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["id", "h", "at", "bytes"])

    same = F.expr("m.id <=> r.id and m.h = r.h")
    texts = rows.alias("r").join(marked.hint("merge").alias("m"), same).select("r.id", "r.h", "r.text", "m.at")
    found = scratch.cut(texts.mapInArrow(pick, "id long, h long, at long, bytes binary").distinct(), "found")
    # null ids sort last: a document with an id is the first
    where = F.struct(F.col("id").isNull().alias("z"), "id", "h", "at")
    first = scratch.cut(found.groupBy("bytes").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bytes", "first"), "first")
    scratch.drop("marked")
    gone = scratch.cut(found.join(first, "bytes").filter(where != F.col("first")).groupBy("id", "h").agg(F.collect_list("at").alias("cut")), "gone")
    scratch.drop("found", "first")
    return gone


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with repeated units of lines removed from text, and the added columns line_total and line_removed (longs), before which columns
    of these names give way; others of any name pass."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removals(docs, scratch)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "line_total", "line_removed")]
    rows = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    joined = rows.join(gone.hint("merge"), F.expr("doc_id <=> id and hash = h"), "left").select("row", "text", "cut")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts, total, removed = [], [], []
            for t, cut in zip(b.column("text").to_pylist(), b.column("cut").to_pylist()):
                n = 0 if t is None else t.count("\n") + 1
                lost = 0
                if cut:
                    raw, want, kept, low = t.encode("utf-8", "surrogatepass"), set(cut), [], 0
                    for s, e in zip(*chunks(raw)[:2]):
                        if place(s, e) in want and e > low:
                            kept.append(raw[low:s])
                            lost += raw.count(b"\n", max(low, s), e) + (not raw.endswith(b"\n", s, e))
                            low = e
                    t = b"".join([*kept, raw[low:]]).decode("utf-8", "surrogatepass")
                texts.append(t), total.append(n), removed.append(lost)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "line_total", "line_removed"])

    schema = T.StructType([rows.schema["row"], rows.schema["text"]]).add("line_total", "long").add("line_removed", "long")
    own = ["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("line_total", "line_removed")]
    return joined.mapInArrow(rebuild, schema).select(*own, "line_total", "line_removed")


def query(docs: DataFrame) -> DataFrame:
    got = cleaned(docs.select("doc_id", "text"))
    return got.select("doc_id", F.col("line_total").alias("n_lines"), F.col("line_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
