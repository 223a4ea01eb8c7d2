"""Packing token streams into sequences by order-preserving dynamic programming.

A partition's documents form one stream in their order; every document ends with the end id. Sequences are consecutive stretches of at
most LENGTH ids. Windows may end where a document ends (free), where a sentence ends (SENTENCE), or, inside stretches without either,
every FILL ids (CUT). The program minimises padding plus those penalties: cost[j] = penalty[j] + min over i of cost[i] + padding(i, j).
Padding is LENGTH less the length, so the minimum runs over cost[i] + position[i] in a sliding window, kept in a monotone queue; lengths that
are a power of two aren't padded, and the transitions of LENGTH down to an eighth of it are looked at by themselves (SHORT is their price). Memory: about BLOCK ids at a time;
a block's last sequence is carried into the next.

Ids are those of the tokenizer file. Most texts are cut at blanks, and each distinct word is encoded once a worker (a cache of CACHE
words); texts with rare or non-Latin-1 characters, runs of blanks or special tokens go through the tokenizer whole. Both give the same ids (tested).

sequence_id holds the partition's number above 33 bits and a count below. The layout depends on the order and the split of the input, which
are the same for every run over the same files. Defined cases: null text is empty; an empty document is its end id alone. Repeated rows
and null ids are packed like any others. Of cuts that cost the same the earliest start wins. A very long text is encoded whole and cut like any
other; its ids are held at once, 4 bytes each. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pieces

LENGTH, END, SENTENCE, SHORT, CUT, FILL, BLOCK, CACHE = 2048, 1, 12, 16, 96, 128, 1 << 20, 300_000
#: Byte-level BPE's pattern, for texts in which blanks stand alone: its rule for runs of blanks isn't needed there.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Of Latin-1: signs that readers of Unicode class differently (superscripts, fractions, separators); blanks.
_RARE = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
_BLANKS = bytes.maketrans(b"\t\n\v\f\r\x85\xa0", b" " * 7)


def _plain_blanks(text: str) -> bool:
    """Latin-1 without rare signs, in which blanks stand alone."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    spaced = raw.translate(_BLANKS, _RARE)
    return len(spaced) == len(raw) and b"  " not in spaced


class Encoder:
    """Ids of texts, as the tokenizer of a file gives them without added special tokens."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocab = self.whole.get_vocab()
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        self.stops[[i for t, i in vocab.items() if t[-1:] in (".", "!", "?", "Ċ")]] = True  # Ċ stands for a line's end
        self.plain = _plain(vocab, path)

    def _miss(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.plain(" " + word))
        if len(self.cache) < CACHE:
            self.cache[word] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if not _plain_blanks(text) or any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        # blanks stand alone: a piece begins at each one, so what lies between two of them is encoded by itself
        first, *words = text.split(" ")
        out = list(self.plain(first))
        get, add, miss = self.cache.get, out.extend, self._miss
        for w in words:
            add(get(w) or miss(w))
        return np.fromiter(out, np.uint32, len(out))


def _plain(vocab: dict[str, int], path: str):
    """Ids of a text without runs of blanks. A byte-level vocabulary whose ids rise with its merges is what tiktoken calls ranks, and that is the quicker way."""
    import json

    import tiktoken

    of = {}
    spare = 0
    for b in range(256):  # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            of[chr(b)] = b
        else:
            of[chr(256 + spare)] = b
            spare += 1
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("the ids of this vocabulary don't follow its merges")
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("pieces", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def windows(ends: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of the chosen cuts, 0 left out. ends: rising places where a window may end, no two further apart than ``length``; the
    last is the stream's end."""
    pos = np.concatenate([[0], ends])
    n = len(pos)
    exact: dict[int, list[int]] = {}
    k = length
    while k >= max(1, length >> 3):
        at = np.searchsorted(pos, pos - k)
        for j in np.nonzero(pos[at] == pos - k)[0].tolist():
            exact.setdefault(j, []).append(int(at[j]))
        k //= 2
    cost, back, key = [0] * n, [0] * n, [0] * n
    place, fine = pos.tolist(), [0, *penalty.tolist()]
    queue = deque([0])
    for j in range(1, n):
        here = place[j]
        low = here - length
        while place[queue[0]] < low:
            queue.popleft()
        by = queue[0]
        least = key[by] - low
        if j in exact:
            for i in exact[j]:
                if (c := cost[i] + (SHORT if place[i] > low else 0)) < least:
                    least, by = c, i
        back[j] = by
        cost[j] = least = least + fine[j]
        key[j] = least = least + here
        while queue and key[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


def ends_of(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a stream, and the penalties."""
    fine = np.full(len(ids) + 1, -1, np.int64)
    inside = ids < len(stops)
    fine[1:][stops[np.where(inside, ids, 0)] & inside] = SENTENCE
    fine[doc_ends] = 0
    fine[len(ids)] = 0
    known = np.concatenate([[0], np.nonzero(fine >= 0)[0]])
    for a, gap in zip(known[:-1][np.diff(known) > FILL].tolist(), np.diff(known)[np.diff(known) > FILL].tolist()):
        fine[a + FILL : a + gap : FILL] = CUT
    fine[0] = -1
    at = np.nonzero(fine >= 0)[0]
    return at, fine[at]


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also ids, as little-endian uint32."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        base, made = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []  # (doc_id, tokens of the document, where this part starts in it, ids)
        n = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, made, n
            begin = np.cumsum([0] + [len(h[3]) for h in held])
            ids = np.concatenate([h[3] for h in held])
            cuts = windows(*ends_of(ids, begin[1:], encode.stops))
            rows: list[tuple] = []
            keep: list[tuple] = []
            low = 0
            for high in cuts:
                carry = not last and high == cuts[-1]
                k = bisect_right(begin.tolist() if len(begin) < 64 else begin, low) - 1
                at = low
                while at < high:
                    doc, total, start, own = held[k]
                    stop = min(high, int(begin[k + 1]))
                    part = own[at - int(begin[k]) : stop - int(begin[k])]
                    if carry:
                        keep.append((doc, total, start + at - int(begin[k]), part))
                    else:
                        raw = part.astype("<u4").tobytes()
                        rows.append((doc, start + at - int(begin[k]), stop - at, zlib.crc32(raw), total, base | made, at - low) + ((raw,) if with_ids else ()))
                    at, k = stop, k + 1
                made += not carry
                low = high
            held, n = keep, sum(len(h[3]) for h in keep)
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.binary()) for i, c in enumerate(cols)], names)

        for b in pieces(batches, 1):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END))
                held.append((doc, len(ids), 0, ids))
                n += len(ids)
                if n >= BLOCK:
                    yield flush(False)
        if held:
            yield flush(True)

    schema = ", ".join(f"{c} long" for c in names[:7]) + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, vocabulary())
