"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding: lower case; letters lose their marks; look-alike letters of other scripts and digits that stand for letters become Latin ones;
l counts as i (a 1 may mean either); everything else parts words. The automaton holds two kinds of entries, stems (matched where a word
begins) and whole words. The longest entry at a word counts, with its weight; it doesn't if it lies in an exception phrase (the word
with a neighbour, as seen in clean documents). The sum of weights is normalised by the number of words, and a logistic curve over that
density and the sum gives the score.

Learnt from labelled rows of the training folds alone, on a bounded sample chosen by hash of id and text: at most TOXIC toxic and CLEAN clean
documents (of a document with several labels the greatest counts; rows alike in id and text count once). Weights are smoothed log-odds of an
entry's document frequencies; stems have STEM letters. At most ENTRIES entries and as many exceptions are kept, the weightiest, from 25 times as
many candidates; the bound is a parameter of train, and None lifts it. A base lexicon and exceptions can be given as parameters.

Defined cases: null and empty texts score as texts without any match. Null ids are held out. With no labels of either kind nothing can
be learnt: the score is the share of toxic labels, if any (else 0). Repeated rows are scored alike. Of entries that begin at one word the
longest counts; entries of equal worth are kept in the order of their letters. Very long texts are folded and matched whole, in memory in
proportion to them. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, held_out, pieces

TOXIC, CLEAN, STEM, ENTRIES, FLUSH = 8000, 20000, range(4, 9), 4000, 400_000
#: Log-odds from which an entry is looked at, and from which it stays once exceptions are known.
DOUBT, SURE = 1.0, 2.5
#: Digits that stand for letters, and look-alikes outside the Latin script.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
LOOKS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
    "ß": "s", "æ": "a", "œ": "o", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
}
SPACE = 32


def _fold_table() -> np.ndarray:
    """By code point of the first plane: a Latin letter, or a blank. By rule: compatibility decomposition's first letter, folded."""
    out = np.full(1 << 16, SPACE, np.uint8)
    for i in range(1 << 16):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i).lower()[:1]
        c = LOOKS.get(c, c)
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        base = LOOKS.get(base, DIGITS.get(base, base))
        if "a" <= base <= "z":
            out[i] = ord("i" if base == "l" else base)
    return out


_FOLD = _fold_table()
_MARKS = np.array([0 < i < 1 << 16 and not 0xD800 <= i < 0xE000 and unicodedata.combining(chr(i)) > 0 or i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF) for i in range(1 << 16)])


def fold(text: str | None) -> str:
    """Words of a-z, each after one blank, and a blank at the end: `` a b ``. Combining marks and zero-width signs vanish."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    styled = np.nonzero(c >= 1 << 16)[0]  # such as mathematical letters
    if len(styled):
        c = c.copy()
        c[styled] = [ord(unicodedata.normalize("NFKD", chr(int(x)))[:1]) for x in c[styled]]
        c = np.where(c < 1 << 16, c, SPACE)
    if len(c) and int(c.max()) >= 0xAD:  # the least of them
        c = c[~_MARKS[c]]
    b = _FOLD[c]
    b = b[(b != SPACE) | np.append(True, b[:-1] != SPACE)] if len(b) else b
    return f" {b.tobytes().decode('ascii').strip()} " if len(b) and (b != SPACE).any() else " "


class Lexicon:
    """entries: `` stem`` or `` word `` to weight. exceptions: phrases of folded words. curve: logistic weights."""

    def __init__(self, entries: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.curve = dict(entries), set(exceptions), curve
        self.auto = None

    def __getstate__(self):
        return self.entries, self.exceptions, self.curve

    def __setstate__(self, s):
        self.__init__(*s)

    def matches(self, folded: str) -> dict[int, tuple[int, str]]:
        """By where a word begins: (where its longest entry ends, the entry)."""
        if self.auto is None:
            self.auto = ahocorasick.Automaton()
            for e in self.entries:
                self.auto.add_word(e, e)
            self.auto.make_automaton()
        out: dict[int, tuple[int, str]] = {}
        if self.entries:
            for end, e in self.auto.iter(folded):
                start = end - len(e) + 1
                if start not in out or out[start][0] < end:
                    out[start] = (end, e)
        return out

    def phrases(self, folded: str, start: int) -> tuple[str, str]:
        """The word that begins after the blank at start, with the word before and with the word after."""
        end = folded.index(" ", start + 1)
        word = folded[start + 1 : end]
        before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
        after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
        return f"{before} {word}", f"{word} {after}"

    def hits(self, text: str | None) -> set[str]:
        folded = fold(text)
        return {e for start, (_, e) in self.matches(folded).items() if self.exceptions.isdisjoint(self.phrases(folded, start))}

    def measure(self, text: str | None) -> tuple[float, int]:
        """Sum of weights, and number of words."""
        folded = fold(text)
        total = 0.0
        for start, (_, e) in self.matches(folded).items():
            if not self.exceptions or self.exceptions.isdisjoint(self.phrases(folded, start)):
                total += self.entries[e]
        return total, folded.count(" ") - 1

    def score(self, total: float, words: int) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * math.log1p(100 * total / max(1, words)) + c * math.log1p(total)))))


def grams(folded: str) -> set[str]:
    """What entries are made from: words, and stems of longer words."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEM if n < len(w)}


def _counted(rows: DataFrame, of, schema: str = "k string, n1 long, n0 long") -> DataFrame:
    """Sums of what ``of(text)`` gives by label, partition by partition, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            names = list(n[0] | n[1])
            return pa.RecordBatch.from_pydict({"k": pa.array(names, pa.string()), "n1": pa.array([n[1][x] for x in names], pa.int64()), "n0": pa.array([n[0][x] for x in names], pa.int64())})

        for b in pieces(batches, 0):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y].update(of(t))
                if len(n[y]) > FLUSH:
                    yield out()
                    n[0].clear(), n[1].clear()
        yield out()

    return rows.select("text", "y").mapInArrow(run, schema).groupBy("k").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (w * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sample(docs: DataFrame, known: DataFrame, toxic: int, clean: int, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of training rows, and how many of each label there are in all: of each label the rows of least hash of id and text,
    ``toxic`` and ``clean`` at most. Written, as several passes follow; documents are read once for it, but for the ids that are joined.

    known: (doc_id, y). A rate by the number of labels thins both sides before they meet; the limit then bounds what is left of an id that
    is repeated, of which repeats with the same text count once.
    """
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    rate = {1: min(1.0, 2 * toxic / max(1, n.get(1, 0))), 0: min(1.0, 2 * clean / max(1, n.get(0, 0)))}
    thin = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    ids = known.filter(thin < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]) * float(1 << 30))
    # the rates give about twice what is asked, and so the broadcast's size; the limits hold it to twice that
    ids = ids.filter("y = 1").limit(4 * toxic).unionByName(ids.filter("y = 0").limit(4 * clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = scratch.cut(rows.select("doc_id", "text", "y", F.xxhash64("doc_id", "text").alias("h")).dropDuplicates(["doc_id", "h"]), "near")
    # where the least hashes end, without the texts
    lines = [rows.filter(F.col("y") == y).select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0] for y, most in ((0, clean), (1, toxic))]
    return rows.filter(F.col("h") <= F.when(F.col("y") == 1, lines[1]).otherwise(lines[0])).select("doc_id", "text", "y"), n


def train(
    docs: DataFrame, labels: DataFrame, base: dict[str, float] | None = None, exceptions: Iterable[str] = (), toxic: int = TOXIC, clean: int = CLEAN, entries_most: int | None = ENTRIES
) -> Lexicon:
    """entries_most: how many entries and how many exceptions are learnt at most, the weightiest; None for all that the sample shows."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows, n = sample(docs, known, toxic, clean, scratch)
    share = n.get(1, 0) / max(1, sum(n.values()))
    given = {f" {w} " if not w.startswith(" ") else w: v for w, v in (base or {}).items()}
    m = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if 0 not in m or 1 not in m:
        # without both labels there is no curve to learn: the score is the share of toxic labels, and none at all is taken as none toxic
        scratch.drop("near")
        return Lexicon(given, exceptions, (500.0 if share == 1 else -500.0, 0.0, 0.0))
    least = max(3, round(0.002 * m[1]))
    frequent = _counted(rows.filter("y = 1"), lambda t: grams(fold(t))).filter(F.col("n1") >= least).orderBy(F.desc("n1"), "k")
    # a candidate occurs in ``least`` sampled texts, so their number is bounded by the sample's words; the limit holds the broadcast
    n1 = {r.k: r.n1 for r in (frequent.limit(25 * entries_most) if entries_most else frequent).collect()}
    shared = spark.sparkContext.broadcast(frozenset(n1))
    n0 = {r.k: r.n0 for r in _counted(rows.filter("y = 0"), lambda t: grams(fold(t)) & shared.value).collect()}
    odds_of = lambda a, b: math.log((a + 0.1) / (m[1] + 0.2)) - math.log((b + 0.1) / (m[0] + 0.2))
    odds = {k: odds_of(c, n0.get(k, 0)) for k, c in n1.items()}
    entries: dict[str, float] = {}
    # a longer entry is only worth keeping if none that it begins with says as much
    for k in sorted((k for k, w in odds.items() if w >= DOUBT), key=lambda k: (len(k), k)):
        if not any(k[:i] in entries and entries[k[:i]] >= odds[k] - 1 for i in range(4, len(k))):
            entries[k] = odds[k]
    entries = dict(sorted(entries.items(), key=lambda x: (-x[1] * math.sqrt(n1[x[0]]), x[0]))[:entries_most]) | given
    lexicon = Lexicon(entries, exceptions)

    def around(t):
        folded = fold(t)
        return {p for s in lexicon.matches(folded) for p in lexicon.phrases(folded, s)}

    seen = _counted(rows, around).filter((F.col("n0") >= 3) & (F.col("n0") / m[0] > 3 * F.col("n1") / m[1])).orderBy(F.desc("n0"), "k")
    lexicon = Lexicon(entries, set(exceptions) | {r.k for r in (seen.limit(entries_most) if entries_most else seen).collect()})
    # what an entry says where no exception phrase holds it
    again = {r.k: odds_of(r.n1, r.n0) for r in _counted(rows, lexicon.hits).collect()}
    entries = {k: again[k] for k in entries if again.get(k, 0) >= SURE and k not in given} | given
    lexicon = Lexicon(entries, lexicon.exceptions)
    got = _measured(rows, lexicon).collect()
    got.sort(key=lambda r: (r.doc_id, r.total, r.words))
    scratch.drop("near")
    y = np.array([r.y for r in got], float)
    x = np.array([[1.0, math.log1p(100 * r.total / max(1, r.words)), math.log1p(r.total)] for r in got])
    weight = np.where(y == 1, n[1] / m[1], n[0] / m[0])
    return Lexicon(entries, lexicon.exceptions, tuple(logistic(x, y, weight / weight.mean()).tolist()))


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            got = [shared.value.measure(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "y", "total", "words"])

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, total double, words long")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, matched_weight, n_words) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in pieces(batches, 2):
            got = [lex.measure(t) for t in b.column(2).to_pylist()]
            s = [lex.score(*g) for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "held_out", "score", "predicted", "matched_weight", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, matched_weight double, n_words long")


def filtered(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the rows predicted toxic, judged row by row in one pass; columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            keep = [shared.value.score(*shared.value.measure(t)) < 0.5 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
