"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text's characters, all of it, hashed to DIM slots: (1 + ln count) times the inverse
document frequency, scaled to length one. Document frequencies count every training row. Weights come from follow-the-regularised-leader
(FTRL-proximal) with an elastic net (L1 and L2) on a bounded sample: about SAMPLE rows, spread evenly over the languages, chosen by hash of id
and text. The temperature that calibrates the probabilities is fitted to what TURNS models, each learnt without its
fold of the sample, say of that fold, at every size; its targets are smoothed as if one more row had been of another language.

Training rows are those with an id whose crc32 isn't 0 modulo 5 and a non-null lang. Predictions read the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if there is nothing to learn from.
Null ids are held out. Repeated rows count repeatedly in the frequencies, once in the sample. Ties go to the language that comes first. Very long
texts are counted in pieces. At most LANGUAGES values of lang are learnt (a parameter; more are refused, since each is a column of weights that
every task holds). An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, pieces

DIM, GRAMS, SAMPLE, TURNS, LANGUAGES = 1 << 14, (1, 2, 3), 4000, 2, 500
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 0.02, 0.002, 4
PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and how often each occurs."""
    total = np.zeros(DIM, np.int64)
    text = text.lower()
    for k in range(0, max(1, len(text)), PIECE):  # pieces overlap by what their last n-grams need
        c = np.frombuffer(text[k : k + PIECE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(PIECE, len(text) - k)
        mixed = np.zeros(len(c), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            mixed = mixed[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] if n <= len(c) else mixed[:0]
            if n in GRAMS:
                h = (mixed[:own] + np.uint32(n)) * np.uint32(0x9E3779B1)
                total += np.bincount(h >> np.uint32(32 - 14), minlength=DIM)
    at = np.nonzero(total)[0]
    return at, total[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    x = (1 + np.log(n)) * idf[at]
    norm = math.sqrt(float(x @ x))
    return at, (x / norm if norm else x)


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: in how many each slot occurs. Partitions' sums are summed in about a root of their number of groups, then here."""
    slots = max(16, math.isqrt(rows.rdd.getNumPartitions()))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in pieces(batches, 0):
            for t in b.column(0).to_pylist():
                df[counts(t)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % slots], pa.int32()), "n": pa.array([n], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        df = np.zeros(DIM, np.int64)
        for x in t.column("df").to_pylist():
            df += np.frombuffer(x, np.int64)
        return pa.table({"n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})

    got = rows.select("text").mapInArrow(one, "slot int, n long, df binary").groupBy("slot").applyInArrow(add, "n long, df binary").collect()
    return sum((np.frombuffer(r.df, np.int64) for r in got), np.zeros(DIM, np.int64)), sum(r.n for r in got)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """(DIM + 1, classes) weights; the last row is the bias, which isn't penalised."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        w[-1] = -z[DIM] / ((BETA + np.sqrt(n[DIM])) / ALPHA)
        return w

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sq = n[at] + g * g
            z[at] += g - (np.sqrt(sq) - np.sqrt(n[at])) / ALPHA * w
            n[at] = sq
    return weights(np.arange(DIM + 1))


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """Of least cross entropy to the targets (rows that sum to 1), by golden sections of ln T."""
    if not len(targets):
        return 1.0

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (targets * s).sum(axis=1)).mean())

    a, b, g = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def smoothed(y: np.ndarray, classes: int) -> np.ndarray:
    """Targets of calibration: 1 at y, less what one more row of another class would take (Platt's correction), so that a sample without a
    single error doesn't call for certainty."""
    n = len(y)
    out = np.full((n, classes), 1 / (n + 2) / max(1, classes - 1))
    out[np.arange(n), y] = (n + 1) / (n + 2) if classes > 1 else 1.0
    return out


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> dict | None:
    """languages, idf, weights and temperature; None if no row can be learnt from. More than ``languages`` values of lang are refused."""
    rows = _train_rows(docs)
    by = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(languages + 1).collect()}
    if not by:
        return None
    if len(by) > languages:
        raise ValueError(f"more than {languages} languages to learn")
    langs = sorted(by)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    # by hash of id and text, and rows alike in these count once: so neither a repeated id nor a repeated row can fill the sample, and its size
    # is that of ``sample`` independent draws, give or take a few in a hundred
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / len(langs) / by[k]))])
    h = F.xxhash64("doc_id", "text", F.lit("langid"))
    chosen = rows.filter(F.pmod(h, F.lit(1 << 30)) < rate[F.col("lang")] * float(1 << 30))
    chosen = chosen.withColumn("h", h).dropDuplicates(["doc_id", "lang", "h"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            got = [features(t, idf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([a.astype(np.int16).tobytes() for a, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())], ["doc_id", "lang", "at", "x"])

    got = chosen.select("doc_id", "text", "lang").mapInArrow(vectors, "doc_id long, lang string, at binary, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r["at"]))
    data = [(np.frombuffer(r["at"], np.int16).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float), langs.index(r.lang)) for r in got]
    # each row's logits come from weights that were learnt without its fold; the weights of all rows are the model's
    fold = np.arange(len(data)) % TURNS
    logits, truth = np.zeros((len(data), len(langs))), np.array([y for *_, y in data], int)
    for k in range(TURNS):
        w = ftrl([r for r, f in zip(data, fold) if f != k], len(langs))
        for i in np.nonzero(fold == k)[0].tolist():
            at, x, _ = data[i]
            logits[i] = x @ w[at] + w[DIM]
    w = ftrl(data, len(langs))
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "t": temperature(logits, smoothed(truth, len(langs)))}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, 2):
            names, scores = [], []
            for t in b.column(2).to_pylist():
                if m is None or t is None or not _LETTER.search(t):
                    names.append("und"), scores.append(0.0)
                    continue
                at, x = features(t, m["idf"])
                s = (x @ m["w"][at] + m["w"][DIM]) / m["t"]
                p = np.exp(s - s.max())
                k = int(p.argmax())
                names.append(m["langs"][k]), scores.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
