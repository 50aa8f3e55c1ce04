"""Quality by ordinal regression: one score from hashed text, ordered thresholds between the grades.

A text's features are the shares of its byte trigrams in hashed buckets, and of words that repeat the word before. The cumulative-link model has one
weight for each bucket, shared by all grades, and a threshold for each step: P(grade >= k) = logistic(score - threshold k).
A text's score is then a mean of weights over its trigrams, less that of an average text; pseudo-trigrams hold back on short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, local_rows
from .kernels import SPAN_BYTES, U64, chunks, mix, text_bytes, word_hashes

#: Rated rows that are learned from at most: the first by a hash of their ids. The only rows not taken whole.
SAMPLE = 6000
BUCKETS, PSEUDO = 2048, 200
#: Trigrams that a word equal to the one before counts as; they have a bucket of their own.
REPEAT = 4


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Buckets:
    """Bucket of each trigram by its code. It is reckoned: a table of all would be 32 MB, which each worker would keep."""

    def __getitem__(self, code: np.ndarray | int) -> np.ndarray:
        code = np.asarray(code, U64)
        return (mix(code.reshape(-1)) % U64(BUCKETS)).reshape(code.shape)


_TABLE = _Buckets()


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that begins at each byte, and the documents' offsets among them."""
    buf, offs = text_bytes(column)
    n = max(0, len(buf) - 2)
    bucket = np.zeros(len(buf), np.uint16)
    for s in range(0, n, SPAN_BYTES):
        a, b, c = (buf[s + k : min(n, s + SPAN_BYTES) + k].astype(U64) for k in range(3))
        bucket[s : s + len(a)] = _TABLE[a | b << U64(8) | c << U64(16)]
    inside = np.ones(len(buf) + 1, bool)
    for k in (1, 2):  # trigrams don't cross documents
        at = offs[1:] - k
        inside[at[at >= 0]] = False
    inside = inside[: len(buf)]
    lens = np.maximum(np.diff(offs) - 2, 0)
    # a document of one byte or none puts its marks on its neighbour's bytes, which are then looked up again
    short = np.diff(offs) < 2
    if short.any():
        inside = np.zeros(len(buf) + 1, np.int32)
        long = lens > 0
        np.add.at(inside, offs[:-1][long], 1)
        np.add.at(inside, offs[:-1][long] + lens[long], -1)
        inside = np.cumsum(inside)[: len(buf)] > 0
    return bucket[inside], np.r_[0, np.cumsum(lens)]


def _repeats(column: pa.Array) -> np.ndarray:
    """Words equal to the word before, for each text."""
    words, first = word_hashes(column)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words):
        same[1:-1] = words[1:] == words[:-1]
        at = first[:-1]
        same[at] = 0  # a text's first word repeats nothing
    return np.diff(np.r_[0, np.cumsum(same[:-1])][first])


def _counts(column: pa.Array) -> np.ndarray:
    bucket, offs = _trigrams(column)
    n = np.diff(offs)
    doc = np.repeat(np.arange(len(n)), n)
    x = np.bincount(doc * BUCKETS + bucket, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
    return np.c_[x, REPEAT * _repeats(column)].astype(np.float32)


def _rows(columns: list[pa.Array]) -> np.ndarray:
    """What _counts() made, from the bytes of its rows; the columns are given up one by one."""
    x, at = np.empty((sum(map(len, columns)), BUCKETS + 1), np.float32), 0
    while columns:
        for row in columns.pop(0):
            x[at] = np.frombuffer(row.as_buffer(), np.float32)
            at += 1
    return x


class OrdinalModel:
    """Cumulative-link regression fitted by gradient steps (Adam) with an L2 penalty."""

    def fit(self, x: np.ndarray, y: np.ndarray, grades: int, steps: int = 300, rate: float = 0.05, ridge: float = 3e-3) -> OrdinalModel:
        """x: counts, a row for each text. What is fitted is their excess over the average text of that length.

        Beside x there is one array of its size, as memory is small; means and spreads are taken some columns at a time.
        """
        n = x.sum(axis=1, keepdims=True)
        ends = np.linspace(0, x.shape[1], 9).astype(int)  # no single column, which numpy would add up in another order
        some = [slice(*c) for c in zip(ends, ends[1:], strict=False) if c[1] > c[0]]
        usual = np.concatenate([(x[:, c] / np.maximum(n, 1)).mean(axis=0) for c in some])
        excess = np.multiply(n, usual)
        np.subtract(x, excess, out=excess)
        excess /= n + PSEUDO
        x = excess
        self.spread = np.concatenate([x[:, c].std(axis=0) for c in some]) + 1e-5
        x /= self.spread
        w = np.zeros(x.shape[1], np.float32)
        share = np.array([(y >= k).mean() for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
        # thresholds are the first one and positive gaps
        start = -np.log(share / (1 - share))
        t = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))].astype(np.float64)
        theta, m, v = np.r_[w.astype(np.float64), t], 0.0, 0.0
        for step in range(1, steps + 1):
            w, t = theta[: x.shape[1]], theta[x.shape[1] :]
            cuts = np.cumsum(np.r_[t[0], np.exp(t[1:])])
            score = x @ w.astype(np.float32)
            p = np.c_[np.ones(len(y)), _logistic(score[:, None] - cuts[None, :]), np.zeros(len(y))]
            d = p * (1 - p)
            like = np.maximum(p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1], 1e-9)
            up, down = d[np.arange(len(y)), y] / like, d[np.arange(len(y)), y + 1] / like
            slope = -(up - down) / len(y)
            gw = (slope.astype(np.float32) @ x) + ridge * w
            gc = np.array([(up * (y == k) - down * (y == k - 1)).sum() for k in range(1, grades)]) / len(y)
            gt = np.r_[gc.sum(), [gc[k:].sum() * np.exp(t[k]) for k in range(1, grades - 1)]]
            g = np.r_[gw, gt]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = theta[: x.shape[1]], theta[x.shape[1] :]
        self.weights = (w / self.spread).astype(np.float64)
        self.cuts = np.cumsum(np.r_[t[0], np.exp(t[1:])])
        self.base = -float(usual @ self.weights)
        return self

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a row for each text."""
        bucket, offs = _trigrams(column)
        again = REPEAT * _repeats(column)
        total = np.diff(np.r_[0.0, np.cumsum(self.weights[bucket])][offs]) + again * self.weights[BUCKETS]
        n = np.diff(offs) + again
        score = (total + n * self.base) / (n + PSEUDO)
        return _logistic(score[:, None] - self.cuts[None, :])


def quality(docs: DataFrame, ratings: DataFrame, least: float = 0.5, tail: int = 1, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...) with expected_grade, tail_probability and keep, for every row.

    ratings(doc_id, grade) are whole numbers from 0 on; at most `sample` rated texts are learned from, ratings with a null don't
    count; repeated ratings and rows count each. expected_grade sums P(grade >= k), tail_probability is P(grade >= tail), keep says whether it reaches `least`. A null
    text is empty; an empty or very short text has nearly the average text's score. Without ratings of two grades everything is
    kept with a tail probability of 1. Null and repeated doc_ids are passed on, as other columns
    are; columns named like the new ones are replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.drop("expected_grade", "tail_probability", "keep").withColumn("text", F.col("text").cast("string"))
    rated = ratings.select(F.col("doc_id").cast("long").alias("id"), F.col("grade").cast("int").alias("grade")).filter("id is not null and grade >= 0")
    rated = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample).collect()
    bounded = local_rows(spark, id=pa.array([r["id"] for r in rated], pa.int64()), grade=pa.array([r["grade"] for r in rated], pa.int32()))
    # at most `sample` rows of two numbers are broadcast
    known = rows.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(bounded), F.col("_id") == F.col("id")).select("grade", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = _counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([r.tobytes() for r in x], pa.binary())], names=["grade", "x"])

    grades = 1 + max((r["grade"] for r in rated), default=0)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model of all rows, or nothing without two grades; only its weights leave the task."""
        ys, columns = [], []
        for batch in batches:
            ys.append(batch.column("grade").to_numpy())
            columns.append(batch.column("x"))
        y = np.concatenate(ys).astype(np.int64) if ys else np.zeros(0, np.int64)
        if len(np.unique(y)) > 1:
            m = OrdinalModel().fit(_rows(columns), y, max(grades, tail + 1))
            yield pa.RecordBatch.from_pydict({"weights": [m.weights], "cuts": [m.cuts], "base": [m.base]})

    model = None
    if rated:
        seen = known.transform(in_arrow, featured, "grade int, x binary")
        # more rows only where doc_ids repeat; then a hash chooses among them. They are one task's, in this order: the driver sees the weights alone
        chosen = seen.orderBy(F.xxhash64("grade", "x"), "grade").limit(sample)
        for r in chosen.transform(in_arrow, fitted, "weights array<double>, cuts array<double>, base double").collect():  # one row at most
            model = OrdinalModel()
            model.weights, model.cuts, model.base = np.array(r["weights"]), np.array(r["cuts"]), r["base"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p = model.tails(part.column("text")) if model else np.ones((part.num_rows, max(grades - 1, tail)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.sum(axis=1)), pa.array(p[:, tail - 1])], names=[*part.schema.names, "expected_grade", "tail_probability"])

    schema = T.StructType([*rows.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    out = rows.transform(in_arrow, scored, schema)
    return out.withColumn("keep", F.col("tail_probability") >= least)
