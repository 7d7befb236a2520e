"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

N-grams of code points of the lower-cased text, white space runs as one space, hashed. The log-count ratios come from the
presence of n-grams in texts; the n-grams that tell the classes apart most keep their ratio as a scale, and a logistic
model with an L2 penalty is fitted on the logarithms of 1 + their counts, so scaled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, batches, dropped, held_out, in_small_batches, stored

BITS = 20
ORDERS = (4, 5, 6, 7)
#: Characters of a text whose n-grams are hashed at a time.
PIECE = 1 << 20


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """The hashed n-grams of a whole text, each position once, in arrays of bounded length."""
    if not text:
        return
    flat = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    for start in range(0, len(flat), PIECE):
        before = min(start, max(ORDERS) - 1)
        a = flat[start - before : start + PIECE].astype(U)
        x = a
        for n in range(2, max(ORDERS) + 1):
            if n > len(a):
                break
            x = x[: len(a) - n + 1] * U(0x9E3779B97F4A7C15) + a[n - 1 :]
            if n in ORDERS:
                yield (mixed_once(x[max(0, before - n + 1) :]) >> U(64 - BITS)).astype(np.int32)


def mixed_once(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Model:
    """slots: per hash the number of its feature, from 1, or 0; weights by feature."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def features(self, text: str | None) -> np.ndarray:
        """How often each feature occurs in the whole text; place 0 is unused."""
        counts = np.zeros(len(self.weights), np.int64)
        for h in hashed(text):
            found = self.slots[h]
            counts += np.bincount(found[found > 0], minlength=len(counts))
        return counts

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.log1p(self.features(text)) @ self.weights)
        return float(1 / (1 + np.exp(-max(-500.0, z))))

    def column(self, text: Column) -> Column:
        @F.arrow_udf("double")
        def of(texts: pa.Array) -> pa.Array:
            return pa.array([self.score(x.as_py()) for x in texts], pa.float64())

        return of(text.cast("string"))


def counted(rows: DataFrame, parts: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Per class, in how many of the (text, y) rows each hash occurs. Fixed-size partial counts are summed in slices."""
    size = 1 << BITS
    slices = 64

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, size), np.int32)
        for b in it:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = list(hashed(text.as_py()))
                if found:
                    tally[y, np.unique(np.concatenate(found))] += 1
        cut = tally.reshape(2, slices, -1).transpose(1, 0, 2)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["slice", "tally"])

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(t, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "tally"])

    found = rows.mapInArrow(partial, "slice int, tally binary").repartition(parts, "slice").mapInArrow(total, "slice int, tally binary").collect()
    out = np.zeros((2, size), np.int64)
    for r in found:
        out.reshape(2, slices, -1)[:, r["slice"], :] += np.frombuffer(r["tally"], np.int32).reshape(2, -1)
    return out[0], out[1]


def logistic(rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int, scale: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """L2-penalised logistic weights of sparse (row, feature, value) scaled by `scale`, and the bias."""
    positive = max(1.0, y.sum())
    weight = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * max(1.0, len(y) - positive)))
    weight = np.sqrt(weight)
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, (scale * w)[features] * values, n) + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / weight.sum()
        grad = np.append(scale * np.bincount(features, r[rows] * values, len(scale)) + penalty * w, r.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) * (1 - 0.9 * t / rounds)
        w, b = w - move[:-1], b - move[-1]
    return scale * w, float(b)


def fitted(rows: DataFrame, n_features: int = 6000, alpha: float = 0.5, penalty: float = 2e-4) -> Model:
    """A model of a bounded number of (text string, y int) rows."""
    zero, one = counted(rows)
    known = rows.groupBy().agg(F.sum("y").alias("one"), F.count("*").alias("n")).first()
    n, pos = known["n"], known["one"] or 0
    slots = np.zeros(1 << BITS, np.int16)
    if not pos or pos == n:
        p = (pos + 1) / (n + 2)
        return Model(slots, np.zeros(1), float(np.log(p / (1 - p))))
    ratio = np.log((one + alpha) / (pos + 2 * alpha)) - np.log((zero + alpha) / (n - pos + 2 * alpha))
    p, q = one / pos, zero / (n - pos)
    telling = np.where(one + zero >= 3, np.abs(ratio) * np.abs(p - q), 0)
    chosen = np.sort(np.argsort(-telling, kind="stable")[:n_features])
    chosen = chosen[telling[chosen] > 0]
    slots[chosen] = np.arange(1, len(chosen) + 1)
    scale = np.append(0.0, ratio[chosen])
    shell = Model(slots, scale, 0.0)

    def sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for b in it:
                for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    counts = shell.features(text.as_py())
                    at = np.flatnonzero(counts)
                    yield at.astype(np.int16).tobytes(), counts[at].astype(np.int32).tobytes(), y

        return batches(pa.schema([("f", pa.binary()), ("v", pa.binary()), ("y", pa.int32())]), rows_of())

    found = rows.mapInArrow(sparse, "f binary, v binary, y int").toPandas()
    lists = [np.frombuffer(f, np.int16) for f in found["f"]]
    at = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    values = np.log1p(np.frombuffer(b"".join(found["v"]), np.int32))
    weights, bias = logistic(at, np.concatenate(lists), values, len(lists), scale, found["y"].to_numpy(np.float64), penalty)
    return Model(slots, weights, bias)


def trained(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], max_fit_rows: int = 10_000, label: str = "toxic") -> Model:
    """A model from (id, text) and the labels of rows outside the held-out fold.

    max_fit_rows bounds the labelled rows it is fitted on: those with the smallest hashes of their ids, the same on
    every run, up to half of the bound of each label. Their ids, no more than the bound, are broadcast; their features reach the
    driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"), *fold)).groupBy("id").agg(F.max("y").alias("y"))
    half = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_fit_rows // 2) for y in (0, 1)]
    rows = in_small_batches(docs).join(F.broadcast(half[0].union(half[1])), "id").select(F.col("text").cast("string").alias("text"), "y")
    rows = stored(rows.repartition(16), "toxic-fit")
    model = fitted(rows)
    dropped(rows)
    return model


def scored(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every row: the score is the probability that the text is toxic.

    Null and empty texts have no n-grams: their score is that of the bias. A null id counts as held out. Repeated rows
    are scored each; of repeated labels the larger holds. With no usable label the score is one constant.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model = trained(own, labels, fold)
    return own.select("id", held_out(F.col("id"), *fold).alias("held_out"), model.column(F.col("text")).alias("score"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose toxicity score stays below the threshold."""
    model = trained(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), labels, fold)
    return docs.where(model.column(F.col(text_col)) < threshold)
