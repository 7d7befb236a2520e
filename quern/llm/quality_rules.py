"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees on a bounded sample of labelled rows give paths; each path is a conjunction of comparisons of
statistics. A logistic model with an L1 penalty picks few of these rules, and the rules with their weights become
one Spark column expression.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, held_out, in_small_batches

#: Byte classes whose shares of a text are statistics.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",",
    "bang": b"!?",
    "mark": b"#$%&*",
    "bar": b"|",
    "other": b"\"'()-/:;<=>@[\\]^_`{}~+",
    "space": b" \t\r\x0b\x0c",
    "high": bytes(range(128, 256)),
}
NAMES = [
    *CLASSES, "log_bytes", "log_words", "word_len", "word_len_var", "distinct", "repeated_lines", "same_next",
    "words_a_line", "short", "ends_marked", "top_word", "entropy", "title_words", "sentence_len",
]
_TABLE = np.array([[c in chars for c in range(256)] for chars in CLASSES.values()], np.float64).T


_MARKED, _TITLE = re.compile(rb"[#$%&*!|](?=\s|$)"), re.compile(rb"(?:^|(?<=\s))[A-Z][a-z]")


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES; of an empty one all 0."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _TABLE) / n
    words = text.split()
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lower = text.lower().split()
    tally = Counter(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, lower, lower[1:]))
    p = counts[counts > 0] / n
    return [
        *shares.tolist(), float(np.log1p(n)), float(np.log1p(len(words))), float(lens.mean()), float(lens.var()), len(tally) / m,
        1 - len(set(lines)) / max(1, len(lines)), same / m, float(np.log1p(m / max(1, len(lines)))), float((lens <= 3).mean()),
        len(_MARKED.findall(text)) / m, max(tally.values(), default=0) / m, float(-(p * np.log2(p)).sum()),
        len(_TITLE.findall(text)) / m, float(np.log1p(m / (1 + counts[46]))),
    ]


def stats_column(text: Column) -> Column:
    """The statistics of a text column as an array of doubles."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x.as_py()) for x in texts], pa.list_(pa.float64()))

    return of(text.cast("binary"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of comparisons (statistic, above, threshold)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.parts:
            out &= (x[:, f] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for f, above, t in self.parts:
            out &= (stats[f] > t) if above else (stats[f] <= t)
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1, as one expression over an array of statistics."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, depth: int, least: int, path: tuple, out: list, value: np.ndarray, rows: np.ndarray, features: np.ndarray) -> None:
    """Grows a regression tree on the rows; adds each node's path to out and sets value of its leaves."""
    if path:
        out.append(Rule(path))
    g, h = target[rows].sum(), weight[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for f in features:
            bins = np.searchsorted(cuts[f], x[rows, f], side="left")
            gs = np.cumsum(np.bincount(bins, target[rows], len(cuts[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins, weight[rows], len(cuts[f]) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, float(cuts[f][gain.argmax()]))
    if best[1] is None:
        value[rows] = g / (h + 1)
        return
    _, f, t = best
    above = x[rows, f] > t
    for side in (False, True):
        _tree(x, cuts, target, weight, depth - 1, least, (*path, (int(f), side, t)), out, value, rows[above == side], features)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights and bias under an L1 penalty on the weights (accelerated proximal gradient)."""
    n, m = a.shape
    step = 4 / (np.linalg.norm(a, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y
        new_w = v - step * (a.T @ r) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = c - step * r.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def fitted(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> Model:
    """A model of statistics x and labels y; without both labels it is the share of label 1."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model((), (), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    raw, found = np.zeros(len(y)), []
    least = max(3, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        value = np.zeros(len(y))
        features = rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]
        _tree(x, cuts, y - p, p * (1 - p), depth, least, (), found, value, rows, features)
        raw += 0.3 * value
    unique: dict[bytes, Rule] = {}
    for rule in sorted(set(found), key=lambda r: len(r.parts)):
        unique.setdefault(rule.holds(x).tobytes(), rule)
    rules = list(unique.values())
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    w, b = lasso(a, y, penalty)
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-4]
    return Model(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), float(b))


def trained(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], max_fit_rows: int = 20_000, label: str = "quality") -> Model:
    """A model from (id, text) and the labels of rows outside the held-out fold.

    max_fit_rows bounds the labelled ids it is fitted on: those with the smallest hashes, the same on every run. They are
    broadcast, and only the texts of these ids are measured for it; their statistics reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"), *fold)).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_fit_rows)
    rows = docs.join(F.broadcast(known), "id").select("id", stats_column(F.col("text")).alias("stats"), "y").orderBy(F.xxhash64("id"), "id", "stats").limit(max_fit_rows).toPandas()
    x = np.array(rows["stats"].tolist(), np.float64).reshape(len(rows), len(NAMES))
    return fitted(x, rows["y"].to_numpy(np.float64))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def scored(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every row: the score is the probability that the quality label is 1.

    Null and empty texts have statistics of 0 and a score like any other. A null id counts as held out. Repeated rows
    are scored each; of repeated labels the larger holds. With no usable label the score is one constant.
    """
    own = _own(docs, id_col, text_col)
    model = trained(own, labels, fold)
    return own.select("id", stats_column(F.col("text")).alias("stats")).select("id", held_out(F.col("id"), *fold).alias("held_out"), model.score(F.col("stats")).alias("score"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose quality score reaches the threshold. Odd rows are scored as in scored()."""
    model = trained(_own(docs, id_col, text_col), labels, fold)
    own = free("stats", docs.columns)
    return docs.withColumn(own, stats_column(F.col(text_col))).where(model.score(F.col(own)) >= threshold).drop(own)
