"""Exact top-k inner products with block-at-a-time pruning.

Candidates lie in blocks of neighbouring ids, each with a forward index (its vectors) and the largest and smallest value
of each component. The sum of the maxima that a query's components can reach bounds every score in a block. A query
visits blocks by falling bound and stops when the bound is below its k-th score. A first round over few ranges of
blocks, the query's own and those of the smallest ids, gives every query a k-th (score, id) to start from. The extremes
of whole ranges are a table of their own: only queries whose bound there reaches their start are sent to a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a block, in a range of blocks (one row of the index), and queries in a group.
BLOCK, RANGE, GROUP = 256, 4096, 512
#: Ranges whose extremes lie in one row.
LIMITS = 1024
#: Vectors of the smallest ids that every query begins with, beside its own range, and most ranges that hold them.
LEADING, LEADS = 16_384, 64

INDEXED = "kind int, range long, n int, ids binary, vectors binary, home long, least long, limits binary"
_INDEXED = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("home", pa.int64()), ("least", pa.int64()), ("limits", pa.binary())])


SENT = "range long, group long, n int, rows binary, ids binary, vectors binary, kth binary, kth_id binary"
_SENT = pa.schema([("range", pa.int64()), ("group", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "vectors", "kth", "kth_id"))])


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components, each component x as floor(64 * x), a whole double."""
    raw = F.col(vector_col)
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(raw.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(raw, _floored).alias("v"))


def _floored(x: Column) -> Column:
    y = x.cast("double") * 64
    return y - F.pmod(y, F.lit(1.0))


def indexed(vectors: DataFrame, query: Column, dims: int) -> DataFrame:
    """Rows of kind 0, ranges of candidates, and of kind 1, groups of queries with the range they start from (home)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        ask: list[np.ndarray] = []

        def dense(column: pa.Array) -> np.ndarray:
            out = np.zeros((len(column), dims))
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(column)), lengths)
            out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            return out

        def out_of(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, rows, ask
            a, x, q = np.concatenate(ids), np.concatenate(rows), np.concatenate(ask)
            while len(a) >= RANGE or (final and len(a)):
                number += 1
                yield _row(0, number, a[:RANGE], x[:RANGE], number)
                for start in range(0, int(q[:RANGE].sum()), GROUP):
                    at = np.flatnonzero(q[:RANGE])[start : start + GROUP]
                    yield _row(1, (number << 8) + start // GROUP, a[at], x[at], number)
                a, x, q = a[RANGE:], x[RANGE:], q[RANGE:]
            ids, rows, ask = [a], [x], [q]

        for b in it:
            if b.num_rows:
                ids.append(b.column(0).to_numpy())
                rows.append(dense(b.column(1)))
                ask.append(b.column(2).to_numpy(zero_copy_only=False).astype(bool))
                yield from out_of(False)
        if ids:
            yield from out_of(True)

    n = max(1, -(-vectors.count() // (4 * RANGE)))
    dealt = vectors.select("id", "v", query.alias("q"), F.xxhash64("v").alias("h")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")
    return dealt.select("id", "v", "q").mapInArrow(run, INDEXED)


def _row(kind: int, number: int, ids: np.ndarray, vectors: np.ndarray, home: int) -> pa.RecordBatch:
    small = len(vectors) == 0 or np.abs(vectors).max() < 1 << 24
    raw = vectors.astype(np.float32 if small else np.float64).tobytes()
    limits = np.stack([vectors.max(axis=0), vectors.min(axis=0)]).astype(np.float64).tobytes() if kind == 0 else None
    row = kind, number, len(ids), ids.astype(np.int64).tobytes(), raw, home, int(ids.min()), limits
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEXED, strict=True)], schema=_INDEXED)


def _vectors(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dims else np.float64).reshape(n, dims)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return out.astype(np.int64)  # raises where a score is no long


def _bounds(q: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each query and each block no less than any score there."""
    out = np.maximum(q, 0).astype(np.float64) @ tops.T + np.minimum(q, 0).astype(np.float64) @ lows.T
    return out + np.abs(out) * 1e-9  # never below the exact sum


def _best(who: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: larger scores, then smaller ids."""
    by = np.lexsort((found, -scores, who))
    who, found, scores = who[by], found[by], scores[by]
    first = np.searchsorted(who, who)
    keep = np.arange(len(who)) - first < k
    return who[keep], found[keep], scores[keep]


def _kth(who: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> None:
    """Sets (kth, kth_id) of the queries that have k results, which are in order."""
    full = np.flatnonzero(np.bincount(who, minlength=len(kth)) >= k)
    last = np.searchsorted(who, full) + k - 1
    s, i = scores[last].astype(np.float64), found[last]
    better = (s > kth[full]) | ((s == kth[full]) & (i < kth_id[full]))
    kth[full[better]], kth_id[full[better]] = s[better], i[better]


def pruned(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, start: np.ndarray, start_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, id, score) of the k best in this range for each query, none behind its start (score, id), and how many
    blocks were scored."""
    blocks = [slice(s, min(s + BLOCK, len(x))) for s in range(0, len(x), BLOCK)]
    bounds = _bounds(q, np.stack([x[b].max(axis=0) for b in blocks]).astype(np.float64), np.stack([x[b].min(axis=0) for b in blocks]).astype(np.float64))
    least = np.array([ids[b].min() for b in blocks])
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth, kth_id = start.copy(), start_id.copy()
    who, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    visited = 0
    for r in range(len(blocks)):
        at = order[:, r]
        own_bound = bounds[np.arange(len(q)), at]
        if not (own_bound >= kth).any():
            break
        live = np.flatnonzero((own_bound > kth) | ((own_bound == kth) & (least[at] <= kth_id)))
        new = []
        for b in np.unique(at[live]):
            own = live[at[live] == b]
            visited += len(own)
            s, i = _products(q[own], x[blocks[b]]), ids[blocks[b]][None, :]
            limit = kth[own][:, None]
            fit = ((s > limit) | ((s == limit) & (i <= kth_id[own][:, None]))) & (i != q_ids[own][:, None])
            row, col = np.nonzero(fit)
            new.append((own[row], ids[blocks[b]][col], s[row, col]))
        if new:
            who, found, scores = _best(*(np.concatenate([old, *(n[j] for n in new)]) for j, old in enumerate((who, found, scores))), k)
            _kth(who, found, scores, k, kth, kth_id)
    return who, found, scores, visited


def top_k(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, its k best among rows of another id.

    The score is the exact inner product of the components floor(64 * x); ties go to the smaller id. Vectors that are
    null or hold a null or non-finite component, and rows with a null id, take no part; a shorter vector counts as
    filled up with zeros. Repeated rows are candidates each, repeated query rows have results each. A score that no
    long can hold is an error. Other columns are not looked at.
    """
    vectors = whole_vectors(rows, id_col, vector_col)
    dims = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    index = stored(indexed(vectors, F.pmod("id", F.lit(every)) == 0, dims), "vectors")
    ranges = index.where("kind = 0").select("range", F.col("n").alias("xn"), F.col("ids").alias("xids"), F.col("vectors").alias("x"))
    groups = index.where("kind = 1").select(F.col("range").alias("group"), "n", "ids", "vectors", "home")
    n_ranges = index.where("kind = 0").count()
    lead, seen = [], 0
    for r in index.where("kind = 0").select("range", "n").orderBy("least", "range").limit(LEADS).collect():
        if seen < LEADING:
            lead.append(r["range"])
            seen += r["n"]
    nothing = np.iinfo(np.int64).max

    def first_round(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for g, n, q_ids, q, xn, ids, x in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                who, found, scores, _ = pruned(np.frombuffer(q_ids, np.int64), _vectors(q, n, dims), np.frombuffer(ids, np.int64), _vectors(x, xn, dims), k, np.full(n, -np.inf), np.full(n, nothing))
                yield pa.RecordBatch.from_arrays([pa.array([g]), *(pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in (who, found, scores))], names=["group", "who", "found", "scores"])

    # the ranges of the smallest ids too, to which ties go
    goes = groups.withColumn("range", F.explode(F.array_distinct(F.array("home", *[F.lit(x).cast("long") for x in lead])))).join(ranges, "range")
    begun = goes.select("group", "n", "ids", "vectors", "xn", "xids", "x").mapInArrow(first_round, "group long, who binary, found binary, scores binary")
    begun = stored(begun.groupBy("group").agg(F.collect_list(F.struct("who", "found", "scores")).alias("begun")), "begun")
    shelves = -(-n_ranges // LIMITS)
    limits = index.where("kind = 0").select(F.pmod(F.xxhash64("range"), F.lit(max(1, shelves))).cast("int").alias("shelf"), "range", "least", "limits")
    limits = limits.groupBy("shelf").agg(F.collect_list(F.struct("range", "least", "limits")).alias("limits"))  # some LIMITS ranges
    told = groups.join(begun, "group").withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(max(0, shelves - 1))))).join(limits, "shelf")

    def sent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for group, n, q_ids, q, starts, own in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                parts = [[np.frombuffer(r[c], np.int64) for r in starts] for c in ("who", "found", "scores")]
                kth, kth_id = np.full(n, -np.inf), np.full(n, nothing)
                _kth(*_best(*map(np.concatenate, parts), k), k, kth, kth_id)
                q_ids, q = np.frombuffer(q_ids, np.int64), _vectors(q, n, dims)
                extremes = np.stack([np.frombuffer(r["limits"]).reshape(2, -1) for r in own])
                bounds = _bounds(q, extremes[:, 0], extremes[:, 1])
                for j, r in enumerate(own):
                    live = np.flatnonzero((bounds[:, j] > kth) | ((bounds[:, j] == kth) & (r["least"] <= kth_id)))
                    if len(live):
                        row = r["range"], group, len(live), live.tobytes(), q_ids[live].tobytes(), q[live].tobytes(), kth[live].tobytes(), kth_id[live].tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SENT, strict=True)], schema=_SENT)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for group, n, rows_, q_ids, q, kth, kth_id, xn, ids, x in zip(*(b.column(c).to_pylist() for c in range(10)), strict=True):
                q_ids = np.frombuffer(q_ids, np.int64)
                who, found, scores, _ = pruned(q_ids, _vectors(q, n, dims), np.frombuffer(ids, np.int64), _vectors(x, xn, dims), k, np.frombuffer(kth), np.frombuffer(kth_id, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), group)), pa.array(np.frombuffer(rows_, np.int64)[who]), pa.array(q_ids[who]), pa.array(found), pa.array(scores)], names=["group", "row", "query_id", "id", "score"])

    reached = told.select("group", "n", "ids", "vectors", "begun", "limits").mapInArrow(sent, SENT)
    best = reached.join(ranges, "range").select("group", "n", "rows", "ids", "vectors", "kth", "kth_id", "xn", "xids", "x").mapInArrow(scored, "group long, row long, query_id long, id long, score long")
    order = Window.partitionBy("group", "row").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
