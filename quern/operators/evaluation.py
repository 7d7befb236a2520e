"""Confusion counts, thresholds, bootstrap intervals, bitmaps and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, rounded to six places; `empty` where b is 0."""
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty).cast("double")), 6)


def confusion(rows: DataFrame, by: list[str], prediction: Column, truth: Column, empty: float | None = 0.0) -> DataFrame:
    """TP, FP, FN, TN and the ratios made of them, per group."""
    p, t = prediction.cast("boolean"), truth.cast("boolean")
    c = rows.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return c.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp, empty).alias("precision"), ratio(tp, tp + fn, empty).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, empty).alias("f1"), ratio(tp, tp + fp + fn, empty).alias("iou"), ratio(tp + tn, n, empty).alias("accuracy"), ratio(tp + fp, n, empty).alias("positive_rate"), ratio(tp + fn, n, empty).alias("target_rate"))


def sweep(rows: DataFrame, score: Column, truth: Column, grid: list[float]) -> DataFrame:
    """Confusion counts and F1 for each threshold (score >= threshold) in one pass, without a row per threshold."""
    t = truth.cast("boolean")
    found = rows.agg(*[f(x).alias(f"{n}{i}") for i, g in enumerate(grid) for n, f, x in (("tp", F.count_if, (score >= g) & t), ("fp", F.count_if, (score >= g) & ~t))], F.count_if(t).alias("pos"), F.count("*").alias("n"))
    each = found.select(F.explode(F.array(*[F.struct(F.lit(g).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("pos") - F.col(f"tp{i}")).alias("fn")) for i, g in enumerate(grid)])).alias("x")).select("x.*")
    return each.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def best_threshold(swept: DataFrame, middle: float = 0.5) -> DataFrame:
    """The threshold with the largest F1; of equals the nearest to the middle, then the lower."""
    key = F.struct("f1", -F.round(F.abs(F.col("threshold") - middle), 9), -F.col("threshold"))
    return swept.agg(F.max_by("threshold", key).alias("threshold"), F.max("f1").alias("f1"))


def bootstrap(rows: DataFrame, by: list[str], value: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """Mean and percentile interval per group. Resamples are Poisson weights by hash, so groups of any size are summed
    where their rows are and only `resamples` sums per group move."""
    weights = [F.expr(f"CAST(aggregate(array(0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582), 0, (a, c) -> a + IF(pmod(xxhash64({value}, {','.join(by) or '0'}, id, {seed + r}), 1000000) / 1000000.0 >= c, 1, 0)) AS DOUBLE)") for r in range(resamples)]
    sums = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.array(*[F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0)) for w in weights]).alias("m"))

    def ends(x: pd.Series) -> pd.Series:
        return x.map(lambda m: list(np.nanquantile(np.array(m, float), [0.025, 0.975])))

    return sums.select(*by, "n", "mean", F.pandas_udf(ends, "array<double>")("m").alias("interval"))


def sign_bits(vector: Column) -> Column:
    """A long of up to 64 sign bits, most significant first."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("long")))


def packed_bytes(bits: Column) -> Column:
    """Bits (array of 0 and 1) as hex of bytes, eight a byte, most significant first."""
    groups = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 8).cast("int"))
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(F.aggregate(F.slice(bits, g * 8 + 1, F.lit(8)), F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))), 2, "0")), "")


def paired(queries: DataFrame, gallery: DataFrame, own: bool = False, most: int = 100_000) -> DataFrame:
    """(query_id, q, id, g): each query with each item of the gallery, its own only if so wanted.

    The gallery is broadcast if it has at most `most` rows, which is counted; a larger one is dealt in blocks with the
    query set sent to each.
    """
    g = gallery.select(F.col("id"), F.col("bits").alias("g"))
    q = queries.select(F.col("id").alias("query_id"), F.col("bits").alias("q"))
    n = gallery.count()
    if n <= most:
        pairs = q.join(F.broadcast(g))
    else:
        blocks = -(-n // most)
        dealt = g.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        pairs = q.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "b").drop("b")
    return pairs if own else pairs.where("query_id <> id")


def nearest(queries: DataFrame, gallery: DataFrame, k: int, own: bool = False, most: int = 100_000) -> DataFrame:
    """(query_id, rank, id, distance): k nearest by Hamming distance of long `bits`, ties to the smaller id.

    Blocks of a large gallery each give their best k.
    """
    pairs = paired(queries, gallery, True, most)
    near = pairs if own else pairs.where("query_id <> id")
    near = near.select("query_id", "id", F.bit_count(F.col("q").bitwiseXOR(F.col("g"))).cast("long").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def best_overlap(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(query_id, id, f1, margin): best F1 of set bits in the gallery, its lead over the second, ties to the smaller id."""
    pairs = paired(queries, gallery)
    both = F.bit_count(F.col("q").bitwiseAND(F.col("g")))
    f1 = ratio(2 * both, F.bit_count("q") + F.bit_count("g"))
    order = Window.partitionBy("query_id").orderBy(F.desc("f1"), "id")
    top = pairs.select("query_id", "id", f1.alias("f1")).withColumns({"place": F.row_number().over(order), "second": F.lead("f1").over(order)})
    return top.where("place = 1").select("query_id", "id", "f1", F.round(F.col("f1") - F.coalesce("second", F.lit(0.0)), 6).alias("margin"))


def terciles(rows: DataFrame, value: str) -> DataFrame:
    """rows with bucket low, middle or high, cut at the linear 1/3 and 2/3 quantiles (two numbers, broadcast)."""
    cuts = rows.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    joined = rows.join(F.broadcast(cuts))
    return joined.withColumn("bucket", F.when(F.col(value) <= F.col("c")[0], "low").when(F.col(value) <= F.col("c")[1], "middle").otherwise("high")).drop("c")


def standardised(rows: DataFrame, value: str, train: Column, floor: float = 1e-6) -> DataFrame:
    """rows with z: statistics (population deviation, at least floor) of training rows alone."""
    stats = rows.agg(F.avg(F.when(train, F.col(value))).alias("m"), F.greatest(F.stddev_pop(F.when(train, F.col(value))), F.lit(floor)).alias("s"))
    return rows.join(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("m")) / F.col("s")).drop("m", "s")


def learning_rate(step: Column, warm: int, total: int, peak: float, floor: float) -> Column:
    """Linear warm-up, then a cosine to the floor."""
    part = F.least(F.lit(1.0), (step - warm) / F.lit(float(max(1, total - warm))))
    return F.when(step < warm, F.lit(peak) * (step + 1) / warm).otherwise(floor + 0.5 * (peak - floor) * (1 + F.cos(F.pi() * part)))


def gathered_ink(tokens: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """(by, tokens, ink): tokens (by, id) joined with the bitmaps (id, bits) of their items, set bits summed."""
    joined = tokens.groupBy(by, "id").agg(F.count("*").alias("c")).join(items.select("id", F.bit_count("bits").alias("ink")), "id")
    return joined.groupBy(by).agg(F.sum("c").alias("tokens"), F.sum(F.col("c") * F.col("ink")).cast("long").alias("ink"))


def content_nearest(queries: DataFrame, gallery: DataFrame, content: Column, k: int) -> DataFrame:
    """nearest() among content, from the k + c nearest of the whole gallery, c being how many items are no content."""
    other = gallery.where(~content).count()
    near = nearest(queries, gallery, k + other).join(gallery.where(content).select("id"), "id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def best_product(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(query_id, id, common): the item with most set bits in common, of equals the smaller id."""
    pairs = paired(queries, gallery).select("query_id", "id", F.bit_count(F.col("q").bitwiseAND(F.col("g"))).cast("long").alias("common"))
    return pairs.groupBy("query_id").agg(F.max(F.struct("common", (-F.col("id")).alias("i"))).alias("x")).select("query_id", (-F.col("x.i")).alias("id"), F.col("x.common").alias("common"))


def ladders(rows: DataFrame, distance: str, most: tuple[int, ...], overlap: str, least: tuple[float, ...]) -> DataFrame:
    """One row: items, and the shares of all of them within each distance and at or above each overlap."""
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return rows.agg(F.count("*").alias("items"), *[share(F.col(distance) <= x).alias(f"within_{x}") for x in most], *[share(F.col(overlap) >= x).alias(f"f1_{int(100 * x)}") for x in least])


def paired_f1(rows: DataFrame, key: str, first: Column, second: Column, truth: Column, resamples: int) -> DataFrame:
    """One row: F1 of two predictions over the same rows, their difference, and in which share of resamples the first is larger.

    A resample weighs each row, for both predictions alike, by a Poisson number from the hash of its key; all resamples are
    summed in one pass over the rows.
    """
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)

    def weight(r: int) -> Column:
        u = T.text_id_ordinal(str(r), F.col(key), 1_000_000) / 1_000_000.0
        return sum(((u >= c).cast("int") for c in cuts), F.lit(0))

    sums = []
    for r in range(-1, resamples):
        w = F.lit(1) if r < 0 else weight(r)
        for k, p in enumerate((first, second)):
            sums += [F.sum(F.when(p & truth, w).otherwise(0)).alias(f"h{k}_{r + 1}"), F.sum(F.when(p != truth, w).otherwise(0)).alias(f"e{k}_{r + 1}")]
    s = rows.agg(*sums)
    f1 = lambda k, r: F.coalesce(2 * F.col(f"h{k}_{r}") / F.nullif(2 * F.col(f"h{k}_{r}") + F.col(f"e{k}_{r}"), F.lit(0)), F.lit(0.0))
    larger = sum(((f1(0, r) > f1(1, r)).cast("int") for r in range(1, resamples + 1)), F.lit(0))
    return s.select(F.round(f1(0, 0), 6).alias("first"), F.round(f1(1, 0), 6).alias("second"), F.round(f1(0, 0) - f1(1, 0), 6).alias("difference"), F.round(larger / resamples, 6).alias("probability"))


def deltas(baseline: DataFrame, control: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Control minus baseline of each measure, paired by the keys."""
    a, b = baseline.alias("a"), control.alias("b")
    return a.join(b, keys).select(*keys, *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(f"d_{m}") for m in measures])
