"""Splits, rankings and samples by hash, all repeatable and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_id_ordinal


def split(key: Column, seed: str = "20260907", cuts: tuple[int, int] = (980, 990)) -> Column:
    """train, validation or test by the hash ordinal of a key, in thousandths."""
    at = text_id_ordinal(seed, key)
    return F.when(at < cuts[0], "train").when(at < cuts[1], "validation").otherwise("test")


def hash_rank(seed: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def smallest(df: DataFrame, k: int, by: Column, partition: list[str], ties: list[Column]) -> DataFrame:
    """The k rows of each partition with the smallest rank; Spark keeps k per task before the shuffle."""
    order = Window.partitionBy(*partition).orderBy(by, *ties)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def one_per_group(df: DataFrame, group: str, seed: str, key: str, k: int) -> DataFrame:
    """One row per group by hash of its key, then the k groups with the smallest hashes."""
    best = df.withColumn("__h", hash_rank(seed, F.col(key))).groupBy(group).agg(F.min_by(F.struct(*df.columns), F.struct("__h", key)).alias("r")).select("r.*")
    return best.withColumn("group_hash", hash_rank(seed, F.col(group))).orderBy("group_hash", group).limit(k)


def top_frequencies(values: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return values.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def group_split(groups: DataFrame, key: str, seed: str, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Whole groups cut by the rank of their hash: the first share train, the next validation, the rest test."""
    n = groups.count()
    ranked = groups.withColumn("place", F.row_number().over(Window.orderBy(hash_rank(seed, F.col(key)))))
    a, b = round(n * shares[0]), round(n * (shares[0] + shares[1]))
    return ranked.withColumn("split", F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "validation").otherwise("test")).drop("place")


def rank_shards(rows: DataFrame, place: str, batch: int, world: int) -> DataFrame:
    """rank and step of each place when batches are dealt to ranks in turn."""
    b = F.floor(F.col(place) / batch)
    return rows.withColumns({"rank": (b % world).cast("int"), "step": F.floor(b / world).cast("long")})


def padded_shards(n: int, world: int, spark) -> DataFrame:
    """(rank, slot, id): every id once, short ranks padded with -1."""
    per = -(-n // world)
    return spark.range(per * world).select((F.col("id") % world).cast("int").alias("rank"), F.floor(F.col("id") / world).alias("slot"), F.when(F.col("id") < n, F.col("id")).otherwise(-1).alias("id"))


def epoch(rows: DataFrame, key: str, seed: int, number: int, cursor: int = 0) -> DataFrame:
    """A repeatable shuffle of an epoch without what the cursor has consumed."""
    ranked = rows.withColumn("place", F.row_number().over(Window.orderBy(hash_rank(f"{seed}:{number}", F.col(key)), F.col(key))) - 1)
    return ranked.where(F.col("place") >= cursor)


def sortish(rows: DataFrame, key: str, length: str, seed: int, batch: int, pool: int = 64) -> DataFrame:
    """Batches of like lengths: hash-ordered pools sorted by falling length, full batches shuffled, the short one last."""
    size = batch * pool
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(hash_rank(str(seed), F.col(key)), F.col(key))) - 1)
    pooled = placed.withColumn("pool", F.floor(F.col("place") / size))
    inside = pooled.withColumn("slot", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc(length), "place")) - 1)
    batched = inside.withColumn("batch", F.floor((F.col("pool") * size + F.col("slot")) / batch))
    full = F.count("*").over(Window.partitionBy("batch")) == batch
    return batched.withColumn("full", full).withColumn("order", F.when(F.col("full"), hash_rank(f"{seed}:b", F.col("batch"))).otherwise("~")).drop("place", "slot")


def sweeps(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n balanced passes over all rows, each in an order of its own."""
    each = rows.withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("sweep").orderBy(F.xxhash64(F.lit(seed), "sweep", key), key)))


def positions(rows: DataFrame, rank: str, place: str, skip: int, take: int) -> DataFrame:
    """Rows skip .. skip + take of the order by rank, then place."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(rank, place)) - 1).where((F.col("position") >= skip) & (F.col("position") < skip + take))
