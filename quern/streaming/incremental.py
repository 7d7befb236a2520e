"""Incremental runs: batches applied once, duplicate removal against a table of state, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def identity_guard(found: dict, expected: dict, upgrade: str | None = None) -> dict:
    """The identity a resumed run continues under; other fields than the code's hash must be equal, and that needs
    an explicit upgrade, which goes into the history."""
    differ = {k for k in found.keys() | expected.keys() if k != "history" and found.get(k) != expected.get(k)}
    if differ - {"code_sha256"}:
        raise ValueError(f"the run was begun with other {', '.join(sorted(differ))}")
    if differ and upgrade != expected["code_sha256"]:
        raise ValueError("the code has changed; name its hash to go on")
    history = [*found.get("history", []), *([found["code_sha256"]] if differ else [])]
    return expected | {"history": history}


def seen_before(spark: SparkSession, state: str) -> DataFrame | None:
    """The table of hashes that earlier batches have left, if there is one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(state) if fs.exists(path) else None


def first_copies(stream: DataFrame, out: str, checkpoint: str, key: str = "text", order: str = "doc_id") -> StreamingQuery:
    """Appends rows whose key no earlier row had. Each batch goes to a folder of its number, overwritten if replayed,
    and the state a batch sees is what batches of smaller numbers have written: a replay gives the same rows."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("key_hash", F.sha2(F.coalesce(F.col(key), F.lit("")), 256))
        first = rows.join(rows.groupBy("key_hash").agg(F.min(order).alias(order)), ["key_hash", order]).dropDuplicates(["key_hash"])
        before = seen_before(spark, out)
        if before is not None:
            first = first.join(before.where(F.col("batch") < number).select("key_hash").distinct(), "key_hash", "left_anti")
        first.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with ts as a timestamp in the session's zone, with a watermark on a stream."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late) if events.isStreaming else own


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; works on a stream and on a table."""
    own = timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return own.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users by a gap of event time."""
    own = timed(events, late)
    w = F.session_window("ts", gap)
    return own.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once, with state bounded by the watermark on a stream."""
    own = timed(events, late)
    return own.dropDuplicatesWithinWatermark([key]) if events.isStreaming else own.dropDuplicates([key])
