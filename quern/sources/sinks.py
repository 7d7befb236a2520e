"""Sinks: splits as Parquet and text, token streams with offsets, small JSON files on the driver."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet, zstd, one folder per split; a path that exists is an error."""
    df.write.mode("error").partitionBy(split).option("compression", "zstd").parquet(path)


def paragraphs_text(df: DataFrame, path: str, text: str = "text") -> None:
    """Text files whose paragraphs a blank line separates."""
    df.select(F.concat(F.col(text), F.lit("\n"))).write.mode("error").text(path)


def token_stream(docs: DataFrame, path: str, order: str, tokens: str, parts: int = 64) -> None:
    """Ordered Parquet of (order, offset, little-endian unsigned 16-bit stream as binary), ranges in order."""
    from ..operators.sequence import offsets

    placed = offsets(docs.withColumn("n", F.size(tokens).cast("long")), order, "n", parts)
    code = lambda t: F.concat(F.lpad(F.hex(t % 256), 2, "0"), F.lpad(F.hex(F.shiftright(t, 8)), 2, "0"))
    stream = F.unhex(F.array_join(F.transform(tokens, lambda t: code(t.cast("long"))), ""))
    placed.select(order, "offset", "n", stream.alias("stream")).repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("error").parquet(path)


def atomic_json(path: str, value: object) -> None:
    """Writes JSON beside the target and renames it, so a reader never sees half a file."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=1)
    os.replace(name, target)
