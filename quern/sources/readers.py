"""Scans with explicit ordinals, adapters and evidence."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = "id string, url string, title string, text string"


def pages(spark: SparkSession, *paths: str, most: int | None = None) -> DataFrame:
    """Parquet pages: id as text, null text as empty, the file they come from; the first `most` by file and id."""
    raw = spark.read.parquet(*paths)
    own = raw.select(F.col("id").cast("string").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("url", "title")], F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_name").alias("file"))
    return own if most is None else own.orderBy("file", "id").limit(most)


def scan_evidence(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, rows): what a scan has seen of each file, to hold against a manifest."""
    return spark.read.parquet(*paths).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


def wiki_xml(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Pages of a MediaWiki dump (bz2 too) in the main namespace that aren't redirects; `most` counts all pages."""
    kind = "id long, ns int, title string, redirect struct<_title:string>, revision struct<id:long,text:struct<_VALUE:string>>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(kind).load(path)
    raw = raw if most is None else raw.orderBy("id").limit(most)
    return raw.where("ns = 0 AND redirect IS NULL").select("id", F.col("revision.id").alias("revision_id"), "title", F.col("revision.text._VALUE").alias("raw"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSONL file; blank lines are skipped and not numbered, a line that is no object is an error."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    parsed = raw.withColumn("o", F.from_json("value", schema, {"mode": "FAILFAST"}))
    order = Window.partitionBy("file").orderBy("block", "at")
    return parsed.select("file", (F.row_number().over(order) - 1).alias("row"), "o.*")


def tolerant_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL log; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def row_range(df: DataFrame, ordinal: str, start: int, stop: int) -> DataFrame:
    """Rows by a stored ordinal; the filter reaches the row groups of a file sorted by it."""
    return df.where((F.col(ordinal) >= start) & (F.col(ordinal) < stop))


def code_points(spark: SparkSession, path: str) -> DataFrame:
    """(code_point, field, value) of tab-separated U+XXXX lines; comments are left out, the first value wins."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).where("value LIKE 'U+%'")
    part = F.split("value", "\t")
    rows = raw.select(F.conv(F.substring(part[0], 3, 8), 16, 10).cast("int").alias("code_point"), part[1].alias("field"), part[2].alias("value"), "line")
    return rows.groupBy("code_point", "field").agg(F.min_by("value", "line").alias("value"))


def decompositions(spark: SparkSession, path: str) -> DataFrame:
    """(character, definition) of tab-separated files by path and line, the first wins, only what precedes a semicolon."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where("value <> '' AND value NOT LIKE '#%'")
    part = F.split("value", "\t")
    rows = raw.select(part[F.size(part) - 2].alias("character"), F.split_part(F.element_at(part, -1), F.lit(";"), F.lit(1)).alias("definition"), "file", "line")
    return rows.groupBy("character").agg(F.min_by("definition", F.struct("file", "line")).alias("definition"))


def pinned_files(spark: SparkSession, path: str, chosen: str = "all") -> DataFrame:
    """(place, path, size, sha256) of the files of a pinned JSON configuration, all of them or a list of places."""
    files = spark.read.option("multiLine", True).json(path).select(F.posexplode("files").alias("place", "f")).select("place", "f.*")
    if chosen == "all":
        return files
    places = [int(p) for p in chosen.split(",")]
    n = files.count()
    if len(set(places)) != len(places) or not all(0 <= p < n for p in places):
        raise ValueError(f"places must be distinct and below {n}: {chosen}")
    return files.where(F.col("place").isin(places))


def safe_path(raw: str, aliases: dict[str, str], dataset: str) -> str:
    """A relative path under its dataset's folder; absolute paths and parents are errors."""
    p = PurePosixPath(raw)
    if p.is_absolute() or ".." in p.parts:
        raise ValueError(f"unsafe path: {raw}")
    return str(PurePosixPath(aliases.get(dataset, dataset)) / p)


def bitmap_labels(inventory: DataFrame, bits: Column) -> DataFrame:
    """(bits, labels): labels of each bitmap, several where bitmaps collide."""
    return inventory.groupBy(bits.alias("bits")).agg(F.array_sort(F.collect_list("label")).alias("labels"))


def transcribed(tiles: DataFrame, labels: DataFrame, bracket: str = "[]", mark: str = "/", unknown: str = "□") -> DataFrame:
    """(sample, text): tiles in order as labels; of several as [a/b], none as a box. The dimension is joined, not sent."""
    name = F.when(F.col("labels").isNull(), unknown).when(F.size("labels") == 1, F.col("labels")[0]).otherwise(F.concat(F.lit(bracket[0]), F.array_join("labels", mark), F.lit(bracket[1])))
    named = tiles.join(labels, "bits", "left").select("sample", F.struct("position", name.alias("name")).alias("x"))
    return named.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]), "").alias("text"))
