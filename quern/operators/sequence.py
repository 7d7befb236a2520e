"""Offsets, chunks, packed windows, runs, repetition and cycles of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, EOS, NEWLINE, FIRST = 1, 2, 3, 4


def offsets(docs: DataFrame, order: str, length: str, parts: int | None = None, seen: int = 100_000) -> DataFrame:
    """Exclusive running sum of lengths in the given order: sums of ranges first, then inside each range.

    A row's range follows from its own value and boundaries that are found once, so both passes agree on it; rows of
    equal order are in one range. The boundaries, at most `parts` values, reach the driver. Nulls come first.
    """
    parts = parts or min(512, max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged, bases = range_sums(docs, order, length, parts, seen)
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(bases), "__range")  # one row per range
    return out.withColumn("offset", (F.col("base") + F.coalesce(F.sum(length).over(inside), F.lit(0))).cast("long")).drop("base", "__range")


def boundaries(docs: DataFrame, order: str, parts: int, seen: int) -> list:
    """At most parts - 1 values that cut the order into like parts, from a sample of about `seen` values."""
    share = min(1.0, seen / max(1, docs.count()))
    known = docs.select(order).where(F.col(order).isNotNull())
    part = (known.sample(share, seed=7) if share < 1 else known).select(order, F.ntile(parts).over(Window.orderBy(order)).alias("n"))
    return sorted({r["least"] for r in part.groupBy("n").agg(F.min(order).alias("least")).where("n > 1").collect()})


def range_number(x: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending values are not above x, by a balanced tree of comparisons; 0 for null."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x < F.lit(cuts[middle]).cast(kind), tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.when(x.isNull(), 0).otherwise(tree(0, len(cuts)))


def range_sums(docs: DataFrame, order: str, length: str, parts: int, seen: int) -> tuple[DataFrame, DataFrame]:
    """(docs with __range, (__range, base) per range): base is the sum of all ranges before."""
    ranged = docs.withColumn("__range", range_number(F.col(order), boundaries(docs, order, parts, seen), docs.schema[order].dataType.simpleString()))
    sums = ranged.groupBy("__range").agg(F.sum(length).alias("s"))
    return ranged, sums.select("__range", F.coalesce(F.sum("s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def encoded(text: Column, vocabulary: Column) -> Column:
    """BOS, the numbers of the characters (line feed its own, unknown -1), EOS."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(BOS)), F.transform(chars, lambda c: F.when(c == "\n", NEWLINE).otherwise(F.coalesce(vocabulary[c], F.lit(-1)))), F.array(F.lit(EOS)))


def inventory(docs: DataFrame, text: str) -> DataFrame:
    """(char, asset_id): distinct characters in code-point order, numbered after the controls."""
    chars = docs.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).where("char <> '' AND char <> '\n'").distinct()
    return chars.withColumn("asset_id", (F.row_number().over(Window.orderBy(F.hex(F.encode("char", "UTF-32")))) + FIRST - 1).cast("long"))


def chunk_counts(docs: DataFrame, length: str, contexts: list[int]) -> DataFrame:
    """Per context: documents cut into chunks of its targets (a document of n tokens has n - 1)."""
    t = F.col(length) - 1
    each = docs.where(t > 0).select(t.alias("t"), F.explode(F.array(*[F.lit(c) for c in contexts])).alias("context"))
    chunks = F.floor((F.col("t") - 1) / F.col("context")) + 1
    full = F.floor(F.col("t") / F.col("context"))
    return each.groupBy("context").agg(F.sum(chunks).alias("chunks"), F.sum(full).alias("full_chunks"), F.sum("t").alias("targets"), F.round(F.sum("t") / F.sum(chunks), 6).alias("mean_targets"), F.round(100 * F.sum(full * F.col("context")) / F.sum("t"), 6).alias("full_target_percent"))


def chunks(docs: DataFrame, key: str, length: str, context: int) -> DataFrame:
    """(key, chunk, start, valid): one-token overlap, the last chunk short."""
    n = F.floor((F.col(length) - 2) / context)
    each = docs.where(F.col(length) >= 2).select(key, F.col(length).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk"))
    return each.select(key, "chunk", (F.col("chunk") * context).alias("start"), F.least(F.lit(context), F.col("n") - 1 - F.col("chunk") * context).cast("long").alias("valid"))


def packed_windows(docs: DataFrame, order: str, length: str, context: int) -> DataFrame:
    """(window, targets): windows over the concatenated stream; a target that opens a document isn't counted."""
    placed = offsets(docs.select(order, length), order, length)
    total = placed.agg(F.sum(length).alias("n"))
    masked = placed.where("offset > 0").groupBy(F.floor((F.col("offset") - 1) / context).alias("window")).agg(F.count("*").alias("masked"))
    last = F.floor((F.col("n") - 2) / context)
    windows = total.where("n >= 2").select("n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    size = F.least(F.lit(context), F.col("n") - 1 - F.col("window") * context)
    return windows.join(masked, "window", "left").select("window", (size - F.coalesce("masked", F.lit(0))).cast("long").alias("targets"))


def packing_statistics(docs: DataFrame, length: str, context: int) -> DataFrame:
    """One row of fourteen measures of documents packed end to end."""
    t = F.col(length) - 1
    p = F.percentile(t, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    a = docs.agg((F.sum(length) - 1).alias("total"), F.sum(t).alias("targets"), F.count("*").alias("n"), F.avg(t).alias("mean"), p.alias("p"), F.max(t).alias("longest"), F.sum(F.floor(t / context)).alias("full"), F.sum(F.when(t >= context, t).otherwise(0)).alias("long"))
    w = F.ceil(F.col("total") / context)
    return a.select(F.lit(context).alias("context"), w.alias("windows"), F.col("targets").alias("effective_targets"), F.round(F.col("targets") / w, 6).alias("mean_effective_targets"), F.round(F.col("targets") / (w * context), 6).alias("target_utilization"), (w * context - F.col("total")).alias("padding_positions"), (F.col("n") - 1).alias("masked_transitions"), F.round("mean", 6).alias("document_mean_targets"), *[F.round(F.col("p")[i], 6).alias(f"document_p{q}") for i, q in enumerate((50, 95, 99))], F.col("longest").alias("document_max"), F.col("full").alias("full_document_windows"), F.col("long").alias("long_document_targets"))


def length_summary(values: DataFrame, column: str, edges: tuple[int, ...] = (32, 64, 128, 256, 512, 1024, 2048, 4096)) -> tuple[DataFrame, DataFrame]:
    """(one row of count, extremes, mean and percentiles; a row per closed bin, empty bins too)."""
    x = F.col(column)
    p = F.percentile(x, F.array(*[F.lit(q / 100) for q in (50, 75, 90, 95, 99)]))
    stats = values.agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 6).alias("mean"), p.alias("p"))
    stats = stats.select("n", "least", "most", "mean", *[F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 75, 90, 95, 99))])
    number = sum(((x > e).cast("int") for e in edges), F.lit(0))
    spark = values.sparkSession
    bins = spark.createDataFrame([(i, low, high) for i, (low, high) in enumerate(zip((1, *(e + 1 for e in edges)), (*edges, None), strict=True))], "bin int, low int, high int")
    counts = values.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return stats, bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / total, 6).alias("percent"))


def document_of(points: DataFrame, spans: DataFrame, key: str = "doc_id", width: int = 4096) -> DataFrame:
    """The document whose span [start, start + n) holds each point: spans go to buckets of positions, an equi-join."""
    s = spans.where("n > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width))))
    p = points.withColumn("bucket", F.floor(F.col("point") / width))
    return p.join(s, "bucket").where("point >= start AND point < start + n").select("point", key, (F.col("point") - F.col("start")).alias("inside"))


def islands(rows: DataFrame, partition: list[str], order: str, flag: Column) -> DataFrame:
    """(partition..., first, n): maximal runs of rows with the flag."""
    w = Window.partitionBy(*partition).orderBy(order)
    marked = rows.withColumn("__f", flag).withColumn("__g", F.sum((~F.col("__f")).cast("long")).over(w))
    return marked.where("__f").groupBy(*partition, "__g").agg(F.min(order).alias("first"), F.count("*").alias("n")).drop("__g")


def repetition(rows: DataFrame, group: str, order: str, item: str, periods: int = 4, cycle: int = 32) -> DataFrame:
    """Per group: adjacent repeat rate, longest run, distinct items, longest cycle over periods (run + period) and its flag."""
    w = Window.partitionBy(group).orderBy(order)
    base = rows.select(group, order, item)
    plain = base.withColumn("p", F.lag(item).over(w)).groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(item).alias("distinct_items"), F.sum(F.col("p").eqNullSafe(F.col(item)).cast("long") * F.col("p").isNotNull().cast("long")).alias("same"))
    each = None
    for k in range(1, periods + 1):
        lagged = base.select(group, order, F.lit(k).alias("period"), (F.lag(item, k).over(w) == F.col(item)).alias("hit"))
        each = lagged if each is None else each.unionByName(lagged)
    runs = islands(each, [group, "period"], order, F.coalesce("hit", F.lit(False)))
    best = runs.groupBy(group).agg(F.max(F.when(F.col("period") == 1, F.col("n"))).alias("run"), F.max(F.col("n") + F.col("period")).alias("cycle"))
    out = plain.join(best, group, "left")
    return out.select(group, "n", F.round(F.coalesce(F.col("same") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)), 6).alias("repeat_rate"), (F.coalesce("run", F.lit(0)) + 1).alias("longest_run"), "distinct_items", F.coalesce("cycle", F.lit(0)).alias("longest_cycle"), (F.coalesce("cycle", F.lit(0)) >= cycle).alias("has_cycle"))


def merged_ranges(ranges: DataFrame, partition: str) -> DataFrame:
    """Ranges [start, stop) that touch the one before, joined."""
    w = Window.partitionBy(partition).orderBy("start")
    fresh = F.coalesce(F.lag("stop").over(w) != F.col("start"), F.lit(True))
    grouped = ranges.withColumn("__new", fresh.cast("long")).withColumn("__g", F.sum("__new").over(w))
    return grouped.groupBy(partition, "__g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__g")


def continuity(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Accepted lines with join: whether each continues the accepted line just before it.

    lines has line_no, line, accepted, kept, parent, split, heading. A line joins when the non-blank line right before it
    is kept too, both in one split, with consecutive parents, and it is no heading.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    ok = F.lag("kept").over(w) & F.col("kept") & (F.lag("split").over(w) == F.col("split")) & (F.lag("parent").over(w) + 1 == F.col("parent")) & ~F.col("heading")
    return lines.withColumn("join", F.coalesce(ok, F.lit(False))).where("kept")


def runs(joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """Maximal runs of joined lines: first and last line, parents, text joined by line feeds."""
    w = Window.partitionBy(key).orderBy("line_no")
    numbered = joined.withColumn("run", F.sum((~F.col("join")).cast("long")).over(w))
    g = numbered.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "parent", "line"))).alias("x"))
    return g.select(key, "run", F.col("x")[0]["line_no"].alias("first_raw_line"), F.element_at("x", -1)["line_no"].alias("last_raw_line"), F.col("x")[0]["parent"].alias("parent_start"), F.size("x").alias("parent_count"), F.array_join("x.line", "\n").alias("text"))


def budget_trim(docs: DataFrame, order: str, length: str, budget: int) -> DataFrame:
    """(order, kept): documents in order up to a global budget of units; the last one is trimmed to what is left of it."""
    placed = offsets(docs.select(order, length), order, length).where((F.col("offset") < budget) & (F.col(length) > 0))
    return placed.select(order, F.least(F.col(length), F.lit(budget) - F.col("offset")).cast("long").alias("kept"))


def padded(rows: DataFrame, batch: str, length: str, multiple: int, cap: int) -> DataFrame:
    """(batch, width, padding, trimmed): width is the longest row up to a multiple and a cap."""
    width = F.least(F.lit(cap), F.floor((F.max(length) + multiple - 1) / multiple) * multiple).cast("long")
    joined = rows.join(rows.groupBy(batch).agg(width.alias("width")), batch)
    over = F.col(length) - F.col("width")
    return joined.groupBy(batch).agg(F.max("width").alias("width"), F.sum(F.greatest(F.lit(0), -over)).cast("long").alias("padding"), F.sum(F.greatest(F.lit(0), over)).cast("long").alias("trimmed"))


def run_proof(found: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """One row: parents, lines that runs cover, and how many are missing, repeated or out of order.

    A run's text is taken apart at its line feeds and held against the parents' texts in the order of their lines.
    """
    apart = found.select(key, "run", "parent_start", "parent_count", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(key, (F.col("parent_start") + F.col("at")).alias("parent"), "line", (F.col("at") < F.col("parent_count")).alias("inside"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    own = parents.select(key, place.cast("long").alias("parent"), F.col("text").alias("expected"))
    counted = apart.groupBy(key, "parent").agg(F.count("*").alias("c"), F.min("line").alias("line"), F.bool_and("inside").alias("inside"))
    both = own.join(counted, [key, "parent"], "full_outer")
    here = F.col("expected").isNotNull()
    wrong = here & F.col("c").isNotNull() & (~F.col("inside") | (F.col("line") != F.col("expected")))
    n = lambda c: F.count_if(c).cast("long")
    return both.agg(n(here).alias("parents"), n(here & F.col("c").isNotNull()).alias("covered"), n(here & F.col("c").isNull()).cast("int").alias("missing"), n((F.col("c") > 1) | ~here).cast("int").alias("repeated"), n(wrong).cast("int").alias("out_of_order"))
