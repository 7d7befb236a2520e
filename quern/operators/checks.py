"""Reconciliation: counts derived again, contracts of rows, differences of tables, configurations and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rules): rows that break rules, with the names of those."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, broken.alias("rules")).where(F.size("rules") > 0)


def differences(expected: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows in one table alone or with other values, by a full outer join."""
    a, b = expected.alias("a"), found.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = a.withColumn("__a", F.lit(1)).alias("a").join(b.withColumn("__b", F.lit(1)).alias("b"), cond, "full_outer")
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    kind = F.when(F.col("b.__b").isNull(), "missing").when(F.col("a.__a").isNull(), "unexpected").when(differ, "different")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], kind.alias("kind")).where("kind IS NOT NULL")


def not_covered(expected: DataFrame, parts: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that no part holds (relational division: all are covered if none is left)."""
    return expected.join(parts.select(*on).distinct(), on, "left_anti")


def several_splits(rows: DataFrame, page: str, split: str = "split") -> DataFrame:
    return rows.groupBy(page).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def content_digest(rows: DataFrame, order: list[str], value: str, groups: list[str]) -> DataFrame:
    """SHA-256 over the ordered values of each group."""
    ordered = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("x"))
    return ordered.select(*groups, F.sha2(F.array_join(F.col(f"x.{value}"), "\n"), 256).alias("digest"))


def file_digests(spark, path: str) -> DataFrame:
    """(path, size, sha256) of files, to hold against a pinned manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def flat_config(configs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): the entries of JSON objects, one level below the top as well."""
    kind = "map<string,string>"
    top = configs.select(key, F.explode(F.from_json(json, kind)).alias("__k", "__v"))
    nested = F.coalesce(F.col("__v").startswith("{"), F.lit(False))
    inner = top.where(nested).select(key, "__k", F.explode(F.from_json("__v", kind)).alias("__k2", "__v2"))
    plain = top.where(~nested).select(key, F.col("__k").alias("path"), F.col("__v").alias("value"))
    return plain.unionByName(inner.select(key, F.concat_ws(".", "__k", "__k2").alias("path"), F.col("__v2").alias("value")))


def config_changes(a: DataFrame, b: DataFrame, allowed: list[str]) -> DataFrame:
    """(path, kind) of entries that differ and aren't on the list."""
    return differences(a, b, ["path"], ["value"]).where(~F.col("path").isin(allowed))


def latest(logs: DataFrame, kind: str = "kind", at: str = "position") -> DataFrame:
    """The last row of each kind by position, metrics and all."""
    return logs.groupBy(kind).agg(F.max_by(F.struct(*[c for c in logs.columns if c != kind]), at).alias("x")).select(kind, "x.*")


def progress(rows: DataFrame, run: str, at: str, done: str, total: int) -> DataFrame:
    """Per row: change since the one before, rate an hour, percent, hours to go."""
    w = Window.partitionBy(run).orderBy(at)
    delta = F.col(done) - F.lag(done).over(w)
    hours = (F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w))) / 3600
    rate = delta / F.nullif(hours, F.lit(0.0))
    out = rows.withColumns({"delta": delta, "rate": F.round(rate, 6), "percent": F.round(100 * F.col(done) / total, 6)})
    return out.withColumn("eta_hours", F.round((total - F.col(done)) / F.nullif(rate, F.lit(0.0)), 6))


def retained(checkpoints: DataFrame, position: str, recent: int, every: int, final: int) -> DataFrame:
    """Checkpoints to keep: the most recent, the multiples and the final one."""
    place = F.row_number().over(Window.orderBy(F.desc(position)))
    return checkpoints.withColumn("__p", place).where((F.col("__p") <= recent) | (F.col(position) % every == 0) | (F.col(position) == final)).drop("__p")


def replaced(base: DataFrame, covered: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Base rows that aren't wholly covered, and the new ones; a partly covered row is an error."""
    state = base.join(covered.groupBy(key).agg(F.count("*").alias("__c")), key, "left")
    part = F.coalesce(F.col("__c"), F.lit(0))
    kept = state.withColumn("__ok", F.when((part > 0) & (part < F.col("parent_count")), F.raise_error(F.lit("partly covered"))).otherwise(part == 0)).where("__ok").drop("__c", "__ok")
    return kept.unionByName(new, allowMissingColumns=True)


def length_gate(text: Column, least: int = 1024, most: int = 200_000) -> Column:
    """short, fit, or opaque for texts too long to be taken apart."""
    return F.when(F.length(text) > most, "opaque").when(F.length(text) < least, "short").otherwise("fit")


def renderable(docs: DataFrame, key: str, text: str, supported: DataFrame) -> DataFrame:
    """(key, missing, renderable): distinct characters of each text that the supported ones (char) lack."""
    chars = docs.select(key, F.explode(F.array_distinct(T.characters(F.coalesce(text, F.lit(""))))).alias("char"))
    missing = chars.join(supported.select("char"), "char", "left_anti").groupBy(key).agg(F.count("*").alias("missing"))
    found = docs.select(key).join(missing, key, "left").select(key, F.coalesce("missing", F.lit(0)).alias("missing"))
    return found.withColumn("renderable", F.col("missing") == 0)
