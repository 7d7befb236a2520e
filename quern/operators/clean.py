"""Paragraph cleaning with one accountable reason per rejection, and segmentation of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..policy import LATIN_PAIRS, LATIN_STRICT, PAIRS, Policy


def lines(docs: DataFrame, policy: Policy, key: str = "doc_id", text: str = "text", nfc: bool = True) -> DataFrame:
    """(key, line_no, line): non-empty stripped lines of each text with their raw ordinals."""
    raw = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(key, F.posexplode(T.lines(T.nfc(raw) if nfc else raw)).alias("line_no", "line"))
    own = T.stripped(T.full_width(F.col("line")) if policy.full_width else F.col("line"))
    return cut.select(key, "line_no", own.alias("line")).where("line <> ''")


def judged(docs: DataFrame, policy: Policy = LATIN_STRICT, key: str = "doc_id", text: str = "text", converted=None) -> DataFrame:
    """lines() with the reason that rejects each, null for kept ones."""
    own = lines(docs, policy, key, text)
    if converted is None:
        return own.withColumn("reason", T.reject_reason(F.col("line"), policy))
    out = own.withColumn("converted", converted(F.col("line")))
    return out.select(key, "line_no", F.col("converted").alias("line"), T.reject_reason(F.col("line"), policy, F.col("converted")).alias("reason"))


def paragraphs(docs: DataFrame, policy: Policy = LATIN_STRICT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept lines with their digest and number of letters."""
    kept = judged(docs, policy, key, text).where("reason IS NULL")
    return kept.select(key, "line_no", F.col("line").alias("text"), F.sha2("line", 256).alias("text_sha256"), T.letter_count(F.col("line"), policy).alias("letters"))


def reason_counts(judged_lines: DataFrame) -> DataFrame:
    """Lines and characters per reason; 'kept' for none."""
    return judged_lines.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("line")).cast("long").alias("chars"))


def segments(docs: DataFrame, policy: Policy = LATIN_STRICT, key: str = "doc_id", text: str = "text", boundary=None, bad=None, least: int = 20, quality: bool = True) -> DataFrame:
    """(key, segment, first_line, last_line, n_lines, text): runs of allowed lines; a bad line breaks one hard, a heading
    starts the next; only runs with `least` letters and no quality reason stay."""
    own = lines(docs, policy, key, text)
    line = F.col("line")
    artifact = T.artifact_reason(line).isNotNull() if policy.full_width else F.lit(False)  # they hold full-width marks
    wrong = bad(line) if bad else ~T.allowed(line, policy) | artifact | T.spam(line, policy.phrases) | T.repeated_unit(line)
    flagged = own.withColumns({"bad": wrong, "head": boundary(line) if boundary else T.boundary(line)})
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flagged.withColumn("segment", F.sum((F.col("bad") | F.col("head")).cast("long")).over(order)).where("NOT bad")
    runs = numbered.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    out = runs.select(key, "segment", F.col("parts")[0]["line_no"].alias("first_line"), F.element_at("parts", -1)["line_no"].alias("last_line"), F.size("parts").alias("n_lines"), F.array_join(F.col("parts.line"), "\n").alias("text"))
    out = out.where(T.letter_count(F.col("text"), policy) >= least)
    return out.where(T.quality_reason(F.col("text"), policy, PAIRS if policy.full_width else LATIN_PAIRS).isNull()) if quality else out


def units(rows: DataFrame, policy: Policy, minimum: Column, adapter: str = "adapter") -> DataFrame:
    """Adapter dispatch: question and answer rows whole, articles by excerpt under their topic, plain text by line.

    Rows have instruction, input, output and text; the result has body (what is deduplicated) and text.
    """
    qa = rows.where(F.col(adapter) == "jsonl_qa").select("*", T.qa_text(F.col("instruction"), F.col("input"), F.col("output"), policy).alias("unit")).withColumn("body", F.col("unit"))
    topic = F.concat(F.lit("主题："), T.pure_field(F.col("instruction"), policy), F.when(F.coalesce("input", F.lit("")) == "", "").otherwise(F.concat(F.lit("补充："), T.pure_field(F.col("input"), policy))), F.lit("资料摘录："))
    article = rows.where(F.col(adapter) == "jsonl_article").select("*", topic.alias("prefix"), F.explode(T.markdown_lines(F.col("output"))).alias("body")).where(T.allowed(F.col("body"), policy) & T.artifact_reason(F.col("body")).isNull())
    article = article.where("prefix IS NOT NULL AND length(body) <= 3500").withColumn("unit", F.concat("prefix", "body")).drop("prefix")
    plain = rows.where(~F.col(adapter).isin("jsonl_qa", "jsonl_article")).select("*", F.explode(T.lines(T.nfc(F.coalesce("text", F.lit(""))))).alias("raw"))
    plain = plain.withColumn("unit", T.stripped(T.full_width(F.col("raw")))).drop("raw").withColumn("body", F.col("unit")).where(T.allowed(F.col("unit"), policy))
    whole = qa.unionByName(article).unionByName(plain).where("unit IS NOT NULL AND length(unit) <= 4096")
    return whole.where(T.letter_count(F.col("body"), policy) >= minimum)


def records(docs: DataFrame, policy: Policy, file: str, revision: str, metadata: list[str], split: Column) -> DataFrame:
    """Kept paragraphs as records of 13 fields; docs has doc_id, text, source and lang. Metadata are the JSON of the named
    columns, without those that are null."""
    about = docs.select("doc_id", "source", "lang", F.to_json(F.struct(*metadata)).alias("source_metadata"), split.alias("split"))
    own = paragraphs(docs, policy).join(about, "doc_id")
    return own.select(
        F.concat_ws(":", "doc_id", "line_no").alias("sample_id"), F.col("doc_id").alias("source_page_id"), F.lit(file).alias("source_file"), F.lit(revision).alias("source_file_revision"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"), F.col("source").alias("source_family"), F.col("lang").alias("domain"), F.lit("source").alias("domain_method"),
        "source_metadata", "text", "text_sha256", "split", "letters",
    )
