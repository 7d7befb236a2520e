"""Queries over the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, clean, dedup, evaluation, near, sampling, sequence
from ..policy import LATIN_PAIRS, LATIN_STRICT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A small one of documents, read by fewer tasks than there are cores, is dealt out, as its texts are the
    work; a table of more than some MB a core is read by more tasks than that and stays where it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "documents":
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# ---- SQL that several oracles begin with ------------------------------------------------------------------------------
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ALLOWED = r"""[\p{L}\p{M} ,.;:!?()''"\-]+"""
SQL_LINES = rf"""
cut AS (SELECT doc_id, regexp_split_to_array(nfc_normalize(coalesce(text, '')), '{_BREAK}') AS p FROM documents),
lines AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g') AS line
  FROM (SELECT doc_id, unnest(p) AS line, unnest(range(0, len(p))) AS line_no FROM cut)),
judged AS (SELECT doc_id, line_no, line, len(regexp_extract_all(line, '[\p{{L}}\p{{M}}]')) AS letters,
  CASE WHEN NOT regexp_full_match(line, '{_ALLOWED}') THEN 'symbols' WHEN len(regexp_extract_all(line, '[\p{{L}}\p{{M}}]')) < 40 THEN 'short'
    WHEN length(line) > 4096 THEN 'long' WHEN len(list_filter(range(1, length(line) - 8), lambda i: substr(line, i, 10) = repeat(substr(line, i, 1), 10))) > 0 THEN 'repeated_character' END AS reason
  FROM lines WHERE line <> '')"""
SQL_CANON = r"regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}]', '', 'g')"


@query(f"WITH {SQL_LINES} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM judged GROUP BY 1")
def clean_reason_counts(spark, d):
    """T1 P1 P3 P7 A1 A2"""
    return clean.reason_counts(clean.judged(table(spark, d, "documents")))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, line AS text, sha256(line) AS text_sha256, CAST(letters AS INTEGER) AS letters FROM judged WHERE reason IS NULL")
def clean_paragraphs(spark, d):
    """G1 G4 T2 T10 T13"""
    return clean.paragraphs(table(spark, d, "documents"))


@query(f"WITH {SQL_LINES} SELECT count(*) AS candidates, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected, true AS balanced FROM judged")
def reason_reconciliation(spark, d):
    """V3: lines counted without judging them equal kept and rejected ones counted by reason."""
    docs = table(spark, d, "documents")
    counts = clean.reason_counts(clean.judged(docs)).agg(F.sum(F.when(F.col("reason") == "kept", F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("reason") != "kept", F.col("n")).otherwise(0)).alias("rejected"))
    own = clean.lines(docs, LATIN_STRICT).agg(F.count("*").alias("candidates"))
    return own.join(counts).select("candidates", "kept", "rejected", (F.col("candidates") == F.col("kept") + F.col("rejected")).alias("balanced"))


@query(
    rf"""WITH {SQL_LINES}, k AS (SELECT doc_id, line_no, line, list_reduce(list_prepend('', list_filter(string_split(line, ''), lambda c: c IN ('(', ')'))),
    lambda s, c: CASE WHEN s = '!' THEN '!' WHEN c = '(' THEN s || '(' WHEN s <> '' THEN substr(s, 1, length(s) - 1) ELSE '!' END) AS stack FROM judged WHERE reason IS NULL)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[,.;:!?)]') THEN 'leading_fragment' WHEN NOT regexp_matches(line, '[.!?)"'']$') THEN 'no_sentence_ending'
  WHEN len(list_filter(range(1, 17), lambda p: len(list_filter(range(1, greatest(1, length(line) - 6 * p + 2)), lambda i: substr(line, i, 5 * p) = substr(line, i + p, 5 * p))) > 0)) > 0 THEN 'repetition'
  WHEN stack <> '' THEN 'unbalanced_delimiters' END AS reason FROM k"""
)
def quality_reasons(spark, d):
    """P4 P5 P6"""
    kept = clean.paragraphs(table(spark, d, "documents"))
    return kept.select("doc_id", "line_no", T.quality_reason(F.col("text"), LATIN_STRICT, LATIN_PAIRS).alias("reason"))


_WORDS = {"articles": ("the ", "The "), "german": ("der ", "die ", "und "), "french": ("le ", "la ", "et "), "spanish": ("el ", "los ", "y ")}
_HITS = {k: " + ".join(f"CAST(contains(coalesce(text, ''), '{w}') AS INTEGER)" for w in ws) for k, ws in _WORDS.items()}


@query(
    "WITH s AS (SELECT doc_id, source, lang, " + ", ".join(f"{v} AS {k}" for k, v in _HITS.items()) + " FROM documents), b AS (SELECT *, greatest(" + ", ".join(_HITS) + ") AS best FROM s) SELECT doc_id, "
    "CASE WHEN lang IN ('en', 'de') AND best >= 2 THEN CASE " + " ".join(f"WHEN {k} = best THEN '{k}'" for k in _HITS) + " END ELSE source END AS domain, CASE WHEN lang IN ('en', 'de') AND best >= 2 THEN 'heuristic' ELSE 'source' END AS method FROM b"
)
def domain_labels(spark, d):
    """T23"""
    label, method = T.domain(F.coalesce("text", F.lit("")), F.col("lang"), F.col("source"), ("en", "de"), _WORDS)
    return table(spark, d, "documents").select("doc_id", label.alias("domain"), method.alias("method"))


_SPLIT = "CASE WHEN CAST('0x' || substr(sha256('20260907:' || doc_id), 1, 8) AS BIGINT) % 1000 < 980 THEN 'train' WHEN CAST('0x' || substr(sha256('20260907:' || doc_id), 1, 8) AS BIGINT) % 1000 < 990 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, CAST('0x' || substr(sha256('20260907:' || doc_id), 1, 8) AS BIGINT) % 1000 AS bucket, {_SPLIT} AS split FROM documents")
def hash_split(spark, d):
    """O11"""
    return table(spark, d, "documents").select("doc_id", T.text_id_ordinal("20260907", F.col("doc_id")).alias("bucket"), sampling.split(F.col("doc_id")).alias("split"))


@query(f"WITH {SQL_LINES}, k AS (SELECT doc_id, letters, length(line) AS chars, {_SPLIT} AS split FROM judged WHERE reason IS NULL) SELECT split, count(*) AS paragraphs, count(DISTINCT doc_id) AS pages, CAST(sum(letters) AS BIGINT) AS letters, CAST(sum(chars + 1) AS BIGINT) AS targets FROM k GROUP BY split")
def split_summary(spark, d):
    """A3"""
    p = clean.paragraphs(table(spark, d, "documents")).withColumn("split", sampling.split(F.col("doc_id")))
    return p.groupBy("split").agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("pages"), F.sum("letters").alias("letters"), F.sum(F.length("text") + 1).alias("targets"))


@query(f"SELECT {_SPLIT} AS split, source, lang, count(*) AS n, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}]'))) AS BIGINT) AS letters FROM documents GROUP BY GROUPING SETS ((1), (source), (lang), ())")
def family_domain_totals(spark, d):
    """A4: all groupings in one pass."""
    docs = table(spark, d, "documents").select(sampling.split(F.col("doc_id")).alias("split"), "source", "lang", T.letter_count(F.coalesce("text", F.lit("")), LATIN_STRICT).alias("letters"))
    sets = [[F.col(c)] for c in ("split", "source", "lang")] + [[]]
    return docs.groupingSets(sets, "split", "source", "lang").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"))


def _records(spark, d) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), T.canonical(text, LATIN_STRICT).alias("canonical")).withColumns({"text_hash": F.sha2("text", 256), "canonical_hash": F.sha2("canonical", 256)})


_EXACT = f"WITH r AS (SELECT doc_id, sha256(coalesce(text, '')) AS th, sha256({SQL_CANON}) AS ch FROM documents), f AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(th) OVER w AS ft FROM r WINDOW w AS (PARTITION BY ch ORDER BY doc_id)), e AS (SELECT doc_id, CASE WHEN doc_id = fd THEN NULL WHEN th = ft THEN 'exact' ELSE 'punctuation_variant' END AS reason FROM f)"


@query(_EXACT + " SELECT doc_id, reason FROM e")
def exact_dedup(spark, d):
    """J1 T9 T13 D10"""
    return dedup.exact(_records(spark, d), ["doc_id"]).select("doc_id", "reason")


@query(_EXACT + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM e GROUP BY 1")
def dedup_reason_counts(spark, d):
    return dedup.exact(_records(spark, d), ["doc_id"]).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_NODES = f"""c AS (SELECT min(doc_id) AS id, canon FROM (SELECT doc_id, {SQL_CANON} AS canon FROM documents) GROUP BY canon),
sh AS (SELECT id, canon, length(canon) AS n, list_distinct(list_transform(range(1, greatest(2, length(canon) - 3)), lambda i: substr(canon, i, 5))) AS s FROM c),
an AS (SELECT id, canon, n, s, list_sort(list_distinct(list_transform(s, lambda x: substr(sha256(x), 1, 8))))[:8] AS a FROM sh)"""


@query(f"WITH {_NODES} SELECT id, CAST(n AS INTEGER) AS length, CAST(len(s) AS INTEGER) AS shingles, a[1] AS least_anchor, CAST(len(a) AS INTEGER) AS anchors FROM an")
def shingle_stats(spark, d):
    """T11 T12"""
    return _nodes(spark, d).select("id", "length", F.size(T.shingles(F.col("canonical"))).alias("shingles"), F.col("anchors")[0].alias("least_anchor"), F.size("anchors").alias("anchors"))


def _nodes(spark, d) -> DataFrame:
    own = _records(spark, d).groupBy("canonical").agg(F.min("doc_id").alias("id")).select("id", "canonical", F.length("canonical").alias("length"))
    own = own.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    return own.withColumn("anchors", T.sha_anchors(F.col("canonical")))


def _canonical(spark, d) -> DataFrame:
    """(id, text) with the letters of each text; only documents read by very few tasks are dealt out."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.canonical(F.coalesce("text", F.lit("")), LATIN_STRICT).alias("text"))


_PAIRS = f"""{_NODES}, p AS (SELECT id, n, unnest(a) AS h FROM an),
cand AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM p a JOIN p b ON a.h = b.h AND a.id < b.id AND a.n >= floor(b.n * 0.9) AND a.n <= ceil(b.n / 0.9) GROUP BY 1, 2 HAVING count(*) >= 2),
sim AS (SELECT cand.a, cand.b, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS na, len(y.s) AS nb FROM cand JOIN sh x ON x.id = cand.a JOIN sh y ON y.id = cand.b WHERE least(len(x.s), len(y.s)) / greatest(len(x.s), len(y.s)) >= 0.9),
links AS (SELECT a, b, i / (na + nb - i) AS jaccard FROM sim WHERE i / (na + nb - i) >= 0.9)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM links")
def near_dup_pairs(spark, d):
    """J2 J3 J4 U3"""
    texts = _canonical(spark, d)
    found = near.links(texts, dedup.checkpointed(near.nodes(texts)))
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    f"""WITH {_PAIRS}, r0 AS (SELECT 0 AS id WHERE false),
k1 AS (SELECT id FROM c WHERE id NOT IN (SELECT b FROM links)), r1 AS (SELECT DISTINCT b AS id FROM links WHERE a IN (SELECT id FROM k1)),
k2 AS (SELECT id FROM c WHERE id NOT IN (SELECT b FROM links WHERE a NOT IN (SELECT id FROM r1)) AND id NOT IN (SELECT id FROM r1)), r2 AS (SELECT DISTINCT b AS id FROM links WHERE a IN (SELECT id FROM k2)),
k3 AS (SELECT id FROM c WHERE id NOT IN (SELECT b FROM links WHERE a NOT IN (SELECT id FROM r2)) AND id NOT IN (SELECT id FROM r2)), r3 AS (SELECT DISTINCT b AS id FROM links WHERE a IN (SELECT id FROM k3)),
k4 AS (SELECT id FROM c WHERE id NOT IN (SELECT b FROM links WHERE a NOT IN (SELECT id FROM r3)) AND id NOT IN (SELECT id FROM r3)), r4 AS (SELECT DISTINCT b AS id FROM links WHERE a IN (SELECT id FROM k4))
SELECT id, id NOT IN (SELECT id FROM r4) AS kept FROM c"""
)
def near_dedup_ordered(spark, d):
    """H1: first wins, only kept records reject."""
    texts = _canonical(spark, d)
    nodes = dedup.checkpointed(near.nodes(texts))
    return dedup.first_wins(nodes, near.links(texts, nodes))


@query(
    """WITH e AS (SELECT sha256(text) AS h FROM benchmark UNION SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, source FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT h FROM e)"""
)
def held_out_exclusion(spark, d):
    """J5; J6 without the near index."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    banned = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("h")).union(docs.where("doc_id % 10 = 0").select("h"))
    return dedup.excluded(docs, banned, "h").select("doc_id", "source")


@query(
    r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS g FROM t WHERE len(w) >= 8),
h AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS g FROM h WHERE len(w) >= 8),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT id AS doc_id, item_id, round(count(*) / any_value(n.n), 6) AS containment FROM g JOIN b USING (g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) / any_value(n.n) >= 0.5"""
)
def benchmark_contamination(spark, d):
    """D14"""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    held = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return dedup.contained(docs, held).select(F.col("id").alias("doc_id"), F.col("held_id").alias("item_id"), F.round("containment", 6).alias("containment"))


@query(
    """WITH s AS (SELECT item_id AS id, unnest(list_distinct(list_transform(range(1, greatest(2, length(text) - 3)), lambda i: substr(text, i, 5)))) AS g FROM benchmark),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
j AS (SELECT a, b, c / (x.n + y.n - c) AS j FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS k FROM j)
SELECT a AS item_id, round(j, 6) AS best, b AS best_id FROM r WHERE k = 1"""
)
def benchmark_self_leakage(spark, d):
    """J19 inside the benchmark: most alike other item, the earliest of equals."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    sets = b.select("id", T.shingles(F.col("text")).alias("s")).select("id", F.size("s").alias("n"), F.explode("s").alias("g"))
    pairs = sets.alias("a").join(sets.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.id") != F.col("b.id"))).groupBy(F.col("a.id").alias("item_id"), F.col("b.id").alias("id")).agg(F.count("*").alias("c"), F.max("a.n").alias("na"), F.max("b.n").alias("nb"))
    scored = pairs.withColumn("j", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
    return scored.groupBy("item_id").agg(F.round(F.max("j"), 6).alias("best"), F.max_by("id", F.struct("j", -F.col("id"))).alias("best_id"))


@query(
    rf"""WITH {SQL_LINES}, f AS (SELECT doc_id, line_no, line, NOT regexp_full_match(line, '{_ALLOWED}') AS bad, right(line, 1) = ':' AS head FROM lines WHERE line <> ''),
n AS (SELECT *, sum(CAST(bad OR head AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM f)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(line_no) AS first_line, max(line_no) AS last_line, CAST(count(*) AS INTEGER) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS digest
FROM n WHERE NOT bad GROUP BY 1, 2 HAVING len(regexp_extract_all(string_agg(line, chr(10)), '[\p{{L}}\p{{M}}]')) >= 20"""
)
def document_segments(spark, d):
    """P10, and G5 before its quality tests: runs of allowed lines as candidates; quality_segments has those that stay."""
    found = clean.segments(table(spark, d, "documents"), boundary=lambda x: F.endswith(x, F.lit(":")), bad=lambda x: ~T.allowed(x, LATIN_STRICT), quality=False)
    return found.select("doc_id", "segment", "first_line", "last_line", "n_lines", F.sha2("text", 256).alias("digest"))


_STACK = "list_reduce(list_prepend('', list_filter(string_split({0}, ''), lambda c: c IN ('(', ')'))), lambda s, c: CASE WHEN s = '!' THEN '!' WHEN c = '(' THEN s || '(' WHEN s <> '' THEN substr(s, 1, length(s) - 1) ELSE '!' END)"
_UNIT = "len(list_filter(range(1, 17), lambda p: contains(array_to_string(list_transform(list_zip({0}[:-1 - p], {0}[p + 1:]), lambda z: CASE WHEN z[1] = z[2] THEN '1' ELSE '0' END), ''), repeat('1', 5 * p)))) > 0"


# Artifacts hold full-width marks, which the Latin alphabet lacks; a unit has no line feed, so a line with one breaks first.
@query(
    rf"""WITH {SQL_LINES}, f AS (SELECT doc_id, line_no, line, CASE WHEN NOT regexp_full_match(line, '{_ALLOWED}') THEN true ELSE {_UNIT.format("string_split(line, '')")} END AS bad, right(line, 1) = ':' AS head FROM lines WHERE line <> ''),
n AS (SELECT *, sum(CAST(bad OR head AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM f),
g AS (SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(line_no) AS first_line, max(line_no) AS last_line, CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM n WHERE NOT bad GROUP BY 1, 2)
SELECT doc_id, segment, first_line, last_line, n_lines, sha256(text) AS digest FROM g WHERE len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]')) >= 20
  AND CASE WHEN regexp_matches(text, '^[,.;:!?)]') THEN 'leading_fragment' WHEN NOT regexp_matches(text, '[.!?)"'']$') THEN 'no_sentence_ending' WHEN {_STACK.format("text")} <> '' THEN 'unbalanced_delimiters' END IS NULL"""
)
def quality_segments(spark, d):
    """All tests; repeated units break segments too, and only those without a quality reason stay."""
    found = clean.segments(table(spark, d, "documents"), boundary=lambda x: F.endswith(x, F.lit(":")))
    return found.select("doc_id", "segment", "first_line", "last_line", "n_lines", F.sha2("text", 256).alias("digest"))


def _joined(spark, d) -> DataFrame:
    lines = clean.judged(table(spark, d, "documents")).withColumn("kept", F.col("reason").isNull())
    w = Window.partitionBy("doc_id").orderBy("line_no")
    ready = lines.withColumns({"parent": F.sum(F.col("kept").cast("long")).over(w) - 1, "split": sampling.split(F.col("doc_id")), "heading": F.endswith("line", F.lit(":"))})
    return sequence.continuity(ready)


_RUNS = f"""{SQL_LINES}, k AS (SELECT *, reason IS NULL AS kept, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS nb FROM judged),
j AS (SELECT *, coalesce(lag(kept) OVER w AND right(line, 1) <> ':', false) AS joins, sum(CAST(kept AS BIGINT)) OVER w - 1 AS parent FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(CAST(NOT joins AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM j WHERE kept)"""


@query(f"WITH {_RUNS} SELECT doc_id, CAST(run AS BIGINT) AS run, min(line_no) AS first_raw_line, max(line_no) AS last_raw_line, CAST(min(parent) AS BIGINT) AS parent_start, CAST(count(*) AS INTEGER) AS parent_count, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM r GROUP BY 1, 2")
def continuity_runs(spark, d):
    """W5 W6 W7 W8"""
    found = sequence.runs(_joined(spark, d))
    return found.select("doc_id", "run", "first_raw_line", "last_raw_line", "parent_start", "parent_count", F.sha2("text", 256).alias("digest"))


@query(f"WITH {SQL_LINES}, k AS (SELECT * FROM judged WHERE reason IS NULL), n AS (SELECT doc_id, line_no, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k) SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM judged x WHERE x.doc_id = n.doc_id AND x.line_no > n.before AND x.line_no < n.line_no)) AS broken FROM n WHERE before IS NOT NULL")
def run_edge_proof(spark, d):
    """V7 V8: neighbours among kept lines, and how many have a rejected line between, found by an interval join."""
    lines = clean.judged(table(spark, d, "documents"))
    kept = lines.where("reason IS NULL").select("doc_id", "line_no", F.lag("line_no").over(Window.partitionBy("doc_id").orderBy("line_no")).alias("before")).where("before IS NOT NULL")
    bad = lines.where("reason IS NOT NULL").select(F.col("doc_id").alias("k"), F.col("line_no").alias("n"))
    broken = kept.join(bad, (F.col("doc_id") == F.col("k")) & (F.col("n") > F.col("before")) & (F.col("n") < F.col("line_no")), "left_semi")
    return kept.agg(F.count("*").alias("edges")).join(broken.agg(F.count("*").alias("broken")))


def _lengths(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.length(F.coalesce("text", F.lit(""))) + 2).cast("long").alias("n"))


_LEN = "l AS (SELECT doc_id, length(coalesce(text, '')) + 2 AS n FROM documents)"
_OFF = f"{_LEN}, o AS (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS offs FROM l)"


@query(f"WITH {_OFF} SELECT doc_id, n, offs AS \"offset\" FROM o")
def token_offsets(spark, d):
    """W1 K3"""
    return sequence.offsets(_lengths(spark, d), "doc_id", "n")


@query(f"WITH {_LEN}, c AS (SELECT n - 1 AS t, unnest([256, 512, 1024, 2048]) AS context FROM l) SELECT CAST(context AS INTEGER) AS context, CAST(sum((t - 1) // context + 1) AS BIGINT) AS chunks, CAST(sum(t // context) AS BIGINT) AS full_chunks, CAST(sum(t) AS BIGINT) AS targets, round(sum(t) / sum((t - 1) // context + 1), 6) AS mean_targets, round(100 * sum(t // context * context) / sum(t), 6) AS full_target_percent FROM c WHERE t > 0 GROUP BY 1")
def context_chunks(spark, d):
    """A7 A9 W2"""
    return sequence.chunk_counts(_lengths(spark, d), "n", [256, 512, 1024, 2048])


@query(f"WITH {_LEN}, c AS (SELECT doc_id, n, unnest(range(0, (n - 2) // 512 + 1)) AS chunk FROM l WHERE n >= 2) SELECT doc_id, chunk, chunk * 512 AS start, least(512, n - 1 - chunk * 512) AS valid FROM c")
def document_chunks(spark, d):
    """G6 W3"""
    return sequence.chunks(_lengths(spark, d), "doc_id", "n", 512)


@query(f"WITH {_OFF}, t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM l), w AS (SELECT n, unnest(range(0, (n - 2) // 1024 + 1)) AS win FROM t), m AS (SELECT (offs - 1) // 1024 AS win, count(*) AS c FROM o WHERE offs > 0 GROUP BY 1) SELECT w.win AS \"window\", CAST(least(1024, n - 1 - w.win * 1024) - coalesce(c, 0) AS BIGINT) AS targets FROM w LEFT JOIN m ON m.win = w.win")
def packed_windows(spark, d):
    """W4 G7"""
    return sequence.packed_windows(_lengths(spark, d), "doc_id", "n", 1024)


@query(
    f"""WITH {_LEN}, a AS (SELECT CAST(sum(n) - 1 AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS t, count(*) AS c, avg(n - 1) AS m, quantile_cont(n - 1, [0.5, 0.95, 0.99]) AS p, max(n - 1) AS mx, CAST(sum((n - 1) // 1024) AS BIGINT) AS f, CAST(sum(CASE WHEN n - 1 >= 1024 THEN n - 1 ELSE 0 END) AS BIGINT) AS lg FROM l), b AS (SELECT *, (total + 1023) // 1024 AS w FROM a)
SELECT CAST(1024 AS INTEGER) AS context, w AS windows, t AS effective_targets, round(t / w, 6) AS mean_effective_targets, round(t / (w * 1024), 6) AS target_utilization, w * 1024 - total AS padding_positions, c - 1 AS masked_transitions, round(m, 6) AS document_mean_targets, round(p[1], 6) AS document_p50, round(p[2], 6) AS document_p95, round(p[3], 6) AS document_p99, mx AS document_max, f AS full_document_windows, lg AS long_document_targets FROM b"""
)
def packing_statistics(spark, d):
    """A8"""
    return sequence.packing_statistics(_lengths(spark, d), "n", 1024)


@query(f"WITH {_LEN}, a AS (SELECT count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, quantile_cont(n, [0.5, 0.75, 0.9, 0.95, 0.99]) AS p FROM l) SELECT n, least, most, mean, round(p[1], 6) AS p50, round(p[2], 6) AS p75, round(p[3], 6) AS p90, round(p[4], 6) AS p95, round(p[5], 6) AS p99 FROM a")
def length_summary(spark, d):
    """A6"""
    return sequence.length_summary(_lengths(spark, d), "n")[0]


@query(f"WITH {_LEN}, e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS bin, unnest([1, 33, 65, 129, 257, 513, 1025, 2049, 4097]) AS low, unnest([32, 64, 128, 256, 512, 1024, 2048, 4096, NULL]) AS high) SELECT bin, low, high, count(l.n) AS n, round(100 * count(l.n) / (SELECT count(*) FROM l), 6) AS percent FROM e LEFT JOIN l ON l.n >= low AND (high IS NULL OR l.n <= high) GROUP BY 1, 2, 3")
def length_bins(spark, d):
    """Empty bins too."""
    return sequence.length_summary(_lengths(spark, d), "n")[1]


@query(f"WITH {_OFF} SELECT point, doc_id, point - offs AS inside FROM (SELECT CAST(unnest(range(0, (SELECT max(offs) FROM o), 9973)) AS BIGINT) AS point) JOIN o ON point >= offs AND point < offs + n")
def document_lookup(spark, d):
    """An as-of lookup of every 9973rd position before the last document; window_lookup has all windows."""
    spans = sequence.offsets(_lengths(spark, d), "doc_id", "n").withColumnRenamed("offset", "start")
    points = spans.agg(F.max("start").alias("m")).where("m > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(9973).cast("long"))).alias("point"))
    return sequence.document_of(points, spans)


@query(f"WITH {_OFF} SELECT point, doc_id, point - offs AS inside FROM (SELECT CAST(unnest(range(0, (SELECT CAST(sum(n) AS BIGINT) FROM l) - 1, 1024)) AS BIGINT) AS point) JOIN o ON point >= offs AND point < offs + n")
def window_lookup(spark, d):
    """The document that holds the start of each window of packed_windows, up to the end of the last document."""
    spans = sequence.offsets(_lengths(spark, d), "doc_id", "n").withColumnRenamed("offset", "start")
    points = spans.agg(F.sum("n").alias("m")).where("m > 1").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 2, F.lit(1024).cast("long"))).alias("point"))
    return sequence.document_of(points, spans)


@query("SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1")
def character_frequencies(spark, d):
    """A10 A11"""
    return table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(coalesce(text, ''), '')) AS c FROM documents) WHERE c NOT IN ('', chr(10))) SELECT c AS char, row_number() OVER (ORDER BY unicode(c)) + 3 AS asset_id FROM c")
def asset_inventory(spark, d):
    """K4 V6: content numbered after the controls in code-point order."""
    return sequence.inventory(table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text")), "text")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) + 2 AS INTEGER) AS tokens, sha256(coalesce(text, '')) AS decoded, true AS same FROM documents")
def encode_round_trip(spark, d):
    """Characters to numbers and back."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    inv = sequence.inventory(docs, "text").agg(F.map_from_entries(F.collect_list(F.struct("char", "asset_id"))).alias("v"), F.map_from_entries(F.collect_list(F.struct("asset_id", "char"))).alias("r"))
    coded = docs.join(F.broadcast(inv)).select("doc_id", "text", sequence.encoded(F.col("text"), F.col("v")).alias("ids"), "r")  # the alphabet: at most 65,532 entries
    back = F.array_join(F.transform(F.slice("ids", F.lit(2), F.size("ids") - 2), lambda i: F.when(i == sequence.NEWLINE, "\n").otherwise(F.col("r")[i])), "")
    return coded.select("doc_id", F.size("ids").alias("tokens"), F.sha2(back, 256).alias("decoded"), (back == F.col("text")).alias("same"))


@query("WITH r AS (SELECT doc_id, source, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM r) SELECT doc_id, source, CAST(before AS BIGINT) AS before FROM s WHERE before < 20000")
def family_budget(spark, d):
    """W13 D2"""
    docs = table(spark, d, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    caps = docs.select("source").distinct().withColumn("cap", F.lit(20000))
    return dedup.budgeted(docs, "source", ["doc_id"], "n", caps).select("doc_id", "source", "before")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source FROM r WHERE k <= 5")
def source_cap(spark, d):
    """D2"""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(w).alias("k")).where("k <= 5").select("doc_id", "source")


@query("WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id DESC) AS k FROM documents) SELECT lang, doc_id, CAST(k AS INTEGER) AS place FROM r WHERE k <= 10")
def hash_rank_sample(spark, d):
    """O3 O7 O8 O16"""
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return sampling.smallest(docs, 10, sampling.hash_rank("7", F.col("doc_id")), ["lang"], [F.desc("doc_id")]).select("lang", "doc_id", "place")


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM documents) SELECT source, doc_id, sha256('7:' || source) AS group_hash FROM r WHERE k = 1 ORDER BY group_hash, source LIMIT 8")
def one_per_group(spark, d):
    """O4 O5 O6"""
    return sampling.one_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "7", "doc_id", 8)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5")
def top_frequencies(spark, d):
    """O2 O1"""
    return sampling.top_frequencies(table(spark, d, "events"), "event_type", 5)


@query("WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256('11:' || source)) AS k, count(*) OVER () AS n FROM g) SELECT source, CASE WHEN k <= round_even(n * 0.8, 0) THEN 'train' WHEN k <= round_even(n * 0.9, 0) THEN 'validation' ELSE 'test' END AS split FROM r")
def group_split(spark, d):
    """O9 O10 D15 D17"""
    return sampling.group_split(table(spark, d, "documents").select("source").distinct(), "source", "11").select("source", "split")


@query("SELECT doc_id, CAST((doc_id // 4) % 3 AS INTEGER) AS rank, doc_id // 4 // 3 AS step FROM documents")
def rank_shards(spark, d):
    """O15"""
    return sampling.rank_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 4, 3)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:1:' || doc_id), doc_id) - 1 AS place FROM documents) SELECT doc_id, CAST(place AS INTEGER) AS place FROM r WHERE place >= 100")
def epoch_order(spark, d):
    """O12 O14"""
    return sampling.epoch(table(spark, d, "documents").select("doc_id"), "doc_id", 3, 1, 100)


@query(
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY sha256('3:' || doc_id), doc_id) - 1 AS place FROM documents), i AS (SELECT *, row_number() OVER (PARTITION BY place // 64 ORDER BY n_chars DESC, place) - 1 AS slot FROM r), b AS (SELECT doc_id, place // 64 AS pool, (place // 64 * 64 + slot) // 8 AS batch FROM i)
SELECT doc_id, pool, batch, count(*) OVER (PARTITION BY batch) = 8 AS "full" FROM b"""
)
def sortish_batches(spark, d):
    """O13"""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return sampling.sortish(docs, "doc_id", "n_chars", 3, 8, 8).select("doc_id", F.col("pool").cast("long").alias("pool"), F.col("batch").cast("long").alias("batch"), "full")


_SCORE = "s AS (SELECT l.doc_id, lang, quality = 1 AS t, length(regexp_replace(coalesce(text, ''), '[^\\p{L} ]', '', 'g')) / greatest(1, length(coalesce(text, ''))) AS score FROM labels l JOIN documents USING (doc_id))"
_RATIOS = "tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), {e}), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), {e}), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), {e}), 6) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), {e}), 6) AS iou, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_rate, round((tp + fn) / (tp + fp + fn + tn), 6) AS target_rate"
_COUNTS = "count(*) FILTER (score >= 0.9 AND t) AS tp, count(*) FILTER (score >= 0.9 AND NOT t) AS fp, count(*) FILTER (score < 0.9 AND t) AS fn, count(*) FILTER (score < 0.9 AND NOT t) AS tn"


def _scored(spark, d) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    score = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / F.greatest(F.lit(1), F.length(text))
    docs = table(spark, d, "documents").select("doc_id", "lang", score.alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "quality", "toxic", "score")


@query(f"WITH {_SCORE}, c AS (SELECT {_COUNTS} FROM s) SELECT {_RATIOS.format(e='0.0')} FROM c")
def confusion_metrics(spark, d):
    """A12 A35"""
    return evaluation.confusion(_scored(spark, d), [], F.col("score") >= 0.9, F.col("quality") == 1)


@query(f"WITH {_SCORE}, c AS (SELECT lang, {_COUNTS} FROM s GROUP BY lang) SELECT lang, {_RATIOS.format(e='NULL')} FROM c")
def confusion_by_language(spark, d):
    """Absent categories are null, not 0."""
    return evaluation.confusion(_scored(spark, d), ["lang"], F.col("score") >= 0.9, F.col("quality") == 1, None)


_GRID = [round(0.5 + 0.05 * k, 2) for k in range(10)]
_SWEEP = f"{_SCORE}, g AS (SELECT CAST(unnest({_GRID}) AS DOUBLE) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND t) AS tp, count(*) FILTER (score >= threshold AND NOT t) AS fp, count(*) FILTER (score < threshold AND t) AS fn FROM s CROSS JOIN g GROUP BY 1), f AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c)"


@query(f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, f1 FROM f")
def threshold_sweep(spark, d):
    """A32"""
    return evaluation.sweep(_scored(spark, d), F.col("score"), F.col("quality") == 1, _GRID)


@query(f"WITH {_SWEEP} SELECT threshold, f1 FROM f ORDER BY f1 DESC, round(abs(threshold - 0.5), 9), threshold LIMIT 1")
def best_threshold(spark, d):
    """A18"""
    return evaluation.best_threshold(evaluation.sweep(_scored(spark, d), F.col("score"), F.col("quality") == 1, _GRID))


@query("WITH c AS (SELECT quantile_cont(n_chars, 1 / 3.0) AS a, quantile_cont(n_chars, 2 / 3.0) AS b FROM documents) SELECT CASE WHEN n_chars <= a THEN 'low' WHEN n_chars <= b THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM documents, c GROUP BY 1")
def tercile_buckets(spark, d):
    """A15"""
    return evaluation.terciles(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars").groupBy("bucket").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT avg(n_chars) FILTER (doc_id % 10 <> 0) AS m, greatest(stddev_pop(n_chars) FILTER (doc_id % 10 <> 0), 1e-6) AS s FROM documents) SELECT doc_id, round((n_chars - m) / s, 6) AS z FROM documents, s")
def standardised_lengths(spark, d):
    """A30"""
    found = evaluation.standardised(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", F.col("doc_id") % 10 != 0)
    return found.select("doc_id", F.round("z", 6).alias("z"))


def _bits(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", evaluation.sign_bits(F.col("embedding")).alias("bits"))


_BITS = "b AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS g FROM embeddings), h AS (SELECT a.id AS query_id, b.id, a.label AS la, b.label AS lb, CAST(list_sum(list_transform(list_zip(a.g, b.g), lambda z: abs(z[1] - z[2]))) AS BIGINT) AS distance, CAST(list_sum(list_transform(list_zip(a.g, b.g), lambda z: z[1] * z[2])) AS BIGINT) AS common, CAST(list_sum(a.g) + list_sum(b.g) AS BIGINT) AS total FROM b a JOIN b ON a.id <> b.id WHERE a.id % 10 = 0)"


@query(f"WITH {_BITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM h) SELECT query_id, CAST(k AS INTEGER) AS rank, id, distance FROM r WHERE k <= 5")
def hamming_neighbours(spark, d):
    """J15 J18"""
    b = _bits(spark, d)
    return evaluation.nearest(b.where("id % 10 = 0"), b, 5)


@query(f"WITH {_BITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM h) SELECT count(*) FILTER (k = 1 AND la = lb) AS top1, count(*) FILTER (k <= 5 AND la = lb) AS top5_hits, round(avg(distance) FILTER (k = 1), 6) AS mean_nearest FROM r")
def retrieval_rates(spark, d):
    """A16"""
    b = _bits(spark, d)
    labels = b.select("id", "label")
    n = evaluation.nearest(b.where("id % 10 = 0"), b, 5).join(labels.withColumnRenamed("label", "lb"), "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("la")), "query_id")
    same = F.col("la") == F.col("lb")
    return n.agg(F.count_if(same & (F.col("rank") == 1)).alias("top1"), F.count_if(same).alias("top5_hits"), F.round(F.avg(F.when(F.col("rank") == 1, F.col("distance"))), 6).alias("mean_nearest"))


@query(f"WITH {_BITS}, f AS (SELECT query_id, id, round(coalesce(2 * common / nullif(total, 0), 0.0), 6) AS f1 FROM h), r AS (SELECT *, row_number() OVER w AS k, lead(f1) OVER w AS second FROM f WINDOW w AS (PARTITION BY query_id ORDER BY f1 DESC, id)) SELECT query_id, id, f1, round(f1 - coalesce(second, 0.0), 6) AS margin FROM r WHERE k = 1")
def overlap_neighbours(spark, d):
    """J17"""
    b = _bits(spark, d)
    return evaluation.best_overlap(b.where("id % 10 = 0"), b)


@query("WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) SELECT CAST(pos AS INTEGER) AS pos, round(avg(CAST(x > 0 AS INTEGER)), 6) AS mean, round(sum(CAST(x > 0 AS INTEGER) * (label + 1)) / sum(label + 1), 6) AS weighted FROM e GROUP BY 1")
def mean_item(spark, d):
    """A17"""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    on = (F.col("x") > 0).cast("long")
    return e.groupBy("pos").agg(F.round(F.avg(on), 6).alias("mean"), F.round(F.sum(on * (F.col("label") + 1)) / F.sum(F.col("label") + 1), 6).alias("weighted"))


@query("WITH b AS (SELECT vec_id, array_to_string(list_transform(embedding[:8], lambda x: CAST(x > 0 AS INTEGER)), '') AS k FROM embeddings) SELECT k AS bits, count(*) AS n, min(vec_id) AS first_id, array_to_string(list_sort(list(vec_id)), ',') AS ids, dense_rank() OVER (ORDER BY k) - 1 AS unique_index FROM b GROUP BY k HAVING count(*) > 1")
def collision_groups(spark, d):
    """Groups by the first eight signs alone, lists of all their ids: no collisions of whole bitmaps; bitmap_members has those."""
    key = F.array_join(F.transform(F.slice("embedding", 1, 8), lambda x: (x > 0).cast("int").cast("string")), "")
    g = table(spark, d, "embeddings").select("vec_id", key.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.array_sort(F.collect_list("vec_id")).alias("v")).where("n > 1")
    return g.select("bits", "n", "first_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("ids"), (F.dense_rank().over(Window.orderBy("bits")) - 1).cast("long").alias("unique_index"))


@query("WITH b AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)), '') AS k FROM embeddings) SELECT vec_id, k AS bits, count(*) OVER (PARTITION BY k) AS n, min(vec_id) OVER (PARTITION BY k) AS first_id, dense_rank() OVER (ORDER BY k) - 1 AS unique_index FROM b")
def bitmap_members(spark, d):
    """Each item with its whole bitmap's number among the distinct ones, size and first item; n > 1 is a collision."""
    key = F.array_join(F.transform("embedding", lambda x: (x > 0).cast("int").cast("string")), "")
    own = table(spark, d, "embeddings").select("vec_id", key.alias("bits"))
    g = own.groupBy("bits").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn("one", F.lit(1))
    return own.join(sequence.offsets(g, "bits", "one"), "bits").select("vec_id", "bits", "n", "first_id", F.col("offset").alias("unique_index"))


@query("WITH f AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type AS fresh FROM events), g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM f), n AS (SELECT user_id, r, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n) AS longest FROM n GROUP BY 1")
def longest_event_run(spark, d):
    """W17"""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    same = e.withColumn("same", F.coalesce(F.lag("event_type").over(w) == F.col("event_type"), F.lit(False)))
    runs = sequence.islands(same, ["user_id"], "event_id", F.col("same")).groupBy("user_id").agg(F.max("n").alias("m"))
    return e.select("user_id").distinct().join(runs, "user_id", "left").select("user_id", (F.coalesce("m", F.lit(0)) + 1).alias("longest"))


_CYCLE = " UNION ALL ".join(f"SELECT user_id, event_id, {k} AS period, coalesce(lag(event_type, {k}) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS hit FROM events" for k in (1, 2, 3, 4))


@query(
    f"""WITH e AS ({_CYCLE}), g AS (SELECT *, sum(CAST(NOT hit AS INTEGER)) OVER (PARTITION BY user_id, period ORDER BY event_id) AS g FROM e), r AS (SELECT user_id, period, count(*) AS n FROM g WHERE hit GROUP BY user_id, period, g),
b AS (SELECT user_id, max(n) FILTER (period = 1) AS run, max(n + period) AS cyc FROM r GROUP BY 1), p AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS distinct_items, sum(CAST(same AS BIGINT)) AS same FROM (SELECT user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS same FROM events) GROUP BY 1)
SELECT user_id, n, round(coalesce(same / nullif(n - 1, 0), 0.0), 6) AS repeat_rate, coalesce(run, 0) + 1 AS longest_run, distinct_items, coalesce(cyc, 0) AS longest_cycle, coalesce(cyc, 0) >= 8 AS has_cycle FROM p LEFT JOIN b USING (user_id)"""
)
def event_repetition(spark, d):
    """W18"""
    return sequence.repetition(table(spark, d, "events"), "user_id", "event_id", "event_type", 4, 8)


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 'length' END, CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END], lambda x: x IS NOT NULL), ',') AS rules FROM documents WHERE n_chars IS DISTINCT FROM length(text) OR length(text) < 200 OR lang NOT IN ('en', 'de')")
def row_contracts(spark, d):
    """V4"""
    found = checks.violations(table(spark, d, "documents"), "doc_id", {"length": F.col("n_chars") == F.length("text"), "short": F.length("text") >= 200, "language": F.col("lang").isin("en", "de")})
    return found.select("doc_id", F.array_join("rules", ",").alias("rules"))


@query("SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'missing' WHEN a.source IS NULL THEN 'unexpected' ELSE 'different' END AS kind FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 2 = 0 GROUP BY 1) b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n")
def manifest_differences(spark, d):
    """J23 A5 V2"""
    docs = table(spark, d, "documents")
    a = docs.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"))
    b = docs.where("lang IN ('en', 'fr') AND doc_id % 2 = 0").groupBy("source").agg(F.count("*").alias("n"))
    return checks.differences(a, b, ["source"], ["n"])


@query(f"SELECT source, count(DISTINCT s) AS splits FROM (SELECT source, {_SPLIT} AS s FROM documents) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def several_splits(spark, d):
    """J22"""
    return checks.several_splits(table(spark, d, "documents").select("source", sampling.split(F.col("doc_id")).alias("split")), "source")


@query("SELECT source, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def content_digests(spark, d):
    """V12 V1"""
    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return checks.content_digest(docs, ["doc_id"], "h", ["source"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered_documents(spark, d):
    """J8 U4 U6"""
    return checks.not_covered(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_by_kind(spark, d):
    """The last row of each kind, as of a log already read."""
    return checks.latest(table(spark, d, "events").select("event_type", "event_id", "user_id", "value"), "event_type", "event_id")


@query("WITH b AS (SELECT CAST(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) AS VARCHAR) AS run, doc_id AS position FROM documents) SELECT run, position FROM (SELECT *, row_number() OVER (ORDER BY position DESC) AS k FROM b) WHERE k <= 3 OR position % 100 = 0 OR position = 57")
def retained_checkpoints(spark, d):
    """K7"""
    own = table(spark, d, "documents").select(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1).alias("run"), F.col("doc_id").alias("position"))
    return checks.retained(own, "position", 3, 100, 57)


@query("SELECT doc_id, round(CASE WHEN doc_id < 50 THEN 0.001 * (doc_id + 1) / 50 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * least(1.0, (doc_id - 50) / 950.0))) END, 9) AS lr FROM documents")
def learning_rates(spark, d):
    """W21"""
    return table(spark, d, "documents").select("doc_id", F.round(evaluation.learning_rate(F.col("doc_id"), 50, 1000, 0.001, 0.0001), 9).alias("lr"))


@query("WITH r AS (SELECT source, doc_id AS start, doc_id + 1 + doc_id % 3 * 20 AS stop FROM documents), f AS (SELECT *, lag(stop) OVER w IS DISTINCT FROM start AS fresh FROM r WINDOW w AS (PARTITION BY source ORDER BY start)), g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY source ORDER BY start) AS g FROM f) SELECT source, min(start) AS start, max(stop) AS stop FROM g GROUP BY source, g")
def merged_ranges(spark, d):
    """A26"""
    own = table(spark, d, "documents").select("source", F.col("doc_id").alias("start"), (F.col("doc_id") + 1 + F.col("doc_id") % 3 * 20).alias("stop"))
    return sequence.merged_ranges(own, "source")


_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+?[0-9][0-9 ()-]{7,}[0-9]", "address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "link": r"https?://[^\s]+"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS INTEGER) AS {k}" for k, p in _PII.items()) + ", sha256(regexp_replace(coalesce(text, ''), '" + _PII["email"] + "', '<email>', 'g')) AS masked FROM documents")
def pii_counts(spark, d):
    """D5"""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", *[F.regexp_count(text, F.lit(p)).alias(k) for k, p in _PII.items()], F.sha2(F.regexp_replace(text, _PII["email"], "<email>"), 256).alias("masked"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), n AS (SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS d FROM l WHERE trim(line) <> '' GROUP BY 1) SELECT doc_id, lines, round(1 - d / lines, 6) AS repeated, 1 - d / lines > 0.3 AS flagged FROM n")
def repeated_lines(spark, d):
    """D8"""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where("trim(line) <> ''")
    n = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_distinct("line").alias("d"))
    r = 1 - F.col("d") / F.col("lines")
    return n.select("doc_id", "lines", F.round(r, 6).alias("repeated"), (r > 0.3).alias("flagged"))


@query("WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT sha256(line) AS line_hash, count(*) AS documents FROM l WHERE length(line) >= 20 GROUP BY 1 HAVING count(*) >= 3")
def shared_lines(spark, d):
    """D11"""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("line")).where("length(line) >= 20")
    return lines.groupBy(F.sha2("line", 256).alias("line_hash")).agg(F.count("*").alias("documents")).where("documents >= 3")


@query("WITH t AS (SELECT sum(n_chars) AS total FROM documents), r AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY sha256('5:' || doc_id)) - n_chars AS before FROM documents) SELECT doc_id, lang FROM r, t WHERE before < total * CASE lang WHEN 'en' THEN 0.2 WHEN 'de' THEN 0.1 ELSE 0.05 END")
def weighted_mix(spark, d):
    """D1"""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", sampling.hash_rank("5", F.col("doc_id")).alias("h"))
    share = F.when(F.col("lang") == "en", 0.2).when(F.col("lang") == "de", 0.1).otherwise(0.05)
    caps = docs.join(F.broadcast(docs.agg(F.sum("n_chars").alias("t")))).groupBy("lang").agg((F.max("t") * F.max(share)).alias("cap"))
    return dedup.budgeted(docs, "lang", ["h"], "n_chars", caps).select("doc_id", "lang")


@query(f"WITH {SQL_LINES} SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM judged JOIN documents USING (doc_id) GROUP BY 1, 2")
def stage_report(spark, d):
    """D9"""
    docs = table(spark, d, "documents")
    j = clean.judged(docs).join(docs.select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


_STOP = {"en": ("the", "of", "and", "to"), "de": ("der", "die", "und", "das"), "fr": ("le", "de", "les", "et"), "es": ("el", "los", "que", "del")}


def _hits(words, some):
    return F.size(F.filter(words, lambda w: w.isin(*some)))


@query("WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+')) AS w FROM documents), c AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (w IN {ws}) AS {k}" for k, ws in _STOP.items()) + " FROM w GROUP BY 1) SELECT doc_id, CASE " + " ".join(f"WHEN {k} > 0 AND {k} = greatest(en, de, fr, es) THEN '{k}'" for k in _STOP) + " ELSE 'none' END AS guess FROM c")
def language_guess(spark, d):
    """D4"""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    c = table(spark, d, "documents").select("doc_id", *[_hits(words, ws).alias(k) for k, ws in _STOP.items()])
    best = F.greatest(*_STOP)
    guess = F.lit("none")
    for k in reversed(_STOP):
        guess = F.when((F.col(k) > 0) & (F.col(k) == best), F.lit(k)).otherwise(guess)
    return c.select("doc_id", guess.alias("guess"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def page_text(spark, d):
    """D3: the regular-expression form; op9 has the block rules."""
    x = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))
    return table(spark, d, "pages").select("page_id", F.sha2(x, 256).alias("digest"))


@query("WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sha256('Q: ' || text || ' A: ' || t2) AS pair FROM t WHERE role = 'user' AND r2 = 'assistant' AND text <> '' AND t2 <> ''")
def turn_pairs(spark, d):
    """Questions and answers of neighbouring turns, whole."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return t.where("role = 'user' AND r2 = 'assistant' AND text <> '' AND t2 <> ''").select("conv_id", "turn", F.sha2(F.concat(F.lit("Q: "), "text", F.lit(" A: "), "t2"), 256).alias("pair"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: tumbling windows."""
    e = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark, d):
    """Builtin coverage."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"WITH {_SCORE} SELECT 'quality' AS kind, count(*) AS n FROM s WHERE t UNION ALL SELECT 'other', count(*) FROM s WHERE NOT t")
def label_partition(spark, d):
    """Categories are disjoint and add up."""
    s = _scored(spark, d)
    return s.where("quality = 1").agg(F.lit("quality").alias("kind"), F.count("*").alias("n")).unionByName(s.where("quality <> 1").agg(F.lit("other").alias("kind"), F.count("*").alias("n")))


@query()
def bootstrap_lengths(spark, d):
    """A19 with 100 resamples: Poisson bootstrap by hash; rows only."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").cast("double").alias("v"))
    return evaluation.bootstrap(rows, ["lang"], "v", 100).select("lang", "n", F.round("mean", 6).alias("mean"), F.round(F.col("interval")[0], 6).alias("low"), F.round(F.col("interval")[1], 6).alias("high"))
