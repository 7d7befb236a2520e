"""Queries on the strict Chinese policy over small inline tables, and gates, contracts and comparisons over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, clean, dedup, evaluation, sampling, sequence
from ..policy import ARTIFACTS, HAN_MARKS, HAN_RANGES, HAN_STRICT, KEYWORD_FAMILIES, KEYWORDS, LATIN_STRICT, SECTION
from . import catalogue as C
from .catalogue import query, table


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(names: str, rows: list[tuple]) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({names})"


def inline(spark, names: str, rows: list[tuple]) -> DataFrame:
    kinds = ["long" if all(isinstance(r[k], int) for r in rows) else "string" for k in range(len(rows[0]))]
    return spark.createDataFrame(rows, ", ".join(f"{n.strip()} {t}" for n, t in zip(names.split(","), kinds, strict=True)))


# ---- the strict Chinese policy, on new sentences -------------------------------------------------------------------------
_LONG = "山高水长云深不知处林中有鸟声声入耳溪边花开年年如故村里的人早出晚归种田读书"
LINES = [
    (1, f"{_LONG},{_LONG}."), (2, "太短的一行。"), (3, f"{_LONG}ABC{_LONG}。"), (4, f"{_LONG}（，）{_LONG}。"), (5, f"{_LONG}总面积为，{_LONG}。"), (6, f"{_LONG}（学名：）{_LONG}。"),
    (7, f"{_LONG}好好好好好好好好好好好{_LONG}。"), (8, f"〇{_LONG}：“{_LONG}！”"), (9, f"{_LONG}々{_LONG}"), (10, "𠀀" * 41), (11, ""), (12, f"{_LONG}；位于法国{_LONG}面积，位于法国。"),
]
_FULL = "translate(x, ',.!?;:()', '，。！？；：（）')"
_ARTIFACT = "CASE " + " ".join(f"WHEN regexp_matches(y, '{p}') THEN '{k}'" for k, p in ARTIFACTS.items()) + " END"


@query(
    f"""WITH l AS (SELECT id, {_FULL} AS y FROM {values('id, x', LINES)}), n AS (SELECT *, len(regexp_extract_all(y, '[{HAN_RANGES}]')) AS n, {_ARTIFACT} AS artifact FROM l)
SELECT id, CASE WHEN NOT regexp_full_match(y, '[{HAN_RANGES}{HAN_MARKS}]+') THEN 'symbols' WHEN artifact IS NOT NULL THEN artifact WHEN n < 40 THEN 'short' WHEN length(y) > 4096 THEN 'long'
  WHEN len(list_filter(range(1, length(y) - 8), lambda i: substr(y, i, 10) = repeat(substr(y, i, 1), 10))) > 0 THEN 'repeated_character' END AS reason, n AS letters FROM n"""
)
def han_reasons(spark, d):
    """Reasons under the strict Chinese policy."""
    own = inline(spark, "id, x", LINES).withColumn("y", T.full_width(F.col("x")))
    return own.select("id", T.reject_reason(F.col("y"), HAN_STRICT).alias("reason"), T.letter_count(F.col("y"), HAN_STRICT).cast("long").alias("letters"))


CONVERSION = {"皇后": "皇后", "後來": "后来", "乾隆": "乾隆", "乾": "干", "後": "后", "來": "来", "龍": "龙", "雲": "云"}
SENTENCES = [(1, "後來乾隆來了，龍雲在天。"), (2, "皇后不乾，雲後有龍。"), (3, "没有要换的字。"), (4, ""), (5, "後後來來乾乾隆")]


@query("SELECT id, replace(replace(replace(replace(replace(replace(replace(x, '乾隆', '甲'), '後來', '后来'), '乾', '干'), '後', '后'), '來', '来'), '龍', '龙'), '雲', '云') AS y0, replace(y0, '甲', '乾隆') AS converted FROM " + values("id, x", SENTENCES))
def han_conversion(spark, d):
    """T4: dictionary conversion, the longest entry first; y0 marks the entry that protects its characters."""
    own = inline(spark, "id, x", SENTENCES).withColumn("converted", T.converted(F.col("x"), CONVERSION))
    return own.select("id", F.replace("converted", F.lit("乾隆"), F.lit("甲")).alias("y0"), "converted")


FIELDS = [(1, "# 标题"), (2, "## 春天：\n山 清 水 秀 。 **很好** ，是吗？"), (3, "一行\n\n  二行  \n###三行"), (4, "有 abc 的一行。"), (5, ""), (6, "#　全角空格\n答案。"), (7, "面积为，不明。")]
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^#{1,6}[\s\x{3000}]+', ''), '\*\*([^*]+)\*\*', '\1', 'g'), '([，。！？；：、])[ \t\x{3000}]+', '\1', 'g'), '[ \t\x{3000}]+([，。！？；：、])', '\1', 'g')"
_MD = rf"list_transform(list_filter(list_transform(string_split({_FULL}, chr(10)), lambda l: trim(l, ' 　')), lambda l: l <> ''), lambda l: CASE WHEN regexp_matches(l, '^#{{1,6}}[\s\x{{3000}}]+') AND NOT regexp_matches({_CLEAN}, '[：。！？]$') THEN {_CLEAN} || '：' ELSE {_CLEAN} END)"


@query(f"WITH m AS (SELECT id, {_MD} AS ls FROM {values('id, x', FIELDS)}) SELECT id, array_to_string(ls, '|') AS lines, CASE WHEN len(list_filter(ls, lambda y: NOT regexp_full_match(y, '[{HAN_RANGES}{HAN_MARKS}]+') OR {_ARTIFACT} IS NOT NULL)) = 0 THEN array_to_string(ls, '') END AS pure FROM m")
def markdown_fields(spark, d):
    """Lines of a Markdown field, and the whole field if each is pure."""
    own = inline(spark, "id, x", FIELDS)
    return own.select("id", F.array_join(T.markdown_lines(F.col("x")), "|").alias("lines"), T.pure_field(F.col("x"), HAN_STRICT).alias("pure"))


PAIRS = [(1, "什么是山？", "", "山是高地。"), (2, "什么是水？", "说短一些", "水是溪流。"), (3, "有 3 个吗？", "", "没有。"), (4, "什么是云？", "abc", "云在天上。"), (5, "", "", "没有问题。"), (6, "问", None, "答"), (7, "没有回答？", "", "")]
_PURE = {c: f"CASE WHEN coalesce({c}, '') = '' THEN '' WHEN regexp_full_match({c}, '[{HAN_RANGES}{HAN_MARKS}]+') THEN {c} END AS {c}" for c in "qea"}


@query(f"WITH p AS (SELECT id, {', '.join(_PURE.values())} FROM {values('id, q, e, a', PAIRS)}) SELECT id, CASE WHEN q <> '' AND a <> '' AND e IS NOT NULL THEN '问：' || q || CASE WHEN e = '' THEN '' ELSE '补充：' || e END || '答：' || a END AS unit FROM p")
def qa_units(spark, d):
    """A whole question and answer or nothing."""
    return inline(spark, "id, q, e, a", PAIRS).select("id", T.qa_text(F.col("q"), F.col("e"), F.col("a"), HAN_STRICT).alias("unit"))


HEADS = [(1, "第三章 山水"), (2, "【篇二】水"), (3, "问：什么？"), (4, "问题十二：谁？"), (5, "【短题】"), (6, "【" + "长" * 80 + "】"), (7, "平常的一行。"), (8, "  第十二回"), (9, "第三人"), (10, "问题: 什么")]


@query(f"SELECT id, regexp_matches(x, '{SECTION}') OR (starts_with(x, '【') AND ends_with(x, '】') AND length(x) <= 80) AS boundary FROM {values('id, x', HEADS)}")
def section_boundaries(spark, d):
    """P10: section headings and titles in brackets."""
    return inline(spark, "id, x", HEADS).select("id", T.boundary(F.col("x")).alias("boundary"))


LABELS = [(1, "山"), (2, "。"), (3, "〇"), (4, "，"), (5, "“"), (6, "𠀀")]


@query(f"SELECT id, CASE WHEN regexp_full_match(x, '[{HAN_RANGES}]') THEN 'letter' WHEN regexp_full_match(x, '\\p{{P}}') THEN 'punctuation' END AS category FROM {values('id, x', LABELS)}")
def label_categories(spark, d):
    """Letters and punctuation; anything else would be an error."""
    return inline(spark, "id, x", LABELS).select("id", T.category(F.col("x"), HAN_STRICT).alias("category"))


SPAMMED = [(1, "请扫码关注我们。"), (2, "山高水长。"), (3, "点击下载看看！"), (4, "本站免责声明如下。"), (5, "加微信了解。"), (6, "加了微信。")]


@query("SELECT id, " + " OR ".join(f"contains(x, '{p}')" for p in HAN_STRICT.phrases) + f" AS spam FROM {values('id, x', SPAMMED)}")
def han_spam(spark, d):
    """P5: the phrase list of the strict Chinese policy."""
    return inline(spark, "id, x", SPAMMED).select("id", T.spam(F.col("x"), HAN_STRICT.phrases).alias("spam"))


TOPICS = [(1, "法院的判决和司法。", "news", "新闻"), (2, "法院在山上。", "news", "新闻"), (3, "银行和证券，医院和疾病。", "education_web", "网页"), (4, "农业与土壤的生态。", "wiki", "百科"), (5, "学校的课程与教学。", "education_web", "网页")]
_FIELD_HITS = {k: " + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in ws) for k, ws in KEYWORDS.items()}


@query(
    "WITH s AS (SELECT id, family, hint, [" + ", ".join(_FIELD_HITS.values()) + f"] AS h, [{', '.join(_sql(k) for k in KEYWORDS)}] AS k FROM {values('id, x, family, hint', TOPICS)}) "
    f"SELECT id, CASE WHEN family IN {KEYWORD_FAMILIES} AND list_max(h) >= 2 THEN k[list_position(h, list_max(h))] ELSE hint END AS label, CASE WHEN family IN {KEYWORD_FAMILIES} AND list_max(h) >= 2 THEN 'heuristic' ELSE 'source' END AS method FROM s"
)
def han_domains(spark, d):
    """T23 with the policy's keywords."""
    label, method = T.domain(F.col("x"), F.col("family"), F.col("hint"), KEYWORD_FAMILIES, KEYWORDS)
    return inline(spark, "id, x, family, hint", TOPICS).select("id", label.alias("label"), method.alias("method"))


MARKUP = [(1, "山{{引|一{{内}}}}水"), (2, "前<ref>注</ref>后"), (3, "见[[山川|山]]与[[水]]"), (4, "[[File:a.png|图]]字"), (5, "'''粗''' ''斜'' <br/>行"), (6, "[http://a.org 链接]文"), (7, "<table><tr><td>表</td></tr></table>后")]
_TAGGED = "u"
for _name in ("ref", "table", "math", "gallery", "code", "timeline"):
    _TAGGED = rf"regexp_replace({_TAGGED}, '(?is)<{_name}\b[^>]*?(?:/>|>.*?</{_name}>)', chr(10), 'g')"
_BRACES = "x"
for _level in range(4):
    _BRACES = rf"regexp_replace({_BRACES}, '\{{\{{[^{{}}]*\}}\}}', chr(10), 'g')"


@query(
    rf"""WITH b AS (SELECT id, {_BRACES} AS u FROM {values('id, x', MARKUP)}), t AS (SELECT id, {_TAGGED} AS v FROM b)
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?i)\[\[(?:file|image|category|文件|图像|分类):[^\[\]]*\]\]', chr(10), 'g'), '\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]', '\1', 'g'), '\[https?://\S+ ([^\]]*)\]', '\1', 'g'), '''{{2,5}}', '', 'g'), '<[^>]+>', '', 'g') AS plain FROM t"""
)
def wikitext_plain(spark, d):
    """T5: templates four levels deep, tags, files and links."""
    return inline(spark, "id, x", MARKUP).select("id", T.plain_wikitext(F.col("x")).alias("plain"))


GLYPHS = [(1, "⿰木木", "林"), (2, "⿱山石", "岩"), (3, "山", "山"), (4, None, "水"), (5, "⿻一丨", "十"), (6, "木木", "林")]


@query("SELECT id, CASE WHEN x IS NULL OR x = c THEN 0 WHEN unicode(x) BETWEEN 12272 AND 12283 THEN unicode(x) - 12271 ELSE 13 END AS class FROM " + values("id, x, c", GLYPHS))
def structure_classes(spark, d):
    """The leading operator of a decomposition."""
    return inline(spark, "id, x, c", GLYPHS).select("id", T.structure_class(F.col("x"), F.col("c")).alias("class"))


LISTS = [(1, "3, 1,2,,3"), (2, ""), (3, "10,9"), (4, " 7 ")]


@query("SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(x, ','), lambda p: trim(p) <> ''), lambda p: CAST(trim(p) AS INTEGER)))), ' ') AS numbers FROM " + values("id, x", LISTS))
def typed_lists(spark, d):
    """A comma-separated list as its sorted distinct numbers."""
    own = inline(spark, "id, x", LISTS)
    return own.select("id", F.array_join(F.transform(T.typed_list(F.col("x"), "int"), lambda n: n.cast("string")), " ").alias("numbers"))


# ---- gates and records over documents ---------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 200000 THEN 'opaque' WHEN length(coalesce(text, '')) < 1024 THEN 'short' ELSE 'fit' END AS gate FROM documents")
def length_gates(spark, d):
    """P13"""
    return table(spark, d, "documents").select("doc_id", checks.length_gate(F.coalesce("text", F.lit(""))).alias("gate"))


@query(
    """WITH s AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark), x AS (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents)
SELECT d.doc_id, count(x.c) AS missing, count(x.c) = 0 AS renderable FROM documents d LEFT JOIN (SELECT * FROM x WHERE c <> '' AND c NOT IN (SELECT c FROM s)) x USING (doc_id) GROUP BY 1"""
)
def renderable_documents(spark, d):
    """How many characters of a document the benchmark's inventory lacks."""
    supported = table(spark, d, "benchmark").select(F.explode(T.characters(F.col("text"))).alias("char")).distinct()
    return checks.renderable(table(spark, d, "documents"), "doc_id", "text", supported)


@query(
    f"""WITH {C.SQL_LINES} SELECT doc_id || ':' || line_no AS sample_id, doc_id AS source_page_id, 'documents' AS source_file, 'r0' AS source_file_revision, 'doc:' || doc_id AS source_url, source AS source_family, lang AS domain, 'source' AS domain_method,
'{{' || array_to_string(list_filter(['"source":"' || source || '"', '"lang":"' || lang || '"', '"n_chars":' || n_chars], lambda x: x IS NOT NULL), ',') || '}}' AS source_metadata, line AS text, sha256(line) AS text_sha256, {C._SPLIT} AS split, CAST(letters AS INTEGER) AS letters
FROM judged JOIN documents USING (doc_id) WHERE reason IS NULL"""
)
def paragraph_records(spark, d):
    """The 13 fields of a kept paragraph; metadata are the JSON of what is there."""
    docs = table(spark, d, "documents")
    return clean.records(docs, LATIN_STRICT, "documents", "r0", ["source", "lang", "n_chars"], sampling.split(F.col("doc_id")))


@query("SELECT doc_id, CAST(least(n, 300000 - offs) AS BIGINT) AS kept FROM (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS offs FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)) WHERE offs < 300000 AND n > 0")
def page_budget(spark, d):
    """Whole pages in order up to a global budget, and how much of the last one stays."""
    docs = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return sequence.budget_trim(docs, "doc_id", "n", 300_000)


@query(
    """WITH b AS (SELECT DISTINCT sha256(l) AS h FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE length(l) >= 20), x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE length(l) >= 20 AND sha256(l) IN (SELECT h FROM b))"""
)
def row_exclusion(spark, d):
    """A document any of whose lines is held out goes as a whole."""
    docs, held = table(spark, d, "documents"), table(spark, d, "benchmark")
    return dedup.rows_excluded(docs, "doc_id", "text", held, "text", 20).select("doc_id")


@query("WITH l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}]')) AS letters, greatest(1, length(coalesce(text, ''))) AS n FROM documents) SELECT doc_id, letters, round(letters / n, 6) AS share, letters >= 50 AND letters / n >= 0.8 AS passed FROM l")
def ratio_gates(spark, d):
    """50 letters or more, and 80 % of all characters."""
    text = F.coalesce("text", F.lit(""))
    own = table(spark, d, "documents").select("doc_id", T.letter_count(text, LATIN_STRICT).cast("long").alias("letters"), F.greatest(F.lit(1), F.length(text)).alias("n"))
    share = F.col("letters") / F.col("n")
    return own.select("doc_id", "letters", F.round(share, 6).alias("share"), ((F.col("letters") >= 50) & (share >= 0.8)).alias("passed"))


NUMBERS = {"date": r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b", "percent": r"\b[0-9]+(?:\.[0-9]+)?%", "decimal": r"\b[0-9]+\.[0-9]+\b", "year": r"\b(?:19|20)[0-9]{2}\b", "count": r"\b[0-9]+\b"}
_NUMBERS = "coalesce(text, '')"
for _kind, _pattern in NUMBERS.items():
    _NUMBERS = f"regexp_replace({_NUMBERS}, '{_pattern}', '<{_kind}>', 'g')"


@query(f"SELECT doc_id, sha256(x) AS rewritten, " + ", ".join(f"CAST((length(x) - length(replace(x, '<{k}>', ''))) / {len(k) + 2} AS BIGINT) AS {k}_n" for k in NUMBERS) + f" FROM (SELECT doc_id, {_NUMBERS} AS x FROM documents)")
def typed_numbers(spark, d):
    """Dates, percentages, decimals, years and counts as typed marks, the narrowest form first."""
    x = T.typed_numbers(F.coalesce("text", F.lit("")), NUMBERS)
    own = table(spark, d, "documents").select("doc_id", x.alias("x"))
    hits = [((F.length("x") - F.length(F.replace("x", F.lit(f"<{k}>"), F.lit("")))) / (len(k) + 2)).cast("long").alias(f"{k}_n") for k in NUMBERS]
    return own.select("doc_id", F.sha2("x", 256).alias("rewritten"), *hits)


_RULES = {
    "id": "doc_id >= 0", "text": "text IS NOT NULL", "length": "n_chars = length(text)", "blank": "trim(text) <> ''", "longest": "length(text) <= 200000", "nul": "NOT contains(text, chr(0))",
    "return": "NOT contains(text, chr(13))", "language": "lang IN ('en', 'de', 'fr', 'es')", "source": "source <> ''", "spaces": "NOT contains(text, '   ')",
}


@query("SELECT * FROM (SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in _RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS rules FROM documents) WHERE rules <> ''")
def all_row_contracts(spark, d):
    """V4: ten rules of a row."""
    found = checks.violations(table(spark, d, "documents"), "doc_id", {k: F.expr(c) for k, c in _RULES.items()})
    return found.select("doc_id", F.array_join("rules", ",").alias("rules"))


@query(f"WITH {C.SQL_LINES} SELECT count(*) AS parents, count(*) AS covered, 0 AS missing, 0 AS repeated, 0 AS out_of_order FROM judged WHERE reason IS NULL")
def export_proof(spark, d):
    """V8: runs taken apart again hold every kept line once, in order, with its text."""
    docs = table(spark, d, "documents")
    return sequence.run_proof(sequence.runs(C._joined(spark, d)), clean.paragraphs(docs), "doc_id")


@query("WITH p AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^[\\p{L}\\p{M} ,.;:!?()''\"\\-]*') AS p FROM documents), e AS (SELECT doc_id, p, regexp_extract(p, '(?s)^.*[.!?]') AS s, len(regexp_extract_all(p, '[\\p{L}\\p{M}]')) AS n, len(list_distinct(regexp_extract_all(p, '[\\p{L}\\p{M}]'))) AS u FROM p) SELECT doc_id, length(p) AS legal, length(s) AS sentence, n AS letters, n >= 8 AND u >= 4 AS substantial FROM e")
def legal_prefixes(spark, d):
    """How far a text is of the alphabet, the last end of a sentence there, its letters, and whether they are more than trivial."""
    return T.legal_prefix(table(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")), LATIN_STRICT)


@query("SELECT conv_id, turn, CASE WHEN contains(text, '.') THEN instr(text, '.') - 1 ELSE length(text) END AS kept, contains(text, '.') AS ended FROM conversations WHERE text IS NOT NULL")
def trimmed_turns(spark, d):
    """What comes before the first end mark."""
    at = F.instr("text", ".")
    t = table(spark, d, "conversations").where("text IS NOT NULL")
    return t.select("conv_id", "turn", F.when(at > 0, at - 1).otherwise(F.length("text")).cast("long").alias("kept"), (at > 0).alias("ended"))


@query("WITH l AS (SELECT doc_id // 8 AS batch, length(coalesce(text, '')) AS n FROM documents), w AS (SELECT *, least(4096, (max(n) OVER (PARTITION BY batch) + 7) // 8 * 8) AS width FROM l) SELECT batch, CAST(any_value(width) AS BIGINT) AS width, CAST(sum(greatest(0, width - n)) AS BIGINT) AS padding, CAST(sum(greatest(0, n - width)) AS BIGINT) AS trimmed FROM w GROUP BY batch")
def padded_batches(spark, d):
    """Batches padded or trimmed to their longest row, up to a multiple of 8 and a cap."""
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 8).alias("batch"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return sequence.padded(rows, "batch", "n", 8, 4096)


@query("SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT source, lang FROM documents WHERE doc_id % 50 = 0)")
def permitted_rows(spark, d):
    """Rows whose source and language are on a list."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.join(docs.where("doc_id % 50 = 0").select("source", "lang").distinct(), ["source", "lang"], "left_semi").select("doc_id")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def targets_or_missing(spark, d):
    """Targets, -1 where there is none."""
    labels = table(spark, d, "labels")
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


# ---- comparisons ---------------------------------------------------------------------------------------------------------------
@query("WITH c AS (SELECT item_id, unicode(c) % 100 AS v FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '') SELECT item_id, count(*) AS tokens, CAST(sum(len(list_filter(embedding, lambda x: x > 0))) AS BIGINT) AS ink FROM c JOIN embeddings ON vec_id = v GROUP BY 1")
def gathered_bitmaps(spark, d):
    """The bitmap of each token, gathered by a join and summed."""
    tokens = table(spark, d, "benchmark").select("item_id", F.explode(T.characters(F.col("text"))).alias("c"))
    return evaluation.gathered_ink(tokens.select("item_id", (F.expr("conv(hex(encode(c, 'UTF-32')), 16, 10)").cast("long") % 100).alias("id")), C._bits(spark, d), "item_id")


@query(f"WITH {C._BITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM h WHERE lb <> 0) SELECT query_id, CAST(k AS INTEGER) AS rank, id, distance FROM r WHERE k <= 3")
def content_candidates(spark, d):
    """The k nearest of content, recovered from the whole gallery's k + c nearest, c being the items that are no content."""
    b = C._bits(spark, d)
    return evaluation.content_nearest(b.where("id % 10 = 0"), b, F.col("label") != 0, 3)


@query(f"WITH {C._BITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY common DESC, id) AS k FROM h) SELECT query_id, id, common FROM r WHERE k = 1")
def best_by_product(spark, d):
    """The item of the gallery with the largest inner product of bits."""
    b = C._bits(spark, d)
    return evaluation.best_product(b.where("id % 10 = 0"), b)


_DISTANCES, _OVERLAPS = (1, 2, 4, 8, 16, 24, 32), (0.5, 0.6, 0.7, 0.75)


@query(f"WITH {C._BITS}, n AS (SELECT query_id, min(distance) AS d, max(round(coalesce(2 * common / nullif(total, 0), 0.0), 6)) AS f FROM h GROUP BY 1) SELECT count(*) AS items, " + ", ".join([f"round(count(*) FILTER (d <= {x}) / count(*), 6) AS within_{x}" for x in _DISTANCES] + [f"round(count(*) FILTER (f >= {x}) / count(*), 6) AS f1_{int(100 * x)}" for x in _OVERLAPS]) + " FROM n")
def similarity_ladders(spark, d):
    """Shares of all items whose nearest is within a distance or above an F1."""
    b = C._bits(spark, d)
    q = b.where("id % 10 = 0")
    n = evaluation.nearest(q, b, 1).select("query_id", F.col("distance").alias("d")).join(evaluation.best_overlap(q, b).select("query_id", F.col("f1").alias("f")), "query_id")
    return evaluation.ladders(n, "d", _DISTANCES, "f", _OVERLAPS)


_RESAMPLES = 40
_WEIGHT = "len(list_filter([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582], lambda c: CAST('0x' || substr(sha256(r || ':' || doc_id), 1, 8) AS BIGINT) % 1000000 / 1000000.0 >= c))"


@query(
    f"""WITH {C._SCORE}, w AS (SELECT doc_id, t, score, r, CASE WHEN r < 0 THEN 1 ELSE {_WEIGHT} END AS w FROM s, (SELECT unnest(range(-1, {_RESAMPLES})) AS r)),
c AS (SELECT r, """
    + ", ".join(f"coalesce(2 * sum(w) FILTER (score >= {g} AND t) / nullif(2 * sum(w) FILTER (score >= {g} AND t) + sum(w) FILTER ((score >= {g}) <> t), 0), 0.0) AS f{k}" for k, g in enumerate((0.9, 0.8)))
    + " FROM w GROUP BY r) SELECT round(max(f0) FILTER (r < 0), 6) AS first, round(max(f1) FILTER (r < 0), 6) AS second, round(max(f0 - f1) FILTER (r < 0), 6) AS difference, round(count(*) FILTER (r >= 0 AND f0 > f1) / count(*) FILTER (r >= 0), 6) AS probability FROM c"
)
def paired_f1(spark, d):
    """The difference of two F1 over the same rows, and the share of paired resamples in which the first is larger."""
    rows = C._scored(spark, d)
    return evaluation.paired_f1(rows, "doc_id", F.col("score") >= 0.9, F.col("score") >= 0.8, F.col("quality") == 1, _RESAMPLES)


@query("WITH m AS (SELECT source, lang, count(*) AS n, max(n_chars) AS most, min(n_chars) AS least, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1, 2) SELECT source, b.n - a.n AS d_n, b.most - a.most AS d_most, b.least - a.least AS d_least, round(b.mean - a.mean, 6) AS d_mean FROM m a JOIN m b USING (source) WHERE a.lang = 'en' AND b.lang = 'de'")
def run_deltas(spark, d):
    """Control minus baseline on four measures, paired by key."""
    m = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return evaluation.deltas(m.where("lang = 'en'"), m.where("lang = 'de'"), ["source"], ["n", "most", "least", "mean"])


@query("WITH b AS (SELECT doc_id // 50 AS batch, count(DISTINCT c) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1) SELECT count(*) AS batches, max(n) AS most, round(quantile_cont(n, 0.95), 6) AS p95 FROM b")
def batch_assets(spark, d):
    """Distinct characters of a batch, at most and at the 95th percentile."""
    c = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("batch"), F.explode(F.array_distinct(T.characters(F.coalesce("text", F.lit(""))))).alias("c"))
    n = c.groupBy("batch").agg(F.count_distinct("c").alias("n"))
    return n.agg(F.count("*").alias("batches"), F.max("n").alias("most"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))


@query("WITH r AS (SELECT date_trunc('day', ts) AS repeat, user_id % 4 AS rank, sum(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT repeat, max(v) AS slowest FROM r GROUP BY 1) SELECT count(*) AS repeats, round(median(slowest), 4) AS middle FROM s")
def slowest_rank_median(spark, d):
    """The slowest rank of each repeat, then the median over repeats."""
    e = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("repeat"), (F.col("user_id") % 4).alias("rank")).agg(F.sum("value").alias("v"))
    return e.groupBy("repeat").agg(F.max("v").alias("slowest")).agg(F.count("*").alias("repeats"), F.round(F.percentile("slowest", F.lit(0.5)), 4).alias("middle"))


@query("SELECT count(*) AS pairs, round(avg(a.n_chars), 6) AS own, round(avg(b.n_chars), 6) AS shifted, count(*) FILTER (b.n_chars < a.n_chars) AS worse FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def shift_sensitivity(spark, d):
    """A score in its own context and in the next one's, and how often that is worse."""
    a = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("own"))
    both = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("own").alias("shifted")), "doc_id")
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg("own"), 6).alias("own"), F.round(F.avg("shifted"), 6).alias("shifted"), F.count_if(F.col("shifted") < F.col("own")).alias("worse"))


_TOTALS = C.ORACLES["event_repetition"]


@query(f"SELECT count(*) AS samples, CAST(sum(n) AS BIGINT) AS positions, max(longest_run) AS longest_run, max(longest_cycle) AS longest_cycle, count(*) FILTER (has_cycle) AS cyclic, count(*) FILTER (longest_run >= 4) AS stuck, round(avg(repeat_rate), 6) AS mean_repeat, count(*) FILTER (has_cycle OR longest_run >= 4) AS flagged FROM ({_TOTALS})")
def generation_totals(spark, d):
    """Totals over samples, and how many are flagged."""
    r = sequence.repetition(table(spark, d, "events"), "user_id", "event_id", "event_type", 4, 8)
    stuck = F.col("longest_run") >= 4
    return r.agg(F.count("*").alias("samples"), F.sum("n").alias("positions"), F.max("longest_run").alias("longest_run"), F.max("longest_cycle").alias("longest_cycle"), F.count_if("has_cycle").alias("cyclic"), F.count_if(stuck).alias("stuck"), F.round(F.avg("repeat_rate"), 6).alias("mean_repeat"), F.count_if(F.col("has_cycle") | stuck).alias("flagged"))


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, sha256(coalesce(html, '')) AS h FROM pages), s AS (SELECT *, CAST('0x' || substr(sha256('site:' || site), 1, 8) AS BIGINT) % 1000 < 200 AS held FROM p)
SELECT page_id, site FROM s WHERE held AND h NOT IN (SELECT h FROM s WHERE NOT held)"""
)
def held_out_sites(spark, d):
    """Whole sites held out, without pages whose content the other sites have too."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("site"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("h"))
    s = p.withColumn("held", T.text_id_ordinal("site", F.col("site")) < 200)
    return dedup.excluded(s.where("held"), s.where("NOT held").select("h"), "h").select("page_id", "site")
