"""Text expressions on small Chinese and Latin samples written for these tests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import clean
from quern.policy import HAN_STRICT, LATIN_STRICT, PAIRS, SPAM


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "reason"),
    [("他在（）中", "empty_parentheses"), ("花（学名：）开", "empty_labeled_parentheses"), ("海拔约为，", "missing_numeric_slot"), ("花（红色）开", None), ("总人口不少，", None), ("面积约，位于法国", "missing_numeric_slot")],
)
def test_artifacts(spark, text, reason):
    assert one(spark, T.artifact_reason(F.col("t")), t=text) == reason


@pytest.mark.parametrize(
    ("text", "reason"),
    [("，起头不对。", "leading_fragment"), ("没有结尾", "no_sentence_ending"), ("哈哈哈哈哈哈哈。", "repetition"), ("请扫码关注我们。", "boilerplate_or_spam"), ("他说“你好。", "unbalanced_delimiters"), ("他说（你】好。", "unbalanced_delimiters"), ("一切如常（真的）。", None)],
)
def test_quality(spark, text, reason):
    assert one(spark, T.quality_reason(F.col("t"), HAN_STRICT, PAIRS, SPAM), t=text) == reason


def test_question_and_answer(spark):
    def qa(q, e, a):
        return one(spark, T.qa_text(F.col("q"), F.col("e"), F.col("a"), HAN_STRICT), q=q, e=e, a=a)

    assert qa("为何天蓝", None, "因为散射。") == "问：为何天蓝答：因为散射。"
    assert qa("为何天蓝", "白天", "因为散射。") == "问：为何天蓝补充：白天答：因为散射。"
    assert qa("为何2天", None, "因为散射。") is None
    assert qa("", None, "因为散射。") is None
    assert qa("为何", None, "## 原因\n**散射** ，是的。") == "问：为何答：原因：散射，是的。"


@pytest.mark.parametrize(("text", "rows"), [("", 0), ("\n", 0), ("a", 1), ("a\nb", 2), ("a\n\nb", 3), ("\nb", 2), ("a" * 20 + "\nb", 2), ("a\r\nb\n", 2), ("a" * 21, 2)])
def test_layout(spark, text, rows):
    assert one(spark, T.layout_rows(F.col("t")), t=text) == rows


def test_small_expressions(spark):
    assert one(spark, T.typed_list(F.col("t"), "int"), t="3, 1,3,,2") == [1, 2, 3]
    assert tuple(one(spark, T.sample_parts(F.col("t")), t="4:17:2")) == (4, 17, 2)
    assert one(spark, T.structure_class(F.col("d"), F.col("c")), d="⿰木木", c="林") == 1
    assert one(spark, T.structure_class(F.col("d"), F.col("c")), d="木", c="木") == 0
    assert one(spark, T.structure_class(F.col("d"), F.col("c")), d="x木", c="木") == 13
    assert one(spark, T.text_id_ordinal("20260907", F.col("t")), t="17") == 512
    assert one(spark, T.boundary(F.col("t")), t="【旧题】") and one(spark, T.boundary(F.col("t")), t="第三章云") and not one(spark, T.boundary(F.col("t")), t="普通一句。")
    assert one(spark, T.shingles(F.col("t")), t="abc") == ["abc"] and one(spark, T.shingles(F.col("t")), t="") == [""]
    assert one(spark, T.converted(F.col("t"), {"後來": "后来", "後": "后"}), t="後來與後") == "后来與后"
    assert one(spark, T.plain_wikitext(F.col("t")), t="a{{x|{{y}}}}b [[c|d]] [[File:e.png]]") == "a\nb d \n"
    assert one(spark, T.nfc(F.col("t")), t="é") == "é"
    assert one(spark, T.canonical(F.col("t"), HAN_STRICT), t="々〇a林。") == "〇林"


def test_one_reason_per_line(spark):
    rows = [(1, "林林林林。\r\n林x " + "山" * 39 + "\n" + "山水" * 21 + "\n" + "山" * 41), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.reason for r in clean.judged(docs, HAN_STRICT).collect()}
    assert got == {(1, 0): "short", (1, 1): "symbols", (1, 2): "short", (1, 3): None, (1, 4): "repeated_character"}


def test_segments_break_at_bad_lines(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta.\nEta theta iota kappa.\n12 34\nLambda mu nu xi omicron pi rho sigma.")], "doc_id long, text string")
    got = clean.segments(docs, LATIN_STRICT).orderBy("segment").collect()
    assert [(r.first_line, r.last_line) for r in got] == [(0, 1), (3, 3)]


def test_adapters(spark):
    rows = [("jsonl_qa", "为何天蓝", "", "因为空气散射阳光。", None), ("jsonl_article", "天空", "", "天空蓝色因为散射。\nbad 1", None), ("jsonl_text", None, None, None, "山高水长云深不知处。\nx")]
    df = spark.createDataFrame(rows, "adapter string, instruction string, input string, output string, text string")
    got = sorted(r.unit for r in clean.units(df, HAN_STRICT, F.lit(5)).collect())
    assert got == sorted(["问：为何天蓝答：因为空气散射阳光。", "主题：天空资料摘录：天空蓝色因为散射。", "山高水长云深不知处。"])
