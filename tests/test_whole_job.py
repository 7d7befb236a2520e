"""Registered queries do the whole job on small tables made to show where a part would be missing."""

from __future__ import annotations

import bench
from quern.operators import clean, sequence
from quern.plans import catalogue
from quern.policy import HAN_STRICT


def run(spark, tmp_path, name, **tables):
    """Rows of a query over tables given as (rows, schema)."""
    for k, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{k}.parquet")
    return catalogue.QUERIES[name](spark, str(tmp_path)).collect()


GOOD = "Alpha beta gamma delta epsilon zeta."


def test_segments_pass_all_quality_tests(spark, tmp_path):
    texts = [GOOD, ", " + GOOD, GOOD[:-1], f"({GOOD}", f"{GOOD}\nabababababab.\n{GOOD}", f"{GOOD}\nAn (open\nmark) closed."]
    got = run(spark, tmp_path, "quality_segments", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.first_line, r.last_line) for r in got) == [(0, 0, 0), (4, 0, 0), (4, 2, 2), (5, 0, 2)]


def test_only_whole_bitmaps_collide(spark, tmp_path):
    a = [1.0] * 64
    rows = [(1, a, 0), (2, a[:-1] + [-1.0], 0), (3, [0.5] * 64, 0), (4, [-1.0] + a[1:], 0)]
    got = run(spark, tmp_path, "bitmap_members", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_id, r.n, r.first_id, r.unique_index) for r in got) == [(1, 2, 1, 2), (2, 1, 2, 1), (3, 2, 1, 2), (4, 1, 4, 0)]


def test_spam_phrases_come_with_the_policy(spark, tmp_path):
    texts = ["Alpha beta gamma delta epsilon zeta, Click to download theta.", "Alpha beta gamma delta epsilon zeta eta theta iota."]
    got = run(spark, tmp_path, "quality_reasons", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.reason) for r in got) == [(0, "boilerplate_or_spam"), (1, None)]
    good = "山高水长云深不知处，林中有鸟声声入耳，溪边花开年年如故。"
    docs = spark.createDataFrame([(1, f"{good}\n请扫码关注我们。\n{good}")], "doc_id long, text string")
    assert sorted((r.first_line, r.last_line) for r in clean.segments(docs, HAN_STRICT).collect()) == [(0, 0), (2, 2)]


def test_offsets_are_one_running_sum(spark, tmp_path):
    """Boundaries from a small sample, a wide column that one pass doesn't read, keys in no order, nulls and ties."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select(F.when(F.col("id") % 1000 > 0, F.xxhash64("id")).alias("k"), (F.col("id") % 50).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    rows.repartition(7).write.parquet(f"{tmp_path}/t")
    got = sequence.offsets(spark.read.parquet(f"{tmp_path}/t"), "k", "n", seen=500).where("k IS NOT NULL").toPandas().sort_values("k")
    nulls = rows.where("k IS NULL").agg(F.sum("n")).first()[0]
    assert len(got) == 199_800 and (got["n"].cumsum() - got["n"] + nulls == got["offset"]).all()


def test_windows_are_looked_up_to_the_end(spark, tmp_path):
    docs = [(i, "x" * (n - 2)) for i, n in enumerate((700, 30, 400, 3000))]
    got = run(spark, tmp_path, "window_lookup", documents=(docs, "doc_id long, text string"))
    assert sorted((r.point, r.doc_id, r.inside) for r in got) == [(0, 0, 0), (1024, 2, 294), (2048, 3, 918), (3072, 3, 1942), (4096, 3, 2966)]


def test_bench_has_the_near_duplicate_queries():
    assert {"near_dup_pairs", "near_dedup_ordered"} <= set(bench.HEADLINE) <= set(catalogue.QUERIES)
