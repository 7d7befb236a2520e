from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import dedup, sequence


def test_first_wins_keeps_what_only_rejected_ones_resemble(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert dict(dedup.first_wins(nodes, links).collect()) == {1: True, 2: False, 3: True}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_wins_is_the_greedy_result(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a < b}
    kept: set[int] = set()
    for n in range(40):
        if not any((a, n) in edges for a in kept):
            kept.add(n)
    for parts in (1, 8):
        got = dedup.first_wins(spark.range(40).repartition(parts), spark.createDataFrame(sorted(edges), "a long, b long"))
        assert {r.id for r in got.collect() if r.kept} == kept


def test_reasons(spark):
    base = "".join(chr(0x4E00 + i) for i in range(200))
    near = base[:100] + "龥" + base[101:]
    texts = [base, base, base + "。", near, near, "".join(chr(0x6000 + i) for i in range(200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("canonical", F.regexp_replace("text", "。", ""))
    rows = rows.withColumns({"text_hash": F.sha2("text", 256), "canonical_hash": F.sha2("canonical", 256)})
    got = dedup.ordered_near(rows, ["doc_id"], T.anchors(F.col("canonical")))
    reasons = {r.doc_id: r.reason for r in got.collect()}
    assert reasons == {0: None, 1: "exact", 2: "punctuation_variant", 3: "near_duplicate", 4: "near_duplicate", 5: None}


def test_budget_stops_before_a_record(spark):
    rows = [(i, "a" if i % 2 else "b", 10) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, family string, n long").orderBy(F.desc("id"))
    caps = spark.createDataFrame([("a", 25), ("b", 20)], "family string, cap long")
    got = sorted((r.family, r.id) for r in dedup.budgeted(df, "family", ["id"], "n", caps).collect())
    assert got == [("a", 1), ("a", 3), ("a", 5), ("b", 0), ("b", 2)]


def test_exclusion_on_either_key(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "p", "q"), (3, "q", "z")], "id long, h string, g string")
    banned = spark.createDataFrame([("q",)], "h string")
    assert [r.id for r in dedup.excluded(rows, banned, "h", "g").collect()] == [1]


@pytest.mark.parametrize("context", [1, 2, 4, 8, 1024])
def test_packed_targets_are_conserved(spark, context):
    lengths = [4, 3, 8, 2]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = sequence.packed_windows(docs, "doc_id", "n", context).collect()
    assert sum(r.targets for r in got) == sum(n - 1 for n in lengths)


def test_cycles(spark):
    rows = [(1, i, "ab"[i % 2]) for i in range(40)] + [(2, i, "a") for i in range(5)] + [(3, 0, "x")]
    got = {r.g: r for r in sequence.repetition(spark.createDataFrame(rows, "g int, i int, x string"), "g", "i", "x").collect()}
    assert got[1].has_cycle and got[1].repeat_rate == 0 and got[1].longest_cycle == 40
    assert got[2].longest_run == 5 and not got[2].has_cycle
    assert got[3].repeat_rate == 0 and got[3].longest_run == 1
