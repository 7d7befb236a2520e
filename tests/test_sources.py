from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import checks
from quern.sources import readers, sinks
from quern.streaming import incremental


def test_json_lines_are_numbered_without_blanks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n\n{"text": "y"}\n', encoding="utf-8")
    got = readers.json_lines(spark, str(tmp_path), "text string").orderBy("row").collect()
    assert [(r.row, r.text) for r in got] == [(0, "x"), (1, "y")]
    (tmp_path / "b.jsonl").write_text("not an object\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path), "text string").collect()


def test_dictionaries(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\nU+6797\tkRS\t75.4\nU+6797\tkRS\t1.1\n", encoding="utf-8")
    assert [tuple(r) for r in readers.code_points(spark, str(tmp_path / "u.txt")).collect()] == [(0x6797, "kRS", "75.4")]
    (tmp_path / "i.txt").write_text("U+6797\t林\t⿰木木;x\nU+6797\t林\t⿱木木\n", encoding="utf-8")
    assert [tuple(r) for r in readers.decompositions(spark, str(tmp_path / "i.txt")).collect()] == [("林", "⿰木木")]


def test_pinned_files(spark, tmp_path):
    path = tmp_path / "c.json"
    sinks.atomic_json(str(path), {"files": [{"path": "a", "size": 1, "sha256": "x"}, {"path": "b", "size": 2, "sha256": "y"}]})
    assert [r.path for r in readers.pinned_files(spark, str(path), "1").collect()] == ["b"]
    with pytest.raises(ValueError, match="distinct"):
        readers.pinned_files(spark, str(path), "1,1")
    assert json.loads(path.read_text())["files"][0]["path"] == "a"


@pytest.mark.parametrize("bad", ["/etc/x", "../x", "a/../../b"])
def test_unsafe_paths(bad):
    with pytest.raises(ValueError, match="unsafe"):
        readers.safe_path(bad, {}, "d")


def test_transcription(spark):
    inventory = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "label string, bits long")
    tiles = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 9)], "sample int, position int, bits long")
    got = readers.transcribed(tiles, readers.bitmap_labels(inventory, F.col("bits"))).collect()
    assert [tuple(r) for r in got] == [(0, "[a/b]c□")]


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{n}</ns><id>{i}</id>{r}<revision><id>9</id><text xml:space=\"preserve\">body {i}</text></revision></page>"
    text = "<mediawiki>" + page.format(t="A", n=0, i=1, r="") + page.format(t="B", n=1, i=2, r="") + page.format(t="C", n=0, i=3, r='<redirect title="A"/>') + "</mediawiki>"
    (tmp_path / "w.xml").write_text(text, encoding="utf-8")
    assert [tuple(r) for r in readers.wiki_xml(spark, str(tmp_path / "w.xml")).collect()] == [(1, 9, "A", "body 1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "train", [1, 300, 2]), (2, "y", "test", [1, 2])], "doc_id long, text string, split string, tokens array<int>")
    sinks.splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.token_stream(df, str(tmp_path / "t"), "doc_id", "tokens", 2)
    got = spark.read.parquet(str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [(r.offset, bytes(r.stream)) for r in got] == [(0, b"\x01\x00\x2c\x01\x02\x00"), (3, b"\x01\x00\x02\x00")]


def test_batches_are_applied_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "doc_id long, text string"
    for k, rows in enumerate(([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.first_copies(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == k + 1
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 5]


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    own = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed(own, late="1000 days").writeStream.format("memory").queryName("quern_w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r.event_type, r.start, r.n) for r in df.collect())
    assert rows(spark.table("quern_w")) == rows(incremental.windowed(events))
    assert incremental.sessions(events).count() > 0 and incremental.once(events).count() == events.count()


def test_resumed_identity():
    a = {"seed": 1, "code_sha256": "x"}
    assert incremental.identity_guard(a, dict(a))["history"] == []
    with pytest.raises(ValueError, match="code has changed"):
        incremental.identity_guard(a, a | {"code_sha256": "y"})
    assert incremental.identity_guard(a, a | {"code_sha256": "y"}, "y")["history"] == ["x"]
    with pytest.raises(ValueError, match="seed"):
        incremental.identity_guard(a, a | {"seed": 2})


def test_configurations_and_progress(spark):
    df = spark.createDataFrame([("a", '{"x": "1", "m": {"y": "2"}}'), ("b", '{"x": "3", "m": {"y": "2"}}')], "k string, j string")
    flat = checks.flat_config(df, "k", "j")
    one, two = (flat.where(f"k = '{k}'").drop("k") for k in "ab")
    assert [tuple(r) for r in checks.config_changes(one, two, []).collect()] == [("x", "different")]
    assert checks.config_changes(one, two, ["x"]).count() == 0
    log = spark.sql("SELECT * FROM VALUES ('r', TIMESTAMP '2026-01-01 00:00:00', 10L), ('r', TIMESTAMP '2026-01-01 02:00:00', 30L) AS t(run, at, done)")
    last = checks.progress(log, "run", "at", "done", 100).orderBy(F.desc("at")).first()
    assert (last.delta, last.rate, last.percent, last.eta_hours) == (20, 10.0, 30.0, 7.0)


def test_partly_covered_runs_are_errors(spark):
    base = spark.createDataFrame([(1, 2), (2, 2)], "run long, parent_count int")
    whole = spark.createDataFrame([(1,), (1,)], "run long")
    assert [r.run for r in checks.replaced(base, whole, base.where("false"), "run").collect()] == [2]
    with pytest.raises(Exception, match="partly covered"):
        checks.replaced(base, whole.limit(1), base.where("false"), "run").collect()
