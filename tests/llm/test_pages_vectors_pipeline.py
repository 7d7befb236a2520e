from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import exact_topk, html_main_text, warc_archive

MARK = "\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "http://www.a.org/x?q#f", "plain"), (2, "https://b.a.org", "plain"), (3, None, None), (4, "", ""), (5, "http://a.org/y z", f"x{MARK}é{MARK}{MARK[4:]}"),
    (6, "http://a.org/", MARK * 3), (7, "http://a.org/", "\r\n\r\n"), (8, "u", "WARC/1.1\r\n"), (9, "u", "\r\nWARC/1.1\r\n\r\nWARC/1.1\r\n"), (None, "u", "plain"), (2, "https://b.a.org", "plain"),
    *((k, f"http://h{k % 3}.com/p", "same") for k in range(100, 140)), *((k, "http://big.com/", f"id {k % 7}") for k in (-(10**12), 10**12, 5 * 10**18, -(2**63), 2**63 - 1, 2**31)),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int").repartition(4)
    got = warc_archive.archived(pages, least).collect()
    first: dict = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        refers = first[h or ""] if i is not None and len(body) >= least and i > first[h or ""] else None
        expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(((r.page_id, r.size, r.digest, r.type, r.refers_to) for r in got), key=str) == sorted(expected, key=str)
    keys = [(r.url_key, r.date) for r in got]
    assert keys == sorted(keys), "captures come in the order of the merged index"
    assert warc_archive.archived(pages.where("false")).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc_archive.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("http://www.B.a.org:80/p?x=1#t",), ("",), (None,), ("a.org",)], "u string")
    assert [r[0] for r in rows.select(warc_archive.url_key(F.col("u"))).collect()] == ["org,a,b)/p?x=1", "-", "-", "org,a)/"]


LONG = "It is the story of a man and of the sea that was there for all of us to see in the morning. " * 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One<br>two\n three<p>Four</article><footer>&copy; x</footer>", "T & U\nOne two three\nFour"),
        (f"<div class='sidebar'>{LONG}</div><p>{LONG}</p><div id=comments><p>{LONG}</p></div>", LONG.strip()),
        (f"<p>{LONG}</p><h2>Head</h2><p>{LONG}</p><p>Home</p>", f"{LONG.strip()}\nHead\n{LONG.strip()}"),
        (f"<article><script>var a='</p><p>{LONG}';</script><p>Kept.</p><aside>{LONG}</aside><form>q</form></article>", "Kept."),
        (f"<p><a href=x>{LONG}</a></p>", ""),
        ("<article><p>cut &lt;b&gt; <b", "cut <b>"),
        ("<article><!-- <p>no</p> --><p>yes &#233;&nbsp;é", "yes é é"),
    ],
)
def test_main_text(html, text):
    assert html_main_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [(f"<article><p>First.</p><{n}><p>Second.</p></article>", "First.\nSecond.") for n in ("object", "button", "select", "svg", "canvas", "audio", "video")]
    + [("<article><p>First.</p><script><p>Second.</p></article>", "First."), ("<article><p>So <math><mi>x</mi></math> holds.</p></article>", "So x holds."), ("<article><p>A <svg>no</svg> b.</p></article>", "A b.")],
)
def test_unclosed_elements_lose_no_text(html, text):
    assert html_main_text.main_text(html) == text


JAPANESE = "これは長い日本語の段落です。海と人の物語であり、朝に見るためのものです。" * 6
RUSSIAN = "Это длинный абзац на русском языке о море и человеке, который вышел утром. " * 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<main class="content has-sidebar"><p>{LONG}</p></main>', LONG), (f'<div class="page with-cookie-notice"><article><p>{LONG}</p></article></div>', LONG),
        (f'<div class="ad-free"><p>{LONG}</p></div>', LONG), (f'<section id="social-history"><p>{LONG}</p></section>', LONG),
        (f"<p>{JAPANESE}</p>", JAPANESE), (f"<p>{RUSSIAN}</p>", RUSSIAN), (f"<article><p>{LONG}<a href=x>{LONG[:150]}</a></p></article>", f"{LONG}{LONG[:150]}"),
        (f'<div class="cookie-banner"><p>{LONG}</p></div><div id="site-footer">x</div><p>{LONG}</p>', LONG),
        (f'<article><p>{LONG}</p><p>Short end.</p></article><div id="comments"><article class="comment"><p>{LONG}</p></article></div>', f"{LONG.strip()}\nShort end."),
        (f"<article><p>{LONG}</p><h3>More</h3><ul><li><a href=x>{LONG}</a></li></ul></article>", LONG),
        (f"<p><a href=x>{LONG}</a></p><h2>Title</h2><p>{LONG}</p><p>{LONG[:100]}</p><p><a href=x>{LONG}</a></p>", f"Title\n{LONG.strip()}\n{LONG[:100].strip()}"),
        ("<article><p>Only this.</p></article><footer>y</footer>", "Only this."), ("<p>Home</p>", ""),
    ],
)
def test_rules_decide(html, text):
    assert html_main_text.main_text(html) == text.strip()


@pytest.mark.parametrize("mark", ['<a "', '<a ">', "</script", "<script>", "<a '\"", "<div>", "</section><div>", "<!--", "<", '<a href="x', "<b>x</b>", "&amp", "<article><p>x"])
def test_time_grows_with_the_page(mark):
    import time

    began = time.process_time()
    html_main_text.main_text(mark * (1_000_000 // len(mark)))
    assert time.process_time() - began < 10, "seconds at most, where a search that begins anew each time takes hours"


def test_tags_equal_the_parser_of_the_standard_library():
    """A second, plain reading of tags on pages of well-formed and broken marks."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found.append((tag, False))

        def handle_endtag(self, tag):
            self.found.append((tag, True))

    rng = random.Random(8)
    signs = ["<p>", "</p>", "<a href='x>y'>", '<a title="a > b" x>', "text ", "&amp;", "<!-- <b> -->", "<DIV Class=x>", "</div >", "<br/>", "<!doctype html>", "1 < 2 "]
    for _ in range(300):
        html = "".join(rng.choice(signs) for _ in range(20))
        plain = Plain()
        plain.feed(html)
        plain.close()
        got = [(name, closing) for _, _, name, closing, _ in html_main_text.tags(html) if name]
        assert [g for g in got if g[0] != "br"] == [f for f in plain.found if f[0] != "br"], html


def test_most_blocks_are_decided_by_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    total = sum((html_main_text.decisions(r.html) for r in pages), Counter())
    assert total["first pass"] + total["second pass"] > total["markup"]


def test_extracted_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a é", 5), (None, None, None, 5), (1, "u", "<article><p>a é", 5)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_main_text.extracted(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a é", 3), (None, None, "", 0), (1, "u", "a é", 3)], key=str)
    assert html_main_text.extracted(pages.where("false")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(0, 1, 16).round(1).tolist() if i % 3 else [0.5] * 16) for i in range(600)]
    rows += [(600, None), (620, [None] * 16), (640, [float("nan")] * 16), (660, [float("inf")] * 16), (None, [1.0] * 16), (680, [5.0] * 3), (40, [1.0] * 16), (700, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    good = [(i, np.pad(np.floor(64 * np.array(v, float)), (0, 16 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:20]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    saved = exact_topk.BLOCK, exact_topk.RANGE, exact_topk.GROUP, exact_topk.LIMITS
    exact_topk.BLOCK, exact_topk.RANGE, exact_topk.GROUP, exact_topk.LIMITS = 16, 64, 8, 3
    try:
        got = exact_topk.top_k(df).collect()
    finally:
        exact_topk.BLOCK, exact_topk.RANGE, exact_topk.GROUP, exact_topk.LIMITS = saved
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert exact_topk.top_k(df.where("false")).count() == 0


def test_blocks_below_the_kth_score_are_left_out():
    ids = np.arange(64 * exact_topk.BLOCK // 16)
    x = np.ones((len(ids), 4), np.float32)
    x[exact_topk.BLOCK :] = -1
    who, found, scores, visited = exact_topk.pruned(np.array([-1]), np.ones((1, 4), np.float32), ids, x, 5, np.full(1, -np.inf), np.full(1, 1 << 62))
    assert visited == 1 and found.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [4] * 5


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == docs.columns, name
        assert out.exceptAll(rows).count() == 0, name
        rows = out
    packed = pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows.select("doc_id").collect()}
    odd = docs.limit(5).union(spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "s", 0)], docs.schema))
    for _, stage in pipeline.STAGES:
        stage(spark, odd, sf).collect()


def test_pipeline_keeps_clean_documents(spark):
    """At the scale where the classifiers have a few dozen examples of each label."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    left = pipeline.toxic(spark, pipeline.quality(spark, docs, sf), sf).select("doc_id").join(labels, "doc_id")
    count = lambda df, where: df.where(where).count()
    assert count(left, "quality = 1 AND toxic = 0") >= 0.99 * count(labels, "quality = 1 AND toxic = 0")
    assert count(left, "quality = 0 OR toxic = 1") <= 0.1 * count(labels, "quality = 0 OR toxic = 1")
