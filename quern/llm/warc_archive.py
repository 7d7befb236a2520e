"""WARC archives: writing with revisits, reading back, and a merged index of captures.

Archives are plain WARC/1.1 files made by Spark's text writer. A block never holds the line that begins a record: an
HTTP body that has it goes out in chunks cut inside it, so a reader may split a file of any size at those bytes and
every task parses whole records. Each reading task sorts its captures into a run; runs are cut at shared boundaries and
each range is merged from its runs by a loser tree, which gives one index ordered by URL key and time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, batches, new_path, stored

CRLF = "\r\n"
MARK = "WARC/1.1\r\n"
SEAM = CRLF + CRLF + MARK


def base32(hexes: Column) -> Column:
    """The 32 base32 characters of a SHA-1 in hexadecimal."""
    quads = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """A sort-friendly URL: host labels reversed, no scheme, www or fragment; null or empty: a dash."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^www\d*\.|:\d+$", ""))
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.coalesce(F.when(F.trim(url) == "", None).otherwise(key), F.lit("-"))


def judged(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to) of (page_id, url, html): where a page's payload equals that of a
    page with a smaller id and has `least` bytes or more, refers_to is the smallest such id.

    Only digests that several pages have get a row in the joined table, and only pages whose digest a Bloom filter of
    these lets through move to meet it; the others are written where they are read.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    whole = pages.select("page_id", "url", body.alias("html")).withColumns({"digest": base32(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html").cast("long")})
    fit = whole.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    shared = stored(fit.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first"), "digests")
    bloom = Bloom(shared.select(F.xxhash64("digest")))
    may = bloom.column(F.xxhash64("digest"))
    refers = F.when((F.col("size") >= least) & (F.col("page_id") > F.col("first")), F.col("first"))
    alone = whole.where(~may).withColumn("refers_to", F.lit(None).cast("long"))
    return alone.unionByName(whole.where(may).join(shared, "digest", "left").withColumn("refers_to", refers).drop("first"))


def records(judged_pages: DataFrame) -> DataFrame:
    """(value): one WARC record per row without the two line ends that close it."""
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    day = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    seam = F.col("html").contains(MARK)
    n = F.octet_length("html").cast("string")
    http = lambda how: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), how, F.lit(CRLF + CRLF))
    parts = F.split(F.col("html"), r"(?<=WA)(?=RC/1\.1\r\n)", -1)
    chunk = F.transform(parts, lambda p: F.concat(F.conv(F.octet_length(p).cast("string"), 10, 16), F.lit(CRLF), p, F.lit(CRLF)))
    block = (
        F.when(F.col("refers_to").isNotNull(), F.lit(""))
        .when(seam, F.concat(http(F.lit("Transfer-Encoding: chunked")), F.array_join(chunk, ""), F.lit("0" + CRLF + CRLF)))
        .otherwise(F.concat(http(F.concat(F.lit("Content-Length: "), n)), F.col("html")))
    )
    line = lambda name, v: F.coalesce(F.concat(F.lit(name + ": "), v, F.lit(CRLF)), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(MARK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), pid, F.lit(">"))),
        line("WARC-Date", day),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
    )
    made = judged_pages.select(head.alias("head"), block.alias("block"))
    return made.select(F.concat("head", F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF), "block").alias("value"))


def write(judged_pages: DataFrame, path: str) -> None:
    """WARC files under path, one per task."""
    records(judged_pages).write.option("lineSep", CRLF + CRLF).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, page_id, url, date, digest, size, refers_to, payload) of each record under path.

    Fails where a record's block has not the length its header names, as in archives of other writers whose blocks
    contain the beginning of a record. payload is null for revisits.
    """
    raw = spark.read.option("lineSep", SEAM).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    text = F.when(F.col("value").startswith(MARK), F.substring(F.col("value"), len(MARK) + 1, 2**31 - 1)).otherwise(F.col("value"))
    cut = raw.where("value <> ''").withColumn("text", text).withColumn("at", F.instr("text", CRLF + CRLF))
    both = cut.withColumns({"head": F.expr("concat('\r\n', left(text, at + 1))"), "rest": F.expr("substring(text, at + 4)")})
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    found = both.withColumn("length", field("Content-Length").cast("long"))
    # the last record of a file keeps the two line ends that close it
    extra = F.octet_length("rest") - F.col("length")
    found = found.withColumn("block", F.when((extra == 4) & F.col("rest").endswith(CRLF + CRLF), F.expr("left(rest, length(rest) - 4)")).otherwise(F.col("rest")))
    found = found.withColumn("block", F.when(F.octet_length("block") == F.col("length"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("WARC block of another length than its header says in "), F.col("file")))))
    http = found.withColumns({"http": F.expr("left(block, instr(block, '\r\n\r\n') + 1)"), "body": F.expr("substring(block, instr(block, '\r\n\r\n') + 4)")})
    chunked = F.col("http").contains("Transfer-Encoding: chunked")
    pid = lambda name: F.regexp_extract("head", rf"\r\n{name}: <urn:page:(\d+|-\d+)>", 1)
    return http.select(
        "file",
        field("WARC-Type").alias("type"),
        F.nullif(pid("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.to_timestamp(field("WARC-Date")).alias("date"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("WARC-Payload-Length").cast("long").alias("size"),
        F.nullif(pid("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        F.when(field("WARC-Type") == "response", F.when(chunked, dechunked(F.col("body"))).otherwise(F.col("body"))).alias("payload"),
    )


def dechunked(body: Column) -> Column:
    """The payload of a chunked body; chunk lengths are in bytes, so it is cut as binary."""
    raw = body.cast("binary")
    start = F.struct(raw.alias("left"), F.array().cast("array<binary>").alias("parts"))

    def step(s: Column, _: Column) -> Column:
        at = F.instr(F.decode(F.substring(s["left"], 1, 24), "ISO-8859-1"), CRLF)
        n = F.conv(F.decode(s["left"].substr(F.lit(1), at - 1), "ISO-8859-1"), 16, 10).cast("int")
        rest = s["left"].substr(at + 2 + n + 2, F.octet_length(s["left"]))
        part = s["left"].substr(at + 2, n)
        return F.when(F.octet_length(s["left"]) == 0, s).otherwise(F.struct(rest.alias("left"), F.concat(s["parts"], F.array(part)).alias("parts")))

    turns = F.sequence(F.lit(0), F.size(F.split(body, r"WA\r\n[0-9A-F]+\r\nRC/1")) + 1)
    parts = F.aggregate(turns, start, step, lambda s: s["parts"])
    return F.aggregate(parts, F.lit("").cast("binary"), lambda a, b: F.concat(a, b)).cast("string")


class LoserTree:
    """Merges k sorted lists; each take replays one path of the tree, log2(k) comparisons."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(len(runs)):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        if self.at[a] >= len(x):
            return False
        if self.at[b] >= len(y):
            return True
        p, q = x[self.at[a]], y[self.at[b]]
        return p < q or (p == q and a < b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.runs:
            w = self.winner
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


INDEX = "url_key string, date timestamp, page_id long, type string, digest string, size long, refers_to long, file string"


def capture_index(captures: DataFrame, target: int = 50_000) -> DataFrame:
    """Captures in ranges by (url_key, date, page_id), each range merged from the sorted runs of the reading tasks.

    A run is one reading task's captures in order; a shuffle may hand over the parts of a run in any order, so they are put
    in order again where a range is read. Ranges are cut on all three keys, so captures of one URL, however
    many, are dealt to several ranges; a range has about `target` captures, which is what a task holds at a time.
    """
    keys = ["url_key", "date", "page_id"]
    runs = stored(captures.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*keys), "runs")
    ranges = max(1, -(-runs.count() // target))
    schema = pa.schema([("url_key", pa.string()), ("date", pa.timestamp("us", tz="UTC")), ("page_id", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("refers_to", pa.int64()), ("file", pa.string())])
    names = [f.name for f in schema]

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in it:
            for run, *row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("run", *names)), strict=True):
                held.setdefault(run, []).append(((row[0], row[1] is not None, row[1], row[2] is not None, row[2]), row))
        lists = []
        for run in sorted(held):
            lists.append([_Entry(_Key(k), r) for k, r in held[run]])
        return batches(schema, (tuple(e.row) for e in LoserTree(lists)), 4096)

    return runs.repartitionByRange(ranges, *keys).sortWithinPartitions("run", *keys).select("run", *names).mapInArrow(merged, INDEX)


class _Key(tuple):
    """Sorts nulls first, as Spark does."""

    __slots__ = ()

    def __lt__(self, other: tuple) -> bool:
        for a, b in zip(self, other, strict=True):
            if a != b:
                return a is None or (b is not None and a < b)
        return False


class _Entry:
    __slots__ = ("key", "row")

    def __init__(self, key: _Key, row: list) -> None:
        self.key, self.row = key, row

    def __lt__(self, other: _Entry) -> bool:
        return self.key < other.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Entry) and self.key == other.key


def archived(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The capture index of pages written as WARC records and read back, every payload checked against its digest.

    Null html is an empty payload. Among rows with equal payloads those with the smallest id are responses and the
    others revisits; a row with a null id is a response and is referred to by none. Null urls have no target line
    and sort under a dash. The date of a record is made of its id modulo 2 to the 31st, in seconds, so any id has one. Other columns are not looked at.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    path = new_path(spark, "warc")
    write(judged(own, least), path)
    back = read(spark, path)
    same = (F.col("payload").isNull()) | ((base32(F.sha1(F.col("payload").cast("binary"))) == F.col("digest")) & (F.octet_length("payload") == F.col("size")))
    checked = back.withColumn("digest", F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))
    captures = checked.select(url_key(F.col("url")).alias("url_key"), "date", "page_id", "type", "digest", "size", "refers_to", "file")
    return capture_index(captures)
