"""What the operators share: tables in the shared folder, words, hashes, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a per-worker memo of words; at the limit it is emptied, so memory stays bounded.
MEMO = 250_000
#: Bytes of texts in an Arrow batch; a task holds several batches at a time, on both sides.
BATCH = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local master may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths under the shared folder that this process wrote and has not deleted.
_WRITTEN: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def cleared(spark: SparkSession) -> None:
    """Deletes all that the operators still hold in the shared folder; results not yet read or written are lost with it."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            own = next((p for p in _WRITTEN if p.rpartition("/")[2] in file), None)
            if own:
                _WRITTEN.discard(own)
                _delete(df.sparkSession, own)


def free(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_small_batches(texts: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are bounded by BATCH from here on, unless it has a bound of its own."""
    conf = texts.sparkSession.conf
    if _BATCH_CONF not in conf.getAll:
        conf.set(_BATCH_CONF, str(BATCH))
    return texts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(schema, held)
            held = []
    if held:
        yield batch(schema, held)


def cut(texts: Iterator[tuple[object, bytes]], places: bytes, size: int = 1 << 17) -> Iterator[list[tuple[object, int, bytes]]]:
    """Groups of (key, number of the piece, piece) of about `size` bytes; texts longer than that are cut before a byte of `places` that follows another byte."""
    place = re.compile(rb"(?<![%s])[%s]" % (places, places)) if places else None
    held, total = [], 0
    for key, text in texts:
        begin = number = 0
        while True:
            found = place.search(text, begin + size) if place else None
            end = found.start() if found else len(text)
            held.append((key, number, text[begin:end]))
            total += end - begin + 64
            begin, number = end, number + 1
            if total >= size:
                yield held
                held, total = [], 0
            if begin >= len(text):
                break
    if held:
        yield held


class Grown:
    """An array that is added to at its end."""

    def __init__(self, dtype: type) -> None:
        self.all, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all, np.zeros_like(self.all)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)


_RNG = np.random.default_rng(20_240_229)
_BYTES = _RNG.integers(1, 1 << 63, (2, 256)).astype(U)
_BASE = [int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2)]


class _Powers:
    """base ** i and its inverse modulo 2 ** 64, by i; grown as longer arrays come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASE]


def segment_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each segment of a byte array: differences of running sums of byte values times
    powers, set back to the segment's start. Segments over 64 bytes are hashed whole."""
    out = []
    long_ones = np.flatnonzero(ends - starts > 64)
    for which in (0, 1):
        up, down = _POWERS[which].upto(len(flat) + 1)
        run = np.zeros(len(flat) + 1, U)
        np.cumsum(_BYTES[which][flat] * up[:-1], out=run[1:])
        out.append(mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U)))
    for k in long_ones.tolist():
        h = xxhash.xxh3_128_intdigest(flat[starts[k] : ends[k]].tobytes())
        out[0][k], out[1][k] = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return out[0], out[1]


class ChunkMemo:
    """Numbers of byte strings met before, in a table of bounded size that is emptied when full.

    A string is known by 128 bits of hashes. learn() gets the new strings of a call and keeps a row for each.
    """

    BITS = 21

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.first, self.second = Grown(U), Grown(U)

    def learn(self, strings: list[bytes]) -> None:
        raise NotImplementedError

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, out, todo = (a >> U(64 - self.BITS)).astype(np.int64), np.full(len(a), -1, np.int32), np.arange(len(a))
        while len(todo):
            s = self.slots[at[todo]]
            hit = (s >= 0) & (self.first.all[s] == a[todo]) & (self.second.all[s] == b[todo])
            out[todo[hit]] = s[hit]
            todo = todo[(s >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out

    def _put(self, a: np.ndarray, b: np.ndarray) -> None:
        n = self.first.n
        self.first.add(a)
        self.second.add(b)
        at, todo = (a >> U(64 - self.BITS)).astype(np.int64), np.arange(len(a))
        while len(todo):
            free = self.slots[at[todo]] < 0
            self.slots[at[todo[free]]] = n + todo[free]
            todo = todo[self.slots[at[todo]] != n + todo]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)

    def numbers(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each segment [start, end); valid until the next call."""
        a, b = segment_hashes(flat, starts, ends)
        out = self._find(a, b)
        new = np.flatnonzero(out < 0)
        while len(new):
            _, where = np.unique(a[new] ^ mixed(b[new]), return_index=True)
            if len(new) < len(a) and self.first.n + len(where) > 1 << (self.BITS - 2):
                self.reset()
                new = np.arange(len(a))
                continue
            while self.first.n + len(where) > len(self.slots) // 2:
                self._widen()
            own = new[where]
            raw = flat.tobytes()
            self.learn([raw[i:j] for i, j in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            self._put(a[own], b[own])
            out[new] = self._find(a[new], b[new])
            new = np.flatnonzero(out < 0)
        return out

    def _widen(self) -> None:
        """A table for a call with more new strings than fit, twice as large."""
        a, b, n = self.first, self.second, self.first.n
        self.slots = np.full(2 * len(self.slots), -1, np.int32)
        self.first, self.second = Grown(U), Grown(U)
        if n:
            self._put(a.all[:n], b.all[:n])


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs [start, start + length) of an array, one after another."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.lower and bytes.split mean exactly that."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    return x * U(0xD6E8FEB86659FD93)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence is one, without words there is none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    x = mixed(hashes[:m] + U(n))
    for i in range(1, n):
        x = mixed(x ^ hashes[i : i + m]) + U(i)
    return np.unique(x)


class Bloom:
    """A set of longs in a bit array of at most 8 MB: it may hold more than was put in, never less.

    The array is made in slices by the shuffle, so nothing that grows with the ids reaches one task; the driver gets the
    array. For more ids than it can tell apart there is no array and all pass: what is behind the filter must be
    right, and bounded in what it moves, without it.
    """

    MOST = 1 << 26
    SLICES = 64

    def __init__(self, ids: DataFrame) -> None:
        """ids: one long column, read twice."""
        n, slices = ids.count(), self.SLICES
        size = 1 << 16
        while size < 12 * n:
            size *= 2
        self.size = size
        self.bits = None
        if size > self.MOST:
            return
        own = size // slices

        def marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                at = np.unique(np.concatenate(self.places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array((at // own).astype(np.int32)), pa.array((at % own).astype(np.int32))], names=["slice", "bit"])

        def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for b in it:
                k, bit = (b.column(i).to_numpy() for i in (0, 1))
                for one in np.unique(k).tolist():
                    found.setdefault(one, np.zeros(own, np.uint8))[bit[k == one]] = 1
            yield _slices(list(found), [np.packbits(x) for x in found.values()])

        rows = ids.mapInArrow(marks, "slice int, bit int").repartition(8, "slice").mapInArrow(total, "slice int, bits binary").collect()
        packed = np.zeros((slices, own // 8), np.uint8)
        for r in rows:
            packed[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = packed.reshape(-1)

    def places(self, ids: np.ndarray) -> list[np.ndarray]:
        h = mixed(ids.view(U) + U(1))
        return [((h >> U(s)) & U(self.size - 1)).astype(np.int64) for s in (0, 20, 38)]

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in self.places(ids) if self.bits is not None else ():
            out &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out

    def column(self, ids: Column) -> Column:
        """Whether the set may hold an id; false for null."""
        if self.bits is None:
            return ids.isNotNull()

        @F.arrow_udf("boolean")
        def of(x: pa.Array) -> pa.Array:
            found = self.has(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            return pa.array(found & x.is_valid().to_numpy(zero_copy_only=False))

        return of(ids)


def _slices(keys, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["slice", "bits"])


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row. A null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), the component being its smallest node.

    Alternates large-star and small-star steps; each round is a table in the shared folder. Only a row count and
    a checksum of each round reach the driver.
    """

    spark = edges.sparkSession
    salts = 4 * partitions(spark)

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame) -> DataFrame:
        """(u, v, m): m is the least v of u. The rows of one u are dealt to `salts` keys by v, for the join too."""
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        least = dealt.groupBy("u", "salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("s"))
        return dealt.join(least.select("u", "m", F.explode("s").alias("salt")), ["u", "salt"]).select("u", "v", "m")

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = sign(now)
    while seen[0]:
        both = now.union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        new = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), name)
        was, seen = seen, sign(new)
        dropped(now)
        now = new
        if was == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
