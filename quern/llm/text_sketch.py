"""Document fingerprints: an invertible Bloom lookup table of a text's paragraphs.

A paragraph is a line, or the part of a line up to a word whose hash ends it, so edits stay local. Each paragraph
digest goes into three cells of (count, sum of digests, sum of checks). Tables of two texts subtract cell by cell, and
peeling the difference gives the digests in which the texts differ; where it fails, larger tables are made of the texts
until it doesn't. Whole batches of tables are peeled together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WordHashes, batches, mixed, partitions

#: Cells of a published fingerprint; a third of them for each of the three hash functions.
CELLS = 24
GROWTH = 4
_NEWLINE = b"\n"


def digests(text: str, memo: WordHashes) -> np.ndarray:
    """Distinct digests of the paragraphs of a whole text; a repeated paragraph gets one for each occurrence."""
    if not text:
        return np.zeros(0, U)
    parts = text.encode("utf-8", "surrogatepass").replace(b"\n", b" \n ").split(b" ")
    h = memo.of(parts)
    ends = (h & U(7)) == 0
    ends |= h == U(memo[_NEWLINE])
    ends[-1] = True
    at = np.flatnonzero(ends)
    starts = np.concatenate(([0], at[:-1] + 1))
    place = np.arange(len(h)) - np.repeat(starts, at - starts + 1)
    values = np.add.reduceat(mixed(h ^ mixed(place.astype(U) + U(1))), starts)
    values = np.sort(mixed(values + (at - starts).astype(U)))
    first = np.concatenate(([True], values[1:] != values[:-1]))
    run = np.arange(len(values)) - np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    return mixed(values + run.astype(U) * U(0x9E3779B97F4A7C15))


def _cells(keys: np.ndarray, tables: np.ndarray, size: int, salt: int) -> np.ndarray:
    """The three cells of each key in its table; tables of `size` cells lie one after another."""
    third = size // 3
    h = mixed(mixed(keys ^ U(0xA5A5A5A5A5A5A5A5)) + U(salt)) if salt else mixed(keys ^ U(0xA5A5A5A5A5A5A5A5))
    if third >= 1 << 20:  # 21 bits would not reach all cells
        return np.stack([tables * size + j * third + (mixed(h + U(j)) % U(third)).astype(np.int64) for j in range(3)])
    return np.stack([tables * size + j * third + ((h >> U(21 * j)) & U(0x1FFFFF)).astype(np.int64) % third for j in range(3)])


@dataclass
class Tables:
    """n tables of `size` cells each; the salt deals the same keys to other cells."""

    size: int
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray
    salt: int = 0

    @classmethod
    def empty(cls, n: int, size: int, salt: int = 0) -> Tables:
        return cls(size, np.zeros(n * size, np.int32), np.zeros(n * size, U), np.zeros(n * size, U), salt)

    def add(self, keys: np.ndarray, tables: np.ndarray, signs: np.ndarray) -> None:
        """Adds keys (sign 1) or takes them out (sign -1)."""
        at = _cells(keys, tables, self.size, self.salt).reshape(-1)
        wrap = signs.astype(np.int64).view(U)
        order = np.argsort(at, kind="stable")
        cells = at[order]
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        if not len(starts):
            return
        where = cells[starts]
        for out, values in ((self.key, keys * wrap), (self.check, mixed(keys) * wrap)):
            out[where] += np.add.reduceat(np.tile(values, 3)[order], starts)
        self.count[where] += np.add.reduceat(np.tile(signs.astype(np.int32), 3)[order], starts)

    def peeled(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The keys that came out, the table and the sign of each, and for each table whether nothing is left in it."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.count)
        while len(look):
            sign = self.count[look]
            one = look[np.abs(sign) == 1]
            s = self.count[one].astype(np.int64).view(U)
            keys = self.key[one] * s
            good = self.check[one] == mixed(keys) * s
            one, keys = one[good], keys[good]
            if not len(one):
                break
            tables = one // self.size
            _, first = np.unique(keys ^ mixed(tables.astype(U) + U(1)), return_index=True)
            keys, tables, signs = keys[first], tables[first], self.count[one[first]]
            out.append((keys, tables, signs))
            self.add(keys, tables, -signs)
            look = np.unique(_cells(keys, tables, self.size, self.salt))
            look = look[self.count[look] != 0]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        keys, tables, signs = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in enumerate((U, np.int64, np.int32)))
        return keys, tables, signs, ~left.reshape(n, self.size).any(axis=1)

    def text(self, table: int) -> str:
        """A table as text; equal tables have equal texts."""
        own = slice(table * self.size, (table + 1) * self.size)
        raw = self.count[own].astype("<i4").tobytes() + self.key[own].astype("<u8").tobytes() + self.check[own].astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(sets) if sets else np.zeros(0, U)
    return keys, np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def published(sets: list[np.ndarray]) -> list[str]:
    """The fingerprint of each set of digests."""
    made = Tables.empty(len(sets), CELLS)
    keys, tables = _flat(sets)
    made.add(keys, tables, np.ones(len(keys), np.int64))
    return [made.text(i) for i in range(len(sets))]


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, number of the pair, sign): 1 for what only the first set of a pair holds, -1 for the second.

    Tables of both are subtracted and peeled: first of the published size, then, for pairs that fail, ever larger ones
    with another deal of the digests to the cells, until none is left.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    todo, size, salt = np.arange(len(a)), CELLS, 0
    while len(todo):
        later = []
        step = max(1, (1 << 19) // size)
        for start in range(0, len(todo), step):
            part = todo[start : start + step]
            made = Tables.empty(len(part), size, salt)
            for sets, sign in ((a, 1), (b, -1)):
                keys, tables = _flat([sets[i] for i in part])
                made.add(keys, tables, np.full(len(keys), sign))
            keys, tables, signs, done = made.peeled(len(part))
            whole = done[tables]
            found.append((keys[whole], part[tables[whole]], signs[whole]))
            later.append(part[~done])
        todo, salt = np.concatenate(later), salt + 1
        most = max((len(a[i]) + len(b[i]) for i in todo), default=0)
        size = min(size * GROWTH, 3 * max(CELLS, most))  # with three cells a digest nearly every deal succeeds
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of sets twice the number they share over the sum of their sizes; 1 for two empty ones."""
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    _, pair, _ = differences(a, b)
    return np.where(sizes > 0, 1 - np.bincount(pair, minlength=len(a)) / np.maximum(sizes, 1), 1.0)


FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _rows(pairs: list[tuple], memo: WordHashes) -> Iterator[tuple]:
    """Result rows of (id, text, following text)."""
    changed = [edited(t, f) for _, t, f in pairs]
    own, new = ([digests(x, memo) for x in xs] for xs in ([p[1] for p in pairs], changed))
    after = [own[k + 1] if k + 1 < len(pairs) and pairs[k + 1][1] is p[2] else digests(p[2], memo) for k, p in enumerate(pairs)]
    prints, changed_prints = published(own), published(new)
    near_edited, near_next = likeness(own, new), likeness(own, after)
    for k, (i, text, _) in enumerate(pairs):
        sha = hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest()
        yield i, len(text), sha, prints[k], changed_prints[k], float(near_edited[k]), float(near_next[k])


def _followed(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, following text) of rows (part, tail, id, text) sorted by part, tail, order; tails end their part."""
    held, part, over = None, None, False
    for b in it:
        for p, tail, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = text or ""
            if p != part:
                part, held, over = p, None, False
            if held is not None and not over:
                yield (*held, text)
            over = over or tail
            if not tail:
                held = (i, text)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_mb: int = 2) -> DataFrame:
    """A row per document, the next document being that of the next larger id, after the last one the first.

    Null texts are empty; an empty text has an empty table. Rows of one id follow one another by a hash of their
    texts, rows with a null id come last. A single row is its own next. Other columns are not looked at. Texts move
    once, to range partitions by id; the first row of a range goes to the range before it too. The driver gets the
    boundaries of the ranges alone.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = 4 * partitions(spark)
    cuts = np.array(sorted(set(own.where("id is not null").approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (8 * parts)))), np.int64)
    nowhere = len(cuts) + 1

    def part_of(x: pa.Array) -> np.ndarray:
        places = np.searchsorted(cuts, x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), side="right")
        return np.where(x.is_valid().to_numpy(zero_copy_only=False), places, nowhere)

    @F.arrow_udf("int")
    def part(x: pa.Array) -> pa.Array:
        return pa.array(part_of(x), pa.int32())

    firsts = sorted((r["p"], r["least"]) for r in own.select("id", part("id").alias("p")).groupBy("p").agg(F.min("id").alias("least")).collect())
    goes: dict = {}
    for k, (_, least) in enumerate(firsts):
        goes.setdefault(least, []).append(firsts[k - 1][0])

    @F.arrow_udf("array<struct<part:int,tail:boolean>>")
    def places(x: pa.Array) -> pa.Array:
        out = [[{"part": int(p), "tail": False}, *({"part": q, "tail": True} for q in goes.get(i, ()))] for i, p in zip(x.to_pylist(), part_of(x), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("tail", pa.bool_())])))

    dealt = own.withColumn("to", F.explode(places("id"))).select("to.part", "to.tail", "id", "text")
    order = ["part", "tail", "id", F.xxhash64("text")]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for pair in _followed(it):
                held.append(pair)
                size += len(pair[1])
                if size > piece_mb << 20 or len(held) >= 1000:
                    yield from _rows(held, memo)
                    held, size = [], 0
            if held:
                yield from _rows(held, memo)

        return batches(schema, rows(), 512)

    return dealt.repartition(partitions(spark), "part").sortWithinPartitions(*order).select("part", "tail", "id", "text").mapInArrow(run, FOUND)
