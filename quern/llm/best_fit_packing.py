"""Packing of tokenized documents into sequences by best-two-fit.

What a plan needs of the corpus is how many pieces there are of each length, at most `capacity` numbers. The plan is
a list of patterns (the lengths in one sequence, and how many sequences look like that), so its size depends on the
number of lengths and not on the number of documents; pieces then look up their place by their rank among the
pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ChunkMemo, Grown, batches, cut, gathered, in_small_batches, partitions, stored


#: Letters and then a run of these are two tokens' worth to the tokenizer.
MARKS = b".,;:!?#$%&*|"
#: Closes a word in WordPairs; no word of letters holds it.
CLOSE = "\0"
_LOWER = bytes(range(256)).lower()
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \n\t\r\f\v")] = _SPACE
_KIND[[*b"abcdefghijklmnopqrstuvwxyz", 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[list(MARKS)] = _MARK


class WordPairs:
    """The tokenizer's byte pairs for lower-case words of letters, many words a call.

    The vocabulary is read as ranks, with CLOSE for the mark of a word's end, which is what the second library takes.
    """

    def __init__(self, tokenizer_path: str) -> None:
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        suffix, ranks = model["end_of_word_suffix"], {}
        for piece, number in model["vocab"].items():
            body = piece.removesuffix(suffix)
            if all(c in byte for c in body):
                ranks[bytes(map(byte.__getitem__, body)) + CLOSE.encode() * (body != piece)] = number
        self.encoding = tiktoken.Encoding("words", pat_str=rf"[^{CLOSE}]*{CLOSE}", mergeable_ranks=ranks, special_tokens={})
        self.closing = np.zeros(max(ranks.values()) + 1, bool)
        self.closing[[n for piece, n in ranks.items() if piece.endswith(CLOSE.encode())]] = True

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        ids = self.encoding.encode_to_numpy(CLOSE.join([*words, ""]))
        return ids, np.diff(np.flatnonzero(self.closing[ids]), prepend=-1)


class ChunkIds(ChunkMemo):
    """Token ids of texts: those of their chunks, remembered.

    The tokenizer drops white space and no token crosses it, so chunks end there. Letters of Latin-1 before closing
    marks are chunks apart. A-Z count as a-z, as to the tokenizer, but for texts with the beginning of a special token.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.pairs = WordPairs(tokenizer_path)
        super().__init__()

    def reset(self) -> None:
        super().reset()
        self.ids, self.starts, self.lengths = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def keep(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts.add(self.ids.n + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.ids.add(ids)

    def learn(self, strings: list[bytes]) -> None:
        words = [x.decode() for x in strings]
        asked = [k for k, w in enumerate(words) if not (w.isalpha() and (w.isascii() or max(w) < "\u0100"))]
        other = set(asked)
        plain, counts = self.pairs.of([w.lower() for k, w in enumerate(words) if k not in other])
        if not asked:
            self.keep(plain, counts)
            return
        found = self.ask([words[k] for k in asked])
        lengths = np.zeros(len(words), np.int64)
        lengths[asked] = list(map(len, found))
        lengths[np.setdiff1d(np.arange(len(words)), asked)] = counts
        mine = np.zeros(len(words), bool)
        mine[asked] = True
        ids = np.empty(int(lengths.sum()), np.uint32)
        which = np.repeat(mine, lengths)
        ids[which] = np.concatenate(found)
        ids[~which] = plain
        self.keep(ids, lengths)

    def ask(self, chunks: list[str]) -> list[np.ndarray]:
        out = []
        for start in range(0, len(chunks), 10_000):
            part = chunks[start : start + 10_000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            at = np.fromiter((o[0] for o in e.offsets), np.int64)
            out += np.split(np.array(e.ids, np.uint32), np.searchsorted(at, np.cumsum([len(c) + 1 for c in part]))[:-1])
        return out

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit."""
        odd = {k: np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, "<u4").tobytes() for k, x in enumerate(texts) if b"<|" in x}
        flat = np.frombuffer(b" ".join([b"" if k in odd else x for k, x in enumerate(texts)] + [b""]).translate(_LOWER), np.uint8)
        kind = _KIND[flat]
        follows = (flat & 0xC0) == 0x80
        follows[1:] &= (flat[:-1] != 0xC3) | (flat[1:] == 0x97) | (flat[1:] == 0xB7)
        kind[follows] = _OTHER
        inside = kind != _SPACE
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a chunk of letters with marks only at its end is cut between the two
        last = np.zeros(len(flat), bool)
        last[1:] = (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
        bad = np.zeros(len(flat) + 1, np.int32)
        wrong = kind == _OTHER
        wrong[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
        np.cumsum(wrong, out=bad[1:])
        seam = np.flatnonzero(last)
        owner = np.searchsorted(starts, seam, side="right") - 1
        seam = seam[bad[ends[owner]] == bad[starts[owner]]]
        starts, ends = np.sort(np.concatenate([starts, seam])), np.sort(np.concatenate([ends, seam]))
        number = self.numbers(flat, starts, ends)
        lengths = self.lengths.all[number]
        ids = gathered(self.ids.all, self.starts.all[number], lengths).astype("<u4").tobytes()
        closes = np.cumsum([len(x) + 1 for x in (b"" if k in odd else x for k, x in enumerate(texts))])
        run = np.concatenate(([0], np.cumsum(lengths)))
        stops = (4 * run[np.searchsorted(starts, closes)]).tolist()
        return [odd[k] if k in odd else ids[a:b] for k, (a, b) in enumerate(zip([0, *stops], stops))]


@lru_cache(maxsize=1)
def chunk_ids(tokenizer_path: str) -> ChunkIds:
    """One for all tasks of a worker process."""
    return ChunkIds(tokenizer_path)


PIECES = "id long, piece int, start long, length long, crc long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(id, piece, start, length, crc) of (id, text): each document's ids and a closing 0, cut only where longer than capacity."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = chunk_ids(tokenizer_path)

        def whole() -> Iterator[tuple]:
            key, parts = None, []
            for group in cut((((i,), t.as_py() or b"") for b in it for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)), b" \n"):
                for (own, number, _), ids in zip(group, memo.of([x for *_, x in group]), strict=True):
                    if number == 0 and parts:
                        yield *key, b"".join(parts)
                        parts = []
                    key = own
                    parts.append(ids)
            if parts:
                yield *key, b"".join(parts)

        for i, ids in whole():
            ids += b"\0\0\0\0"
            for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                yield i, k, start // 4, len(part) // 4, zlib.crc32(part)

    return in_small_batches(docs).select("id", F.col("text").cast("binary")).mapInArrow(lambda it: batches(schema, rows(it)), PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, times) that use up the counted lengths.

    A sequence starts with the longest piece left and is filled with the longest that fits, again and again. Then,
    as long as that closes the gap further, its smallest piece gives way to two unpacked ones that together fill
    the place it leaves more tightly. As the same choices come again while none of the lengths runs out, a pattern
    is repeated that often at once.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    open_lengths = sorted(left)
    out = []
    while open_lengths:
        used: Counter[int] = Counter()

        def longest(most: int, used: Counter = used) -> int:
            at = bisect_right(open_lengths, most) - 1
            while at >= 0 and left[open_lengths[at]] <= used[open_lengths[at]]:
                at -= 1
            return open_lengths[at] if at >= 0 else 0

        bin_, gap = [], capacity
        while n := longest(gap):
            bin_.append(n)
            used[n] += 1
            gap -= n
        while gap and len(bin_) > 1:
            s = bin_[-1]
            used[s] -= 1
            best, space = (s, 0), gap + s
            at = bisect_right(open_lengths, space - 1)
            for a in reversed(open_lengths[:at]):
                if 2 * a <= sum(best):
                    break
                if left[a] <= used[a]:
                    continue
                used[a] += 1
                b = longest(min(a, space - a))
                used[a] -= 1
                if b and a + b > sum(best):
                    best = (a, b)
                    if a + b == space:
                        break
            if not best[1]:
                used[s] += 1
                break
            bin_ = sorted([*bin_[:-1], *best], reverse=True)
            used.update(best)
            gap = capacity - sum(bin_)
        used = +used
        times = min(left[n] // m for n, m in used.items())
        out.append((bin_, times))
        for n, m in used.items():
            left[n] -= m * times
        open_lengths = [n for n in open_lengths if left[n]]
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset) by ascending rank: where the pieces of that length go."""
    rank: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            found.setdefault(n, []).append((rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have the closing id alone. Every row of docs is packed, repeated rows and rows with a null
    id as well. Other columns are not looked at. The driver gets the number of pieces of each length, no more than
    `capacity` rows, and makes the plan from it.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), tokenizer_path, capacity), "pieces")
    buckets = max(64, 4 * partitions(spark))
    dealt = cut.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(id, piece, crc), {buckets}) as int)"))
    sizes = stored(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(best_two_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")
    ranked = dealt.join(bases, ["length", "bucket"]).select("id", "piece", "start", "length", "crc", (F.col("base") + F.row_number().over(order) - 1).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lengths, ranks = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                table = where[int(n)]
                at = np.searchsorted(table[:, 0], ranks[own], side="right") - 1
                sequence[own] = table[at, 1] + ranks[own] - table[at, 0]
                offset[own] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(placed, PACKED)
