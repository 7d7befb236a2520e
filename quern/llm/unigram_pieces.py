"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Text gets a marker for each space and one before it; the best path through pieces maximises the sum of their scores;
characters that no piece covers become their bytes. Where no piece can span a place (before a run of markers, around a
character that only stands alone), the paths on its two sides are independent, so a text is encoded chunk by chunk and
chunks are remembered. The new chunks of a batch walk the trie and the lattice together. The marker is held as a space.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkMemo, Grown, batches, cut, gathered

MARKER = "▁"
#: How far below the worst piece an unknown character is.
UNKNOWN = 10.0
#: Scores below this only say that a piece is never merged (runs of spaces); it then counts as the worst other one.
NEVER = -1e8


class DoubleArray:
    """A trie of byte strings: a child of node s by byte c is t = base[s] + c + 1 if check[t] is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        self.base, self.check, self.value = array("i", [0] * 1024), array("i", [-1] * 1024), array("i", [-1] * 1024)
        self.check[0] = 0
        free, wide = 257, 0  # where single children may go, and where the search for several begins
        stack = [(0, tree)]
        while stack:
            state, node = stack.pop()
            self.value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = max(0, free - codes[0] - 1) if len(codes) == 1 else wide
            while True:
                while base + 258 >= len(self.check):
                    for a, x in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        a.extend([x] * len(a))
                if all(self.check[base + c + 1] < 0 for c in codes):
                    break
                base += 1
            wide = max(wide, base) if len(codes) > 1 else wide
            self.base[state] = base
            for c in codes:
                self.check[base + c + 1] = state
                stack.append((base + c + 1, node[c]))


class Pieces:
    """The pieces of a model, by their numbers."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        plain = {i: sp.id_to_piece(i).replace(MARKER, " ") for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        worst = min((s for s in map(sp.get_score, plain) if s > NEVER), default=0.0)
        self.scores = array("d", [s if s > NEVER else worst for s in map(sp.get_score, range(n))])
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        self.unknown = worst - UNKNOWN
        self.trie = DoubleArray({p.encode(): i for i, p in plain.items()})
        self.bytes_of = {i: p.encode() for i, p in plain.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        inner = {p[k : k + 2] for p in plain.values() for k in range(len(p) - 1)}
        self.spaces_lead = not any(x[1] == " " and x[0] != " " for x in inner)
        self.alone = bytes(ord(c) for c in "\n\t\r" if not any(c in x for x in inner))
        self.digest = sha256(repr((sorted(self.bytes_of.items()), self.scores.tolist(), self.unknown)).encode()).hexdigest()


class Encoder(ChunkMemo):
    """Ids, score and number of byte ids of chunks, remembered."""

    #: Longer chunks are encoded one by one.
    TOGETHER = 256

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        more = np.zeros(258, np.int32)  # a state's children are looked up without asking whether there are so many places
        self.base, self.check, self.value = (np.concatenate([np.array(a, np.int32), more + x]) for a, x in ((pieces.trie.base, 0), (pieces.trie.check, -1), (pieces.trie.value, -1)))
        self.plain = self.base.tolist(), self.check.tolist(), self.value.tolist()
        self.scores = np.append(np.array(pieces.scores), pieces.unknown)  # the last is that of -1, an unknown character
        self.byte_ids = np.array([pieces.byte_ids.get(b, 0) for b in range(256)], np.uint32)
        shown = [pieces.bytes_of.get(i, b"") for i in range(len(pieces.scores))]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_lengths = np.array(list(map(len, shown)), np.int64)
        self.shown_starts = np.cumsum(self.shown_lengths) - self.shown_lengths
        super().__init__()

    def reset(self) -> None:
        super().reset()
        self.ids, self.starts, self.lengths = Grown(np.uint32), Grown(np.int64), Grown(np.int64)
        self.best_scores, self.fallen = Grown(np.float64), Grown(np.int64)

    def learn(self, strings: list[bytes]) -> None:
        small = [k for k, x in enumerate(strings) if len(x) <= self.TOGETHER]
        ids, lengths, scores, fallen = self.together([strings[k] for k in small])
        if len(small) < len(strings):
            parts = dict(zip(small, zip(np.split(ids, np.cumsum(lengths)[:-1]), scores, fallen, strict=True), strict=True)) if small else {}
            rows = [parts[k] if k in parts else self.best(x) for k, x in enumerate(strings)]
            ids, lengths = np.concatenate([r[0] for r in rows]), np.array([len(r[0]) for r in rows])
            scores, fallen = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.starts.add(self.ids.n + np.cumsum(lengths) - lengths)
        for out, x in ((self.ids, ids), (self.lengths, lengths), (self.best_scores, scores), (self.fallen, fallen)):
            out.add(x)

    def together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many, score and number of byte ids of each, as best() has them one by one.

        A chunk of n bytes has n + 1 nodes, all nodes being numbered through; an edge is a piece or an unknown character.
        """
        if not chunks:
            return np.zeros(0, np.uint32), *(np.zeros(0, t) for t in (np.int64, np.float64, np.int64))
        sizes = np.array(list(map(len, chunks)), np.int64)
        raw = np.frombuffer(b"\0".join([*chunks, b""]), np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        chunk = np.repeat(np.arange(len(chunks)), sizes + 1)
        begins, last = first[chunk], (first + sizes)[chunk]
        own = np.flatnonzero(((raw & 0xC0) != 0x80) & (np.arange(len(raw)) < last))
        lead = raw[own]
        width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        tails, heads, found = [], [], []
        at, state = own, np.zeros(len(own), np.int64)
        single = np.zeros(len(raw), bool)
        wide = np.zeros(len(raw), np.int64)
        wide[own] = width
        for d in range(self.TOGETHER):
            to = self.base[state] + raw[at + d].astype(np.int64) + 1
            ok = (at + d < last[at]) & (self.check[to] == state)
            at, state = at[ok], to[ok]
            if not len(at):
                break
            v = self.value[state]
            hit = v >= 0
            tails.append(at[hit])
            heads.append(at[hit] + d + 1)
            found.append(v[hit])
            alone = at[hit & (wide[at] == d + 1)]
            single[alone] = True
        lost = ~single[own]
        tail, head = np.concatenate([*tails, own[lost]]), np.concatenate([*heads, (own + width)[lost]])
        piece = np.concatenate([*found, np.full(int(lost.sum()), -1)]).astype(np.int64)
        column = head - begins[tail]
        order = np.lexsort((tail, head, column))
        tail, head, piece, column = tail[order], head[order], piece[order], column[order]
        fresh = np.concatenate(([True], head[1:] != head[:-1]))
        groups = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        best, via = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        bounds = np.searchsorted(column, np.arange(1, column[-1] + 2)) if len(column) else [0]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            s = best[tail[a:b]] + self.scores[piece[a:b]]
            g0, g1 = group[a], group[b - 1] + 1
            top = np.maximum.reduceat(s, groups[g0:g1] - a)
            equal = np.flatnonzero(s == top[group[a:b] - g0])
            which = group[a + equal]
            equal = equal[np.concatenate(([True], which[1:] != which[:-1]))]  # of equal ones the step that began earlier
            to = head[groups[g0:g1]]
            best[to] = top
            via[to] = a + equal
        used = np.zeros(len(tail), bool)
        now = (first + sizes)[sizes > 0]
        while len(now):
            e = via[now]
            used[e] = True
            now = tail[e]
            now = now[now > begins[now]]
        path = np.flatnonzero(used)
        path = path[np.argsort(head[path], kind="stable")]
        own_chunk, unknown = chunk[tail[path]], piece[path] < 0
        span = np.where(unknown, head[path] - tail[path], 1) if self.pieces.byte_ids else np.ones(len(path), np.int64)
        ids = np.repeat(np.where(unknown, self.pieces.unknown_id, piece[path]).astype(np.uint32), span)
        fallen = np.zeros(len(path), np.int64)
        if self.pieces.byte_ids and unknown.any():
            ids[np.repeat(unknown, span)] = self.byte_ids[gathered(raw, tail[path][unknown], span[unknown])]
            fallen = np.where(unknown, span, 0)
        count = lambda w: np.bincount(own_chunk, w, len(chunks)).astype(np.int64)
        return ids, count(span), best[first + sizes], count(fallen)

    def best(self, raw: bytes) -> tuple[np.ndarray, float, int]:
        """The best path through one chunk; of equal ones the last step that began earlier."""
        (base, check, value), scores = self.plain, self.pieces.scores
        n = len(raw)
        best: list[float | None] = [None] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            here, lead = best[i], raw[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single, state = False, 0
            for j in range(i, n):
                to = base[state] + raw[j] + 1
                if check[to] != state:
                    break
                state = to
                v = value[state]
                if v >= 0:
                    s = here + scores[v]
                    if best[j + 1] is None or s > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = s, i, v
                    single = single or j + 1 - i == width
            if not single:
                s = here + self.pieces.unknown
                if best[i + width] is None or s > best[i + width]:
                    best[i + width], back[i + width], piece[i + width] = s, i, -1
            i += width
        ids: list[int] = []
        at, fallen = n, 0
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.pieces.byte_ids:
                own = [self.pieces.byte_ids[b] for b in raw[back[at] : at]]
                ids += own[::-1]
                fallen += len(own)
            else:
                ids.append(self.pieces.unknown_id)
            at = back[at]
        return np.array(ids[::-1], np.uint32), float(best[n] or 0.0), fallen

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts, and how many, score and number of byte ids of each. A part is a text with a space
        before it, or a later piece of one."""
        flat = np.frombuffer(b"".join(parts), np.uint8)
        begins = np.cumsum([0, *map(len, parts)])
        start = np.zeros(len(flat) + 1, bool)
        start[begins] = True
        if self.pieces.spaces_lead and len(flat):
            space = flat == 32
            start[:-1] |= space & ~np.concatenate(([False], space[:-1]))
            for c in self.pieces.alone:
                own = np.flatnonzero(flat == c)
                start[own] = start[own + 1] = True
        starts = np.flatnonzero(start[:-1])
        number = self.numbers(flat, starts, np.append(starts[1:], len(flat)))
        lengths = self.lengths.all[number]
        owner = np.searchsorted(begins, starts, side="right") - 1
        total = lambda w: np.bincount(owner, w[number], len(parts))
        ids = gathered(self.ids.all, self.starts.all[number], lengths)
        return ids, total(self.lengths.all).astype(np.int64), total(self.best_scores.all), total(self.fallen.all).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, markers being spaces; before the first text there is one more."""
        return gathered(self.shown, self.shown_starts[ids], self.shown_lengths[ids]).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(pieces: Pieces) -> Encoder:
    """One for all tasks of a worker process."""
    if pieces.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[pieces.digest] = Encoder(pieces)
    return _ENCODERS[pieces.digest]


def results(texts: Iterator[tuple[object, bytes]], encoder: Encoder) -> Iterator[tuple]:
    """(key, ids, score, number of byte ids, decoded bytes, whether these are the text) of each (key, text)."""

    def row(key: object, parts: list[tuple]) -> tuple:
        text, ids, scores, fallen = zip(*parts, strict=True)
        ids = np.concatenate(ids)
        back = encoder.decode(ids)[1:]
        same = back == b"".join(text)[1:]
        if not same:
            back = back.decode("utf-8", "replace").encode()
        return key, ids, sum(scores), sum(fallen), back, same

    key, held = None, []
    marker = MARKER.encode()
    for group in cut(texts, b" " if encoder.pieces.spaces_lead else b""):
        parts = [b" " + x if number == 0 and x else x for _, number, x in group]
        ids, lengths, scores, fallen = encoder.encode([x.replace(marker, b" ") for x in parts])
        ends = np.cumsum(lengths)
        for k, (own, number, _) in enumerate(group):
            if number == 0 and held:
                yield row(key, held)
                held = []
            key = own
            held.append((parts[k], ids[ends[k] - lengths[k] : ends[k]], float(scores[k]), int(fallen[k])))
    if held:
        yield row(key, held)


ENCODED = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean"


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: pieces, byte pieces among them, crc32 of the ids (little-endian unsigned 32-bit), the best
    path's score, and SHA-256 of the text decoded from the ids, with whether that is the text itself.

    Null texts are empty: no pieces, score 0. A text that holds the marker itself decodes to a space there and is no
    round trip. Ids, null or repeated ones too, pass through; other columns are not looked at.
    """
    pieces = Pieces(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        texts = ((i, x.as_py() or b"") for b in it for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for i, ids, score, fallen, back, same in results(texts, encoder_of(pieces)):
            yield i, len(ids), fallen, zlib.crc32(ids.astype("<u4").tobytes()), score, sha256(back).hexdigest(), same

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(lambda it: batches(schema, rows(it), 1024), ENCODED)
