"""Character shingles of many texts at a time, in numpy: numbered where they are compared, hashed once where they are kept.

A text's shingles are those of T.shingles: all of n characters, a shorter text is its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa

#: Groups of hashes at least whose sizes are a text's profile, and hashes of a group; a size is cut at what a byte holds.
GROUPS, EACH = 64, 12
#: Characters that are numbered at a time, and entries of a worker's memo of hashes; at the limit it is emptied.
SLICE, MEMO = 1 << 20, 400_000


class _Hashes(dict):
    """The first eight bytes of SHA-256 by shingle."""

    def __missing__(self, s: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        found = self[s] = sha256(s.encode()).digest()[:8]
        return found


_HASHES = _Hashes()


def slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts of about SLICE characters; a longer one stands alone or ends its slice."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def numbered(texts: list[str], n: int = 5) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts, place of each distinct shingle's first occurrence, each shingle's number, bounds of the texts in these).

    Numbers are dense and stand for whole shingles, so equal numbers mean equal shingles. Short texts are padded by NUL.
    """
    whole = "".join([t if len(t) >= n else t.ljust(n, "\0") for t in texts])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(np.maximum(size, n))[:-1]])
    counts = np.maximum(1, size - (n - 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(begins - bounds[:-1], counts)
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    codes = (np.cumsum(seen) - 1)[codes]
    wide = span = int(codes.max()) + 1
    key = codes[at]
    for j in range(1, n):
        if span * wide >= 1 << 62:  # beginnings are numbered anew, so a key stays whole in 64 bits
            begun = pa.array(key).dictionary_encode()
            key, span = begun.indices.to_numpy().astype(np.int64), len(begun.dictionary)
        key, span = key * wide + codes[at + j], span * wide
    own = pa.array(key).dictionary_encode()
    number = own.indices.to_numpy()
    first = np.empty(len(own.dictionary), np.int64)
    first[number[::-1]] = at[::-1]
    return whole, first, number, bounds


def hashed(texts: list[str], n: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles as the first 64 bits of SHA-256."""
    whole, first, number, bounds = numbered(texts, n)
    cut = [whole[i : i + n] for i in first.tolist()]
    for k in number[bounds[:-1][np.diff(bounds) == 1]].tolist():  # only these can be padded
        cut[k] = cut[k].rstrip("\0")
    each = np.frombuffer(b"".join([_HASHES[s] for s in cut]), ">u8").astype(np.uint64)[number]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        s = np.sort(each[i:j])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])]


def anchors(s: np.ndarray, k: int = 8) -> np.ndarray:
    """The k smallest distinct first halves of sorted hashes: T.sha_anchors as numbers."""
    a = s >> np.uint64(32)
    return a[np.concatenate([[True], a[1:] != a[:-1]])][:k].astype(np.int64)


def profile(s: np.ndarray) -> np.ndarray:
    """Sizes of the groups of hashes, of which there are a power of two, so profiles of larger sets fold to those of smaller ones.

    Between two sets these differ by no more than the sets do, folded or not."""
    groups = max(GROUPS, 1 << (len(s) // EACH).bit_length() - 1) if len(s) >= EACH else GROUPS
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(profiles: list[bytes], groups: int) -> np.ndarray:
    """A row for each profile, folded to that many groups."""
    out = np.zeros((len(profiles), groups), np.int16)
    size = np.fromiter(map(len, profiles), np.int64, len(profiles))
    for k in np.unique(size).tolist():
        own = np.flatnonzero(size == k)
        flat = np.frombuffer(b"".join([profiles[i] for i in own.tolist()]), np.uint8)
        out[own] = flat.reshape(len(own), k // groups, groups).sum(1, dtype=np.int16)
    return out
