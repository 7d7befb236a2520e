"""Links of texts that are alike, without a text or a set of shingles moved that no pair needs.

Each text gets a narrow row where it is read: the hash of the whole text, the anchors, the number of shingles and their
profile. Rows meet in lists under an anchor and a range of set sizes, where profiles rule out nearly all pairs that can't
be alike enough; none that is can be ruled out. The rest are confirmed on whole sets, in blocks that hold each text once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shingles as S
from .dedup import checkpointed

#: Characters and texts of a side of a block that is confirmed, pairs of a list compared at a time (TILE rows with WIDTH), ids of
#: candidates that are broadcast at most, and rows of a list whose pairs are compared by whole profiles at once.
BLOCK, SIDE, TILE, WIDTH, MOST, FEW = 1_000_000, 256, 128, 2048, 1_000_000, 64
_PART = ["anchor", "bucket", "x", "y"]


def _parts(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one after another, of batches sorted by key; a key's rows may stand in several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        begin = 0
        for end in np.flatnonzero(new).tolist():
            if end > begin:
                held.append(batch.slice(begin, end - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def nodes(texts: DataFrame, n: int = 5) -> DataFrame:
    """(id, length, shingles, anchors, profile) of the first id of each distinct text of (id, text); no text moves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begin = batch.column(0), 0
            for part in S.slices(batch.column(1).to_pylist()):
                sets = list(S.hashed(part, n))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, len(part)),
                    pa.array([sha256(t.encode()).digest() for t in part], pa.binary()),
                    pa.array([len(t) for t in part], pa.int32()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([S.anchors(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([S.profile(s).tobytes() for s in sets], pa.binary()),
                ], ["id", "h", "length", "shingles", "anchors", "profile"])
                begin += len(part)

    own = texts.select("id", "text").mapInArrow(rows, "id long, h binary, length int, shingles int, anchors array<long>, profile binary")
    rest = ["length", "shingles", "anchors", "profile"]
    return own.groupBy("h").agg(F.min("id").alias("id"), F.first(F.struct(*rest)).alias("f")).select("id", *[f"f.{c}" for c in rest])


def _alike(rows: pa.Table, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a list, by rising set size, of pairs that may be linked and whose first common anchor is the list's."""
    col = {c: rows.column(c).to_numpy() for c in ("anchor", "id", "length", "shingles", "guest")}
    ids, size, long, guest = col["id"], col["shingles"].astype(np.int64), col["length"].astype(np.int64), col["guest"]
    flat = rows.column("anchors").combine_chunks()
    ends = np.cumsum(flat.value_lengths().to_numpy())
    wide = np.full((len(ids), int(np.diff(ends, prepend=0).max())), -1, np.int64)
    own = np.arange(wide.shape[1])[None, :] < np.diff(ends, prepend=0)[:, None]
    wide[own] = flat.flatten().to_numpy()
    profiles = rows.column("profile").to_pylist()
    coarse = S.folded(profiles, S.GROUPS).T.astype(np.int16 if size[-1] < 1 << 14 else np.int32, order="C") if len(ids) > FEW else ()
    fine = S.folded(profiles, min(map(len, profiles)))
    upto = np.searchsorted(size, np.floor(size / least + 1e-6).astype(np.int64), "right")
    slack = (1 - least) / (1 + least)  # sets of sizes p and q are as alike only if they differ by slack * (p + q) at most
    out = []
    for i in range(0, len(ids), TILE):
        i_end = min(i + TILE, len(ids))
        for j in range(i + 1, int(upto[i_end - 1]), WIDTH):
            j_end = min(j + WIDTH, int(upto[i_end - 1]))
            may = (np.arange(j, j_end)[None, :] > np.arange(i, i_end)[:, None]) & (np.arange(j, j_end)[None, :] < upto[i:i_end, None])
            may &= ~(guest[i:i_end, None] & guest[None, j:j_end])
            if len(coarse):
                apart = np.zeros(may.shape, coarse.dtype)
                for g in coarse:
                    apart += np.abs(g[i:i_end, None] - g[None, j:j_end])
                may &= apart <= slack * (size[i:i_end, None] + size[None, j:j_end]) + 1e-6
            p, q = np.nonzero(may)
            out.append((p + i, q + j))
    p, q = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
    kept = []
    step = max(1, min(1 << 14, (1 << 22) // fine.shape[1]))
    for k in range(0, len(p), step):
        u, v = p[k : k + step], q[k : k + step]
        near = np.abs(fine[u] - fine[v]).sum(1, dtype=np.int64) <= slack * (size[u] + size[v]) + 1e-6
        both = ((wide[u][:, :, None] == wide[v][:, None, :]) & (wide[u] >= 0)[:, :, None]).any(2)
        first = wide[u, both.argmax(1)] == col["anchor"][0]
        early = ids[u] < ids[v]
        a, b = np.where(early, long[u], long[v]), np.where(early, long[v], long[u])
        kept.append(near & (both.sum(1) >= shared) & first & (a >= np.floor(b * least)) & (a <= np.ceil(b / least)))
    kept = np.concatenate(kept or [np.zeros(0, bool)])
    return p[kept], q[kept]


def candidates(own: DataFrame, shared: int = 2, least: float = 0.9) -> DataFrame:
    """(anchor, bucket, x, y, a, b): pairs that may be linked, each once, with the block in which they are confirmed.

    Two texts with `shared` common anchors have one of them among all but the last shared - 1 of each, so lists under
    these hold every pair. A text stands in the list of its range of set sizes and, as a guest, in that of the next.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["anchor", "bucket"]):
            if len(rows) < 2:
                continue
            p, q = _alike(rows, shared, least)
            if not len(p):
                continue
            named = np.unique(np.concatenate([p, q]))
            block = np.zeros(len(rows), np.int32)
            block[named] = np.cumsum(np.maximum(rows.column("length").to_numpy()[named].astype(np.int64), BLOCK // SIDE)) // BLOCK
            ids = rows.column("id").to_numpy()
            same = [np.repeat(rows.column(c).to_numpy()[:1], len(p)) for c in ("anchor", "bucket")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, block[p], block[q], np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]))], [*_PART, "a", "b"])

    unit = -math.log(least * 0.999)  # a little wider, so that rounding puts no pair two ranges apart
    bucket = F.floor(F.log("shingles") / unit).cast("int")
    posts = own.withColumn("own", bucket).withColumn("anchor", F.explode(F.slice("anchors", 1, F.greatest(F.lit(0), F.size("anchors") - (shared - 1)))))
    posts = posts.withColumn("bucket", F.explode(F.array("own", F.col("own") + 1))).withColumn("guest", F.col("bucket") > F.col("own")).drop("own")
    dealt = posts.repartition(_parts(own.sparkSession), "anchor", "bucket").sortWithinPartitions("anchor", "bucket", "shingles", "id")
    return dealt.mapInArrow(pairs, "anchor long, bucket int, x int, y int, a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int = 5, least: float = 0.9) -> DataFrame:
    """(a, b, jaccard) of the pairs of candidates() whose whole sets are alike enough; only their texts of (id, text) move."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, _PART):
            a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
            n_texts = len(a) - int(rows.column("pair").to_numpy().sum())
            ids = {k: i for i, k in enumerate(a[:n_texts].tolist())}
            _, first, number, bounds = S.numbered(rows.column("text").slice(0, n_texts).to_pylist(), n)
            sets = [np.unique(number[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            has, of, found = np.zeros(len(first), bool), None, []
            for x, y in zip(a[n_texts:].tolist(), b[n_texts:].tolist(), strict=True):
                s, t = sets[ids[x]], sets[ids[y]]
                if of is not s:
                    if of is not None:
                        has[of] = False
                    has[s], of = True, s
                both = int(np.count_nonzero(has[t]))
                likeness = both / (len(s) + len(t) - both)
                if likeness >= least:
                    found.append((x, y, likeness))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["a", "b", "jaccard"])

    members = pairs.select(*_PART, F.explode(F.array("a", "b")).alias("id")).distinct()
    named = checkpointed(members.select("id").distinct())
    own = texts.select("id", "text").join(F.broadcast(named) if named.count() <= MOST else named, "id", "left_semi").join(members, "id")
    rows = own.select(*_PART, F.lit(False).alias("pair"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    rows = rows.unionByName(pairs.select(*_PART, F.lit(True).alias("pair"), "a", "b", F.lit(None).cast("string").alias("text")))
    dealt = rows.repartition(_parts(pairs.sparkSession), *_PART).sortWithinPartitions(*_PART, "pair", "a")
    return dealt.mapInArrow(links, "a long, b long, jaccard double")


def links(texts: DataFrame, own: DataFrame, n: int = 5, least: float = 0.9, shared: int = 2) -> DataFrame:
    """(a, b, jaccard): ids of `own`, which is nodes() of texts (id, text), with `shared` common anchors, lengths within
    the band and shingle sets alike enough."""
    return confirmed(checkpointed(candidates(own, shared, least)), texts, n, least)
