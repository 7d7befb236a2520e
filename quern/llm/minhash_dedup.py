"""Near-duplicate detection by a signature-coordinate inverted join.

Every distinct shingle set gets k minhash coordinates and is posted under each (coordinate, value) pair of the
first k - t + 1 coordinates: two sets that agree on t of k coordinates must meet in one of these lists (the prefix).
Lists are merged in blocks of bounded size. Inside a block a set is compared, on all k coordinates, only with sets
that no earlier match has tied to it (the skip), and what is kept is a spanning forest of the pairs with t matches
or more. The classes of this forest are then confirmed on full shingle sets, block by block, and the confirmed
links make the components. No list of pairs of a group is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, U, WordHashes, batches, components, dropped, free, in_small_batches, mixed, partitions, shingle_set, stored, words


@dataclass(frozen=True)
class Policy:
    """A link: 100 * intersection >= percent * union of the sets of n-word shingles.

    k coordinates; the match threshold t is the largest for which a pair right at the similarity is missed with a
    probability of at most miss. block: most sets in half a block of a merge; block_mb: most MB of sets in half a
    block of a confirmation.
    """

    shingle: int = 5
    percent: int = 80
    k: int = 64
    miss: float = 1e-7
    block: int = 2048
    block_mb: int = 24

    @property
    def threshold(self) -> int:
        p, below = self.percent / 100, 0.0
        for t in range(self.k + 1):
            below += comb(self.k, t) * p**t * (1 - p) ** (self.k - t)
            if below > self.miss:
                return max(1, t)
        return self.k


SIGNED = "id long, n long, digest binary, sig binary, keys array<long>"


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return seeds[:k] | U(1), seeds[k:]


def minhashes(values: np.ndarray, k: int) -> np.ndarray:
    a, b = _coefficients(k)
    out = np.full(k, ~U(0), U)
    for start in range(0, len(values), 2048):
        np.minimum(out, (values[start : start + 2048, None] * a + b).min(axis=0), out=out)
    return out


def signed(docs: DataFrame, policy: Policy) -> DataFrame:
    """(id, n, digest, sig, keys) of (id, text): size and digest of the set, a byte per coordinate, the posting keys."""
    k, prefix, n = policy.k, policy.k - policy.threshold + 1, policy.shingle
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])
    salt = mixed(np.arange(1, k + 1, dtype=U))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo = WordHashes()
        for b in it:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = shingle_set(memo.of(words(text.as_py())), n)
                if not len(found):
                    yield i, 0, None, None, None
                    continue
                marks = mixed(minhashes(found, k) ^ salt)
                yield i, len(found), xxhash.xxh3_128_digest(found.tobytes()), (marks >> U(56)).astype(np.uint8).tobytes(), marks[:prefix].view(np.int64).tolist()

    return in_small_batches(docs).select("id", F.col("text").cast("binary")).mapInArrow(lambda it: batches(schema, rows(it), 1024), SIGNED)


def forest(sigs: np.ndarray, t: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows that agree on t columns or more; each row is compared only with rows not yet reached."""
    out, left = [], np.arange(len(sigs))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            hit = (sigs[left] == sigs[u]).sum(axis=1) >= t
            if hit.any():
                out += [(u, v) for v in left[hit]]
                stack += left[hit].tolist()
                left = left[~hit]
    return out


def _groups(it: Iterator[pa.RecordBatch], n_key: int) -> Iterator[list[tuple]]:
    """Runs of rows with an equal key in their first n_key columns; input sorted by it, runs bounded by the caller."""
    key, held = None, []
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_key] != key:
                if held:
                    yield held
                key, held = row[:n_key], []
            held.append(row)
    if held:
        yield held


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _merged(t: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[int, int]]:
            pairs: list[tuple] = []

            def flush() -> Iterator[tuple[int, int]]:
                if pairs:
                    x, y = (np.frombuffer(b"".join(p[i][4] for p in pairs), np.uint8).reshape(len(pairs), -1) for i in (0, 1))
                    for p, same in zip(pairs, (x == y).sum(axis=1) >= t, strict=True):
                        if same:
                            yield p[0][3], p[1][3]
                    pairs.clear()

            for rows in _groups(it, 3):
                if len(rows) == 2:
                    pairs.append(rows)
                    if len(pairs) == 1000:
                        yield from flush()
                elif len(rows) > 2:
                    sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
                    yield from ((rows[u][3], rows[v][3]) for u, v in forest(sigs, t))
            yield from flush()

        return batches(EDGE, edges())

    return run


def _blocks(df: DataFrame, key: str, chunks: str) -> DataFrame:
    """Rows of a key dealt to blocks (ci <= cj) of two of its chunks each, so that every two rows meet in one block at least."""
    return (
        df.withColumn("c", F.expr(f"cast(pmod(xxhash64(id, 7), {chunks}) as int)"))
        .withColumn("o", F.explode(F.expr(f"sequence(0, cast({chunks} as int) - 1)")))
        .withColumns({"ci": F.least("c", "o"), "cj": F.greatest("c", "o")})
        .withColumn("block", F.xxhash64(key, "ci", "cj"))
    )


def candidates(sets: DataFrame, policy: Policy) -> DataFrame:
    """Edges (a, b) whose classes hold every two sets with t matches: posting, prefix, blockwise merging.

    Of lists that hold the same sets, as a group of copies has under all its coordinates, one is merged; they are
    told by two 64-bit sums of hashed ids.
    """
    posts = sets.select("id", F.explode("keys").alias("key"))
    who = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"w{k}") for k in (0, 1)]
    lists = posts.groupBy("key").agg(F.count("*").alias("m"), *who).where("m > 1").groupBy("m", "w0", "w1").agg(F.min("key").alias("key"))
    met = posts.join(lists.select("key", "m"), "key").join(sets.select("id", "sig"), "id")
    block = _blocks(met, "key", f"ceil(m / {policy.block})").select("key", "ci", "cj", "id", "sig", "block")
    return block.repartition(partitions(sets.sparkSession), "block").sortWithinPartitions("key", "ci", "cj").select("key", "ci", "cj", "id", "sig").mapInArrow(_merged(policy.threshold), "a long, b long")


def linked(sets: list[np.ndarray], policy: Policy, ahead: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |A and B| >= percent * |A or B|.

    A set is compared only with sets of a fitting size that no link has tied to its class yet, those with most
    matching coordinates first. Matches only order the work and rule out what is below the threshold.
    """
    sizes = np.array([len(s) for s in sets])
    sigs = np.stack([(mixed(minhashes(s, policy.k)) >> U(56)).astype(np.uint8) for s in sets])
    root = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    for u in range(1, len(sets)):
        others = np.flatnonzero((root[:u] != root[u]) & (100 * np.minimum(sizes[:u], sizes[u]) >= policy.percent * np.maximum(sizes[:u], sizes[u])))
        if not len(others):
            continue
        same = (sigs[others] == sigs[u]).sum(axis=1)
        keep = same >= policy.threshold
        others, same = others[keep], same[keep]
        for v in others[np.argsort(-same, kind="stable")]:
            if root[v] != root[u] and _similar(sets[u], sets[v], policy.percent):
                out.append((u, int(v)))
                root[root == root[v]] = root[u]
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(policy: Policy):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[int, int]]:
            for rows in _groups(it, 3):
                found = linked([np.frombuffer(r[4], U) for r in rows], policy)
                yield from ((rows[u][3], rows[v][3]) for u, v in found)

        return batches(EDGE, edges())

    return run


def confirmed(classes: DataFrame, docs: DataFrame, policy: Policy) -> DataFrame:
    """Edges (a, b) of links between sets of a class, confirmed on full sets computed from the texts.

    Only texts whose ids a Bloom filter of the classes lets through move to meet their class, once; where there are too
    many ids for a filter, every text moves once. Sets are made there, and only those of the class go on to its blocks.
    """
    n, bloom = policy.shingle, Bloom(classes.select("id"))
    schema = pa.schema([("key", pa.int64()), ("chunks", pa.int64()), ("id", pa.int64()), ("hashes", pa.binary())])

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo = WordHashes()
        for b in it:
            for key, chunks, i, size, text in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                made = shingle_set(memo.of(words(text.as_py())), n)
                if len(made) == size:
                    yield key, chunks, i, made.tobytes()

    sized = classes.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("m") / policy.block), F.ceil(F.col("total") * 8 / (policy.block_mb << 20)))
    members = classes.join(sized, "component").select(F.col("component").alias("key"), chunks.cast("long").alias("chunks"), "id", "n")
    own = docs.where(bloom.column(F.col("id"))).select("id", F.col("text").cast("binary").alias("text"))
    met = own.join(members.hint("merge"), "id").select("key", "chunks", "id", "n", "text")
    found = met.mapInArrow(lambda it: batches(schema, sets(it), 256), "key long, chunks long, id long, hashes binary")
    block = _blocks(found, "key", "chunks").select("key", "ci", "cj", "id", "hashes", "block")
    return block.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("key", "ci", "cj").select("key", "ci", "cj", "id", "hashes").mapInArrow(_confirmed(policy), "a long, b long")


def near_duplicates(docs: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component): per row of docs its id, the size of its shingle set and the smallest id linked with it.

    Words are maximal runs of other bytes than space and 9 to 13, A-Z in lower case. Null and empty texts have an
    empty set and are linked with nothing; a null id is linked with nothing and has a null component. Repeated rows
    and equal sets are one set, so groups of copies of any size cost one row each. Rows of one id with different texts
    are one node: what either is linked with is in one component. Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(signed(own, policy), "sets")
    whole = sets.where("n > 0 and id is not null")
    first = whole.groupBy("digest").agg(F.min("id").alias("id"))
    reps = stored(whole.join(first, ["digest", "id"]).dropDuplicates(["digest"]).select("id", "n", "digest", "sig", "keys"), "reps")
    tied = components(candidates(reps, policy), "classes")
    classes = stored(tied.withColumnRenamed("node", "id").join(reps.select("id", "n", "digest"), "id"), "members")
    found = components(confirmed(classes, own.where("id is not null"), policy), "links")
    comps = found.withColumnRenamed("node", "id")
    known = reps.select("id", "digest").join(comps, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    rows = sets.select("id", "n", "digest").join(known, "digest", "left")
    done = stored(rows.select("id", "n", F.when(F.col("digest").isNotNull() & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component")), "components")
    dropped(sets, reps, tied, classes, found)
    return done


def deduplicated(docs: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each group of near duplicates: the one with the smallest id.

    Columns are those of docs. Rows with a null id stay; a repeated row (same id, same text) stays once. Rows that a
    Bloom filter of the ids to drop and the repeated ids doesn't know stay where they are; the others are joined.
    """
    found = near_duplicates(docs, policy, id_col, text_col)
    known = found.where("id is not null")
    out = stored(known.where("id <> component").select("id").union(known.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")).distinct(), "suspects")
    gone = stored(known.where("id <> component").select("id").distinct(), "gone")
    bloom = Bloom(out)
    dropped(found, out)
    key = F.col(id_col).cast("long")
    may = F.coalesce(bloom.column(key), F.lit(False))
    own_id, own_text = free("id", docs.columns), free("text_hash", docs.columns)
    unsure = docs.where(may).withColumns({own_id: key, own_text: F.xxhash64(F.col(text_col))})
    rest = unsure.join(gone.withColumnRenamed("id", own_id), own_id, "left_anti").dropDuplicates([own_id, own_text]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~may).unionByName(rest)
