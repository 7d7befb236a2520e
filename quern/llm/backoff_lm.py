"""Language-model scores from a weighted backoff automaton over bigrams of the training texts.

A state is a context: the root for none, and one for each trained word. A state has an arc for each word seen after
it and a failure arc to the root, whose arcs are the smoothed word probabilities. A text is scored by one traversal
from left to right that carries its state; many texts are traversed side by side. The model is as large as the corpus,
so no task holds it. Texts go in blocks; a block asks, partition of hashed keys by partition, for the counts of its own
words and word pairs, and scores on the part of the automaton that it can reach. The number of partitions follows
from the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WordHashes, dropped, held_out, mixed, partitions, stored, words

#: The word that closes every text and is the context of its first word; no text holds it, as words have no spaces.
END = b" end "
#: Pseudo-count of the word distribution in every context (Dirichlet smoothing).
PRIOR = 500.0
#: Tokens in a block; a longer text is a block of its own.
BLOCK = 500_000
#: Tokens of the corpus for each partition of keys: a task of counts reads some 10 bytes for each distinct pair of a block.
PART = 1_000_000
#: Tokens of a text that one lane of the traversal takes; the next lane starts from the state there.
LANE = 512

DOCS = "block long, part int, ids binary, valid binary, held binary, lengths binary, words binary, tokens binary, trained long, size long"
_DOCS = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "valid", "held", "lengths", "words", "tokens")), ("trained", pa.int64()), ("size", pa.int64())])
ASKED = "part int, block long, uni binary, uni_n binary, bi binary, bi_n binary"
_ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("uni", "uni_n", "bi", "bi_n"))])
TOLD = "block long, part int, uni binary, bi binary, vocabulary long"
_TOLD = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("uni", pa.binary()), ("bi", pa.binary()), ("vocabulary", pa.int64())])


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: the bytes that are nearly always 0 take no room once compressed."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def steps(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the distances between them."""
    return planes(np.diff(keys, prepend=U(0)).astype("<u8"))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8"), dtype=U)


def _one(schema: pa.Schema, *row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def blocked(docs: DataFrame) -> DataFrame:
    """Blocks of (id, held, text): ids, folds, lengths in tokens, distinct words by falling frequency, tokens as their numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, number = WordHashes(), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            flat = np.concatenate([h for *_, h in held])
            own, tokens, counts = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = np.array([i or 0 for i, *_ in held], np.int64)
            valid = np.array([i is not None for i, *_ in held], np.uint8)
            fold = np.array([f for _, f, _ in held], np.uint8)
            lengths = np.array([len(h) for *_, h in held], np.int64)
            number += 1
            return _one(_DOCS, number, -1, ids.tobytes(), valid.tobytes(), fold.tobytes(), lengths.tobytes(), own[order].tobytes(), planes(rank[tokens].astype("<i4")), int(lengths[fold == 0].sum()), len(flat))

        for b in it:
            for i, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = memo.of([*words(text.as_py()), END])
                if held and size + len(h) > BLOCK:
                    yield block()
                    held, size = [], 0
                held.append((i, fold, h))
                size += len(h)
        if held:
            yield block()

    return docs.select("id", "held", F.col("text").cast("binary")).mapInArrow(run, DOCS)


class Block:
    """What a row of blocked() holds, its word pairs and where their counts are kept."""

    def __init__(self, held: bytes, lengths: bytes, own: bytes, tokens: bytes, parts: int) -> None:
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.lengths = np.frombuffer(lengths, np.int64)
        self.words = np.frombuffer(own, U)
        self.tokens = from_planes(tokens, "<i4").astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.tokens[-1]  # the closing word of any text
        self.codes = self.before * len(self.words) + self.tokens
        self.codes, self.pair = np.unique(self.codes, return_inverse=True)
        self.context, self.word = np.divmod(self.codes, len(self.words))
        pair_keys = mixed(mixed(self.words[self.context]) + self.words[self.word])
        # the places of words and of pairs by ascending key, and where each part's keys end there
        self.word_order, self.pair_order = np.argsort(self.words, kind="stable"), np.argsort(pair_keys, kind="stable")
        self.word_keys, self.pair_keys = self.words[self.word_order], pair_keys[self.pair_order]
        cuts = np.array([((k << 64) + parts - 1) // parts for k in range(1, parts)], U)
        self.word_ends = np.concatenate(([0], np.searchsorted(self.word_keys, cuts), [len(self.words)]))
        self.pair_ends = np.concatenate(([0], np.searchsorted(self.pair_keys, cuts), [len(pair_keys)]))


def asked(blocks: DataFrame, parts: int) -> DataFrame:
    """For each block and part the block's words and word pairs there, and how often its training texts have them.

    A part is a range of keys. Parts of which a block has nothing get no row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for number, *raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                x = Block(*raw, parts)
                training = np.repeat(~x.held, x.lengths)
                uni_n = np.bincount(x.tokens[training], minlength=len(x.words)).astype("<u4")[x.word_order]
                bi_n = np.bincount(x.pair[training], minlength=len(x.codes)).astype("<u4")[x.pair_order]
                for p in range(parts):
                    u, v = slice(*x.word_ends[p : p + 2]), slice(*x.pair_ends[p : p + 2])
                    if u.stop > u.start or v.stop > v.start:
                        yield _one(_ASKED, p, number, steps(x.word_keys[u]), planes(uni_n[u]), steps(x.pair_keys[v]), planes(bi_n[v]))

    return blocks.select("block", "held", "lengths", "words", "tokens").mapInArrow(run, ASKED)


def _totals(keys: list[np.ndarray], counts: list[bytes]) -> tuple[list[bytes], int]:
    """Each list's keys' counts summed over all lists, and how many distinct keys have any."""
    flat, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, np.concatenate([from_planes(c, "<u4") for c in counts]), len(flat)).astype("<u8")
    own = np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])
    return [planes(x) for x in own], int((sums > 0).sum())


def told(questions: DataFrame, parts: int) -> DataFrame:
    """The answer to each question: counts over all training texts, in the order asked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def answers() -> Iterator[pa.RecordBatch]:
            uni, vocabulary = _totals([from_steps(r[1]) for r in held], [r[2] for r in held])
            bi, _ = _totals([from_steps(r[3]) for r in held], [r[4] for r in held])
            for k, r in enumerate(held):
                yield _one(_TOLD, r[0], part, uni[k], bi[k], vocabulary if k == 0 else 0)

        for b in it:
            for p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if held:
                        yield from answers()
                    part, held = p, []
                held.append(row)
        if held:
            yield from answers()

    return questions.repartition(max(parts, partitions(questions.sparkSession)), "part").sortWithinPartitions("part").mapInArrow(run, TOLD)


class Automaton:
    """States by number: 0 the root, then one for each word with a count; arcs of the states by (context, word), ascending."""

    def __init__(self, uni: np.ndarray, context: np.ndarray, word: np.ndarray, bi: np.ndarray, trained: int, vocabulary: int, prior: float = PRIOR) -> None:
        p = (uni + 1) / (trained + vocabulary + 1)
        self.size = len(uni)
        self.root_arcs = np.log10(p)
        self.state = np.where(uni > 0, np.arange(1, len(uni) + 1), 0)
        self.failure = np.concatenate(([0.0], np.where(uni > 0, np.log10(prior / (uni + prior)), 0.0)))
        seen = (bi > 0) & (uni[context] > 0)
        context, word = context[seen], word[seen]
        self.codes = self.state[context] * self.size + word
        self.arcs = np.log10((bi[seen] + prior * p[word]) / (uni[context] + prior))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the words, and the weights: of the arc, or of the failure arc and the root's."""
        wanted = state * self.size + word
        at = np.searchsorted(self.codes, wanted)
        at[at == len(self.codes)] = 0
        found = (self.codes[at] == wanted) & (state > 0) if len(self.codes) else np.zeros(len(state), bool)
        weight = self.failure[state] + self.root_arcs[word]
        weight[found] = self.arcs[at[found]]
        return self.state[word], weight

    def traversed(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The summed weights of each text (start, length; before: the word that the first one follows).

        Texts go side by side, the longest first. A text longer than LANE goes in lanes of that length; each starts in
        the state that the lane before ends in, which in a bigram automaton is that of its last word.
        """
        lanes = np.maximum(1, -(-lengths // LANE))
        text = np.repeat(np.arange(len(starts)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[text] + place * LANE
        size = np.minimum(LANE, lengths[text] - place * LANE)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, total = self.state[np.where(place[order] == 0, before[begin], tokens[begin - (place[order] > 0)])], np.zeros(len(order))
        live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for t, n in enumerate(live.tolist()):
            state[:n], weight = self.step(state[:n], tokens[begin[:n] + t])
            total[:n] += weight
        out = np.empty(len(order))
        out[order] = total
        return np.add.reduceat(out, np.cumsum(lanes) - lanes) if len(out) else out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, fold: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; logarithms to base 10.

    Training texts are those whose crc32 of the id as text, modulo fold[0], is not fold[1]; a null id is held out.
    Null and empty texts are the closing word alone. Repeated rows train and are scored each. Other columns are not
    looked at. score is proper: in each context the probabilities of all words and of one unknown word sum to 1.
    The driver gets four numbers: tokens, distinct words and tokens of the training texts,
    and blocks.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("held", held_out(F.col("id"), *fold).cast("int"))
    blocks = stored(blocked(own), "lm-blocks")
    trained, size, n_blocks = blocks.agg(F.sum("trained"), F.sum("size"), F.count("*")).first()
    trained = trained or 0
    parts = max(1, -(-(size or 0) // PART))
    answers = stored(told(asked(blocks, parts), parts), "lm-answers")
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, replies = None, []

        def result() -> pa.RecordBatch:
            x = Block(row["held"], row["lengths"], row["words"], row["tokens"], parts)
            uni, bi = np.zeros(len(x.words)), np.zeros(len(x.codes))
            for r in replies:
                p = r["part"]
                uni[x.word_order[slice(*x.word_ends[p : p + 2])]] = from_planes(r["uni"], "<u8")
                bi[x.pair_order[slice(*x.pair_ends[p : p + 2])]] = from_planes(r["bi"], "<u8")
            automaton = Automaton(uni, x.context, x.word, bi, trained, vocabulary, prior)
            base = np.add.reduceat(automaton.root_arcs[x.tokens], x.starts)
            score = automaton.traversed(x.tokens, x.starts, x.lengths, x.before)
            known = np.add.reduceat((uni > 0).astype(np.int64)[x.tokens], x.starts)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["valid"], np.uint8) == 0)
            return pa.RecordBatch.from_arrays([ids, pa.array(x.held), pa.array(x.lengths), pa.array(known), pa.array(np.full(len(known), trained)), pa.array(base), pa.array(score)], schema=schema)

        for b in it:
            for r in b.to_pylist():
                if r["part"] < 0:
                    if row is not None:
                        yield result()
                    row, replies = r, []
                else:
                    replies.append(r)
        if row is not None:
            yield result()

    told_rows = answers.select("block", "part", *(F.lit(None).cast("binary").alias(c) for c in ("ids", "valid", "held", "lengths", "words", "tokens")), "uni", "bi")
    both = blocks.select("block", "part", "ids", "valid", "held", "lengths", "words", "tokens", *(F.lit(None).cast("binary").alias(c) for c in ("uni", "bi"))).unionByName(told_rows)
    tasks = max(partitions(spark), n_blocks)
    found = stored(both.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(run, SCORED), "lm-scores")
    dropped(blocks, answers)
    return found
