"""Hashed maximum-entropy language model with a class-factored softmax.

The next token's outcome (a frequent word, or a bucket of the others) has a
class and a slot: P(outcome | history) = P(class | history) * P(slot | class,
history). Below a bucket, a tree of FORK branches a node leads to leaves, and each
branch has its probability given the history too. All factors are softmaxes over
hashed n-gram and skip features of the history. The words of one leaf share it by
smoothed unigrams; the tree is as deep as the number of distinct words asks for,
and each bucket's most frequent words have different leaves.
Training runs distributed rounds: every task makes gradient updates over its
part of the text, starting from the same weights; the updates are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from itertools import repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import slices, stored, texts
from paperweave.worker import new_key, shared

CLASSES = 16
SLOTS = 16
BUCKETS = 128                # outcomes that stand for the words with some endings
SINGLE = CLASSES * SLOTS - BUCKETS
ENDING = 3                   # bytes of a word that choose its bucket
FORK = 16                    # branches of a node below a bucket
DEPTH = 2                    # levels below a bucket, at least
LEAF_WORDS = 128             # distinct words (most occur once) of a leaf on average, at most
WIDTHS = (CLASSES, SLOTS, FORK)
ROWS = (1 << 14, 1 << 15, 1 << 17)  # hashed features of the class, slot and branch softmaxes, at least
ROOT = 4                     # class rows for the square root of the number of distinct histories
SKETCH = 1024                # least hashes of histories by which these are counted
MORE = 16                    # times as many rows, at most: what is broadcast has a bound (185 MB of weights)
LEAVES = 1 << 23             # leaves at most; beyond it, more words share one
KNOWN = 1 << 18              # words whose counts are broadcast, at most; others are joined
KNOWN_BYTES = 32 << 20       # of these words
FLUSH = 1 << 19              # distinct words that a counting task holds
PIECE = 1 << 20              # bytes of text that a task works on at once
TOKEN_BITS = 15
BATCH = 1 << TOKEN_BITS      # tokens of one gradient update
RATE = 1.0
SHRINK = 4.0                 # a row's gradient is its sum over this many occurrences more than it has
LIMIT = 8.0                  # of a weight: sums of a few stay within what an exponential can take
LIMITED = 4                  # batches after which the weights are brought back to it
ROUNDS = 2
BLOCK = 512                  # rows of weights that are averaged together
SENT = 512                   # blocks that are broadcast at once: the driver never holds all weights
ROW_TOKENS = 8               # training tokens of a task for each row of the weights, unless tasks get too few
FAN = 256                    # tasks whose updates are added up first
END = b""                    # the end token: no word is empty
BINS = 16


def tokens_of(rows: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts (words with A-Z lowered, then the end), and how many each has."""
    out: list[bytes] = []
    size = np.empty(len(rows), np.int64)
    for i, r in enumerate(rows):
        words = r.lower().split()           # of bytes: splits at \\x20 and \\x09-\\x0D only
        words.append(END)
        size[i] = len(words)
        out += words
    return out, size


def histories_of(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For tokens with these word hashes, in texts of these sizes, hashes of:
    the word before, the two words before, the word two before (skip). At a
    text's start, the words before are marks."""
    first = np.cumsum(size) - size
    w1, w2 = np.roll(hashes, 1), np.roll(hashes, 2)
    w1[first] = w2[first] = 1 << 40
    w2[first[size > 1] + 1] = 1 << 40
    with np.errstate(over="ignore"):
        a = (w1 + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        b = (w2 + np.uint64(11)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = np.stack([a, a ^ (b * np.uint64(0x165667B19E3779F9)), b])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(token, n, history)`` of the ``text`` column: tokens, counted in the
    tasks, then summed (no history); and the least hashes of each task's
    histories (no token, n 0), by which ``distinct_histories`` counts these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter = Counter()
        least = np.zeros(0, np.uint64)

        def flush(least=()):
            token = pa.array(list(held.keys()) + [None] * len(least), pa.binary()).cast(pa.string())
            n = pa.array(list(held.values()) + [0] * len(least), pa.int64())
            history = pa.array([None] * len(held) + list(least), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([token, n, history], names=["token", "n", "history"])

        for batch in batches:
            for part in slices(batch, "text", PIECE):
                words, size = tokens_of(texts(part))
                held.update(words)
                h = histories_of(word_hashes(words), size) >> np.uint64(1)
                if len(least) == SKETCH:
                    h = h[h < least[-1]]
                least = np.unique(np.concatenate([least, h.ravel()]))[:SKETCH]
                if len(held) > FLUSH:
                    yield flush()
        yield flush(least.tolist())

    return docs.mapInArrow(run, "token string, n long, history long").groupBy("token", "history").agg(F.sum("n").alias("n"))


def distinct_histories(counts: DataFrame) -> int:
    """From the SKETCH least hashes of all tasks (a few hundredths off; exact if there are fewer)."""
    least = [r.history for r in counts.where("history is not null").select("history").distinct().orderBy("history").limit(SKETCH).collect()]
    return len(least) if len(least) < SKETCH else round((SKETCH - 1) / (least[-1] / 2 ** 63))


def rows_for(histories: int) -> tuple[int, ...]:
    """Rows of the weights: grow with the square root of the number of
    distinct histories, so four times the histories have twice the rows, up to MORE times the least."""
    more = 1
    while more < MORE and ROWS[0] * more < ROOT * histories ** 0.5:
        more *= 2
    return tuple(n * more for n in ROWS)


class Vocabulary(NamedTuple):
    """What the tasks know of the counts. Words are in order of falling counts."""
    words: list[bytes]
    counts: np.ndarray
    outcome: np.ndarray      # of each word: its number if it is single, else SINGLE + its leaf
    n: int                   # all tokens
    distinct: int
    bucket_n: np.ndarray     # tokens and words in each leaf of each bucket
    bucket_words: np.ndarray


def bucket_of(word: bytes) -> int:
    """By the word's ending, which tells languages and word forms apart."""
    return crc32(word[-ENDING:]) % BUCKETS


def leaf_of(word: bytes, leaves: int) -> int:
    """The leaf, of all buckets' leaves, of a word that is not among the most frequent."""
    inner = leaves // BUCKETS
    return bucket_of(word) * inner + (crc32(word) >> 8) % inner


def leaves_for(distinct: int) -> int:
    """Leaves of all buckets: grow with the number of distinct words."""
    leaves = BUCKETS * FORK ** DEPTH
    while leaves < LEAVES and leaves * LEAF_WORDS < distinct:
        leaves *= FORK
    return leaves


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, KNOWN and KNOWN_BYTES at most: those above the count that a
    histogram of counts shows to leave no more, long words too. Driver and tasks hold these
    and the sums of at most LEAVES leaves."""
    step = F.floor(BINS * F.log2(F.col("n"))).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.count("*"), F.sum(F.octet_length("token")), F.sum("n")).collect()
    n, distinct = sum(r[3] for r in bins), sum(r[1] for r in bins)
    least, held, size = None, 0, 0
    for b, k, z, _ in sorted(bins, reverse=True):
        held, size = held + k, size + z
        if held > KNOWN or size > KNOWN_BYTES:
            break
        least = b
    keep = counts.where(step >= least) if least is not None else counts.limit(0)
    end = counts.where("token = ''")
    got = keep.where("token != ''").unionByName(end).toArrow()
    rows = sorted(zip(got.column("token").cast(pa.binary()).to_pylist(), got.column("n").to_pylist(), strict=True),
                  key=lambda r: (r[0] != END, -r[1], r[0]))
    if not rows or rows[0][0] != END:
        rows.insert(0, (END, 0))
    words = [w for w, _ in rows]
    leaves = leaves_for(distinct)
    inner = leaves // BUCKETS
    bytes_of = F.encode("token", "UTF-8")
    ending = F.when(F.octet_length("token") > ENDING, F.substring(bytes_of, -ENDING, ENDING)).otherwise(bytes_of)
    leaf = F.crc32(ending) % BUCKETS * inner + F.shiftright(F.crc32(bytes_of), 8) % inner
    total, kinds = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
    sums = counts.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("s"), F.count("*").alias("k")).toArrow()
    at = sums.column("leaf").to_numpy()
    total[at], kinds[at] = sums.column("s").to_numpy(), sums.column("k").to_numpy()
    outcome, ranks = np.arange(len(words), dtype=np.int64), [0] * BUCKETS
    for i, (w, c) in enumerate(rows):        # single words are in no leaf, others of a bucket take turns
        if c:
            old = leaf_of(w, leaves)
            total[old] -= c
            kinds[old] -= 1
        if i >= SINGLE:
            b = bucket_of(w)
            new = b * inner + ranks[b] % inner
            ranks[b] += 1
            outcome[i] = SINGLE + new
            total[new] += c
            kinds[new] += 1
    return Vocabulary(words, np.array([c for _, c in rows], np.int64), outcome, n, distinct, total, kinds)


class Model:
    """Weights of the softmaxes, and the batches' forward and gradient steps."""

    def __init__(self, v: Vocabulary, weights: list[np.ndarray] | None):
        self.ids = dict(zip(v.words, range(len(v.words)), strict=True))
        self.hashes = word_hashes(v.words)
        self.outcome = v.outcome
        self.leaves = len(v.bucket_n)
        self.spans = []                      # leaves below a branch, level by level
        span = self.leaves // BUCKETS
        while span > 1:
            span //= FORK
            self.spans.append(span)
        weight = np.full(CLASSES * SLOTS, 0.5)
        weight[:min(SINGLE, len(v.words))] += v.counts[:SINGLE]
        weight[SINGLE:] += v.bucket_n.reshape(BUCKETS, -1).sum(axis=1)
        table = weight.reshape(CLASSES, SLOTS)
        self.bias = [np.log(table.sum(axis=1) / table.sum()).astype(np.float32),
                     np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)]
        for span in self.spans:
            table = v.bucket_n.reshape(-1, FORK, span).sum(axis=2) + 0.5
            self.bias.append(np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))
        self.weights = weights or [np.zeros((n, k), np.float32) for n, k in zip(ROWS, WIDTHS, strict=True)]

    def own(self) -> Model:
        """The same model with weights that can be changed."""
        out = copy(self)
        out.weights = [w.copy() for w in self.weights]
        out._moves, out._where = np.empty((BATCH, max(WIDTHS)), np.float32), np.empty((BATCH, max(WIDTHS) // 2), np.int64)
        return out

    def read(self, rows: Sequence[bytes]):
        """Words, their numbers (negative: rare) and outcomes, the rare ones, features and sizes of texts."""
        words, size = tokens_of(rows)
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(ids < 0)
        rare_words = [words[i] for i in rare.tolist()]
        out = self.outcome[ids]
        out[rare] = SINGLE + np.fromiter(map(leaf_of, rare_words, repeat(self.leaves)), np.int64, len(rare))
        hashes = self.hashes[ids]
        hashes[rare] = word_hashes(rare_words)
        return words, ids, out, rare, rare_words, histories_of(hashes, size), size

    def _places(self, k: int, features: np.ndarray, node: np.ndarray | None) -> np.ndarray:
        """Rows of the weights ``k`` for the features at a node of the tree (the root has none)."""
        rows = len(self.weights[k])
        if node is None:
            return (features & np.uint64(rows - 1)).astype(np.int64)
        with np.errstate(over="ignore"):
            mixed = (features + node.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        return (mixed >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)

    def _exponents(self, k: int, bias: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Logits of the branches for each token: the bias is a log
        probability and weights are limited, so their exponentials are finite."""
        width = self.weights[k].shape[1]
        whole = self.weights[k].view(np.dtype((np.void, 4 * width))).ravel()    # rows travel as one item each
        x = None
        for p in places:
            part = whole.take(p).view(np.float32).reshape(-1, width)
            x = part if x is None else np.add(x, part, out=x)
        x += bias
        return x

    def _factors(self, out: np.ndarray, features: np.ndarray):
        """For each softmax on the way to the outcomes: which weights, the
        tokens (None: all), logits, what was seen, and the rows of the weights."""
        top, deep = out, None
        if self.spans:
            deep = np.flatnonzero(out >= SINGLE)
            leaf = out[deep] - SINGLE
            top = out.copy()
            top[deep] = SINGLE + leaf // (self.leaves // BUCKETS)
        cls, slot = top // SLOTS, top % SLOTS
        places = self._places(0, features, None)
        yield 0, None, self._exponents(0, self.bias[0][None, :], places), cls, places
        places = self._places(1, features, cls)
        yield 1, None, self._exponents(1, np.take(self.bias[1], cls, axis=0), places), slot, places
        if self.spans and len(deep):
            features, first = features[:, deep], CLASSES
            for level, span in enumerate(self.spans):
                node, branch = leaf // (span * FORK), leaf // span % FORK
                places = self._places(2, features, first + node)
                yield 2, deep, self._exponents(2, np.take(self.bias[2 + level], node, axis=0), places), branch, places
                first += self.leaves // (span * FORK)

    def log_probability(self, out: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Natural logarithm of each outcome's probability."""
        total = np.zeros(len(out))
        for at in range(0, len(out), BATCH):
            part = total[at:at + BATCH]
            for _, who, x, hit, _ in self._factors(out[at:at + BATCH], features[:, at:at + BATCH]):
                own = x[np.arange(len(hit)), hit].astype(np.float64)
                part[slice(None) if who is None else who] += own - np.log((np.exp(x, out=x) @ np.ones(x.shape[1], np.float32)).astype(np.float64))
        return total

    def step(self, out: np.ndarray, features: np.ndarray, rate: float, touched: list[np.ndarray]) -> None:
        """One gradient update, over BATCH tokens at most, of all rows that these use: a
        row moves by the sum of its tokens' errors over SHRINK more than their number. Work and
        memory follow the tokens, not the size of the weights; ``touched`` counts the tokens of each row."""
        for k, _, x, hit, places in self._factors(out, features):
            n, width = x.shape
            err = np.exp(x, out=x)
            err /= (err @ np.ones(width, np.float32))[:, None]
            err[np.arange(n), hit] -= 1
            # two weights travel as one complex number, which halves the steps of the scatter
            flat, half, seen = self.weights[k].view(np.complex64).reshape(-1), width // 2, touched[k]
            move, where = self._moves[:n, :width], self._where[:n, :half]
            for p in places:
                before = seen[p]
                np.add.at(seen, p, np.float32(1))
                np.multiply(err, (rate / (seen[p] - before + SHRINK)).astype(np.float32)[:, None], out=move)
                np.add((p * half)[:, None], np.arange(half), out=where)
                np.subtract.at(flat, where.reshape(-1), move.view(np.complex64).reshape(-1))

    def limit(self) -> None:
        """Bring the weights back between the limits. A batch moves a row by less than three, so after LIMITED batches
        the exponentials are still finite."""
        for w in self.weights:
            np.clip(w, -LIMIT, LIMIT, out=w)


class Sent(NamedTuple):
    """What the tasks get: the vocabulary as a plain tuple, and the weights in
    broadcasts of SENT blocks. The tasks of a worker share the model that ``key`` names."""
    key: str
    vocabulary: Broadcast
    rows: tuple[int, ...]
    chunks: tuple[Broadcast, ...]

    def model(self) -> Model:
        def make() -> Model:
            weights = [np.zeros((n, k), np.float32) for n, k in zip(self.rows, WIDTHS, strict=True)]
            blocks = [w[at:at + BLOCK] for w in weights for at in range(0, len(w), BLOCK)]
            for chunk in self.chunks:
                for block, values in chunk.value:
                    blocks[block][:] = np.frombuffer(values, np.float32).reshape(blocks[block].shape)
            return Model(Vocabulary(*self.vocabulary.value), weights)

        return shared(self.key, make, slot="maxent")


def _train_tasks(sent: tuple):
    """Task function: updates over the task's texts in; per block of rows the
    change, weighted by how often each row was used, out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Sent(*sent).model()
        model = base.own()
        touched, batch_no = [np.zeros(len(w), np.float32) for w in model.weights], 0
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                _, _, out, _, _, features, _ = model.read(texts(part))
                for at in range(0, len(out), BATCH):
                    model.step(out[at:at + BATCH], features[:, at:at + BATCH], RATE / np.sqrt(1 + batch_no / 16), touched)
                    batch_no += 1
                    if batch_no % LIMITED == 0:
                        model.limit()
        model.limit()
        task, rows = TaskContext.get().partitionId(), []
        block = 0
        for old, new, used in zip(base.weights, model.weights, touched, strict=True):
            for at in range(0, len(old), BLOCK):
                if used[at:at + BLOCK].any():
                    change = (new[at:at + BLOCK] - old[at:at + BLOCK]).astype(np.float16)
                    rows.append((block, task // FAN, change.tobytes(), used[at:at + BLOCK].tobytes()))
                block += 1
        yield _rows(rows)

    return run


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["block", "part", "change", "used"])


def _average(kind):
    """Group function: the mean change of a block's rows over the tasks that used them."""
    def run(t: pa.Table) -> pa.Table:
        total = used = None
        for c, u in sorted(zip(t.column("change").to_pylist(), t.column("used").to_pylist(), strict=True)):
            n = np.frombuffer(u, np.float32).astype(np.float64)
            x = np.frombuffer(c, kind).reshape(len(n), -1) * n[:, None]
            total, used = (x, n) if total is None else (total + x, used + n)
        mean = (total / np.maximum(used, 1)[:, None]).astype(np.float32)
        return pa.Table.from_batches([_rows([(t.column("block")[0].as_py(), t.column("part")[0].as_py(), mean.tobytes(),
                                              used.astype(np.float32).tobytes())])])

    return run


def _add(t: pa.Table) -> pa.Table:
    """Group function: a block's weights and the mean change of its rows, added up."""
    total = sum(np.frombuffer(c, np.float32) for c in t.column("change").to_pylist())
    return pa.Table.from_batches([_rows([(t.column("block")[0].as_py(), 0, total.tobytes(), b"")])])


def _send(vocab: Broadcast, rows: Sequence[int], table: DataFrame | None) -> Sent:
    """The weights as broadcasts; the driver holds one of these at a time."""
    chunks, blocks = [], sum(-(-n // BLOCK) for n in rows)
    for lo in range(0, blocks if table is not None else 0, SENT):
        part = table.where(F.col("block").between(lo, lo + SENT - 1)).select("block", "change").toArrow()
        chunks.append(table.sparkSession.sparkContext.broadcast(
            list(zip(part.column("block").to_pylist(), part.column("change").to_pylist(), strict=True))))
    return Sent(new_key(), vocab, tuple(rows), tuple(chunks))


def train(docs: DataFrame, vocab: Broadcast, rounds: int = ROUNDS, rows: Sequence[int] = ROWS) -> Sent:
    """The model after the rounds; ``docs`` has ``text`` and ``round`` (0 to
    rounds - 1), the round that the row is used in. The weights are a stored table of
    blocks of rows; updates are averaged in two levels of groups and added to it. Small
    parts of the text are trained in one task, so that all tasks' changes of
    the weights stay in proportion to the text as the rows grow."""
    schema = "block int, part int, change binary, used binary"
    sc = docs.sparkSession.sparkContext
    tokens = Vocabulary(*vocab.value).n
    docs = docs.coalesce(max(sc.defaultParallelism, tokens // (ROW_TOKENS * sum(rows))))
    sent, table = _send(vocab, rows, None), None
    for r in range(rounds):
        changes = docs.where(F.col("round") == r).select("text").mapInArrow(_train_tasks(tuple(sent)), schema)
        some = changes.groupBy("block", "part").applyInArrow(_average(np.float16), schema)
        mean = some.groupBy("block").applyInArrow(_average(np.float32), schema)
        table = stored(mean if table is None else table.unionByName(mean).groupBy("block").applyInArrow(_add, schema), "weights")
        for chunk in sent.chunks:
            chunk.destroy()
        sent = _send(vocab, rows, table)
    return sent


SCORED = "row long, id {}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>"


def _score_tasks(sent: tuple):
    """Task function: scores of all but the rare words' own counts, which are to be joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Sent(*sent).model()
        v = Vocabulary(*sent[1].value)
        inside = np.log10(v.bucket_n + v.bucket_words + 1.0)
        log_count = np.log10(v.counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                rows = texts(part)
                _, ids, out, rare, rare_words, features, size = model.read(rows)
                doc = np.repeat(np.arange(len(rows)), size)
                known = ids >= 0
                count = np.zeros(len(ids))
                count[known] = log_count[ids[known]]
                base = count - np.log10(v.n + v.distinct + 1.0)
                score = model.log_probability(out, features) / np.log(10)
                bucket = out >= SINGLE
                score[bucket] += count[bucket] - inside[out[bucket] - SINGLE]
                total = lambda x: np.bincount(doc, weights=x, minlength=len(rows))
                seen = known & (v.counts[np.maximum(ids, 0)] > 0)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(rows)))])
                words = pa.array(rare_words, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(rows))), part.column("id"), part.column("held_out"), pa.array(size),
                     pa.array(total(seen).astype(np.int64)), pa.array(total(base)), pa.array(total(score)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words)],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
                row += len(rows)

    return run


def lm_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text",
              rounds: int = ROUNDS) -> DataFrame:
    """One row per document (repeated rows included): ``id_col``, ``held_out``,
    ``n_tokens``, ``n_known`` (tokens that training has), ``train_tokens``,
    ``base_score`` (smoothed unigrams) and ``score``, the model's log10
    probability of the text. The model learns from every row that isn't held out
    (a null ``held_out`` counts as not); each is used in one round.

    Texts are scored where they are read. Counts of all words but the KNOWN
    most frequent ones come by a join of the rare words, which are a few
    hundredths of the tokens and no hot keys, since frequent words aren't among them.
    The weights grow with the square root of the distinct histories up to MORE times the least,
    the counts with the distinct words.

    Null or empty text: the end token alone. Texts of any length are read whole, one
    word or none among them. Null ids stay null. Other columns
    are not read. An empty table gives no rows; without training rows every
    word is unknown.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.pmod(F.xxhash64(F.col(id_col), F.lit("round")), F.lit(rounds)).cast("int").alias("round"))
    training = rows.where("not held_out")
    counted = stored(count_tokens(training.select("text")), "counts")
    counts = counted.where("history is null").select("token", "n")
    v = vocabulary(counts)
    sc = docs.sparkSession.sparkContext
    sent = train(training, sc.broadcast(tuple(v)), rounds, rows_for(distinct_histories(counted)))
    scored = stored(rows.select("id", "text", "held_out").mapInArrow(_score_tasks(tuple(sent)), SCORED.format(id_type)), "scored")
    rare = (scored.select("row", F.explode("rare").alias("token")).join(counts, "token")
            .groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("x")))
    zero = F.lit(0)
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("x", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("x", zero)).alias("score"))
