"""Benchmark decontamination: SimHash fingerprints of item-sized windows,
looked up in a multi-index of Hamming blocks, then verified exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import slices, texts

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 19                  # a pair at the least similarity differs in about 10 +- 3 of 64 bits
BLOCKS, WIDTH = 8, 8
NEAR = RADIUS // BLOCKS      # of two fingerprints within the radius, one block differs in this many bits at most
DROPPED = b".,;:!?\"'()[]{}"
BATCH_ITEMS = 10_000         # items of one index, and
BATCH_BYTES = 32 << 20       # their text: larger benchmarks are searched batch by batch
FLIPS = np.array([sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(WIDTH), n)], np.int64)


class Match(NamedTuple):
    item: int                # position in the index
    similarity: float
    distance: int
    start: int               # in words
    words: int


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without ASCII punctuation."""
    return text.lower().translate(None, DROPPED).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k words in a row."""
    n = len(word_hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if n > 0 else 0):
            out = out * np.uint64(0x100000001B3) + word_hashes[j:j + n]
        return _mix(out)


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start on."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upto = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = upto[starts + n] - upto[starts]
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight of two shingle multisets."""
    shared = sum(min(n, b[s]) for s, n in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def _shingles(words: Sequence[bytes], k: int) -> Counter:
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def least_shared(n: int, similar: float) -> int:
    """Of n shingles each, so many are shared at least by similar windows."""
    return int(np.ceil(2 * n * similar / (1 + similar) - 1e-9))


class Index:
    """The items of a batch: their shingles, fingerprints and Hamming blocks."""

    def __init__(self, items: Sequence[bytes], similar: float = SIMILAR):
        import xxhash

        self.similar = similar
        self.words = [words_of(t) for t in items]
        known = sorted({w for ws in self.words for w in ws})
        self.vocabulary = {w: i + 1 for i, w in enumerate(known)}
        self.hash_word = lambda w: xxhash.xxh64_intdigest(w, 42)
        self.word_hash = np.array([0, *map(self.hash_word, known)], np.uint64)
        self.kinds: dict[tuple[int, int], list[int]] = {}           # by shingle length and number of words
        self.shingle_sets: dict[int, np.ndarray] = {}
        self.counts, prints = [], []
        found: dict[int, list[np.ndarray]] = {}
        for i, ws in enumerate(self.words):
            k = min(SHINGLE, len(ws))
            self.counts.append(_shingles(ws, k) if ws else Counter())
            if not ws:
                prints.append(0)
                continue
            self.kinds.setdefault((k, len(ws)), []).append(i)
            h = shingle_hashes(self.word_hash[[self.vocabulary[w] for w in ws]], k)
            found.setdefault(k, []).append(h)
            prints.append(int(window_fingerprints(h, np.zeros(1, np.int64), len(h))[0]))
        self.prints = np.array(prints, np.uint64)
        self.shingle_sets = {k: np.unique(np.concatenate(hs)) for k, hs in found.items()}
        self.blocks = {kind: self._blocks(np.array(own)) for kind, own in self.kinds.items()}

    def _blocks(self, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block the items by every block value within NEAR bits of theirs."""
        out = []
        for b in range(BLOCKS):
            value = (self.prints[own] >> np.uint64(b * WIDTH)).astype(np.int64) & ((1 << WIDTH) - 1)
            keys = (value[:, None] ^ FLIPS[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            first = np.searchsorted(keys[order], np.arange((1 << WIDTH) + 1))
            out.append((first, np.repeat(own, len(FLIPS))[order]))
        return out

    def near(self, kind: tuple[int, int], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item of that kind) within the radius."""
        pairs = []
        for b, (first, own) in enumerate(self.blocks[kind]):
            value = (prints >> np.uint64(b * WIDTH)).astype(np.int64) & ((1 << WIDTH) - 1)
            size = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[value], size)
            item = own[at]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            pairs.append(np.stack([window[close], item[close]], axis=1))
        both = np.unique(np.concatenate(pairs), axis=0)
        return both[:, 0], both[:, 1]

    def hits(self, ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
        """Positions of the shingles of known words that some item has."""
        n = len(ids) - k + 1
        if n <= 0 or k not in self.shingle_sets:
            return np.zeros(0, np.int64)
        known = ids > 0
        run = known[:n].copy()
        for j in range(1, k):
            run &= known[j:j + n]
        at = np.flatnonzero(run & (doc[:n] == doc[k - 1:]))
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = h * np.uint64(0x100000001B3) + self.word_hash[ids[at + j]]
            h = _mix(h)
        pool = self.shingle_sets[k]
        return at[pool[np.minimum(np.searchsorted(pool, h), len(pool) - 1)] == h]

    def search(self, rows: Sequence[bytes]) -> dict[int, list[Match]]:
        """The best window of each item that some window of a text is similar
        to, by row. A window is fingerprinted if so many of its shingles occur
        in the benchmark that it can be similar to an item of its size; other
        windows can't, so none is missed for that."""
        split = [words_of(r) for r in rows]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        doc = np.repeat(np.arange(len(split)), sizes)
        ids = np.fromiter(map(self.vocabulary.get, (w for ws in split for w in ws), repeat(0)), np.int64, int(sizes.sum()))
        base = np.cumsum(sizes) - sizes
        out: dict[int, list[Match]] = {}
        for k in self.shingle_sets:
            at = self.hits(ids, doc, k)
            own = doc[at]
            least = min(least_shared(n - k + 1, self.similar) for kk, n in self.kinds if kk == k)
            rows_with, first, count = np.unique(own, return_index=True, return_counts=True)
            for r, a, c in zip(rows_with.tolist(), first.tolist(), count.tolist(), strict=True):
                if c >= least:
                    if got := self._search_row(split[r], at[a:a + c] - base[r], k):
                        out.setdefault(r, []).extend(got)
        return out

    def _search_row(self, words: list[bytes], hits: np.ndarray, k: int) -> list[Match]:
        # Only the stretch around the hits can hold a window.
        reach = max(n for kk, n in self.kinds if kk == k)
        lo, hi = max(0, int(hits[0]) - reach), min(len(words), int(hits[-1]) + k + reach)
        near = words[lo:hi]
        flag = np.zeros(len(near) - k + 2, np.int64)
        flag[hits - lo + 1] = 1
        upto = np.cumsum(flag)
        hashes, best = None, {}
        for kind in self.kinds:
            size, n = kind[1], kind[1] - k + 1
            if kind[0] != k or size > len(near):
                continue
            starts = np.flatnonzero(upto[n:] - upto[:len(upto) - n] >= least_shared(n, self.similar))
            if not len(starts):
                continue
            if hashes is None:
                hashes = shingle_hashes(np.fromiter(map(self.hash_word, near), np.uint64, len(near)), k)
            prints = window_fingerprints(hashes, starts, n)
            for w, i in zip(*(x.tolist() for x in self.near(kind, prints)), strict=True):
                s = int(starts[w])
                similarity = weighted_similarity(_shingles(near[s:s + size], k), self.counts[i])
                if similarity >= self.similar:
                    distance = int(np.bitwise_count(prints[w] ^ self.prints[i]))
                    key = (-similarity, distance, s + lo)
                    if i not in best or key < best[i][0]:
                        best[i] = (key, Match(i, similarity, distance, s + lo, size))
        return [m for _, m in best.values()]


def _indexes(items: DataFrame, id_col: str, text_col: str, similar: float):
    """The items' ids and broadcast indexes, batch by batch. Each batch is
    bounded in items and bytes, and so is what the driver holds and broadcasts."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    batches = max(1, -(-n // BATCH_ITEMS), -(-size // BATCH_BYTES))
    batches = 1 if batches == 1 else 2 * batches
    for b in range(batches):
        part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(batches)) == b)
        got = part.orderBy("id", "text").collect()
        if got:
            sc = items.sparkSession.sparkContext
            yield [r.id for r in got], sc.broadcast([r.text.encode("utf-8") for r in got])


def benchmark_matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document and benchmark item that it holds: ``id_col``,
    ``item_col``, ``similarity`` (weighted, of five-word shingles; of whole
    items below five words), ``distance`` (bits), ``word_start`` and
    ``n_words`` of the best window. Repeated documents give rows each time;
    repeated item ids are items of their own.

    No shuffle: the benchmark is the stated query set, broadcast in batches
    bounded by BATCH_ITEMS and BATCH_BYTES, and each batch scans the documents
    once. Null, empty and wordless texts or items match nothing; null ids stay
    null; other columns are not read; empty tables give no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = (f"id {id_type.simpleString()}, item {item_type.simpleString()}, similarity double, distance int, "
              "word_start long, n_words int")
    out = None
    for names, content in _indexes(items, item_col, item_text_col, similar):
        def run(batches: Iterator[pa.RecordBatch], names=names, content=content) -> Iterator[pa.RecordBatch]:
            index = Index(content.value, similar)
            for batch in batches:
                for part in slices(batch, "text"):
                    found = [(r, m) for r, ms in index.search(texts(part)).items() for m in ms]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array([r for r, _ in found], pa.int64())),
                         pa.array([names[m.item] for _, m in found]).cast(item_arrow),
                         pa.array([m.similarity for _, m in found], pa.float64()),
                         pa.array([m.distance for _, m in found], pa.int32()),
                         pa.array([m.start for _, m in found], pa.int64()),
                         pa.array([m.words for _, m in found], pa.int32())],
                        names=["id", "item", "similarity", "distance", "word_start", "n_words"])

        from pyspark.sql.pandas.types import to_arrow_type
        item_arrow = to_arrow_type(item_type)
        got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_benchmark(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item.
    Cases as in ``benchmark_matches``."""
    for _, content in _indexes(items, item_col, item_text_col, similar):
        def run(batches: Iterator[pa.RecordBatch], content=content) -> Iterator[pa.RecordBatch]:
            index = Index(content.value, similar)
            for batch in batches:
                for part in slices(batch, text_col):
                    bad = index.search(texts(part, text_col))
                    yield part.filter(pa.array([r not in bad for r in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
