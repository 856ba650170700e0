"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is cut into marked words (the mark is the escaped space) that no piece
of the vocabulary crosses. The distinct words of a slice are sorted, which is a
depth-first walk of their trie: a word keeps the forward scores of the prefix
that it shares with the one before and computes the rest. For a unigram model
a forward score is the best sum of piece scores. For a BPE model only one
segmentation is admissible, so none has to be weighed: two pieces may follow
each other if the merges, run on their concatenation, give just these two. The
forward state of a prefix is the last piece of its admissible path, and the
result is that of the merges.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.llm.common import slices
from paperweave.worker import new_key, shared

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6      # fixed values of the model format's piece types
UNK_PENALTY = 10.0                   # fixed value: below the lowest score, for an unknown character
LONG = 1 << 16                       # characters of a word whose forward pass is kept in plain arrays
PIECE = 1 << 20                      # bytes of text that a task works on at once
CACHED_WORDS = 1 << 17               # of a worker, beside those of the slice at hand
CACHED_PAIRS = 1 << 19               # of pieces, whether one may follow the other


class Pieces:
    """A vocabulary, and the forward pass over its words."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or \
                norm.remove_extra_whitespaces or not m.trainer_spec.byte_fallback or \
                any(p.type not in (NORMAL, UNKNOWN, BYTE, 3) for p in m.pieces):
            raise ValueError("needs a unigram or BPE model with byte fallback, without normalisation")
        self.bpe = m.trainer_spec.model_type == BPE
        self.prefix = norm.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        self.score = [p.score for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        # Every tail of a piece; with its id if it is one itself, else -1.
        self.tails = {w[i:]: self.ids.get(w[i:], -1) for w in self.ids for i in range(len(w))}
        self.unk = min(self.score[i] for i in self.ids.values()) - UNK_PENALTY
        self._pairs: dict[int, bool] = {}
        raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode()
               if p.type == NORMAL else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in m.pieces]
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        chars = {c for w in self.ids for c in w}
        crossed = any(MARK in w.lstrip(MARK) for w in self.ids)
        alone = "" if "\n" in chars else "\n"
        self.words = re.compile("(?s).+" if crossed else f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + "|\n" * bool(alone))

    def merges(self, word: str) -> list[str]:
        """The merges of a BPE model run on a short word, best score first."""
        parts = list(word)
        while True:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1)
                        if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand behind piece a (-1: nothing or a character without a piece)."""
        if len(self._pairs) > CACHED_PAIRS:
            self._pairs.clear()
        left = [] if a < 0 else [self.text[a]]
        fits = self.merges("".join(left) + self.text[b]) == [*left, self.text[b]]
        self._pairs[a << 20 | b] = fits
        return fits

    def encode_words(self, words: Sequence[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted distinct ``words``."""
        extend = self._extend_bpe if self.bpe else self._extend_unigram
        # By prefix length: forward score, start and id of the last piece on the best path (-1: unknown character).
        total, start, piece, before = [0.0], [0], [-1], ""
        for word in words:
            if len(word) > LONG:
                path = array("d", total[:1]), array("i", start[:1]), array("i", piece[:1])
                extend(word, 0, *path)
                yield self._backtrack(word, path[1], path[2])
                continue
            n = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                n += 1
            del total[n + 1:], start[n + 1:], piece[n + 1:]
            extend(word, n, total, start, piece)
            before = word
            yield self._backtrack(word, start, piece)

    def _backtrack(self, word, start, piece) -> list[int]:
        out, end = [], len(word)
        while end:
            i = piece[end]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in reversed(word[end - 1].encode("utf-8")))
            end = start[end]
        out.reverse()
        return out

    def _extend_unigram(self, word, n, total, start, piece) -> None:
        """Forward scores of the prefixes longer than n: the best sums."""
        tails, scores = self.tails, self.score
        for end in range(n + 1, len(word) + 1):
            best, at, which = None, end - 1, -1
            for s in range(end - 1, -1, -1):
                i = tails.get(word[s:end])
                if i is None:
                    break
                if i >= 0 and (best is None or total[s] + scores[i] > best):
                    best, at, which = total[s] + scores[i], s, i
            if word[end - 1] not in self.ids and (best is None or total[end - 1] + self.unk > best):
                best, at, which = total[end - 1] + self.unk, end - 1, -1
            total.append(best)
            start.append(at)
            piece.append(which)

    def _extend_bpe(self, word, n, total, start, piece) -> None:
        """Last pieces of the prefixes longer than n, on the admissible path."""
        tails, pairs = self.tails, self._pairs
        for end in range(n + 1, len(word) + 1):
            s, at, which = end - 1, end - 1, -1
            while s >= 0:
                i = tails.get(word[s:end])
                if i is None:
                    break
                if i >= 0:
                    fits = pairs.get(piece[s] << 20 | i)
                    if fits is None:
                        fits = self.follows(piece[s], i)
                    if fits:
                        at, which = s, i
                        break
                s -= 1
            start.append(at)
            piece.append(which)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, without the space that encoding puts first."""
        size = self.raw_len[ids]
        ends = np.cumsum(size)
        flat = self.raw[ragged(self.raw_at[ids], size)].tobytes()
        at = np.concatenate([np.zeros(1, np.int64), ends])[offsets]
        out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [b[1:] if self.prefix and b[:1] == b" " else b for b in out]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes slices of texts and keeps words that it has met."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, docs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets at which each document's ids start."""
        p = self.pieces
        found = [p.words.findall((MARK if p.prefix and d else "") + d.replace(" ", MARK)) for d in docs]
        new = set().union(*found) if found else set()
        if len(self.index) + len(new) > CACHED_WORDS:
            self._clear()
        new = sorted(new.difference(self.index))
        coded = list(p.encode_words(new))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for ids in coded for i in ids), np.int32, int(sizes.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, flat])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter((k for ws in found for k in map(self.index.__getitem__, ws)), np.int64, int(counts.sum()))
        sizes = self.size[at]
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        offsets = offsets[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]
        return self.flat[ragged(self.start[at], sizes)], offsets


def _model(df: DataFrame, path: str) -> Callable[[], Encoder]:
    """What gives a task the encoder of a model file, which the tasks of a Python worker share."""
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    key = new_key()
    return lambda: shared(key, lambda: Encoder(Pieces(sent.value)))


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids",
           check_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``ids_col`` (array<int>) added; a column of
    that name is replaced. With ``check_col``, also whether decoding the ids
    gives the text back (false only for texts that hold the mark itself).

    No shuffle. The model file is read by the driver and broadcast, its size is
    that of the file. A worker holds the words of one slice of a few megabytes
    and at most ``CACHED_WORDS`` earlier ones. A text without spaces is one
    word; its forward pass is linear in its length.

    Null or empty text: no ids. Repeated rows are encoded each time; an empty
    table gives no rows.
    """
    model = _model(docs, model_path)
    cols = [c for c in docs.columns if c not in (ids_col, check_col)]
    names = [f"c{i}" for i in range(len(cols))]
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model()
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                rows = [t or "" for t in part.column("text").to_pylist()]
                ids, offsets = encoder(rows)
                arrays = [part.column(n) for n in names]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
                if check_col:
                    back = encoder.pieces.decode(ids, offsets)
                    arrays.append(pa.array([b == t.encode("utf-8") for b, t in zip(back, rows, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"] + ["check"] * bool(check_col))

    schema = wide.drop("text").schema.add("ids", T.ArrayType(T.IntegerType(), False))
    if check_col:
        schema = schema.add("check", T.BooleanType())
    return wide.mapInArrow(run, schema).toDF(*cols, ids_col, *[check_col] * bool(check_col))


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` with ``text_col``, the text of the ids, added or
    replaced. Null ids or none: empty text. Bytes that are no UTF-8 become
    U+FFFD; an id outside the vocabulary fails."""
    model = _model(rows, model_path)
    cols = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model().pieces
        for batch in batches:
            lists = [x or [] for x in batch.column(ids_col).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            ids = np.fromiter((i for x in lists for i in x), np.int64, int(offsets[-1]))
            back = [b.decode("utf-8", "replace") for b in pieces.decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], pa.array(back, pa.string())],
                                             names=[*cols, text_col])

    return rows.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(
        run, rows.select(*[F.col(f"`{c}`") for c in cols]).schema.add(text_col, T.StringType()))
