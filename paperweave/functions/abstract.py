"""Abstract inverted index: build (F4 shape) and rebuild prose."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.schemas import ABSTRACT_MAP

# Words of a text are the runs between these whitespace characters.
WORD_SPLIT = "[ \t\n\r]+"
_WORD_SPLIT_RE = re.compile(WORD_SPLIT)
PIECE = 1 << 20              # bytes of text that a task works on at once


def pieces(array: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    """Slices of a string array of about ``max_bytes`` (one longer text is a slice of its own)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(array):
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
        yield array.slice(at, end - at)
        at = end


def _index_one(text):
    if text is None:
        return None
    postings: dict[str, list[int]] = {}
    pos = 0
    for word in _WORD_SPLIT_RE.split(text):
        if word:
            postings.setdefault(word, []).append(pos)
            pos += 1
    if not postings:
        return None
    # keys in order of first occurrence, compact separators
    return json.dumps(postings, ensure_ascii=False, separators=(",", ":"))


@F.arrow_udf(T.StringType())
def inverted_index_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Word -> positions JSON object of a text (the snapshot's abstract
    format). A per-row helper run on Arrow batches, in pieces of PIECE bytes
    of text, which is what a task holds as Python objects; NULL for a text without
    words."""
    for texts in batches:
        for piece in pieces(texts, PIECE):
            yield pa.array([_index_one(t) for t in piece.to_pylist()], pa.string())


def rebuild_abstract(index_json: Column) -> Column:
    """prose from a word -> positions JSON object, words ordered by
    position and joined by one space; JVM-side higher-order functions."""
    m = F.from_json(index_json, ABSTRACT_MAP)
    placed = F.flatten(F.transform(
        F.map_entries(m),
        lambda e: F.transform(e.getField("value"),
                              lambda p: F.struct(p.alias("pos"), e.getField("key").alias("word")))))
    ordered = F.array_sort(placed)
    return F.array_join(F.transform(ordered, lambda s: s.getField("word")), " ")
