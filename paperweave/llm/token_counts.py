"""Token counts of fields and sections: every document is encoded once as a
whole, and an interval join of token spans with section spans attributes the
tokens. Encoding the parts on their own would give other counts, since tokens
may cross their boundaries.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import slices, texts
from paperweave.worker import new_key, shared

#: Splits a text before the merges of the rank files: fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Which section a token belongs to that crosses a boundary: the one that holds
#: its first byte, the one that holds its last, or each by its share of bytes.
RULES = ("start", "end", "share")


#: White space (fixed value: the Unicode property) in runs that the pattern can't be tried on.
LONG = 10_000
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def _encoder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs})


def encode_whole(encoder, text: str) -> list[int]:
    """The tokens of the text. A very long run of white space overflows the
    pattern's stack, so such a run is one piece by itself, as the pattern would
    have it: all of it, but for the last character if something follows."""
    if len(text) < LONG:
        return encoder.encode_ordinary(text)
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoder.encode_ordinary(text[at:run.start()])
        out += encoder._encode_single_piece(text[run.start():end].encode("utf-8"))
        at = end
    return out + encoder.encode_ordinary(text[at:])


def token_edges(encoder, lengths: np.ndarray, docs: Sequence[bytes]) -> np.ndarray:
    """Byte offsets, in the concatenation of ``docs``, at which tokens start,
    and its end. A document's tokens cover it without gaps."""
    ids = [np.asarray(encode_whole(encoder, d.decode("utf-8")), np.int64) for d in docs]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[flat])])


def attribute(edges: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two sorted covers of the same bytes: the tokens between
    ``edges`` and the sections between ``bounds``. For each section its tokens
    by ``rule`` and the number of tokens that it shares with another one."""
    starts, ends = edges[:-1], edges[1:]
    if rule == "share":
        upto = np.interp(bounds, edges, np.arange(len(edges), dtype=np.float64))
    elif rule == "start":
        upto = np.searchsorted(starts, bounds, side="left")
    else:
        upto = np.searchsorted(ends, bounds, side="right")
    first = np.searchsorted(ends, bounds[:-1], side="right")          # tokens that touch the section: first to last - 1
    last = np.searchsorted(starts, bounds[1:], side="left")
    crossing = np.zeros(len(bounds) - 1, np.int64)
    some = (last > first) & (bounds[1:] > bounds[:-1])
    crossing[some] += starts[first[some]] < bounds[:-1][some]
    over = ends[last[some] - 1] > bounds[1:][some]
    once = (last[some] - first[some] > 1) | (starts[first[some]] >= bounds[:-1][some])
    crossing[some] += over & once
    return np.diff(upto), crossing


def section_bounds(docs: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sections of the concatenated ``docs``: their lines, each with its line
    break. Byte offsets of the boundaries, and the document of each section
    (an empty document has one empty section)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    breaks = np.flatnonzero(np.frombuffer(b"".join(docs), np.uint8) == 10) + 1
    inside = breaks[~np.isin(breaks, ends)]
    at = np.sort(np.concatenate([ends - sizes, inside]), kind="stable")
    owner = np.empty(len(at), np.int64)
    order = np.argsort(np.concatenate([ends - sizes, inside]), kind="stable")
    owner[:] = np.concatenate([np.arange(len(docs)),
                               np.searchsorted(ends, inside, side="right")])[order]
    return np.concatenate([at, ends[-1:]]), owner


def section_token_counts(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                         fields: Sequence[str] | None = None, rule: str = "start") -> DataFrame:
    """One row per document and section (line, with its line break): ``id_col``,
    ``section`` (from 0), ``char_start``, ``char_end`` (code points, end
    exclusive), ``n_tokens`` (double under the ``share`` rule, else long) and
    ``n_crossing``, the tokens that the section shares with a neighbour. The
    counts of a document's sections add up to the tokens of the whole. With
    ``fields``, the document is these columns' texts one after another, and the sections are the fields, in this order.

    No shuffle: tasks cut their rows into slices of a few megabytes and join
    the two sorted span lists of a slice in numpy. The vocabulary file is read
    by the driver and broadcast; its size is that of the file. The tasks of a worker share the encoder.

    A null or empty text is one section without tokens, a null field an empty section. Texts of
    any length, also without spaces or of spaces only, are encoded whole. Repeated rows give
    their sections each time, null ids stay null, other columns are not read,
    and an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind, key = "double" if rule == "share" else "long", new_key()

    def make():
        encoder = _encoder(ranks.value)
        return encoder, np.array([len(encoder.decode_single_token_bytes(i)) for i in range(encoder.max_token_value + 1)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = shared(key, make)
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = texts(piece)
                if fields:
                    sizes = np.array(piece.column("sizes").to_pylist(), np.int64).reshape(len(rows), -1)
                    bounds, owner = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(rows)), sizes.shape[1])
                else:
                    bounds, owner = section_bounds(rows)
                n, crossing = attribute(token_edges(encoder, lengths, rows), bounds, rule)
                lead = (np.frombuffer(b"".join(rows), np.uint8) & 0xC0) != 0x80
                chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(lead)])[bounds]
                first = np.searchsorted(owner, np.arange(len(rows)))
                base = chars[:-1][first][owner]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(pa.array(owner)), pa.array(np.arange(len(owner)) - first[owner]),
                     pa.array(chars[:-1] - base), pa.array(chars[1:] - base),
                     pa.array(n.astype(np.float64 if rule == "share" else np.int64)), pa.array(crossing)],
                    names=["id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    id_type = docs.schema[id_col].dataType.simpleString()
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields or ()]
    whole = [F.concat(*parts).alias("text"), F.array(*[F.octet_length(c) for c in parts]).alias("sizes")] if fields else [F.col(f"`{text_col}`").alias("text")]
    out = docs.select(F.col(f"`{id_col}`").alias("id"), *whole).mapInArrow(
        count, f"id {id_type}, section long, char_start long, char_end long, n_tokens {kind}, n_crossing long")
    return out.withColumnRenamed("id", id_col)
