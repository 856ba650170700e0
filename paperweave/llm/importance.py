"""Importance resampling towards a target distribution, over hashed features.

A text's features are its words and pairs of neighbouring words. Newlines
separate words, so they cut a text into lines: each distinct line's features are
counted once and multiplied by its occurrences, and the pairs that cross from
one line to the next are added by themselves. A document's weight is made of
its lines' weights in the same way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import slices, stored, sums_before, texts

BUCKETS = 10_000
KEY = 16                     # bytes of the digest that stands for a line
HELD = 16 << 20              # bytes of distinct lines that a counting task holds
HOT = 1 << 16                # most frequent lines whose weights are broadcast; others are joined
SHORT = 64                   # longest word whose pairs are hashed from its own hash

#: Every byte of a word as it is, A-Z lowered; a newline; a space for all others.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else 32 for b in range(256))


def lines_of(text: bytes) -> list[bytes]:
    """The lines that have words, as words among spaces."""
    return [s for line in text.translate(WORDS).split(b"\n") if (s := line.strip(b" "))]


def line_key(line: bytes) -> bytes:
    return blake2b(line, digest_size=KEY).digest()


def crossings(lines: Sequence[bytes]) -> list[int]:
    """Buckets of the pairs of a line's last word and the next one's first."""
    return [crc32(a[a.rfind(b" ") + 1:] + b" " + (b[:at] if (at := b.find(b" ")) >= 0 else b)) % BUCKETS
            for a, b in zip(lines, lines[1:], strict=False)]


def zero_bytes(n: int) -> np.ndarray:
    """What ``k`` more zero bytes (k from 0 to n) make of each byte of a CRC-32:
    the CRC is linear, so that of a joined text follows from its parts'."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(n):
        now = (now >> 8) ^ step[now & 255]
        out.append(now)
    return np.stack(out).ravel()


def line_features(lines: Sequence[bytes], zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, line by line, and the number of words of each line."""
    words: list[bytes] = []
    n = np.empty(len(lines), np.int64)
    for i, line in enumerate(lines):
        own = line.split()
        n[i] = len(own)
        words += own
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    crc = np.fromiter(map(crc32, number), np.uint32, len(number))
    spaced = np.fromiter((crc32(b" ", c) for c in crc.tolist()), np.uint32, len(number))
    size = np.fromiter(map(len, number), np.int64, len(number))
    owner = np.repeat(np.arange(len(lines)), n)
    left = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    a, b = ids[left], ids[left + 1]
    start, shift = spaced[a], np.minimum(size[b], SHORT) << 10
    pair = crc[b]
    for k in range(4):
        pair = pair ^ zeros[shift + (k << 8) + ((start >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    for i in np.flatnonzero(size[b] > SHORT).tolist():
        pair[i] = crc32(words[left[i]] + b" " + words[left[i] + 1])
    features = np.maximum(2 * n - 1, 0)
    first = np.cumsum(features) - features
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(int(features.sum()), np.int16)
    out[first[owner] + place] = crc[ids] % BUCKETS
    out[first[owner[left]] + n[owner[left]] + place[left]] = pair % BUCKETS
    return out, n


def _list(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = Counter(), 0

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["line", "n"])
        held.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            for t in texts(part):
                lines = lines_of(t)
                held.update(lines)
                size += len(t)
            if size > HELD:
                yield flush()
                size = 0
    yield flush()


def _refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lines = [lines_of(t) for t in texts(part)]
            cross = [crossings(own) for own in lines]
            keys = pa.array([line_key(x) for own in lines for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("id"), _list(np.array([len(x) for x in lines]), keys),
                 _list(np.array([len(x) for x in cross]), pa.array([x for own in cross for x in own], pa.int16()))],
                names=["row", "id", "keys", "buckets"])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zeros = zero_bytes(SHORT)
    for batch in batches:
        for part in slices(batch, "line"):
            lines = texts(part, "line")
            flat, words = line_features(lines, zeros)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(line_key, lines), pa.binary()), part.column("n"), pa.array(words), _list(np.maximum(2 * words - 1, 0), pa.array(flat))],
                names=["key", "n", "words", "buckets"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and the row of each."""
    lists = batch.column("buckets")
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0]:at[-1]], np.repeat(np.arange(len(lists)), np.diff(at))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if batch.num_rows:
            flat, row = _flat(batch)
            total += np.bincount(flat, weights=batch.column("n").to_numpy()[row], minlength=BUCKETS).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def prepare(docs: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame]:
    """From ``(id, text)``: the distinct lines with their occurrences, words and
    features, and for each document the keys of its lines and the buckets of its crossing pairs. Both are stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    refs = stored(rows.mapInArrow(_refer, f"row long, id {id_type}, keys array<binary>, buckets array<smallint>"), "line_keys")
    counted = docs.select("text").mapInArrow(_count_lines, "line binary, n long").groupBy("line").agg(F.sum("n").alias("n"))
    lines = stored(counted.mapInArrow(_featurize, "key binary, n long, words long, buckets array<smallint>"), "lines")
    return lines, refs


def bucket_counts(lines: DataFrame, refs: DataFrame) -> np.ndarray:
    """How many features each bucket has: those of the lines, times their
    occurrences, and the crossing pairs. One number per bucket reaches the driver."""
    parts = lines.select("n", "buckets").unionByName(refs.select(F.lit(1).cast("long").alias("n"), "buckets"))
    got = parts.mapInArrow(_add_up, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the floored thousandfold log ratio of its smoothed shares."""
    s, t = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS))))
                     for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains, keep: Sequence[str]):
    """Task function: the sum of the gains of each row's features, with the columns ``keep``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value
        for batch in batches:
            if batch.num_rows:
                flat, row = _flat(batch)
                total = np.bincount(row, weights=table[flat], minlength=batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(total)], names=[*keep, "gain"])

    return run


def document_weights(lines: DataFrame, refs: DataFrame, gains: np.ndarray, id_type: str) -> DataFrame:
    """``(row, id, words, gain)`` of every document. Lines find their
    documents by a join; the most frequent lines, HOT at most by a histogram of their
    occurrences, are broadcast, so none of the joined ones has more than a 32,768th of all."""
    sent = lines.sparkSession.sparkContext.broadcast(gains)
    valued = lines.mapInArrow(_weigh(sent, ("key", "n", "words")), "key binary, n long, words long, gain long")
    power = F.floor(F.log2("n")).cast("int")
    least, held = None, 0
    for p, k in sorted(lines.groupBy(power.alias("p")).agg(F.count("*").alias("k")).collect(), reverse=True):
        if held + k > HOT:
            break
        least, held = p, held + k
    hot = F.broadcast(valued.where(power >= F.lit(least) if least is not None else F.lit(False)).drop("n"))
    cold = valued.where(power < F.lit(least) if least is not None else F.lit(True)).drop("n")
    places = refs.select("row", F.explode("keys").alias("key"))
    found = places.join(hot, "key").unionByName(places.join(hot.select("key"), "key", "left_anti").join(cold, "key"))
    own = refs.select("row", "id", "buckets").mapInArrow(_weigh(sent, ("row", "id")), f"row long, id {id_type}, gain long")
    parts = own.select("row", "id", F.lit(0).cast("long").alias("words"), "gain").unionByName(
        found.select("row", F.lit(None).cast(id_type).alias("id"), "words", "gain"))
    return parts.groupBy("row").agg(F.max("id").alias("id"), F.sum("words").alias("words"), F.sum("gain").alias("gain"))


def gumbel(key: Column) -> Column:
    """A number that the key alone decides, as if drawn from the Gumbel distribution, in thousandths."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = 25, least_words: int = 20, seed: str = "7") -> DataFrame:
    """One row per document (repeated rows included): ``id_col``,
    ``n_features``, ``weight``, ``score`` and ``rank``, its place among the drawn (1 is
    first; null for those not drawn).

    Features are lower-cased words (ASCII letters and digits, and all that is not
    ASCII) and pairs of neighbours, hashed into BUCKETS. A bucket's gain is the log ratio of its share
    in ``target`` and in ``docs``; a document's weight is the floored mean gain of its features (none: 0).
    Of the documents with ``least_words`` words, ``percent`` of 100 are drawn: the highest
    weights plus Gumbel noise of the id, ties to the smaller id. That is sampling without replacement in proportion to exp(weight).

    Distinct lines are found by a shuffle of the lines, counted in the tasks before; texts don't travel otherwise,
    and documents know their lines by 128 bits of BLAKE2. A line that a third of all documents hold is one row per task. Ranks
    come from sorted ranges with offsets, so no task holds all documents.

    Null or empty text: no features, weight 0. A null id hashes like an empty one and comes last among ties. Rows with equal id and
    score are ranked in any order. A very long line is one row. An empty table gives no rows, an empty target weighs by smoothing alone;
    other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    lines, refs = prepare(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), id_type)
    wanted = prepare(target.select(F.lit(0).alias("id"), F.col(f"`{target_col}`").alias("text")), "int")
    gains = gains_of(bucket_counts(lines, refs), bucket_counts(*wanted))
    n = F.greatest(2 * F.col("words") - 1, F.lit(0))
    weight = F.when(n > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    noise = gumbel(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    scored = stored(document_weights(lines, refs, gains, id_type).withColumn("n_features", n).withColumn("weight", weight)
                    .withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    placed = sums_before(able.select("row", "id", "n_features", "weight", "score", F.lit(1).cast("long").alias("one")), [], order, {"before": "one"})
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
