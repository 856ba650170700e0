"""SimHash near-duplicates: tiled exact comparison of all distinct fingerprints.

A tile holds fingerprints with the same bit counts in each of four 16-bit
blocks. Two fingerprints differ in at least the sum of their blocks' count
differences, so tile pairs beyond the radius by that sum are never formed; the
others are compared in numpy by exclusive-or and bit counts, all against all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.llm.common import gathered, packed, slices, stored, texts
from paperweave.llm.components import components, local_components

SEED = 42                    # of XXH64, fixed value
BLOCKS = 4
WIDTH = 64 // BLOCKS
TILE = 4096                  # fingerprints; larger cells are dealt to several tiles
STRIP = 1 << 20              # comparisons at once
BROADCAST_PRINTS = 1 << 18   # 2 MB of fingerprints; the tiles of more meet by a shuffle
PART_ROWS = 2048             # whole documents that a task returns at least, if it can


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of a text's word shingles (repeats count), A-Z lowered.
    A shorter text is one shingle; no word: zero."""
    import xxhash

    words = text.lower().split()        # of bytes: splits at \\x20 and \\x09-\\x0D only, lowers A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in
                     zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)),
                    np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, fp)`` of every row; null text: zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t, shingle) for t in texts(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _cell(fp: Column) -> Column:
    """The bit counts of the blocks, as digits."""
    mask = (1 << WIDTH) - 1
    cell = F.lit(0)
    for i in range(BLOCKS):
        cell = cell * (WIDTH + 1) + F.bit_count(F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit(mask)))
    return cell.cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences between bit counts within the radius, each with its opposite once."""
    reach = range(-min(radius, WIDTH), min(radius, WIDTH) + 1)
    return [d for d in product(reach, repeat=BLOCKS) if sum(map(abs, d)) <= radius and d >= (0,) * BLOCKS]


def _neighbours(cell: Column, radius: int) -> Column:
    """The cells that may hold fingerprints within the radius, one of each pair's directions."""
    digits = [F.floor(cell / (WIDTH + 1) ** (BLOCKS - 1 - i)).cast("int") % (WIDTH + 1) for i in range(BLOCKS)]
    out = []
    for step in _steps(radius):
        inside, to = F.lit(True), F.lit(0)
        for d, s in zip(digits, step, strict=True):
            inside = inside & (d + s).between(0, WIDTH)
            to = to * (WIDTH + 1) + d + s
        out.append(F.when(inside, to))
    return F.array_compact(F.array(*out))


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, a strip of ``a`` at a time."""
    rows = max(1, STRIP // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at:at + rows, None] ^ b[None, :]) <= radius)
        if len(i):
            yield i + at, j


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius across (or in, if they are
    the same) two tiles: a forest, not all pairs."""
    both, label = np.concatenate([a, b]), None
    for i, j in compare_tiles(a, b, radius):
        label = local_components(len(both), i, j + len(a), label)
    if label is None:
        return both[:0], both[:0]
    node = np.flatnonzero((label != np.arange(len(both))) & (both != both[label]))
    return both[node], both[label[node]]


def fingerprint_links(distinct: DataFrame, radius: int, most: int | None = None) -> DataFrame:
    """``distinct(fp)``, of ``most`` rows if that is known, to links ``(u, v)`` with the same components as all
    pairs that differ in at most ``radius`` bits."""
    distinct = distinct if most is None else gathered(distinct, most)
    cells = distinct.select("fp", _cell(F.col("fp")).alias("cell"))
    # At most (WIDTH + 1) ** BLOCKS rows of two numbers, whatever the input.
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("n"))
    tiles = (cells.join(F.broadcast(sizes), "cell")
             .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("n")).alias("chunk"))
             .agg(F.collect_list("fp").alias("fps")))
    tiles = stored(tiles if most is None else packed(tiles, most), "tiles")
    few = most is not None and most <= BROADCAST_PRINTS
    dealt = tiles.repartition(1 + most // TILE) if few else tiles
    left = dealt.select(F.col("cell").alias("from"), F.col("chunk").alias("c"), F.col("fps").alias("a"),
                        F.explode(_neighbours(F.col("cell"), radius)).alias("cell"))
    pairs = (left.join(F.broadcast(tiles) if few else tiles, "cell")
             .where((F.col("from") != F.col("cell")) | (F.col("c") <= F.col("chunk")))
             .select("a", F.col("fps").alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tile_links(_longs(x), _longs(y), radius) for x, y in zip(batch.column("a"), batch.column("b"), strict=True)]
            u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _longs(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).view(np.uint64)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document (repeated rows included): ``id_col``,
    ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    reachable over fingerprints that differ in at most ``radius`` bits.

    Equal fingerprints are one row before any comparison, so a group of copies
    costs nothing there; tasks emit a forest of the links that they find, never
    all pairs. A fingerprint goes to a fixed number of neighbouring tiles; the
    comparisons themselves grow with the square of the number of distinct
    fingerprints, as the exact method does, and split freely over tasks. Only
    ids and fingerprints are shuffled.

    Null or empty text, or one without words: fingerprint zero, linked like any
    other. Null ids are never the smallest; a component of null ids only has a
    null ``component_id``. Other columns are not read; an empty table gives no
    rows.
    """
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    most = rows.count()
    rooted = _rooted(rows, radius, most)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(packed(rooted.join(named, "root").select("fp", "component_id"), most), "classes")
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """``(fp, least, root)`` of each distinct fingerprint of the stored ``rows``, ``most`` in all: the smallest id
    that has it, and the fingerprint that names its component."""
    least = stored(packed(gathered(rows, most).groupBy("fp").agg(F.min("id").alias("least")), most), "distinct")
    roots = components(fingerprint_links(least.select("fp"), radius, most), most=most)
    rooted = gathered(least, most).join(gathered(roots, most), F.col("fp") == F.col("node"), "left")
    return gathered(stored(packed(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), most), "rooted"), most)


def _key(c: Column) -> Column:
    """The id as text, and a text that no id has for a null one."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  radius: int = 3) -> DataFrame:
    """One row of ``docs``, all columns, of each group of near duplicates: the
    one with the smallest id (of several with that id, one of those with the
    smallest fingerprint). Cases as in ``near_duplicates``; a group of null
    ids only keeps one of its rows.

    Rows are shuffled once, by id and fingerprint; equal pairs are cut to one
    before it.
    """
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    most = rows.count()
    # Also its smallest fingerprint: rows with the same id may be in different groups.
    keep = (gathered(rows, most).join(_rooted(rows, radius, most).select("fp", "root"), "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("k"))
            .select(_key(F.col("k.id")).alias("_key"), F.col("k.fp").alias("_own")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    id_name, text_name = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_name):
                fp = np.array([fingerprint(t, shingle) for t in texts(part, text_name)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*names, "_own"])

    printed = wide.mapInArrow(run, wide.select("*").schema.add("_own", T.LongType())).withColumn("_key", _key(F.col(id_name)))
    kept = printed.dropDuplicates(["_key", "_own"]).join(keep, ["_key", "_own"], "left_semi")
    return packed(kept, most, PART_ROWS).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
