"""What the papers near each root hold, put together in cells.

A root reaches papers, and each paper holds items (the ids next to it, with their columns,
or its edges). All pairs of a root and an item are many times the two tables that they
follow from, so the pairs are never moved: the roots are cut into groups and the items into
parts by a hash, and each cell, a group with a part, is one task. It keeps the part's
items as numbers, the roots stream past, and an item's pairs with a root are all in one cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ENTRIES = 2_500_000     # items of papers that a cell holds
PART_ROWS = 256 * 1024       # papers whose columns a cell holds
GROUP_IDS = 8_000_000        # papers reached by the roots of a cell
CHUNK = 3 << 19              # pairs of a root and an item that a task makes at once
BATCH_BYTES = 1 << 24        # columns of items that it sends at once
RANKS = 1 << 10              # ranks of a pair: two for each hop
_PAPER, _NEAR, _ROOT = range(3)
_ROOTS = T.StructField("roots", T.ArrayType(T.StringType()))


class _Part:
    """The items of a cell, and by paper their numbers."""

    def __init__(self, papers: list, near: list, edges: bool):
        near = pa.Table.from_batches(near).combine_chunks() if near else None
        self.names = near["id"].combine_chunks() if near else pa.array([], pa.string())
        lists = [_lists(near[c].combine_chunks()) for c in ("a", "b", "c")] if near else [(np.zeros(0, np.int64), pa.array([], pa.string()))] * 3
        owners = [np.repeat(np.arange(len(n)), n) for n, _ in lists]
        owner = np.concatenate(owners)
        if edges:
            coded = pa.concat_arrays([self.names, *[v for _, v in lists]]).dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            mid, a, b, c = np.split(code, np.cumsum([len(self.names), *[len(v) for _, v in lists[:-1]]]))
            source = np.concatenate([mid[owners[0]], b, mid[owners[2]]])
            target = np.concatenate([a, mid[owners[1]], c])
            found, item = np.unique(source * len(coded.dictionary) + target, return_inverse=True)
            source, target = np.divmod(found, max(1, len(coded.dictionary)))
            self.columns = [coded.dictionary.take(pa.array(source)), coded.dictionary.take(pa.array(target))]
            plus = np.concatenate([np.zeros(len(a) + len(b), np.int64), np.ones(len(c), np.int64)])
        else:
            flat = lists[0][1]
            if papers:
                table = pa.Table.from_batches(papers).combine_chunks()
                self.columns = [c.combine_chunks() for c in table.columns]
            else:
                self.columns = [flat.unique()]
            at = pc.index_in(flat, value_set=self.columns[0])
            known = at.is_valid().to_numpy(zero_copy_only=False)
            owner, item = owner[known], at.drop_null().to_numpy().astype(np.int64)
            mid = pc.index_in(self.names, value_set=self.columns[0]).fill_null(-1).to_numpy()
            plus = (mid[owner] != item).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        self.item, self.plus = item[order], plus[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.names)))]).astype(np.int64)
        self.bytes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                          for c in self.columns if pa.types.is_string(c.type)), np.full(len(self.columns[0]), 16, np.int64))

    def pairs(self, rows, step: int):
        """(item, root, least rank) in order, some roots at a time: each pair once, the rank from the hop and what the entry adds."""
        lens, flat = _lists(rows["a"])
        root = np.repeat(np.arange(len(rows)), lens)
        at = pc.index_in(flat, value_set=self.names)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        root, near = root[known], at.drop_null().to_numpy()
        hop = _lists(rows["hops"])[1].to_numpy()[known].astype(np.int64)
        many = self.first[near + 1] - self.first[near]
        upto = np.cumsum(many)
        lo = 0
        while lo < len(root):
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right"))
            # whole roots; one alone may have more than a chunk
            hi = len(root) if hi >= len(root) else int(np.searchsorted(root, root[hi], "left"))
            if hi <= lo:
                hi = int(np.searchsorted(root, root[lo], "right"))
            n = many[lo:hi]
            entry = np.repeat(self.first[near[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rank = np.repeat(hop[lo:hi] * step, n) + self.plus[entry]
            start = root[lo]
            roots = int(root[hi - 1] - start) + 1
            key = (self.item[entry] * roots + np.repeat(root[lo:hi] - start, n)) * RANKS + rank
            key.sort()
            pair = key // RANKS
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            item, first = np.divmod(pair[new], roots)
            yield item, first + start, key[new] % RANKS
            lo = hi

    def rows(self, ids, item, root, names: list[str], *more):
        """A row for each item with its roots, so that its columns leave the task once for many roots; pairs ordered by item."""
        first = np.flatnonzero(np.diff(item, prepend=-1))
        ends = np.append(first[1:], len(item))
        size = np.cumsum(self.bytes[item[first]] + 16 * (ends - first))
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
            own, at = pa.array(item[first[lo:hi]]), np.append(first[lo:hi], ends[hi - 1])
            roots = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), ids.take(pa.array(root[at[0]:at[-1]])))
            yield pa.RecordBatch.from_arrays([roots, *[c.take(own) for c in self.columns], *[pa.repeat(v, hi - lo) for v in more]], names=names)
            lo = hi


def _lists(col) -> tuple[np.ndarray, pa.Array]:
    return pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.flatten()


def _run(edges: bool, names: list[str], write):
    """Task function over rows sorted by cell and kind."""
    def run(batches):
        now = part = None
        papers, near = [], []
        for batch in batches:
            key = batch["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                cell, kind = divmod(int(key[lo]), 3)
                if cell != now:
                    now, part, papers, near = cell, None, [], []
                rows = batch.slice(lo, hi - lo)
                if kind == _PAPER:
                    papers.append(rows.select(["id", *names]))
                elif kind == _NEAR:
                    near.append(rows.select(["id", "a", "b", "c"]))
                else:
                    if part is None:
                        part = _Part(papers, near, edges)
                        papers, near = [], []
                    yield from write(part, rows)
    return run


def _in_part(arr, parts: int, *hashed):
    """The elements whose hash, with the columns around them, falls into the row's part."""
    return F.filter(arr, lambda x: F.pmod(F.xxhash64(*[x if h is None else h for h in hashed]), F.lit(parts)) == F.col("part")) if parts > 1 else arr


def _dealt(reach: DataFrame, near: DataFrame, papers: DataFrame | None, edges: bool, one_hop: bool = False) -> DataFrame:
    """(key, id, a, b, c, hops, columns of papers): the rows of every cell, in order."""
    spark = reach.sparkSession
    entries = near.agg(F.coalesce(F.sum(F.size("cites") + F.size("cited_by") + F.size("similar") + 1), F.lit(0))).first()[0]
    # one hop reaches what the papers hold, at most
    reached = entries if one_hop else reach.agg(F.coalesce(F.sum(F.size("mids")), F.lit(0))).first()[0]
    rows = 0 if papers is None else papers.count()
    parts = max(1, math.ceil(entries / PART_ENTRIES), math.ceil(rows / PART_ROWS))
    # enough cells to occupy every core, when there is enough to do
    few = 3 * spark.sparkContext.defaultParallelism // parts
    groups = max(1, math.ceil(reached / GROUP_IDS), min(few, math.ceil(reached / 16_384)))
    all_parts, all_groups = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, groups))
    null, mid = F.lit(None).cast("array<string>"), F.col("seed_id")
    if edges:
        lists = [_in_part(F.col("cites"), parts, mid, None), _in_part(F.col("cited_by"), parts, None, mid), _in_part(F.col("similar"), parts, mid, None)]
    else:
        lists = [_in_part(F.array_distinct(F.concat(F.array(mid), "cites", "cited_by", "similar")), parts, None), null, null]
    held = (near.withColumn("part", all_parts).select("part", mid.alias("id"), *[x.alias(c) for x, c in zip(lists, "abc", strict=True)])
            .where(sum((F.coalesce(F.size(c), F.lit(0)) for c in "abc"), F.lit(0)) > 0).withColumn("hops", F.lit(None).cast("array<tinyint>")))
    asked = reach.select(F.col("root_id").alias("id"), F.col("mids").alias("a"), null.alias("b"), null.alias("c"), "hops",
                         F.pmod(F.xxhash64("root_id"), F.lit(groups)).alias("group")).withColumn("part", all_parts)
    key = lambda kind: ((F.col("group") * parts + F.col("part")) * 3 + kind).alias("key")
    order = ["id", "a", "b", "c", "hops"]
    sides = [held.withColumn("group", all_groups).select(key(_NEAR), *order), asked.select(key(_ROOT), *order)]
    if papers is not None:
        sides.append(papers.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("group", all_groups).select(
            key(_PAPER), "id", *[null.alias(c) for c in "abc"], F.lit(None).cast("array<tinyint>").alias("hops"), *papers.columns[1:]))
    out = sides[-1]
    for side in sides[:-1]:
        out = out.unionByName(side, allowMissingColumns=True)
    cell = F.floor(F.col("key") / 3).cast("int")
    return out.repartitionById(groups * parts, cell).sortWithinPartitions("key")


def nodes_of(reach: DataFrame, near: DataFrame, papers: DataFrame, one_hop: bool = False) -> DataFrame:
    """(root_id, id, ...): the papers next to those that each root reaches, once each.

    ``reach``: (root_id, mids, hops), the papers reached and the hops to them; ``near``: (seed_id, cites, cited_by, similar), a row
    per paper; ``papers``: its id first, a row per id; ``one_hop``: no root reaches further."""
    schema = T.StructType([_ROOTS, *papers.schema.fields])

    def write(part, rows):
        for item, root, _ in part.pairs(rows, 0):
            yield from part.rows(rows["id"], item, root, schema.names)

    by_item = _dealt(reach, near, papers, False, one_hop).mapInArrow(_run(False, papers.columns[1:], write), schema)
    return by_item.select(F.explode("roots").alias("root_id"), *papers.columns)


def edges_of(reach: DataFrame, near: DataFrame, one_hop: bool = False) -> DataFrame:
    """(root_id, source, target, type): the edges of the papers that each root reaches, once per source and
    target: the one of the fewest hops, then a citation (null type)."""
    schema = T.StructType([_ROOTS, *[T.StructField(c, T.StringType()) for c in ("source", "target", "type")]])

    def write(part, rows):
        for item, root, rank in part.pairs(rows, 2):
            for k, kind in enumerate((pa.scalar(None, pa.string()), pa.scalar("similarity"))):
                of = rank % 2 == k
                yield from part.rows(rows["id"], item[of], root[of], schema.names, kind)

    by_item = _dealt(reach, near, None, True, one_hop).mapInArrow(_run(True, [], write), schema)
    return by_item.select(F.explode("roots").alias("root_id"), "source", "target", "type")


def reached_next(reach: DataFrame, near: DataFrame) -> DataFrame:
    """``reach`` with one hop more: the least hops to each paper."""
    def write(part, rows):
        for item, root, rank in part.pairs(rows, 1):
            order = np.argsort(root, kind="stable")
            item, root, rank = item[order], root[order], rank[order]
            first = np.flatnonzero(np.diff(root, prepend=-1))
            size = pa.array(np.append(first, len(root)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                rows["id"].take(pa.array(root[first])), pa.ListArray.from_arrays(size, part.columns[0].take(pa.array(item))),
                pa.ListArray.from_arrays(size, pa.array(rank.astype(np.int8)))], names=["root_id", "mids", "hops"])

    by_cell = _dealt(reach, near, None, False).mapInArrow(_run(False, [], write), reach.schema)
    return by_cell.groupBy("root_id").agg(F.collect_list(F.struct("mids", "hops")).alias("x")).select(
        "root_id", F.flatten("x.mids").alias("mids"), F.flatten("x.hops").alias("hops"))
