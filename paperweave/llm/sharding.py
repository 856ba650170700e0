"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.
DataFrame functions only.

Every key hashes to a point of a 32-bit ring; the shards own ``vnodes`` points
each, and a key goes to the shard of the next point clockwise. A full shard
takes no more: its overflow continues clockwise to the next shard with room.
The arcs between points are filled in ring order from the number of keys in
each, ``shards * vnodes`` numbers however many keys there are; a key
then finds its shard from its rank in its arc.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperweave.session import cut_lineage

CELLS = 4096                 # equal cuts of the ring, to find a key's arc by an equi-join
CHUNK = 1 << 16              # copies of one repeated row that are numbered at once


def ring_point(key: Column) -> Column:
    """32 bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _ring(shards: int, vnodes: int) -> Column:
    """The ring's points in order, each with its shard: a constant array."""
    return F.expr(f"""
        array_sort(transform(sequence(0, {shards * vnodes - 1}), i -> struct(
            cast(conv(substring(md5(concat_ws('#', 'shard', i div {vnodes}, i % {vnodes})), 1, 8), 16, 10)
                 AS bigint) AS point,
            cast(i div {vnodes} AS int) AS shard, cast(i % {vnodes} AS int) AS v)))""")


def _arcs(spark: SparkSession, ring: Column) -> DataFrame:
    """One row per arc and cell it touches: ``(cell, arc, lo, hi)``, both ends
    included. Arc i ends at point i; the first one also takes what lies past
    the last point."""
    arc = spark.range(1).select(ring.alias("ring")).select(F.posexplode(F.expr("""
        transform(ring, (n, i) -> struct(if(i = 0, cast(0 as bigint), ring[i - 1].point + 1) AS lo, n.point AS hi))
        """)).alias("arc", "a"), F.expr("ring[size(ring) - 1].point + 1").alias("rest"))
    width = (1 << 32) // CELLS
    spans = (arc.select("arc", F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))
             .unionByName(arc.where("arc = 0").select("arc", F.col("rest").alias("lo"),
                                                      F.lit((1 << 32) - 1).cast("long").alias("hi")))
             .where("lo <= hi"))
    return spans.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, hi div {width})")))


def _segments(counts: DataFrame, ring: Column, shards: int, slack: float) -> DataFrame:
    """Fill the shards: ``(arc, lo, hi, shard, base)``, the keys of ranks lo to
    hi - 1 in the arc go to the shard, from slot ``base`` on. The table has one
    row per arc and at most ``shards`` more.

    The ring and the counts of its arcs, ``shards * vnodes`` numbers however many keys there
    are, are walked once on the driver. Points of full shards are skipped by links to the next point with room."""
    spark = counts.sparkSession
    owner = [r.shard for r in spark.range(1).select(ring.alias("r")).first().r]
    held = {r.arc: r.n for r in counts.collect()}
    n = sum(held.values())
    if slack > 0:
        room = [math.ceil((1 + slack) * n / shards)] * shards
    else:
        room = [n // shards + (i < n % shards) for i in range(shards)]
    start, following, out = list(room), list(range(len(owner))), []

    def with_room(at: int) -> int:
        passed = []
        while not room[owner[at]]:
            passed.append(at)
            at = following[at] if following[at] != at else (at + 1) % len(owner)
        for p in passed:
            following[p] = at
        return at

    for arc in sorted(held):
        at, done = arc, 0
        while done < held[arc]:
            at = with_room(at)
            shard = owner[at]
            take = min(held[arc] - done, room[shard])
            out.append({"arc": arc, "lo": done, "hi": done + take, "shard": shard, "base": start[shard] - room[shard]})
            room[shard] -= take
            done += take
    schema = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,base:bigint>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(out)), schema)).alias("s")).select("s.*")


def _sub_cells(placed: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """``placed`` with ``_part``, the range of its sort order that a row is in,
    and the rows of each arc in each range: an arc with many rows spans several
    ranges, and ranks within one of these need that range only. The ranges are
    fixed once, in a reliable checkpoint. There are fewer sub-cells than arcs
    and ranges together."""
    parts = cut_lineage(placed.repartitionByRange("_arc", "_point", *cols).withColumn("_part", F.spark_partition_id()))
    return parts, parts.groupBy("_arc", "_part").agg(F.sum("_n").alias("_cell_n"))


def assign_shards(rows: DataFrame, shards: int, *, key: str, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """All ``rows`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless
    from 0 in each shard) added; columns of these names are replaced.

    ``slack = 0``: the shards' sizes are at most one row apart (the first
    ``n % shards`` shards hold one more). ``slack = e > 0``: no shard holds
    more than ``ceil((1 + e) * n / shards)`` rows, and fewer keys leave their
    arc's own shard. A key moves only when its own arc, or one that overflows
    into its shard, changes.

    Rows of an arc are ranked by ring point, then by all their columns, so the
    result depends on the rows alone. Equal rows are counted before the
    shuffle and numbered one after another, so a key that a third of all rows
    repeat is one row per task on the way. Null keys are hashed like an empty
    key. An empty table gives no rows. Carry narrow columns only; join texts
    back by their id where they are needed.
    """
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive")
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    cols = [f"_c{i}" for i in range(len(kept))]
    ring = _ring(shards, vnodes)
    point = ring_point(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    grouped = (rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, cols, strict=True)], point.alias("_point"))
               .groupBy(*cols, "_point").agg(F.count("*").alias("_n")))
    arcs = F.broadcast(_arcs(spark, ring).select("cell", F.col("arc").alias("_arc"), "lo", "hi"))
    placed = (grouped.withColumn("_cell", F.expr(f"_point div {(1 << 32) // CELLS}"))
              .join(arcs, (F.col("_cell") == F.col("cell")) & F.col("_point").between(F.col("lo"), F.col("hi")))
              .drop("_cell", "cell", "lo", "hi"))
    placed, totals = _sub_cells(placed, cols)
    counts = totals.groupBy(F.col("_arc").alias("arc")).agg(F.sum("_cell_n").alias("n"))
    segments = F.broadcast(_segments(counts, ring, shards, slack))
    upto = F.sum("_n").over(W.partitionBy("_arc", "_part").orderBy("_point", *cols)
                            .rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.sum("_cell_n").over(W.partitionBy("_arc").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = F.broadcast(totals.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_cell_n"))
    numbered = (placed.withColumn("_upto", upto).join(offsets, ["_arc", "_part"])
                .withColumn("_first", F.col("_before") + F.col("_upto") - F.col("_n"))
                .withColumn("_c", F.explode(F.expr(f"sequence(0, (_n - 1) div {CHUNK})")))
                .withColumn("_k", F.explode(F.expr(
                    f"sequence(_c * {CHUNK}, least(_n, (_c + 1) * {CHUNK}) - 1)")))
                .withColumn("_rank", F.col("_first") + F.col("_k")))
    return (numbered.join(segments, (F.col("_arc") == F.col("arc")) & (F.col("_rank") >= F.col("lo"))
                          & (F.col("_rank") < F.col("hi")))
            .select(*[F.col(n).alias(c) for c, n in zip(kept, cols, strict=True)], "shard",
                    (F.col("base") + F.col("_rank") - F.col("lo")).alias("slot")))
