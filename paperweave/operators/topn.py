"""W1: "LIMIT n" per group when many seeds / queries run together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.session import cut_lineage


def top_n(df: DataFrame, partition_by: Sequence[str | Column], order_by: Sequence[Column],
          n: int, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows of every group in ``order_by`` order.

    Written as ``row_number() <= n`` so that the optimizer inserts a
    WindowGroupLimit: a partial limit runs before the shuffle, so a hot group
    (one key holding a large share of the rows) sends at most ``n`` rows per
    map task instead of all of them.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


# Largest seed / query table broadcast to every task of a join: both bounds
# must hold.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of a row: UTF-8 length of strings and binaries,
    JSON length of nested values, 8 bytes for every other column."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def bounded_size(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """(rows, bytes) of at most the first ``max_rows + 1`` rows of ``df``,
    in one job that stops reading after that many rows."""
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                   F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    n, b = bounded_size(df, max_rows)
    return n <= max_rows and b <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                      max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows and about
    ``max_bytes`` bytes.

    The check is a bounded job (it stops after ``max_rows + 1`` rows); a
    larger table is returned as is, and the join falls back to a shuffle
    join that AQE may still broadcast from measured sizes.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def running_totals(df: DataFrame, order_col: str, sums: Sequence[str], count_as: str,
                   sum_suffix: str = "_total") -> DataFrame:
    """Running row number (``count_as``) and running sums of ``sums`` in
    ``order_col`` order (ascending, unique values), without moving the table
    into one task.

    The rows are range-partitioned by ``order_col``, so partition ``i`` holds
    the ``i``-th range; a window per partition gives local prefixes, and a
    table with one row per partition gives each partition's offset (the
    totals of all partitions before it). Only that per-partition table is
    ordered as a whole; its size is the partition count, not the data.

    The range of each row is fixed once, in a reliable checkpoint, and both
    branches read it from there: planned twice, the two exchanges could draw
    different bounds or be coalesced differently.
    """
    parts = cut_lineage(df.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part").orderBy(order_col)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("_n", F.row_number().over(local))
    for c in sums:
        out = out.withColumn(f"_s_{c}", F.sum(c).over(upto))
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_pn"), *[F.sum(c).alias(f"_ps_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_on"),
                            *[F.coalesce(F.sum(f"_ps_{c}").over(before), F.lit(0)).alias(f"_os_{c}") for c in sums])
    out = out.join(F.broadcast(offsets), "_part")
    out = out.withColumn(count_as, (F.col("_n") + F.col("_on")).cast("int"))
    for c in sums:
        out = out.withColumn(f"{c}{sum_suffix}", F.col(f"_s_{c}") + F.col(f"_os_{c}"))
    return out.drop("_part", "_n", "_on", *[f"_s_{c}" for c in sums], *[f"_os_{c}" for c in sums])
