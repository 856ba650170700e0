"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.session import remove_path, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def _folder(spark: SparkSession, name: str = "") -> str:
    return scratch_path(spark, f"llm/{spark.sparkContext.applicationId}/{name}".rstrip("/"))


def _table_name(spark: SparkSession, name: str = "") -> str:
    """Of this application's own: others may share the catalog."""
    return f"pw_{re.sub(r'[^a-z0-9]', '_', spark.sparkContext.applicationId.lower())}_{name}"


def drop_stored(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that have
    not been written yet still read them."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_table_name(spark)):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    remove_path(spark, _folder(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder (below
    ``spark.checkpoint.dir``) and read it back: the lineage ends at the files,
    so a lost executor re-reads them, and later passes don't recompute."""
    path = _folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int, part_rows: int = 16_384) -> DataFrame:
    """``df``, narrow and dealt out by a shuffle, in no more parts than its ``rows`` rows at most need: each file
    written makes its executor start processes (chmod). Large tables keep the parts of the shuffle."""
    return df.coalesce(1 + rows // part_rows)


def gathered(df: DataFrame, rows: int, part_rows: int = 65_536) -> DataFrame:
    """``df``, narrow and read from files, in no more parts than its ``rows`` rows need. What fits one part is then
    grouped and joined in place: dealt out to all shuffle partitions, each of these would take a page of some
    16 to 32 MB for every aggregate and sort to hold a few rows, and executors grow to all of their heap."""
    return df.coalesce(1 + rows // part_rows)


def stored_in_buckets(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """As ``stored``, bucketed by ``column``: grouping by it reads the files in
    place. ``df`` must be partitioned by the column into as many parts, so that
    each bucket is one file."""
    spark = df.sparkSession
    table_name = _table_name(spark, f"{name}_{uuid.uuid4().hex}")
    path = _folder(spark, table_name)
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20,
           max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that ``column`` holds about ``max_bytes`` per
    piece (one longer text is a piece of its own): bounded memory in a task."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, min(int(np.searchsorted(size, done + max_bytes, side="right")), at + max_rows))
        yield batch.slice(at, end - at)
        at = end


def texts(batch: pa.RecordBatch | pa.Table, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [b if b is not None else b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def sums_before(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with a column for each name in ``sums``: what the rows of its
    group ``by`` that come before it in ``order`` hold of the named column
    together. Groups may be of any size: the rows are range-partitioned by
    group and order, written once (so the ranges don't change), summed within
    their part, and a table with one row per part at most adds what the
    earlier parts of the group hold. ``order`` should be total."""
    keys = [F.col(c).asc_nulls_first() for c in by]
    parts = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    # only the first group of a part can have begun in an earlier one
    offsets = (totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"),
                             *[F.sum(f"_t{i}").over(earlier).alias(f"_o{i}") for i in range(len(sums))])
               .where(F.col("_o0").isNotNull()))
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    local = parts.withColumns({f"_l{i}": F.coalesce(F.sum(c).over(within), F.lit(0)) for i, c in enumerate(sums.values())})
    return local.join(F.broadcast(offsets), same, "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_l{i}") + F.coalesce(f"_o{i}", F.lit(0))).alias(name) for i, name in enumerate(sums)])
