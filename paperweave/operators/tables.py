"""Persistent tables and their write semantics (K1-K6).

Tables are Parquet folders under a root path (any Hadoop file system).
Set-level semantics (insert-or-ignore, strict insert, upsert) are plain
DataFrame transformations that return the rows to write, so they compose
with any sink; the writers below add the file-system side.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.operators.manifest import committed_loads, track_loads
from paperweave.operators.topn import top_n
from paperweave.schemas import TABLE_SCHEMAS
from paperweave.session import hadoop_path, remove_path


class DuplicateKeyError(ValueError):
    """A strict insert found a key twice (in the batch or against the table)."""


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def create_tables(spark: SparkSession, root: str, names: Sequence[str] = tuple(TABLE_SCHEMAS),
                  database: str | None = None) -> dict[str, str]:
    """K1: create the empty tables if they do not exist (idempotent).

    ``mode("ignore")`` writes only when the folder is absent, so a second
    call leaves existing data untouched. From then on a load counts when its
    commit record is written (``manifest``). With ``database``, each table is also
    a catalog table of that database over its folder (created if absent); one
    database holds the tables of one root, and another root is an error.
    """
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    paths = {}
    track_loads(spark, root)
    for name in names:
        path = table_path(root, name)
        restore(spark, path)
        spark.createDataFrame([], TABLE_SCHEMAS[name]).write.mode("ignore").parquet(path)
        if database:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} USING parquet LOCATION '{path}'")
            there = spark.sql(f"DESCRIBE FORMATTED {database}.{name}").where("col_name = 'Location'").first()[1]
            if hadoop_path(spark, there)[1].toUri().getPath().rstrip("/") != hadoop_path(spark, path)[1].toUri().getPath().rstrip("/"):
                raise ValueError(f"{database}.{name} already stands for {there}")
        paths[name] = path
    return paths


def read_table(spark: SparkSession, root: str, name: str, without_load: str | None = None) -> DataFrame:
    """Read a table with its declared schema, without the ``load`` folder's
    column. Rows that were appended without a load count, and those of committed
    loads: a reader never sees a load in one table and not in another.
    ``without_load`` leaves out the rows of that load: what the table held before it."""
    schema = TABLE_SCHEMAS[name]
    path = table_path(root, name)
    restore(spark, path)
    fs, folder = hadoop_path(spark, path)
    if any(s.getPath().getName().startswith("load=") for s in fs.listStatus(folder)):
        # the folder's value is a string, whatever it looks like
        df = spark.read.schema(T.StructType([*schema.fields, T.StructField("load", T.StringType())])).parquet(path)
        done = committed_loads(spark, root)
        if done is not None:
            df = df.where(F.col("load").isNull() | F.col("load").isin(done))
        if without_load is not None:
            df = df.where(~F.col("load").eqNullSafe(without_load))
        return df.select(*schema.fieldNames())
    df = spark.read.option("mergeSchema", "false").parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def insert_ignore(existing: DataFrame, new: DataFrame, key: str = "id",
                  order: Sequence[Column] | None = None) -> DataFrame:
    """K2: rows of ``new`` to append under INSERT OR IGNORE: the first row per
    key in ``order`` wins inside the batch, and keys already stored stay."""
    order = list(order) if order else [F.col(key)]
    first = top_n(new, [key], order, 1)
    return first.join(existing.select(key).distinct(), key, "left_anti")


def insert_strict(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """K5: all rows of ``new``, or ``DuplicateKeyError`` when a key repeats in
    the batch or is already stored. Both checks are distributed aggregates
    that stop at the first offending key."""
    if new.groupBy(key).count().where(F.col("count") > 1).limit(1).count():
        raise DuplicateKeyError(f"duplicate {key} inside the batch")
    if new.join(existing.select(key), key, "left_semi").limit(1).count():
        raise DuplicateKeyError(f"{key} already stored")
    return new


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("paper_id",),
           order: Sequence[Column] | None = None) -> DataFrame:
    """K4: the whole table after INSERT OR REPLACE: the new row wins over the
    stored one; inside the batch the first row in ``order`` wins (for "last
    wins", a descending position). Without ``order`` a key may occur once in
    the batch only, else ``DuplicateKeyError``: which row won would be chance."""
    keys = list(keys)
    if not order and new.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count():
        raise DuplicateKeyError(f"duplicate {keys} inside the batch and no order")
    latest = top_n(new, keys, list(order), 1) if order else new
    cols = existing.columns
    return latest.select(*cols).unionByName(existing.join(latest.select(*keys), keys, "left_anti"))


def append(df: DataFrame, path: str) -> None:
    """K2/K3 sink: add files to a table folder (one atomic job commit)."""
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """K4/K6 sink: replace a table's content by a staged write, then a switch.

    ``df`` may read the folder it replaces: that stays as it is until the new
    content is written completely beside it. The switch is two renames; if the
    job dies between them, ``restore`` (called by the readers here) finds the
    old content and puts it back, so there is a whole table at any time.
    """
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(new)
    fs, target = hadoop_path(spark, path)
    if fs.exists(target):
        fs.rename(target, hadoop_path(spark, old)[1])
    fs.rename(hadoop_path(spark, new)[1], target)
    remove_path(spark, old)


def restore(spark: SparkSession, path: str) -> None:
    """Put back what an interrupted ``overwrite`` has set aside."""
    fs, target = hadoop_path(spark, path)
    if not fs.exists(target) and target.getParent() is not None and fs.exists(target.getParent()):
        for status in fs.listStatus(target.getParent()):
            if status.getPath().getName().startswith(f"{target.getName()}.old-"):
                fs.rename(status.getPath(), target)
                return


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as a catalog table bucketed and sorted by ``key``, one file
    per bucket.

    Two tables bucketed on their join keys with the same bucket count join
    without shuffling either side (the files are already co-partitioned).
    Returns the table as read back through the catalog, which is what
    carries the bucketing into the plan.
    """
    (df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)
