"""Keyed tables in buckets: an upsert rewrites only the buckets it touches (K4, K6),
and a batch of ids is checked against the stored ones by reading little (K2).

A row is in the bucket that its key's hash names. Each bucket is a folder,
written once; a manifest names the live folder of every bucket, so a write is
visible at once when the next manifest is there, and a writer that dies before leaves the table as it
was. Beside each bucket's rows lies a blocked Bloom filter of its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.operators.manifest import ConflictError, publish, read_manifest
from paperweave.operators.tables import DuplicateKeyError
from paperweave.operators.topn import top_n
from paperweave.session import hadoop_path, remove_path, staged

WORDS = 8                    # 32-bit words of a filter block; a key sets one bit in each
KEYS_PER_BLOCK = 21          # 256 bits, about 12 a key: near 0.5 % of other keys pass


@dataclass
class Written:
    buckets: list[int]       # rewritten
    folder: str | None       # below the table's path; None if nothing was written


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys, F.lit("key"))


def create_bucketed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> None:
    """An empty table, if there is none. The number of buckets stays: choose it
    for a bucket of some hundred megabytes at the size the table will have."""
    if not read_manifest(spark, path)[1]:
        publish(spark, path, read_manifest(spark, path)[0],
                {"schema": schema.json(), "keys": list(keys), "buckets": buckets, "live": {}, "blocks": {}})


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, state = read_manifest(spark, path)
    if not state:
        raise FileNotFoundError(f"no bucketed table at {path}")
    return number, state


def _read(spark: SparkSession, path: str, state: dict, some: Sequence[int] | None = None, part: str = "rows") -> DataFrame:
    """The rows (or filter blocks) of these buckets, or of all."""
    schema = T.StructType.fromJson(json.loads(state["schema"])) if part == "rows" else BLOCKS
    folders = [f"{path}/{part}/{f}/bucket={b}" for b, f in sorted(state["live"].items(), key=lambda x: int(x[0]))
               if some is None or int(b) in some]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest manifest has it."""
    return _read(spark, path, _state(spark, path)[1])


BLOCKS = T.StructType([T.StructField("of", T.IntegerType()), T.StructField("block", T.LongType()), *[T.StructField(f"w{i}", T.IntegerType()) for i in range(WORDS)]])


def _masks(bits: str) -> list[Column]:
    return [F.expr(f"shiftleft(1, cast((shiftrightunsigned({bits}, {5 * i}) & 31) as int))") for i in range(WORDS)]


def _write(path: str, rows: DataFrame, keys: Sequence[str], folder: str, buckets: list[int], blocks: int) -> None:
    """``rows`` (with ``bucket``), one file per bucket sorted by key, and the filters of their keys."""
    spark = rows.sparkSession
    dealt = rows.repartition(max(1, len(buckets)), "bucket").sortWithinPartitions("bucket", *keys)
    dealt.write.partitionBy("bucket").parquet(f"{path}/rows/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows/{folder}")
    hashed = written.select("bucket", F.pmod(F.xxhash64(*keys, F.lit("block")), F.lit(blocks)).alias("block"), _key_hash(keys).alias("_bits"))
    filters = (hashed.select("bucket", "block", *[m.alias(f"w{i}") for i, m in enumerate(_masks("_bits"))])
               .groupBy("bucket", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
               .withColumn("of", F.col("bucket")))
    filters.repartition(max(1, len(buckets)), "bucket").write.partitionBy("bucket").parquet(f"{path}/filter/{folder}")


def upsert_bucketed(new: DataFrame, path: str, order: Sequence[Column] | None = None) -> Written:
    """INSERT OR REPLACE: a row of ``new`` wins over the stored one of its
    key; inside the batch the first in ``order`` does, and without ``order`` a key that repeats raises ``DuplicateKeyError``.

    The batch is staged once, so it is computed once. Only the buckets of its
    keys are read and rewritten, into a new folder; then the next manifest is created. If another writer's is there
    first, ``ConflictError``: nothing has changed, call again. Null keys are a key. Folders that no manifest names any more are
    left for readers of older states, see ``vacuum_bucketed``."""
    spark = new.sparkSession
    number, state = _state(spark, path)
    keys, schema = state["keys"], T.StructType.fromJson(json.loads(state["schema"]))
    rows = new if order else new.select(*schema.fieldNames())
    if order:
        rows = top_n(rows, keys, list(order), 1).select(*schema.fieldNames())
    batch, scratch = staged(rows.withColumn("bucket", _bucket(keys, state["buckets"])), "upsert")
    try:
        sizes = batch.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*keys)).alias("k")).collect()
        if any(r.n != r.k for r in sizes):
            raise DuplicateKeyError(f"duplicate {keys} inside the batch and no order")
        touched = sorted(r.bucket for r in sizes)
        if not touched:
            return Written([], None)
        old = _read(spark, path, state, touched)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        kept = old.alias("o").join(batch.select(*keys).alias("n"), same, "left_anti").withColumn("bucket", _bucket(keys, state["buckets"]))
        folder = uuid.uuid4().hex
        # enough blocks for what the fullest touched bucket may hold afterwards
        full = max(r.n for r in sizes) + (kept.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0)
        blocks = max(1, -(-full // KEYS_PER_BLOCK))
        _write(path, batch.unionByName(kept.select(*batch.columns)), keys, folder, touched, blocks)
        live = {**state["live"], **{str(b): folder for b in touched}}
        size = {**state["blocks"], **{str(b): blocks for b in touched}}
        try:
            publish(spark, path, number, {**state, "live": live, "blocks": size})
        except ConflictError:
            for part in ("rows", "filter"):
                remove_path(spark, f"{path}/{part}/{folder}")
            raise
        return Written(touched, folder)
    finally:
        remove_path(spark, scratch)


def unknown_rows(new: DataFrame, path: str, counts: Column | None = None) -> DataFrame:
    """The rows of ``new`` whose key the table doesn't hold (the anti join of K2); with ``counts``, a
    condition on the table's columns, only stored rows that meet it hold a key.

    Keys that the filters of their buckets rule out, nearly all the new ones, are
    unknown without a look at the rows; the table's rows are read only in the buckets
    of the others. So what is read follows the batch. The batch is staged once."""
    spark = new.sparkSession
    _, state = _state(spark, path)
    keys = state["keys"]
    if not state["blocks"]:
        return new
    sizes = spark.createDataFrame([(int(b), n) for b, n in state["blocks"].items()], "_of int, _blocks long")   # a row per bucket
    batch = staged(new.withColumn("_bucket", _bucket(keys, state["buckets"])), "unknown")[0]
    touched = [r[0] for r in batch.select("_bucket").distinct().collect()]
    at = (batch.join(F.broadcast(sizes), F.col("_bucket") == F.col("_of"), "left").drop("_of")
          .withColumn("_at", F.pmod(F.xxhash64(*keys, F.lit("block")), F.coalesce("_blocks", F.lit(1)))).withColumn("_bits", _key_hash(keys)))
    filters = _read(spark, path, state, touched, "filter")
    hit = F.lit(True)
    for i, m in enumerate(_masks("_bits")):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    checked = staged(at.join(filters, (F.col("_bucket") == F.col("of")) & (F.col("_at") == F.col("block")), "left")
                     .select(*[F.col(f"`{c}`") for c in new.columns], "_bucket", F.coalesce(hit, F.lit(False)).alias("_possible")), "checked")[0]
    possible = checked.where("_possible")
    stored = _read(spark, path, state, [r[0] for r in possible.select("_bucket").distinct().collect()])
    if counts is not None:
        stored = stored.where(counts)
    stored = stored.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    absent = possible.join(stored, same, "left_anti")
    return checked.where("not _possible").unionByName(absent).drop("_bucket", "_possible")


def vacuum_bucketed(spark: SparkSession, path: str) -> list[str]:
    """Delete the bucket folders that the newest manifest doesn't name, when no
    reader of an older state and no writer is left; their names."""
    live = {f"{folder}/bucket={b}" for b, folder in _state(spark, path)[1]["live"].items()}
    gone = []
    for part in ("rows", "filter"):
        fs, folder = hadoop_path(spark, f"{path}/{part}")
        for written in fs.listStatus(folder) if fs.exists(folder) else []:
            name = written.getPath().getName()
            there = [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(written.getPath()) if s.isDirectory()]
            old = [x for x in there if x not in live]
            for x in [name] if len(old) == len(there) else old:
                remove_path(spark, f"{path}/{part}/{x}")
            gone += [f"{part}/{x}" for x in old]
    return sorted(gone)
