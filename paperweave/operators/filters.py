"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.functions.records import concept_ids
from paperweave.operators.topn import checked_broadcast, fits_broadcast

PUBLICATION_TYPES = ("article", "preprint", "proceedings-article")
# Most concept ids that the scan filter holds as one array; more are joined.
MAX_CONCEPT_ARRAY = 1_000


def filter_publications(raw: DataFrame, types: Iterable[str] = PUBLICATION_TYPES) -> DataFrame:
    """Title present and type among ``types`` (pushed to the scan)."""
    return raw.where(F.col("title").isNotNull() & F.col("type").isin(list(types)))


def _concepts_complete():
    # a record is skipped when its concept list is missing or any entry has no id
    return F.col("concepts").isNotNull() & ~F.exists("concepts", lambda c: c.getField("id").isNull())


def filter_concepts(raw: DataFrame, wanted: Iterable[str] | DataFrame) -> DataFrame:
    """Keep records sharing at least one concept with ``wanted``, a list of
    concept ids or a DataFrame with a ``concept_id`` column, of any size."""
    return mark_concepts(raw, wanted, "_wanted").where("_wanted").drop("_wanted")


def mark_concepts(raw: DataFrame, wanted: Iterable[str] | DataFrame, name: str) -> DataFrame:
    """All records with a boolean column ``name``: whether X2 keeps them.

    Up to ``MAX_CONCEPT_ARRAY`` ids (counted) are an array beside the scan, a
    narrow filter. More ids are joined: the verdict depends on the concept list
    alone, so each distinct list is exploded and semi-joined once, and its
    records join on the list's digest; AQE broadcasts whichever side measures
    small and splits a list that many records share.
    """
    ids = concept_ids(F.col("concepts"))
    if not isinstance(wanted, DataFrame):
        listed = [str(i) for i in wanted]
        if len(listed) <= MAX_CONCEPT_ARRAY:
            target = F.array(*[F.lit(i) for i in listed]).cast("array<string>")
            return raw.withColumn(name, F.coalesce(_concepts_complete() & F.arrays_overlap(ids, target), F.lit(False)))
        wanted = raw.sparkSession.createDataFrame([(i,) for i in listed], "concept_id string")
    table = wanted.select("concept_id").distinct()
    if fits_broadcast(table, MAX_CONCEPT_ARRAY):
        target = table.select(F.array_sort(F.collect_list("concept_id"))).scalar()
        return raw.withColumn(name, F.coalesce(_concepts_complete() & F.arrays_overlap(ids, target), F.lit(False)))
    keyed = raw.withColumn("_list", F.when(_concepts_complete(), ids)).withColumn(
        "_key", F.coalesce(F.sha2(F.to_json(F.struct("_list")), 256), F.lit("")))
    lists = keyed.where(F.size("_list") > 0).select("_key", "_list").dropDuplicates(["_key"])
    hits = (lists.select("_key", F.explode("_list").alias("concept_id"))
            .join(table, "concept_id", "left_semi").select("_key", F.lit(True).alias(name)).distinct())
    return keyed.drop("_list").join(hits, "_key", "left").drop("_key").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def with_references(raw: DataFrame) -> DataFrame:
    """Only records that carry a reference list."""
    return raw.where(F.col("referenced_works").isNotNull())


def lookup(works: DataFrame, ids: DataFrame, key: str = "id", id_col: str = "id") -> DataFrame:
    """Rows of ``works`` whose key is in ``ids`` (a semi join, never an
    IN-list built on the driver). An id table of checked small size is
    broadcast, so works are not shuffled."""
    return works.join(checked_broadcast(ids.select(F.col(id_col).alias(key))), key, "left_semi")
