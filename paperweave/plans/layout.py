"""Serving layout: tables stored so that the expansion joins never shuffle
the edge table.

``references`` joins citations to works on ``target_id``; ``citing`` joins
on ``source_id``. Storing ``works`` bucketed by ``id`` and two copies of
``citations`` bucketed by ``target_id`` and by ``source_id`` (same bucket
count) makes both joins co-located: the billions of edges are read in place,
and only the at-most-20-per-seed survivors of the partial window limit are
shuffled. The copies are written once per load; every expansion after that
reuses them.

A bucket can't be split, so the edges of hub papers (those with more than
``hub_edges`` of them on the bucketed side) are stored apart, unbucketed. They
are few papers: their works are broadcast (checked) to the hub edges, which
then stream through in as many tasks as they have files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.operators.joins import EdgeParts
from paperweave.operators.tables import save_bucketed
from paperweave.operators.topn import checked_broadcast

HUB_EDGES = 100_000


@dataclass
class ServingTables:
    works: DataFrame                 # bucketed by id
    citations_by_target: EdgeParts   # bucketed by target_id (references), hubs apart
    citations_by_source: EdgeParts   # bucketed by source_id (citing), hubs apart


def build_serving_tables(works: DataFrame, citations: DataFrame, root: str, buckets: int,
                         prefix: str = "pw", hub_edges: int = HUB_EDGES) -> ServingTables:
    """Write the three bucketed tables and the hub edges under ``root`` and
    return them. ``buckets`` should give files of a few hundred MB at the
    target scale."""
    spark = works.sparkSession

    def edges(key: str, name: str) -> EdgeParts:
        hubs = f"{root}/{name}_hub_keys"
        (citations.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_edges)
         .select(key).write.mode("overwrite").parquet(hubs))
        keys = checked_broadcast(spark.read.parquet(hubs))
        citations.join(keys, key, "left_semi").write.mode("overwrite").parquet(f"{root}/{name}_hubs")
        rest = save_bucketed(citations.join(keys, key, "left_anti"), f"{prefix}_{name}", key, buckets, f"{root}/{name}")
        return EdgeParts(rest, spark.read.schema(citations.schema).parquet(f"{root}/{name}_hubs"), spark.read.parquet(hubs))

    w = save_bucketed(works, f"{prefix}_works_by_id", "id", buckets, f"{root}/works_by_id")
    return ServingTables(works=w, citations_by_target=edges("target_id", "citations_by_target"),
                         citations_by_source=edges("source_id", "citations_by_source"))
