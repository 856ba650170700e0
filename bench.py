"""Benchmark the headline queries; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8). Every query runs to completion into Spark's ``noop`` sink (all
rows computed, nothing collected).

``tables_build`` (timed) derives the stored tables ``works`` (with the
abstract index), ``citations`` and ``vector_cache`` from the driver's tables
and writes them as Parquet, as a deployment stores them; the serving queries
then read those tables: expansion of every work (U3), batch search (L1),
cosine top-k (V3), title-index build (A1), substring search (L4), graph
merge (U4). ``a1_index`` builds and saves the title index that L1 reads (postings
bucketed by work id, so the BM25 sums need no shuffle).
``n1_load`` and ``n2_load`` time the concept-filtered and the generic load of a
gzip JSON-lines snapshot made from the same rows (snapshot writing not timed);
``v2_refresh`` embeds the works that have no vector, ``k4_upsert`` rewrites the
vector table. The two-hop exploration (U5) has no bench: over all works it
makes tens of millions of rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from paperweave.operators.graph import merge_graph  # noqa: E402
from paperweave.operators.search import (  # noqa: E402
    build_title_index,
    load_title_index,
    save_title_index,
    substring_top,
)
from paperweave.operators.similarity import similar  # noqa: E402
from paperweave.plans.expand import expand  # noqa: E402
from paperweave.plans.registry import registry  # noqa: E402
from paperweave.plans.search import search  # noqa: E402
from paperweave.session import local_session, scratch_path  # noqa: E402
from paperweave.sources import driver_tables as dt  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="paperweave-bench")
    for name in ("u3_expand_edges", "l1_search", "l4_substring_top", "a1_postings"):
        run(registry()[name](spark, "/root/testdata/sf0.001"))          # JVM / Python warm-up
    work = scratch_path(spark, f"bench-{uuid.uuid4().hex[:8]}")
    times: dict[str, float] = {}

    t0 = time.time()
    dt.works_table(spark, sf_dir).write.parquet(f"{work}/tables/works")
    dt.citations(spark, sf_dir).write.parquet(f"{work}/tables/citations")
    dt.vector_cache(spark, sf_dir).write.parquet(f"{work}/tables/vector_cache")
    times["tables_build"] = round(time.time() - t0, 3)
    works = spark.read.parquet(f"{work}/tables/works")
    cites = spark.read.parquet(f"{work}/tables/citations")
    vectors = spark.read.parquet(f"{work}/tables/vector_cache")
    seeds = works.select(F.col("id").alias("seed_id"))
    queries = dt.search_queries(spark, sf_dir)

    def timed(label, *dfs):
        t = time.time()
        for d in dfs:
            run(d() if callable(d) else d)
        times[label] = round(time.time() - t, 3)

    t = time.time()
    flagship = expand(works, cites, vectors, seeds, persist=True)
    run(flagship.edges)
    run(flagship.nodes)
    flagship.unpersist()
    times["u3_expand"] = round(time.time() - t, 3)
    t = time.time()
    postings_table = f"bench_postings_{uuid.uuid4().hex[:8]}"
    save_title_index(build_title_index(works, partitions=2 * cpus), f"{work}/index",
                     table=postings_table, buckets=2 * cpus)
    times["a1_index"] = round(time.time() - t, 3)
    index = load_title_index(spark, f"{work}/index", table=postings_table)
    timed("l1_search", lambda: search(works, queries, index=index).hits)
    timed("v3_similar", lambda: similar(vectors, seeds, 20))
    timed("x7_substring", lambda: substring_top(works, dt.substring_queries(spark, sf_dir)))

    def merged():
        full = expand(works, cites, vectors, seeds, persist=True)
        cit = full.cited
        n0, e0 = cit.nodes.drop("seed_id").limit(0), cit.edges.drop("seed_id").limit(0)
        n1, e1 = merge_graph(n0, e0, cit.nodes.drop("seed_id"), cit.edges.drop("seed_id"))
        return merge_graph(n1, e1, full.nodes.drop("seed_id"), full.edges.drop("seed_id"))[1]
    timed("u4_merge", merged)

    # Concept-filtered load of a gzip JSON-lines snapshot built from the tables
    from paperweave.operators.embed import hashing_encoder, refresh_vectors
    from paperweave.operators.tables import overwrite, upsert
    from paperweave.plans.load import load_filtered, load_generic
    snap = f"{work}/snapshot/data/works"
    (dt.raw_works(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
     .repartition(max(8, cpus)).write.option("compression", "gzip").text(f"{snap}/updated_date=2024-01-01"))
    t0 = time.time()
    load_filtered(spark, snap, ["C1", "C3"], f"{work}/loaded", glob="*.gz", load_id="bench")
    times["n1_load"] = round(time.time() - t0, 3)
    t0 = time.time()
    load_generic(spark, snap, f"{work}/loaded-all", glob="*.gz", load_id="bench")
    times["n2_load"] = round(time.time() - t0, 3)

    # V2 embeds the works without a vector; K4 writes half of them again
    new = vectors.where(F.crc32("paper_id") % 2 == 0).select("paper_id", F.reverse("embedding").alias("embedding"))
    timed("v2_refresh", lambda: refresh_vectors(works, vectors, hashing_encoder(64)))
    t0 = time.time()
    overwrite(upsert(vectors, new), f"{work}/vectors-upserted")
    times["k4_upsert"] = round(time.time() - t0, 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
