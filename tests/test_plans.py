"""Physical-plan checks: the scale properties the design relies on."""

from __future__ import annotations

import re

from paperweave.plans.registry import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbour_limit_runs_before_shuffle(spark):
    p = plan(registry()["j1_references"](spark, SF))
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns(spark):
    df = registry()["j7_missing_seeds"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("text" not in s for s in schemas)    # documents.text never read


def test_no_python_udf_in_search(spark):
    p = plan(registry()["l1_search"](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_no_cartesian_in_expand(spark):
    p = plan(registry()["u3_expand_edges"](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bucketed_layout_avoids_edge_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F
    from paperweave.operators.joins import references
    from paperweave.plans.expand import expand
    from paperweave.plans.layout import build_serving_tables
    from paperweave.sources import driver_tables as dt
    w, c = dt.works_table(spark, SF), dt.citations(spark, SF)
    st = build_serving_tables(w, c, str(tmp_path), buckets=4, prefix="t")
    seeds = w.select(F.col("id").alias("seed_id"))
    df = references(st.works, st.citations_by_target, seeds)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, l in enumerate(lines) if "t_citations_by_target" in l)
    smj = max(i for i in range(scan) if "SortMergeJoin" in lines[i])
    assert "Bucketed: true" in lines[scan]
    # the edge scan feeds the works join with no shuffle in between
    assert not any("Exchange hashpartitioning" in l for l in lines[smj:scan])
    same = sorted(tuple(r) for r in references(w, c, seeds).collect())
    assert sorted(tuple(r) for r in df.collect()) == same
    ex = expand(st.works, c, None, seeds, citations_by_target=st.citations_by_target,
                citations_by_source=st.citations_by_source)
    assert ex.edges.count() == expand(w, c, None, seeds).edges.count()


def test_substring_search_is_an_equi_join(spark):
    # every sentence of 40 passages at sf0.001, all with a trigram: above the nested-loop
    # bound, so queries meet titles through trigram equi-joins only (queries
    # shorter than three characters would add a counted nested loop)
    from pyspark.sql import functions as F
    from paperweave.operators.search import substring_hits
    from paperweave.sources import driver_tables as dt
    qs = dt.substring_queries(spark, SF).where(F.char_length("q") >= 3)
    for wildcards in (False, True):
        p = plan(substring_hits(dt.works(spark, SF), qs, wildcards=wildcards))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_bucketed_postings_sum_without_shuffle(spark, tmp_path):
    from paperweave.operators.search import bm25_top, build_title_index, load_title_index, save_title_index
    from paperweave.sources import driver_tables as dt
    idx = build_title_index(dt.works(spark, SF))
    save_title_index(idx, str(tmp_path / "plain"))
    save_title_index(idx, str(tmp_path / "bucketed"), table="t_postings_by_id", buckets=4)
    queries = dt.search_queries(spark, SF)
    plain = bm25_top(load_title_index(spark, str(tmp_path / "plain")), queries)
    bucketed = bm25_top(load_title_index(spark, str(tmp_path / "bucketed"), table="t_postings_by_id"), queries)
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r) for r in bucketed.collect())
    lines = bucketed._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, l in enumerate(lines) if "t_postings_by_id" in l)
    final_agg = next(i for i, l in enumerate(lines) if "HashAggregate" in l and "partial_" not in l)
    assert "Bucketed: true" in lines[scan]
    # the per-(query, work) sum runs on the bucketed scan with no exchange
    assert not any("Exchange" in l for l in lines[final_agg:scan] if "BroadcastExchange" not in l)


def test_checked_broadcast_bounds_rows_and_bytes(spark):
    from paperweave.operators.topn import bounded_size, checked_broadcast
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(10)], "k long, s string")
    assert bounded_size(df, 100) == (10, 10 * (8 + 1000))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(checked_broadcast(df, max_rows=10, max_bytes=20_000))
    assert not hinted(checked_broadcast(df, max_rows=9, max_bytes=20_000))     # too many rows
    assert not hinted(checked_broadcast(df, max_rows=10, max_bytes=5_000))     # too many bytes


def test_running_totals_match_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from paperweave.operators.topn import running_totals
    df = spark.range(1000).select(F.format_string("f%05d", (F.col("id") * 7919) % 1000).alias("file"),
                                  ((F.col("id") * 31) % 17).alias("kept"))
    got = running_totals(df, "file", ["kept"], count_as="files_done")
    w = Window.orderBy("file")
    want = (df.withColumn("files_done", F.row_number().over(w))
            .withColumn("kept_total", F.sum("kept").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cols = ["file", "kept", "files_done", "kept_total"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def _lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_doi_lookup_streams_works_without_shuffle(spark):
    from paperweave.operators.search import doi_first
    from paperweave.sources import driver_tables as dt
    df = doi_first(dt.works(spark, SF), dt.search_queries(spark, SF))
    df.write.format("noop").mode("overwrite").save()
    lines = _lines(df)
    bhj = next(i for i, l in enumerate(lines) if "BroadcastHashJoin" in l)
    # the works side scans doc_id and text (titles); the query sides do not
    scan = next(i for i in range(bhj, len(lines)) if re.search(r"FileScan parquet \[doc_id#\d+L?,text#", lines[i]))
    # the works side of the join reads the table directly: no exchange between
    assert not any("Exchange" in l and "Broadcast" not in l for l in lines[bhj:scan]
                   if l.strip(" :+-").startswith(("Exchange", "ShuffleQueryStage", "AQEShuffleRead")))


def test_inline_index_bm25_sum_without_shuffle(spark):
    from paperweave.operators.search import bm25_top, build_title_index
    from paperweave.sources import driver_tables as dt
    df = bm25_top(build_title_index(dt.works(spark, SF)), dt.title_queries(spark, SF))
    df.write.format("noop").mode("overwrite").save()
    plan = "\n".join(_lines(df))
    # one shuffle by work id (titles), none between the postings and the sum
    assert plan.count("REPARTITION_BY_COL") >= 1
    final_sum = plan.index("HashAggregate(keys=[query_id")
    partial_sum = plan.index("partial_sum", final_sum)
    assert "Exchange hashpartitioning(query_id" not in plan[final_sum:partial_sum]
