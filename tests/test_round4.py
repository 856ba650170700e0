"""Work that grows no faster than its input: exploration, snapshot files, Python memory, pattern joins."""

import os

import pytest
from pyspark.sql import functions as F

from paperweave.plans.expand import explore

WORK = "id string, title string, publication_year int, first_author string, venue string, cited_by_count int"


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exploration_merges_ids_only(spark):
    w = spark.createDataFrame([(f"W{i}", f"title {i}", 2000, "a", "v", i) for i in range(6)] + [("W1", "title 1", 2000, "a", "v", 1)], WORK)
    c = spark.createDataFrame([("W0", "W1"), ("W1", "W2"), ("W2", "W3"), ("W4", "W5")], "source_id string, target_id string")
    ex = explore(w, c, None, spark.createDataFrame([("W0",), ("W4",)], "root_id string"))
    assert sorted((r.root_id, r.id, r.title) for r in ex.nodes.collect()) == [
        ("W0", "W0", "title 0"), ("W0", "W1", "title 1"), ("W0", "W2", "title 2"), ("W4", "W4", "title 4"), ("W4", "W5", "title 5")]
    merged = [x for x in optimized(ex.nodes).splitlines() if "Aggregate [root_id" in x]
    assert merged and not any("title" in x for x in merged)


def test_snapshot_files_follow_the_lines(spark, tmp, monkeypatch):
    from paperweave.sources import driver_tables as dt
    monkeypatch.setattr(dt, "FILE_LINES", 10)
    lines = spark.range(0, 105, 1, 2).select(F.concat(F.lit("line "), "id").alias("value"),
                                             F.when(F.col("id") < 100, "2024-01-01").otherwise("2024-01-02").alias("updated_date"))
    path = dt.write_snapshot(lines, os.path.join(tmp, "snap"))
    files = {day: [f for f in os.listdir(f"{path}/updated_date={day}") if f.endswith(".gz")] for day in ("2024-01-01", "2024-01-02")}
    assert 5 <= len(files["2024-01-01"]) <= 15 and len(files["2024-01-02"]) == 1
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(f"line {i}" for i in range(105))
    most = spark.read.text(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most <= 20


def test_texts_are_taken_in_pieces():
    import pyarrow as pa

    from paperweave.functions.abstract import pieces
    texts = pa.array(["a" * 40, None, "b" * 70, "c" * 200, "", "d"])
    got = list(pieces(texts, 100))
    assert [x for p in got for x in p.to_pylist()] == texts.to_pylist()
    assert [len(p) for p in got] == [2, 1, 1, 2]


def test_codes_are_made_in_pieces():
    import numpy as np
    import pandas as pd

    from paperweave.operators.lsh import CODED_ROWS, _codes
    frame = pd.DataFrame({"id": [f"W{i}" for i in range(1100)], "vec": list(np.random.default_rng(0).normal(size=(1100, 4)))})
    out = list(_codes(3, 4, 1, 1)([frame]))
    assert sum(map(len, out)) == 1100 * 6 and max(map(len, out)) <= CODED_ROWS * 6


def test_concepts_are_resolved_without_moving_pairs(spark):
    from paperweave.operators.joins import resolve_concepts
    concepts = spark.createDataFrame([("x/C3", "Deep Learning"), ("x/C1", "deep learning"), ("x/C2", "learning deep nets"), ("x/C4", "maps"),
                                      ("x/C5", "maps"), ("x/C5", "maps"), (None, "seas"), ("x/C6", None)], "id string, display_name string")
    terms = spark.createDataFrame([(1, "deep learning"), (2, "nets, deep learning"), (3, "Maps"), (4, "nothing"), (5, "seas"), (6, None)],
                                  "term_pos int, term string")
    got = resolve_concepts(terms, concepts)
    assert [tuple(r) for r in got.collect()] == [(1, "deep learning", "C1"), (2, "nets, deep learning", "C2"), (3, "Maps", "C5"), (5, "seas", None)]
    assert not any("Aggregate [term_pos" in x for x in optimized(got).splitlines())


def test_response_needs_no_join(spark):
    from paperweave.operators.graph import as_response
    nodes = spark.createDataFrame([("s", f"W{i}", "t", 1, "a", "v", 2) for i in range(3)] + [(None, "W9", "t", 1, "a", "v", 2)],
                                  "seed_id string, id string, title string, year int, first_author string, venue string, cited_by_count int")
    edges = spark.createDataFrame([("s", "W0", f"W{i}", None) for i in range(5)] + [("gone", "a", "b", None)],
                                  "seed_id string, source string, target string, type string")
    got = as_response(nodes, edges, page_rows=2)
    assert sorted((r.seed_id, r.page, len(r.nodes), len(r.edges)) for r in got.collect()) == [("s", 0, 2, 2), ("s", 1, 1, 2), ("s", 2, 0, 1)]
    assert "Join" not in optimized(got)


def test_patterns_of_one_length_meet_by_equality(spark):
    from paperweave.operators.search import doi_matches
    works = spark.createDataFrame([(f"W{i}", "t", d) for i, d in enumerate(
        ["10.1/a_b", "10.1/axb", "10.1/A\U0001f600b", "10.1/ab", "10.1/a_bc", "10.1/a\nb", None, "10.1/\\x_"])], "id string, title string, doi string")
    queries = spark.createDataFrame([(1, " 10.1/a_B "), (2, "10.1/___"), (3, "10.1/%b"), (4, "10.1/ab"), (5, "10.1/\\_y"), (6, "10.1/\\__")],
                                    "query_id int, q string")
    got = doi_matches(works, queries, wildcards=True)
    want = {1: "0 1 2 5", 2: "0 1 2 5 7", 3: "0 1 2 3 5", 4: "3", 6: "7"}
    assert sorted((r.query_id, r.id) for r in got.collect()) == sorted((q, f"W{i}") for q, ids in want.items() for i in ids.split())
    assert "shape" in optimized(got)


def test_stems_stay_where_their_titles_are(spark):
    from paperweave.functions.stem import stems
    from paperweave.operators.search import build_title_index
    rows = spark.createDataFrame([(1, ["networks", "network", "maps"]), (2, None), (3, []), (4, ["networks"])], "k int, toks array<string>")
    assert {r.k: r.s for r in rows.select("k", stems("toks").alias("s")).collect()} == {
        1: ["network", "network", "map"], 2: None, 3: [], 4: ["network"]}
    index = build_title_index(spark.createDataFrame([("W1", "networks network maps")], "id string, title string"), stem=True)
    assert {(r.term, r.tf, r.doc_len) for r in index.postings.collect()} == {("network", 2, 3), ("map", 1, 3)}
    assert "Join" not in optimized(index.postings)


def test_few_texts_among_many_dois_are_broadcast(spark, monkeypatch):
    from paperweave.plans import search as s
    monkeypatch.setattr(s, "BROADCAST_ROWS", 6)
    works = spark.createDataFrame([(f"W{i}", f"blue whale {i}", 2000, "a", "v", 0, f"10.1/{i}") for i in range(8)], f"{WORK}, doi string")
    queries = spark.createDataFrame([(i, f"10.1/{i}") for i in range(8)] + [(8, "whale")], "query_id int, q string")
    hits = s.search(works, queries).hits
    assert "strategy=broadcast" in optimized(hits)
    assert sorted((r.query_id, r.id) for r in hits.collect()) == [(i, f"W{i}") for i in range(8)] + [(8, f"W{i}") for i in range(8)]


def test_a_slot_holds_one_object():
    import pyspark

    from paperweave.worker import new_key, shared
    first, second = new_key(), new_key()
    assert shared(first, lambda: 1, slot="round") == 1 and shared(second, lambda: 2, slot="round") == 2
    held = pyspark.__dict__["_paperweave_shared"]
    assert second in held and first not in held


def test_each_snapshot_file_has_a_task_of_its_own(spark, tmp_path, monkeypatch):
    """No task writes several files, whatever the number of days and of their lines."""
    import paperweave.sources.driver_tables as dt
    monkeypatch.setattr(dt, "FILE_LINES", 50)
    lines = spark.range(28 * 200).select(F.col("id").cast("string").alias("value"), F.concat(F.lit("d"), F.col("id") % 28).alias("updated_date"))
    path = dt.write_snapshot(lines, str(tmp_path / "s"))
    files = list((tmp_path / "s").glob("*/*.gz"))
    assert len(files) == len({f.name.split("-")[1] for f in files}) == 28 * 4
    got = spark.read.text(path)
    assert sorted(int(r.value) for r in got.collect()) == list(range(28 * 200))
    empty = dt.write_snapshot(lines.limit(0), str(tmp_path / "none"))
    assert spark.read.schema("value string, updated_date string").text(empty).count() == 0
