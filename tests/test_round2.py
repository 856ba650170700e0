"""Loads, tables and totals that must hold at any size and after a failure."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from paperweave.functions.text import py_strip, tokens
from paperweave.operators.filters import filter_concepts
from paperweave.operators.tables import DuplicateKeyError, create_tables, overwrite, read_table, restore, save_bucketed, upsert
from paperweave.operators.topn import running_totals
from paperweave.plans import load as load_mod
from paperweave.plans.load import ingest_metrics, load_filtered, load_generic
from paperweave.session import ensure_checkpoint_dir
from paperweave.sources.snapshot import list_files, read_works
from tests.test_ingest import CASES, case, write_snapshot


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("conf", [{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "17"},
                                  {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "50"}, {}])
def test_running_totals_of_many_rows(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 120_000
        df = spark.range(n).select(F.format_string("f%09d", (F.col("id") * 7919) % n).alias("k"), (F.col("id") % 11).alias("v"),
                                   F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("other"))
        got = running_totals(df, "k", ["v"], "nth")
        rows = sorted(got.select("k", "v", "nth", "v_total").collect())
        total = 0
        for i, r in enumerate(rows, 1):
            total += r.v
            assert (r.nth, r.v_total) == (i, total)
        assert len(rows) == n
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_metrics_count_files_without_valid_records(spark, tmp):
    path = write_snapshot(tmp, {"a.gz": [CASES["R1"], CASES["R2"]], "b.gz": [CASES["R3"], CASES["R9"]], "c.gz": [CASES["R6"]]})
    with gzip.open(os.path.join(path, "updated_date=2024-01-01", "empty.gz"), "wt"):
        pass
    m = {os.path.basename(r.file): r for r in load_filtered(spark, path, ["C1"], os.path.join(tmp, "db")).metrics.collect()}
    assert {k: (r.records, r.kept) for k, r in m.items()} == {"a.gz": (2, 1), "b.gz": (0, 0), "c.gz": (1, 1), "empty.gz": (0, 0)}
    assert sorted(r.files_done for r in m.values()) == [1, 2, 3, 4] and max(r.total_kept for r in m.values()) == 2
    assert list_files(spark, path).count() == 4
    raw = read_works(spark, path, keep_invalid=True)
    assert {os.path.basename(r.file) for r in ingest_metrics(raw, filter_concepts(raw, ["C1"])).collect()} == {"a.gz", "b.gz", "c.gz"}


def test_concept_table_of_any_size(spark, tmp):
    path = write_snapshot(tmp, {"a.gz": [CASES[k] for k in ("R1", "R2", "R4", "R5", "R8", "R14")] + [CASES["R1"]]})
    raw = read_works(spark, path).drop("_file", "_line")
    big = spark.range(150_000).select(F.concat(F.lit("X"), F.col("id")).alias("concept_id")).union(spark.createDataFrame([("C1",)]))
    short = ["C1", "other"]
    want = sorted(r.id for r in filter_concepts(raw, short).collect())
    assert want == sorted(r.id for r in filter_concepts(raw, big).collect()) and len(want) == 3
    assert want == sorted(r.id for r in filter_concepts(raw, [f"X{i}" for i in range(3000)] + ["C1"]).collect())
    assert filter_concepts(raw, []).count() == 0


def test_generic_load_again_after_a_failure(spark, tmp, monkeypatch):
    path = write_snapshot(os.path.join(tmp, "snap"), {"a.gz": [case(n) for n in range(1, 6)]})
    root, real = os.path.join(tmp, "db"), load_mod._write

    def dies(spark, root, works, citations, load_id):
        real(spark, root, works, citations.limit(0), load_id)
        raise RuntimeError("lost")

    monkeypatch.setattr(load_mod, "_write", dies)
    with pytest.raises(RuntimeError):
        load_generic(spark, path, root, load_id="one")
    assert read_table(spark, root, "works").count() == 5 and read_table(spark, root, "citations").count() == 0
    monkeypatch.setattr(load_mod, "_write", real)
    load_generic(spark, path, root, load_id="one")
    assert read_table(spark, root, "works").count() == 5 and read_table(spark, root, "citations").count() == 5
    with pytest.raises(DuplicateKeyError):
        load_generic(spark, path, root, load_id="two")
    out = load_filtered(spark, path, ["C1"], root, load_id="three")
    assert out.works.count() == 5                       # short ids differ from the generic loader's
    assert load_filtered(spark, path, ["C1"], root, load_id="three").works.count() == 5
    assert read_table(spark, root, "works").count() == 10


def test_a_load_parses_the_snapshot_once(spark, tmp):
    """Only the staging job reads JSON; everything else starts from its files."""
    path = write_snapshot(os.path.join(tmp, "snap"), {"a.gz": [CASES["R1"], CASES["R6"]]})
    raw = read_works(spark, path, keep_invalid=True)
    rows, kept, _ = load_mod.stage_filtered(raw, ["C1"])
    os.remove(os.path.join(path, "updated_date=2024-01-01", "a.gz"))
    batch = load_mod.filtered_batch(rows, ["C1"], spark.createDataFrame([], load_mod.WORKS), kept=kept)
    assert batch.works.count() == 2 and batch.citations.count() == 1 and batch.metrics.first().kept == 2


def test_tables_of_two_roots_in_the_catalog(spark, tmp):
    one, two = os.path.join(tmp, "one"), os.path.join(tmp, "two")
    db = "pw_test_db"
    try:
        create_tables(spark, one, database=db)
        create_tables(spark, one, database=db)
        with pytest.raises(ValueError):
            create_tables(spark, two, database=db)
        create_tables(spark, two)
        assert spark.table(f"{db}.works").count() == 0
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_overwrite_is_staged_and_restored(spark, tmp):
    path = os.path.join(tmp, "t")
    overwrite(spark.range(3), path)
    overwrite(spark.read.parquet(path).select((F.col("id") + 1).alias("id")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        overwrite(spark.read.parquet(path).select(F.raise_error(F.lit("broken"))), path)
    assert spark.read.parquet(path).count() == 3
    os.rename(path, path + ".old-1")                    # died between the two renames
    restore(spark, path)
    assert spark.read.parquet(path).count() == 3


def test_upsert_needs_an_order_for_repeated_keys(spark):
    old = spark.createDataFrame([("a", 0, 0)], "paper_id string, x int, pos int")
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], old.schema)
    with pytest.raises(DuplicateKeyError):
        upsert(old, new)
    got = {r.paper_id: r.x for r in upsert(old, new, order=[F.col("pos").desc()]).collect()}
    assert got == {"a": 2, "b": 3}


def test_one_file_per_bucket(spark, tmp):
    name = "pw_bucket_test"
    try:
        save_bucketed(spark.range(5000, numPartitions=8).withColumn("k", F.col("id").cast("string")), name, "k", 16, os.path.join(tmp, "b"))
        files = [f for f in os.listdir(os.path.join(tmp, "b")) if f.startswith("part-")]
        assert len(files) == 16
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_combining_marks_and_wide_spaces(spark):
    texts = ["été été", "Ångström Ångström", "naïve"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == [["ete", "ete"], ["angstrom", "angstrom"], ["naive"]]
    odd = ["  10.1/x　\t", "a b", "\x1c\x85x ", "", "\n", "x\n"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(py_strip(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == [t.strip() for t in odd]


def test_checkpoint_folder_off_local(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_stream_with_a_concept_table_and_index(spark, tmp):
    from paperweave.streaming.incremental import stream_filtered
    snap, root, index = (os.path.join(tmp, x) for x in ("snap", "db", "index"))
    os.makedirs(snap)
    wanted = spark.createDataFrame([("C1",)], "concept_id string")
    for name, keys, n in (("a.gz", ["R1", "R2", "R3"], 1), ("b.gz", ["R6", "R10"], 2)):
        with gzip.open(os.path.join(snap, name), "wt") as f:
            f.write("\n".join(CASES[k] for k in keys) + "\n")
        stream_filtered(spark, snap, wanted, root, os.path.join(tmp, "ckpt"), index_path=index).awaitTermination(120)
        assert read_table(spark, root, "works").count() == n
        assert spark.read.parquet(f"{index}/stats").first().n_docs == n


def brute_like(texts, pattern):
    import re
    rx = re.compile("(?s).*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower()) + ".*")
    return {i for i, t in texts if t is not None and rx.fullmatch(t.lower())}


@pytest.mark.parametrize("wildcards", [False, True])
def test_patterns_of_any_length_and_number(spark, wildcards):
    import random
    from paperweave.operators.search import substring_hits
    rnd = random.Random(3)
    texts = [(f"W{i}", "".join(rnd.choices("abcdé %_x", k=rnd.randrange(12)))) for i in range(60)] + [("Wn", None), ("We", "")]
    patterns = ["", "a", "É", "ab", "b ", "xyz", "%", "_", "__", "a%", "a_b", "%b%c", "abc", "_______", "qq", None]
    queries = [(i, p) for i, p in enumerate(patterns * 3)]
    works = spark.createDataFrame(texts, "id string, title string")
    got = {}
    for r in substring_hits(works, spark.createDataFrame(queries, "query_id long, q string"), wildcards).collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i, p in queries:
        want = set() if p is None else brute_like(texts, p) if wildcards else {k for k, t in texts if t is not None and p.lower() in t.lower()}
        assert sorted(got.get(i, [])) == sorted(want), p


def test_twenty_thousand_short_patterns(spark):
    from paperweave.operators.search import substring_hits
    letters = [chr(97 + i) for i in range(26)]
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), F.concat(
        F.element_at(F.array(*map(F.lit, letters)), (F.col("id") % 26 + 1).cast("int")),
        F.when(F.col("id") % 3 > 0, F.element_at(F.array(*map(F.lit, letters)), (F.col("id") % 25 + 1).cast("int"))).otherwise("")).alias("q"))
    works = spark.createDataFrame([("W1", "abba"), ("W2", "zebra"), ("W3", None)], "id string, title string")
    got = {(r.query_id, r.id) for r in substring_hits(works, queries).collect()}
    want = {(r.query_id, w) for r in queries.collect() for w, t in (("W1", "abba"), ("W2", "zebra")) if r.q in t}
    assert got == want
    marks = spark.range(20_000).select(F.col("id").alias("query_id"), F.repeat(F.lit("_"), (F.col("id") % 6).cast("int")).alias("q"))
    assert substring_hits(works, marks, True).count() == sum((i % 6 <= 4) + (i % 6 <= 5) for i in range(20_000))


def test_ties_are_cut_in_the_task(spark):
    """Thousands of equal vectors: k rows per seed and task, smallest ids first."""
    import numpy as np
    from paperweave.operators.similarity import similar, top_k
    vectors = spark.createDataFrame([(f"W{i:05d}", [1.0, 2.0]) for i in range(4000)], "paper_id string, embedding array<float>")
    unit = np.ones((4000, 2)) / np.sqrt(2)
    ids = np.array([f"W{i:05d}" for i in range(4000)], dtype=object)
    local = top_k(ids[:50], unit[:50], ids, unit, 5)
    assert len(local) == 250 and set(local.groupby("seed_id").size()) == {5}
    seeds = spark.createDataFrame([("W00000",), ("W03999",)], "seed_id string")
    for block in (None, 500):
        got = sorted((r.seed_id, r.rank, r.id) for r in similar(vectors, seeds, 5, block_rows=block).collect())
        assert [g[2] for g in got[:5]] == [f"W{i:05d}" for i in range(1, 6)]
        assert [g[2] for g in got[5:]] == [f"W{i:05d}" for i in range(5)]


def test_copies_of_an_id_do_not_crowd_out_others(spark):
    from paperweave.operators.similarity import similar
    rows = [("A", [1.0, 0.0])] + [("B", [1.0, 0.01 * i]) for i in range(8)] + [("C", [1.0, 0.5]), ("D", [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "paper_id string, embedding array<float>")
    seeds = spark.createDataFrame([("A",)], "seed_id string")
    for block in (None, 100):
        assert [r.id for r in sorted(similar(vectors, seeds, 2, block_rows=block).collect(), key=lambda r: r.rank)] == ["B", "C"]


def test_one_seed_shuffles_no_cache(spark):
    from paperweave.operators.similarity import similar
    vectors = spark.createDataFrame([(f"W{i}", [float(i), 1.0]) for i in range(50)], "paper_id string, embedding array<float>")
    plan = similar(vectors, spark.createDataFrame([("W3",)], "seed_id string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "CoGroup" not in plan
    below = plan[plan.index("MapInPandas"):]
    assert "Exchange hashpartitioning" not in below


def test_edges_join_no_wide_works(spark):
    """The edge plan reads ids and citation counts of works only."""
    import re
    from __spark_entry__ import queries
    df = queries()["u3_expand_edges"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "abstract" not in plan and "split(text" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 27


def test_porter_stems():
    from paperweave.functions.stem import porter
    want = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
            "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
            "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
            "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
            "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ",
            "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
            "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
            "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
            "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
            "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
            "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "homologous": "homolog",
            "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
            "roll": "roll", "networks": "network", "as": "as", "y": "y"}
    assert {w: porter(w) for w in want} == want


def test_stemmed_index(spark, tmp):
    from paperweave.operators.search import bm25_top, build_title_index, load_title_index, save_title_index
    works = spark.createDataFrame([("W1", "Neural networks"), ("W2", "A network of networks"), ("W3", "Relational algebra"), ("W4", None)],
                                  "id string, title string")
    queries = spark.createDataFrame([(1, "network"), (2, "relation"), (3, "networking relate")], "query_id long, q string")
    index = build_title_index(works, stem=True)
    save_title_index(index, os.path.join(tmp, "ix"))
    for ix in (index, load_title_index(spark, os.path.join(tmp, "ix"))):
        got = {}
        for r in bm25_top(ix, queries).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        assert got == {1: {"W1", "W2"}, 2: {"W3"}, 3: {"W1", "W2", "W3"}}
        assert {r.term: r.df for r in ix.terms.collect()}["network"] == 2
    plain = bm25_top(build_title_index(works), queries).collect()
    assert {r.id for r in plain if r.query_id == 1} == {"W2"}


def test_response_pages(spark):
    import json
    from paperweave.operators.graph import as_response
    nodes = spark.createDataFrame([("s", f"n{i:03d}", "t", 2000, "a", "v", 1) for i in range(25)],
                                  "seed_id string, id string, title string, year int, first_author string, venue string, cited_by_count int")
    edges = spark.createDataFrame([("s", "s", f"n{i:03d}", None) for i in range(42)], "seed_id string, source string, target string, type string")
    rows = sorted(as_response(nodes, edges, page_rows=10).collect(), key=lambda r: r.page)
    assert [(r.page, len(r.nodes), len(r.edges)) for r in rows] == [(0, 10, 10), (1, 10, 10), (2, 5, 10), (3, 0, 10), (4, 0, 2)]
    assert [n["id"] for r in rows for n in json.loads(r.response)["nodes"]] == [f"n{i:03d}" for i in range(25)]
    one = as_response(nodes, edges).collect()
    assert [(r.page, len(r.nodes)) for r in one] == [(0, 25)]


def test_hub_papers_are_stored_apart(spark, tmp):
    from paperweave.plans.expand import expand
    from paperweave.plans.layout import build_serving_tables
    works = spark.range(60).select(F.concat(F.lit("W"), "id").alias("id"), F.lit("10.1/x").alias("doi"), F.lit("t").alias("title"),
                                   F.lit(2000).alias("publication_year"), (F.col("id") * 7 % 50).cast("int").alias("cited_by_count"),
                                   F.lit("A").alias("first_author"), F.lit("V").alias("venue"), F.lit(None).cast("string").alias("abstract_inverted_index"))
    edges = [(f"W{i}", "W0") for i in range(1, 60)] + [(f"W{i}", f"W{(i * 3) % 70}") for i in range(60)] + [("W5", f"W{j}") for j in range(40)]
    cites = spark.createDataFrame(edges, "source_id string, target_id string")
    seeds = works.select(F.col("id").alias("seed_id"))
    try:
        t = build_serving_tables(works, cites, tmp, 4, prefix="pw_hub", hub_edges=30)
        assert [r[0] for r in t.citations_by_target.hub_keys.collect()] == ["W0"] and t.citations_by_target.hubs.count() >= 59
        assert [r[0] for r in t.citations_by_source.hub_keys.collect()] == ["W5"]
        assert t.citations_by_target.bucketed.count() + t.citations_by_target.hubs.count() == len(edges)
        plain = expand(works, cites, None, seeds)
        split = expand(t.works, cites, None, seeds, citations_by_target=t.citations_by_target, citations_by_source=t.citations_by_source)
        assert sorted(map(tuple, plain.edges.collect()), key=str) == sorted(map(tuple, split.edges.collect()), key=str)
        assert sorted(map(tuple, plain.nodes.collect()), key=str) == sorted(map(tuple, split.nodes.collect()), key=str)
    finally:
        for n in ("works_by_id", "citations_by_target", "citations_by_source"):
            spark.sql(f"DROP TABLE IF EXISTS pw_hub_{n}")


def test_few_terms_prune_the_postings_scan(spark, tmp):
    from paperweave.operators.search import build_title_index, load_title_index, save_title_index
    from paperweave.plans.search import search
    from paperweave.sources import driver_tables as dt
    w = dt.works(spark, "/root/testdata/sf0.001")
    save_title_index(build_title_index(w), os.path.join(tmp, "ix"))
    index = load_title_index(spark, os.path.join(tmp, "ix"))
    one = spark.createDataFrame([(1, "the and in")], "query_id long, q string")
    hits = search(w, one, index=index).hits
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan
    many = dt.title_queries(spark, "/root/testdata/sf0.001").unionByName(one.withColumn("query_id", F.lit(-1).cast("long")))
    batch = search(w, many, index=index).hits
    assert "In(term, [" not in batch._jdf.queryExecution().executedPlan().toString()
    cols = ["rank", "id", "score"]
    assert sorted(map(tuple, hits.select(*cols).collect())) == sorted(map(tuple, batch.where("query_id = -1").select(*cols).collect()))
