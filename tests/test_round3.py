"""Segments, bucketed tables, commits, pruning and worker paths."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from paperweave.operators import bucketed as bk
from paperweave.operators.embed import refresh_vectors
from paperweave.operators.manifest import ConflictError, commit_load, publish, read_manifest, update_manifest, withdraw_load
from paperweave.operators.search import bm25_pruned, bm25_scores, bm25_top, build_title_index, load_title_index, save_title_index
from paperweave.operators.segments import add_segment, load_segments, merge_segments, vacuum
from paperweave.operators.tables import DuplicateKeyError, create_tables, read_table
from paperweave.plans import load as load_mod
from paperweave.plans.load import load_filtered, load_generic
from tests.test_ingest import CASES, case, write_snapshot

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def titles(n, seed=1):
    """Titles over a Zipf-like vocabulary: a few words are in most of them."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8))) for _ in range(4000)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"W{i}", " ".join(rnd.choices(words, weights, k=rnd.randint(4, 18)))) for i in range(n)]
    queries = [(q, " ".join({*rnd.choices(words[:8], k=3), rnd.choice(words[20:200]), rnd.choice(words[20:200])})) for q in range(25)]
    return rows + [("Wn", None), ("We", "")], queries


# ---------------------------------------------------------------- manifest

def test_manifest_survives_a_dying_writer(spark, tmp):
    assert read_manifest(spark, tmp) == (0, {})
    publish(spark, tmp, 0, {"a": 1})
    with pytest.raises(ConflictError):
        publish(spark, tmp, 0, {"a": 2})
    with open(f"{tmp}/_manifest/{2:012d}.json", "w") as f:
        f.write('{"a": ')                                   # died while it wrote
    assert read_manifest(spark, tmp) == (2, {"a": 1})
    update_manifest(spark, tmp, lambda m: {"a": m["a"] + 10})
    assert read_manifest(spark, tmp) == (3, {"a": 11})
    for k in range(20):
        update_manifest(spark, tmp, lambda m, k=k: {"a": k})
    assert len([n for n in os.listdir(f"{tmp}/_manifest") if n.endswith(".json")]) == 10 and read_manifest(spark, tmp)[1] == {"a": 19}


# ---------------------------------------------------------------- search

def key(rows):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in rows)


def test_pruned_search_equals_the_whole_and_scores_few(spark, tmp):
    rows, queries = titles(6000)
    works, q = spark.createDataFrame(rows, "id string, title string"), spark.createDataFrame(queries, "query_id long, q string")
    save_title_index(build_title_index(works), tmp)
    index = load_title_index(spark, tmp)
    got = bm25_pruned(index, q, limit=5)
    assert key(got.top.collect()) == key(bm25_top(index, q, limit=5).collect())
    every = bm25_scores(index, q).count()
    assert got.scored.count() * 5 <= every and got.met.count() < every / 2


def test_pruned_search_of_awkward_queries(spark, tmp):
    rows, queries = titles(300, seed=4)
    queries += [(100, ""), (101, "zzzz"), (102, rows[0][1]), (103, rows[0][1] + " zzzz"), (104, None)]
    works, q = spark.createDataFrame(rows, "id string, title string"), spark.createDataFrame(queries, "query_id long, q string")
    save_title_index(build_title_index(works, stopwords=("aa",)), tmp)
    index = load_title_index(spark, tmp)
    assert key(bm25_pruned(index, q).top.collect()) == key(bm25_top(index, q).collect())
    assert key(bm25_pruned(index, q, limit=1000).top.collect()) == key(bm25_top(index, q, limit=1000).collect())
    with pytest.raises(ValueError):
        bm25_pruned(build_title_index(works), q)
    save_title_index(build_title_index(works.limit(0)), tmp + "/empty")
    assert bm25_pruned(load_title_index(spark, tmp + "/empty"), q).top.count() == 0


def test_segments_equal_one_index(spark, tmp):
    rows, queries = titles(400, seed=2)
    works, q = spark.createDataFrame(rows, "id string, title string"), spark.createDataFrame(queries, "query_id long, q string")
    part = F.pmod(F.xxhash64("id"), F.lit(7))
    seen = {}
    for k in range(7):
        add_segment(works.where(part == k), tmp, f"load-{k}", fanout=3)
        for d, _, names in os.walk(f"{tmp}/segments"):
            for n in names:
                path = os.path.join(d, n)
                assert seen.setdefault(path, os.stat(path).st_mtime_ns) == os.stat(path).st_mtime_ns   # never written again
    whole = bm25_top(build_title_index(works), q).collect()
    assert key(bm25_top(load_segments(spark, tmp), q).collect()) == key(whole)
    assert key(bm25_pruned(load_segments(spark, tmp), q).top.collect()) == key(whole)
    live = read_manifest(spark, tmp)[1]["segments"]
    assert 1 < len(live) < 7 and sorted(n for s in live for n in s["names"]) == [f"load-{k}" for k in range(7)]
    assert sorted(r.df for r in load_segments(spark, tmp).postings_with_df().collect()) == sorted(
        r.df for r in build_title_index(works).postings_with_df().collect())
    add_segment(works.where(part == 6), tmp, "load-6", fanout=3)          # replayed
    add_segment(works.where(part == 0), tmp, "load-0", fanout=3)          # replayed, merged already
    assert key(bm25_top(load_segments(spark, tmp), q).collect()) == key(whole)
    assert vacuum(spark, tmp) and key(bm25_top(load_segments(spark, tmp), q).collect()) == key(whole)
    with pytest.raises(ValueError):
        add_segment(works, tmp, "other", stem=True)


def test_a_segment_holds_its_own_postings_only(spark, tmp):
    rows, _ = titles(200, seed=3)
    works = spark.createDataFrame(rows, "id string, title string")
    add_segment(works.limit(0), tmp, "none")
    assert read_manifest(spark, tmp)[1]["segments"] == []
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    add_segment(works.where(half == 0), tmp, "a", fanout=3)
    add_segment(works.where(half == 1), tmp, "b", fanout=3)
    folders = {s["names"][0]: s["folder"] for s in read_manifest(spark, tmp)[1]["segments"]}
    ids = lambda n: {r.id for r in spark.read.parquet(f"{tmp}/{folders[n]}/postings").select("id").collect()}
    both = {r.id for r in works.where("title <> ''").collect()}
    assert ids("a") and ids("b") and not ids("a") & ids("b") and ids("a") | ids("b") == both
    merge_segments(spark, tmp, fanout=2)
    assert [s["docs"] for s in read_manifest(spark, tmp)[1]["segments"]] == [201]


# ---------------------------------------------------------------- bucketed tables

def table(rows, spark):
    return spark.createDataFrame(rows, "paper_id string, x int")


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp):
    schema = table([], spark).schema
    bk.create_bucketed(spark, tmp, schema, ["paper_id"], 32)
    bk.create_bucketed(spark, tmp, schema, ["paper_id"], 5)               # there already: stays as it is
    assert bk.read_bucketed(spark, tmp).count() == 0 and bk.upsert_bucketed(table([], spark), tmp).buckets == []
    bk.upsert_bucketed(table([(f"p{i}", i) for i in range(1000)] + [(None, -1)], spark), tmp)
    before = files(tmp)
    new = [(f"p{i}", -i) for i in range(0, 1000, 100)] + [("q", 7)]
    done = bk.upsert_bucketed(table(new, spark), tmp)
    assert 1 <= len(done.buckets) <= 11 and len({os.path.dirname(p) for p in files(f"{tmp}/rows") - before}) == len(done.buckets)
    want = {**{f"p{i}": i for i in range(1000)}, None: -1, **dict(new)}
    assert {r.paper_id: r.x for r in bk.read_bucketed(spark, tmp).collect()} == want
    assert bk.read_bucketed(spark, tmp).count() == len(want)
    with pytest.raises(DuplicateKeyError):
        bk.upsert_bucketed(table([("a", 1), ("a", 2)], spark), tmp)
    bk.upsert_bucketed(table([("a", 1), ("a", 2), ("a", 3)], spark), tmp, order=[F.col("x").desc()])
    assert bk.read_bucketed(spark, tmp).where("paper_id = 'a'").first().x == 3
    bk.upsert_bucketed(bk.read_bucketed(spark, tmp).where("paper_id = 'q'").withColumn("x", F.col("x") + 1), tmp)   # reads itself
    assert bk.read_bucketed(spark, tmp).where("paper_id = 'q'").first().x == 8
    assert bk.vacuum_bucketed(spark, tmp) and bk.read_bucketed(spark, tmp).count() == len(want) + 1


def test_upsert_that_dies_or_loses_changes_nothing(spark, tmp, monkeypatch):
    bk.create_bucketed(spark, tmp, table([], spark).schema, ["paper_id"], 4)
    bk.upsert_bucketed(table([("a", 1), ("b", 2)], spark), tmp)
    real = bk.publish
    for error in (RuntimeError("lost"), ConflictError("late")):
        def dies(*a, error=error):
            raise error

        monkeypatch.setattr(bk, "publish", dies)
        with pytest.raises(type(error)):
            bk.upsert_bucketed(table([("a", 9), ("c", 3)], spark), tmp)
        assert {(r.paper_id, r.x) for r in bk.read_bucketed(spark, tmp).collect()} == {("a", 1), ("b", 2)}
    monkeypatch.setattr(bk, "publish", real)
    bk.upsert_bucketed(table([("a", 9), ("c", 3)], spark), tmp)
    assert {(r.paper_id, r.x) for r in bk.read_bucketed(spark, tmp).collect()} == {("a", 9), ("b", 2), ("c", 3)}


def test_unknown_rows_read_the_buckets_they_may_hit(spark, tmp, monkeypatch):
    bk.create_bucketed(spark, tmp, table([], spark).schema, ["paper_id"], 64)
    bk.upsert_bucketed(table([(f"p{i}", i % 2) for i in range(3000)], spark), tmp)
    read, real = [], bk._read

    def spied(spark, path, state, some=None, part="rows"):
        read.append((part, len(some)))
        return real(spark, path, state, some, part)

    monkeypatch.setattr(bk, "_read", spied)
    batch = table([(f"n{i}", i) for i in range(30)] + [("p5", 1), ("p6", 2), (None, 3)], spark)
    got = {r.paper_id for r in bk.unknown_rows(batch, tmp).collect()}
    assert got == {f"n{i}" for i in range(30)} | {None}
    assert dict(read)["filter"] <= 33 and dict(read)["rows"] <= 5        # two hits, and few false ones
    assert {r.paper_id for r in bk.unknown_rows(batch, tmp, F.col("x") == 1).collect()} == got | {"p6"}


# ---------------------------------------------------------------- loads

def test_a_load_shows_in_all_tables_at_once(spark, tmp, monkeypatch):
    path = write_snapshot(os.path.join(tmp, "snap"), {"a.gz": [case(n) for n in range(1, 6)]})
    root, seen = os.path.join(tmp, "db"), []
    real = load_mod.commit_load

    def looks(spark, root, load_id):
        seen.append((read_table(spark, root, "works").count(), read_table(spark, root, "citations").count()))
        real(spark, root, load_id)

    monkeypatch.setattr(load_mod, "commit_load", looks)
    load_generic(spark, path, root, load_id="001")
    assert seen == [(0, 0)] and read_table(spark, root, "works").count() == 5 and read_table(spark, root, "citations").count() == 5
    load_generic(spark, path, root, load_id="001")                        # again: neither while it is written anew
    assert seen == [(0, 0)] * 2 and read_table(spark, root, "works").count() == 5
    withdraw_load(spark, root, "001")
    assert read_table(spark, root, "works").count() == 0
    commit_load(spark, root, "001")
    assert read_table(spark, root, "works").count() == 5


def test_loads_with_an_id_table_and_segments(spark, tmp, monkeypatch):
    snap = lambda name, keys: write_snapshot(os.path.join(tmp, name), {f"{name}.gz": [CASES[k] for k in keys]})
    root, ids, index = (os.path.join(tmp, x) for x in ("db", "ids", "index"))
    create_tables(spark, root)
    one, two = snap("one", ["R1", "R6", "R7"]), snap("two", ["R1", "R10", "R14"])
    load_filtered(spark, one, ["C1"], root, load_id="1", ids_path=ids, segments_path=index)
    first = sorted(r.id for r in read_table(spark, root, "works").collect())

    def dies(*_):
        raise RuntimeError("lost")

    real = load_mod.commit_load
    monkeypatch.setattr(load_mod, "commit_load", dies)
    with pytest.raises(RuntimeError):
        load_filtered(spark, two, ["C1"], root, load_id="2", ids_path=ids, segments_path=index)
    assert sorted(r.id for r in read_table(spark, root, "works").collect()) == first
    monkeypatch.setattr(load_mod, "commit_load", real)
    out = load_filtered(spark, two, ["C1"], root, load_id="3", ids_path=ids, segments_path=index)   # ids of the lost load don't count
    plain = os.path.join(tmp, "plain")
    load_filtered(spark, one, ["C1"], plain, load_id="1")
    want = load_filtered(spark, two, ["C1"], plain, load_id="3")
    assert sorted(out.works.collect()) == sorted(want.works.collect())
    assert load_filtered(spark, two, ["C1"], root, load_id="3", ids_path=ids, segments_path=index).works.count() == want.works.count()
    assert sorted(r.id for r in read_table(spark, root, "works").collect()) == sorted(r.id for r in read_table(spark, plain, "works").collect())
    titled = read_table(spark, root, "works").where("title is not null").count()
    assert load_segments(spark, index).stats.first().n_docs == titled


def test_stream_reports_progress(spark, tmp):
    from paperweave.streaming.incremental import stream_filtered
    snap = write_snapshot(os.path.join(tmp, "snap"), {"a.gz": [CASES[k] for k in ("R1", "R2", "R6", "R7")]})
    seen = []
    stream_filtered(spark, snap, ["C1"], os.path.join(tmp, "db"), os.path.join(tmp, "ckpt"), ids_path=os.path.join(tmp, "ids"),
                    segments_path=os.path.join(tmp, "index"), on_progress=seen.append).awaitTermination(120)
    root = os.path.join(tmp, "db")
    assert len(seen) == 1 and seen[0].works == read_table(spark, root, "works").count()
    assert seen[0].citations == read_table(spark, root, "citations").count() and seen[0].kept <= seen[0].records
    raw = read_table(spark, root, "works").count()
    assert seen[0].kept >= raw


# ---------------------------------------------------------------- embeddings and workers

def test_each_missing_text_is_embedded_once(spark, tmp):
    works = spark.createDataFrame([(f"W{i}", f"title {i}", None) for i in range(40)], "id string, title string, abstract_inverted_index string")
    cache = spark.createDataFrame([(f"W{i}", [1.0, 2.0]) for i in range(10)], "paper_id string, embedding array<float>")
    log = os.path.join(tmp, "calls")

    def make():
        import numpy as np

        def predict(texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            return np.zeros((len(texts), 2), np.float32)

        return predict

    refresh_vectors(works, cache, make).write.parquet(os.path.join(tmp, "out"))
    assert os.path.getsize(log) == 30
    with pytest.raises(DuplicateKeyError):
        refresh_vectors(works.union(works), cache, make)


SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from paperweave.session import local_session
spark = local_session(2, shuffle_partitions=2)
def there(_):
    try:
        import paperweave
        return [1]
    except ImportError:
        return [0]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [0]
from __spark_entry__ import queries
for name in {names!r}:
    print(name, queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["v1_embed", "v2_refresh_vectors", "v3_similar", "l1_stemmed_search"]])
def test_workers_need_no_package(tmp, names):
    """The driver finds the package by its own path; the workers don't."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names)], cwd=tmp, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert len([line for line in out.stdout.splitlines() if line.split(" ")[0] in names]) == len(names)


def test_state_files_hold_names_only(spark, tmp):
    bk.create_bucketed(spark, tmp, table([], spark).schema, ["paper_id"], 4)
    bk.upsert_bucketed(table([("secret-value", 1)], spark), tmp)
    for n in os.listdir(f"{tmp}/_manifest"):
        if n.endswith(".json"):
            with open(f"{tmp}/_manifest/{n}") as f:
                assert "secret-value" not in json.dumps(json.load(f))


# ---------------------------------------------------------------- similarity

def vectors(spark, n, dim, seed=1, clusters=12):
    import numpy as np
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, dim))
    rows = [(f"W{i}", (centres[i % clusters] + 0.25 * rnd.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    return spark.createDataFrame(rows + [("Wz", [0.0] * dim), ("Wn", None)], "paper_id string, embedding array<float>")


@pytest.fixture()
def many_partitions(spark):
    """As on a cluster: keys that belong together must meet by their hash, not by chance in one partition."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brute_cosine(spark_rows, limit):
    import numpy as np
    ids = [r.paper_id for r in spark_rows if r.embedding and any(r.embedding)]
    m = np.array([r.embedding for r in spark_rows if r.embedding and any(r.embedding)], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    return {i: [j for _, j in sorted((-s[a, b], ids[b]) for b in range(len(ids)) if ids[b] != i)[:limit]] for a, i in enumerate(ids)}


@pytest.mark.parametrize("block_rows", [None, 23])
def test_exact_similarity_over_many_partitions(spark, many_partitions, block_rows):
    from paperweave.operators.similarity import similar
    v = vectors(spark, 150, 8).cache()
    got = {}
    for r in similar(v, v.selectExpr("paper_id AS seed_id"), 5, block_rows=block_rows).orderBy("seed_id", "rank").collect():
        got.setdefault(r.seed_id, []).append(r.id)
    assert got == brute_cosine(v.collect(), 5)


def test_approximate_similarity_finds_near_neighbours(spark, many_partitions, monkeypatch):
    import paperweave.operators.lsh as lsh
    v = vectors(spark, 600, 32, seed=2).cache()
    v = v.union(spark.createDataFrame([(f"copy{i}", v.first().embedding) for i in range(50)], v.schema)).cache()
    want = brute_cosine(v.collect(), 10)
    for rows in (lsh.GROUP_ROWS, 16):                       # groups as they are, and dealt out in parts
        monkeypatch.setattr(lsh, "GROUP_ROWS", rows)
        got = lsh.similar_approximate(v, v.selectExpr("paper_id AS seed_id"), 10, tables=10, bits=5, probes=1).collect()
        pairs = {(r.seed_id, r.id) for r in got}
        found = sum((i, j) in pairs for i, js in want.items() for j in js) / sum(map(len, want.values()))
        assert found >= 0.9 and max(r["rank"] for r in got) == 10


def test_approximate_similarity_on_whole_tables(spark):
    """On random vectors, whose neighbours are at wide angles, most pairs have to be compared."""
    from paperweave.plans.registry import registry
    sf = "/root/testdata/sf0.01"
    pairs = lambda n: {(r.seed_id, r.id) for r in registry()[n](spark, sf).collect()}
    want = pairs("v3_similar")
    assert len(want & pairs("v3_similar_approximate")) >= 0.9 * len(want)
