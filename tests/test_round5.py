"""Work that keeps within a machine's disk: exploration in cells, neighbours by two shuffles, vectors and texts moved once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperweave.plans.expand import expand, explore

WORK = "id string, title string, publication_year int, first_author string, venue string, cited_by_count int"


def graph(spark, n=60):
    rnd = random.Random(3)
    w = spark.createDataFrame([(f"W{i}", f"title {i}" * (i % 5), 2000, None, "v", rnd.randrange(9)) for i in range(n)], WORK)
    c = spark.createDataFrame([(f"W{rnd.randrange(n + 9)}", f"W{rnd.randrange(n + 9)}") for _ in range(3 * n)], "source_id string, target_id string")
    v = spark.createDataFrame([(f"W{i}", [rnd.random() - 0.5 for _ in range(4)]) for i in range(0, n, 2)], "paper_id string, embedding array<double>")
    return w, c, v


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_exploration_in_cells_is_that_of_whole_graphs(spark, monkeypatch, hops):
    from paperweave.operators import cells
    for name, value in (("PART_ENTRIES", 150), ("PART_ROWS", 25), ("GROUP_IDS", 100), ("CHUNK", 64), ("BATCH_BYTES", 500)):
        monkeypatch.setattr(cells, name, value)
    w, c, v = graph(spark)
    limits = {"ref_limit": 3, "cite_limit": 2, "sim_limit": 2}
    held, reached = {}, {}
    ex = expand(w, c, v, w.select(F.col("id").alias("seed_id")), **limits)
    for e in ex.edges.collect():
        held.setdefault(e.seed_id, []).append((e.source, e.target, e.type))
    for p in ex.pairs.collect():
        reached.setdefault(p.seed_id, set()).add(p.id)
    roots = [f"W{i}" for i in range(0, 60, 3)]
    want_nodes, want_edges = set(), set()
    for root in roots:
        nodes, edges, now = {root}, {}, {root}
        for _ in range(hops):
            new = {}
            for s, t, kind in (e for seed in now for e in held.get(seed, [])):
                new[s, t] = None if kind is None or ((s, t) in new and new[s, t] is None) else kind
            edges = {**new, **edges}
            now = set().union(*(reached[seed] for seed in now)) - nodes
            nodes |= now
        want_nodes |= {(root, x) for x in nodes}
        want_edges |= {(root, s, t, kind) for (s, t), kind in edges.items()}
    got = explore(w, c, v, spark.createDataFrame([(r,) for r in [*roots, "W-none", None]], "root_id string"), hops=hops, **limits)
    nodes = [tuple(r) for r in got.nodes.collect()]
    titles = {r.id: r.title for r in w.collect()}
    assert sorted(r[:2] for r in nodes) == sorted(want_nodes) and all(r[2] == titles[r[1]] for r in nodes)
    assert sorted(map(tuple, got.edges.collect()), key=str) == sorted(want_edges, key=str)
    # no row per pair of a root and a node is joined or dealt out again
    top = got.nodes._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert len(top) == 2 and not any(x in top[0] for x in ("Join", "Aggregate", "Repartition"))


def test_neighbours_of_many_seeds_are_those_of_each_direction(spark, monkeypatch):
    from paperweave.operators import joins
    from paperweave.plans import expand as plan
    w, c, v = graph(spark)
    w = w.unionByName(w.where("id in ('W3', 'W4')")).unionByName(spark.createDataFrame([(None, "t", 2000, None, "v", 1), ("W5", "t", 2000, None, "v", None)], WORK))
    c = c.unionByName(c.limit(20)).unionByName(spark.createDataFrame([("W3", "W3"), ("W3", None), (None, "W4"), ("W9", "W5")], c.schema))
    seeds = spark.createDataFrame([(f"W{i}",) for i in range(0, 70, 2)], "seed_id string")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    works = seeds.where("seed_id < 'W60' or length(seed_id) < 3")
    for ends, got in zip((("source_id", "target_id"), ("target_id", "source_id")), joins.both_neighbour_ids(w, c, works, 4, 4), strict=True):
        assert rows(got) == rows(joins.neighbour_ids(w, c, works, *ends, 4))
    few = expand(w, c, v, seeds, ref_limit=4, cite_limit=3)
    monkeypatch.setattr(plan, "fits_broadcast", lambda df: False)
    many = expand(w, c, v, seeds, ref_limit=4, cite_limit=3)
    assert set(rows(many.edges)) == set(rows(few.edges)) and set(rows(many.nodes)) == set(rows(few.nodes))


def test_few_codes_are_compared_in_blocks(spark, monkeypatch):
    from paperweave.operators import lsh, similarity
    rnd = random.Random(5)
    rows = [(f"W{i}", [rnd.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [("W1", rows[7][1]), *((f"X{i}", rows[3][1]) for i in range(12)), ("Z", [0.0] * 6), ("N", None), ("E", []), (None, rows[9][1])]
    v = spark.createDataFrame(rows, "paper_id string, embedding array<double>")
    s = spark.createDataFrame([(f"W{i}",) for i in range(0, 400, 3)] + [("X2",), ("Z",), (None,)], "seed_id string")
    got = lambda df: sorted((r.seed_id, str(r.id), r.score, r["rank"]) for r in df.collect())
    ask = lambda: lsh.similar_approximate(v, s, limit=5, tables=4, bits=2, probes=1)
    monkeypatch.setattr(similarity, "MIN_BLOCK_ROWS", 90)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 90 * 8 * 6)
    monkeypatch.setattr(lsh, "CHUNK_SCORES", 500)
    blocks = ask()
    assert "code" not in blocks._jdf.queryExecution().optimizedPlan().toString()      # no copy of a vector for each of its codes
    dense = got(blocks)
    monkeypatch.setattr(lsh, "_dense", lambda *_: False)
    assert dense and dense == got(ask())


def test_stemmed_postings_stay_where_their_title_is(spark):
    from paperweave.functions.stem import porter
    from paperweave.operators.search import bm25_top, build_title_index
    titles = [("W1", "Networks of networking nodes"), ("W2", "the"), ("W3", ""), ("W4", "Cafés, cafe; 12"), ("W5", None), ("W1", "A network")]
    w = spark.createDataFrame(titles, "id string, title string")
    index = build_title_index(w, stopwords=("the", "of"), stem=True)
    assert sorted((r.id, r.term, r.tf) for r in index.postings.collect()) == sorted(
        [("W1", "network", 3), ("W1", porter("nodes"), 1), ("W1", "a", 1), ("W4", "cafe", 2)])
    assert {r.doc_len for r in index.postings.where("id = 'W4'").collect()} == {2}
    top = bm25_top(index, spark.createDataFrame([(1, "the networked cafe")], "query_id long, q string"), broadcast_terms=True)
    assert {r.id for r in top.collect()} == {"W1", "W4"}
    # titles are dealt out by id; neither postings nor scores by pairs of a title and a term or query
    plan = top._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\d+L?", "", line.split("hashpartitioning(")[1].split(")")[0]) for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any(d.startswith("id, ") for d in dealt) and not any(d.startswith(("id, term", "term, id", "query_id, id", "id, query_id")) for d in dealt), dealt
