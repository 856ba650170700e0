"""Expansion, similarity, merge and table semantics on hand-written rows
(FIXTURES section 4 and the invariants of SURVEY section 5)."""

from pyspark.sql import functions as F

from paperweave.operators.graph import as_response, merge_graph
from paperweave.operators.joins import missing_seeds, resolve_concepts
from paperweave.operators.similarity import similar
from paperweave.operators.tables import insert_ignore, upsert
from paperweave.plans.expand import expand
from paperweave.schemas import WORKS

W = "id string, doi string, title string, publication_year int, cited_by_count int, " \
    "first_author string, venue string, abstract_inverted_index string"


def works(spark, ids, cbc=None):
    cbc = cbc or {}
    return spark.createDataFrame([(i, None, f"t{i}", 2000, cbc.get(i, 1), None, None, None) for i in ids], W)


def cites(spark, pairs):
    return spark.createDataFrame(pairs, "source_id string, target_id string")


def vecs(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, embedding array<float>")


def seeds(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "seed_id string")


def test_u2_self_citation_two_edges(spark):
    ex = expand(works(spark, ["a"]), cites(spark, [("a", "a")]), None, seeds(spark, ["a"]))
    edges = sorted(tuple(r) for r in ex.edges.select("source", "target").collect())
    assert edges == [("a", "a"), ("a", "a")]
    assert ex.nodes.count() == 1


def test_dangling_edges_do_not_change_expand(spark):
    w = works(spark, ["a", "b", "c"])
    base = cites(spark, [("a", "b"), ("c", "a")])
    more = cites(spark, [("a", "b"), ("c", "a"), ("a", "zz"), ("yy", "a")])
    e1 = sorted(tuple(r) for r in expand(w, base, None, seeds(spark, ["a"])).edges.collect())
    e2 = sorted(tuple(r) for r in expand(w, more, None, seeds(spark, ["a"])).edges.collect())
    assert e1 == e2


def test_l3_limit_and_order(spark):
    ids = [f"r{i:02d}" for i in range(30)]
    w = works(spark, ["s"] + ids, {i: k for k, i in enumerate(ids)})
    ex = expand(w, cites(spark, [("s", i) for i in ids]), None, seeds(spark, ["s"]))
    got = sorted(r.target for r in ex.edges.collect())
    assert got == sorted(ids[-20:])                      # the 20 most cited


def test_j5_no_refill(spark):
    w = works(spark, ["s", "c1", "c2", "x"])
    c = cites(spark, [("s", "c1"), ("c2", "s")])
    v = vecs(spark, [("s", [1.0, 0.0]), ("c1", [1.0, 0.01]), ("c2", [1.0, 0.02]), ("ghost", [1.0, 0.03]),
                     ("x", [1.0, 0.04]), ("y", [0.0, 1.0]), ("z", [0.1, 1.0])])
    ex = expand(w, c, v, seeds(spark, ["s"]), sim_limit=5)
    sim = sorted(r.target for r in ex.edges.where(F.col("type") == "similarity").collect())
    # nearest five: c1, c2, ghost, x, z -> c1/c2 already citation nodes, ghost is no work
    assert sim == ["x"]


def test_v3_never_returns_seed_and_batch_equals_single(spark):
    rows = [(f"p{i}", [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [("zero", [0.0, 0.0, 0.0])]
    v = vecs(spark, rows)
    batch = similar(v, seeds(spark, ["p1", "p2", "p7", "nothere"]), limit=4, block_rows=8)
    got = batch.collect()
    assert all(r.seed_id != r.id and r.id != "zero" for r in got)
    single = similar(v, seeds(spark, ["p7"]), limit=4)
    assert sorted(tuple(r) for r in single.collect()) == sorted(tuple(r) for r in got if r.seed_id == "p7")
    assert {r.seed_id for r in got} == {"p1", "p2", "p7"}


def test_v3_blocks_equal_one_block(spark):
    rows = [(f"p{i:03d}", [float((i * 7) % 11), float((i * 3) % 13), float(i % 4)]) for i in range(120)]
    v = vecs(spark, rows)
    s = seeds(spark, [f"p{i:03d}" for i in range(0, 120, 3)])
    a = sorted(tuple(r) for r in similar(v, s, limit=6, block_rows=16).collect())
    b = sorted(tuple(r) for r in similar(v, s, limit=6, block_rows=100000).collect())
    assert a == b and len(a) == 39 * 6            # p000 is a zero vector: no rows


def test_u4_merge(spark):
    nodes = spark.createDataFrame([("a", "old")], "id string, title string")
    edges = spark.createDataFrame([("a", "b", None)], "source string, target string, type string")
    new_n = spark.createDataFrame([("a", "new"), ("b", "tb")], "id string, title string")
    new_e = spark.createDataFrame([("a", "b", "similarity"), ("b", "a", "similarity"), ("b", "c", "similarity"),
                                   ("b", "c", None)], "source string, target string, type string")
    n, e = merge_graph(nodes, edges, new_n, new_e)
    assert sorted(tuple(r) for r in n.collect()) == [("a", "old"), ("b", "tb")]
    assert sorted([tuple(r) for r in e.collect()], key=str) == sorted(
        [("a", "b", None), ("b", "a", "similarity"), ("b", "c", None)], key=str)
    n2, e2 = merge_graph(n, e, n, e)                     # merge(g, g) = g
    assert n2.count() == n.count() and e2.count() == e.count()


def test_u6_response(spark):
    w = works(spark, ["a", "b"])
    ex = expand(w, cites(spark, [("a", "b")]), None, seeds(spark, ["a", "b"]))
    r = {x.seed_id: x.response for x in as_response(ex.nodes, ex.edges).collect()}
    assert '"source":"a","target":"b"' in r["a"] and '"id":"b"' in r["b"]


def test_j7_missing(spark):
    assert [r.seed_id for r in missing_seeds(works(spark, ["a"]), seeds(spark, ["a", "W-none"])).collect()] == ["W-none"]


def test_k2_insert_ignore(spark):
    existing = spark.createDataFrame([("x", 0)], "id string, v int")
    new = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "id string, v int")
    got = insert_ignore(existing, new, "id", [F.col("v")]).collect()
    assert [tuple(r) for r in got] == [("y", 2)]


def test_k4_upsert_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "paper_id string, v int")
    new = spark.createDataFrame([("a", 2), ("b2", 2)], "paper_id string, v int")
    once = upsert(old, new, ["paper_id"])
    twice = upsert(once, new, ["paper_id"])
    want = [("a", 2), ("b", 1), ("b2", 2)]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in twice.collect()) == want


def test_j8_resolve_concepts(spark):
    terms = spark.createDataFrame([(0, "Metagenomics"), (1, "unknown thing"), (2, "Systems biology")],
                                  "term_pos int, term string")
    concepts = spark.createDataFrame(
        [("https://x.org/C1", "Metagenomics"), ("https://x.org/C2", "Systems biology"),
         ("https://x.org/C3", "Biology"), ("https://x.org/C4", "Systems")], "id string, display_name string")
    got = [tuple(r) for r in resolve_concepts(terms, concepts).collect()]
    assert got == [(0, "Metagenomics", "C1"), (2, "Systems biology", "C2")]


def test_v2_refresh_embeds_only_missing(spark):
    from paperweave.operators.embed import hashing_encoder, refresh_vectors
    w = works(spark, ["a", "b"])
    cache = vecs(spark, [("a", [9.0, 9.0])])
    out = {r.paper_id: r.embedding for r in refresh_vectors(w, cache, hashing_encoder(8)).collect()}
    assert out["a"] == [9.0, 9.0] and len(out["b"]) == 8
    assert abs(sum(x * x for x in out["b"]) - 1.0) < 1e-5


def test_k4_k6_overwrite_reading_target(spark, tmp_path):
    from paperweave.operators.tables import overwrite
    path = str(tmp_path / "vector_cache")
    spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "paper_id string, embedding array<float>") \
        .write.parquet(path)
    current = spark.read.parquet(path)
    new = spark.createDataFrame([("a", [5.0]), ("c", [3.0])], "paper_id string, embedding array<float>")
    overwrite(upsert(current, new, ["paper_id"]), path)       # reads the folder it replaces
    got = sorted((r.paper_id, r.embedding[0]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 5.0), ("b", 2.0), ("c", 3.0)]


def test_v3_copies_of_an_id_count_once(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1])] + [("c", [0.0, 1.0])] * 50 + [("d", [0.5, 0.5])]
    got = similar(vecs(spark, rows), seeds(spark, ["a"]), limit=3, block_rows=4).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == ["b", "d", "c"]


def test_v3_copies_of_the_seed_never_return_it(spark):
    # 40 exact copies of the seed in a cache of few rows: copies share blocks,
    # and none of them may come back as the seed's own neighbour
    rows = [("a", [1.0, 0.0])] * 40 + [("b", [0.9, 0.1]), ("c", [0.0, 1.0])]
    for block_rows in (4, 4096):
        got = similar(vecs(spark, rows), seeds(spark, ["a"]), limit=5, block_rows=block_rows).collect()
        assert sorted(r.id for r in got) == ["b", "c"]


def test_u4_merge_with_itself_is_unchanged(spark):
    from pyspark.sql import functions as F
    from paperweave.operators.graph import merge_graph
    from paperweave.plans.expand import expand
    from paperweave.sources import driver_tables as dt
    sf = "/root/testdata/sf0.001"
    w, c, v = dt.works(spark, sf), dt.citations(spark, sf), dt.vector_cache(spark, sf)
    ex = expand(w, c, v, w.select(F.col("id").alias("seed_id")))
    n, e = ex.nodes.where("seed_id = 'W0'").drop("seed_id"), ex.edges.where("seed_id = 'W0'").drop("seed_id")
    n1, e1 = merge_graph(n, e, n, e)
    assert sorted(map(tuple, n1.collect())) == sorted(map(tuple, n.collect()))
    # edges: a bag in, first wins per (source, target) against the stored graph
    assert sorted(map(tuple, e1.collect())) == sorted(map(tuple, e.collect()))


def test_single_seed_equals_batch(spark):
    from pyspark.sql import functions as F
    from paperweave.plans.expand import expand, explore
    from paperweave.sources import driver_tables as dt
    sf = "/root/testdata/sf0.001"
    w, c, v = dt.works(spark, sf), dt.citations(spark, sf), dt.vector_cache(spark, sf)
    batch = w.select(F.col("id").alias("seed_id"))
    one = spark.createDataFrame([("W3",)], "seed_id string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    full, single = expand(w, c, v, batch), expand(w, c, v, one)
    assert rows(single.edges) == rows(full.edges.where("seed_id = 'W3'"))
    assert rows(single.nodes) == rows(full.nodes.where("seed_id = 'W3'"))
    roots = batch.select(F.col("seed_id").alias("root_id")).where("root_id in ('W3', 'W5', 'W8')")
    many = explore(w, c, v, roots, hops=2, checkpoint=False)
    alone = explore(w, c, v, one.select(F.col("seed_id").alias("root_id")), hops=2, checkpoint=False)
    assert rows(alone.nodes) == rows(many.nodes.where("root_id = 'W3'"))
    assert rows(alone.edges) == rows(many.edges.where("root_id = 'W3'"))
