"""Registered queries: one per operator row of the inventory, each over the
whole driver tables of a scale-factor folder. Names follow the row ids.

Every callable takes (spark, sf_dir) and returns a lazy DataFrame whose column
names equal those of the matching SQL in ``paperweave.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import joins
from paperweave.operators.project import as_paper
from paperweave.operators.similarity import similar
from paperweave.plans.expand import expand
from paperweave.session import scratch_path
from paperweave.sources import driver_tables as dt

Query = Callable[[SparkSession, str], DataFrame]

#: A search over words that carry meaning leaves these out: fixed values, the most common English ones.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
             "this", "to", "was", "with")
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _tables(spark: SparkSession, sf: str):
    return dt.works(spark, sf), dt.citations(spark, sf), dt.vector_cache(spark, sf), dt.seeds(spark, sf)


# ---------------------------------------------------------------- graph

@register("u3_expand_edges")
def u3_expand_edges(spark, sf):
    w, c, v, s = _tables(spark, sf)
    return expand(w, c, v, s).edges


@register("u3_expand_nodes")
def u3_expand_nodes(spark, sf):
    w, c, v, s = _tables(spark, sf)
    return expand(w, c, v, s).nodes


@register("j1_references")
def j1_references(spark, sf):
    w, c, _, s = _tables(spark, sf)
    return joins.references(w, c, s)


@register("j2_citing")
def j2_citing(spark, sf):
    w, c, _, s = _tables(spark, sf)
    return joins.citing(w, c, s)


@register("j7_missing_seeds")
def j7_missing_seeds(spark, sf):
    w, _, _, s = _tables(spark, sf)
    return joins.missing_seeds(w, s)


@register("v3_similar")
def v3_similar(spark, sf):
    _, _, v, s = _tables(spark, sf)
    return similar(v, s, limit=20)


@register("v3_similar_approximate")
def v3_similar_approximate(spark, sf):
    """Approximate neighbours of every vector; tests measure how many of the true ones it finds."""
    from paperweave.operators.lsh import similar_approximate
    _, _, v, s = _tables(spark, sf)
    return similar_approximate(v, s, limit=20, tables=16, bits=4, probes=1)


@register("p5_as_paper")
def p5_as_paper(spark, sf):
    return as_paper(dt.works(spark, sf))


@register("x4_lookup")
def x4_lookup(spark, sf):
    from paperweave.operators.filters import lookup
    w, _, _, s = _tables(spark, sf)
    return as_paper(lookup(w, s, id_col="seed_id"))


# ---------------------------------------------------------------- search

def _index(spark, sf):
    from paperweave.operators.search import build_title_index
    return build_title_index(dt.search_works(spark, sf))


@register("f2_tokenize")
def f2_tokenize(spark, sf):
    from paperweave.functions.text import tokens
    """Whole texts, once more with combining marks, and a letter-like sign."""
    t = F.col("title")
    marks = F.regexp_replace(F.regexp_replace(t, "\u00e9", "e\u0301"), "\u00fc", "u\u0308")
    text = F.concat_ws(" ", t, marks, F.lit("\u212bngstr\u00f6m"))
    return dt.search_works(spark, sf).select("id", F.posexplode(tokens(text)).alias("pos", "term"))


@register("a1_postings")
def a1_postings(spark, sf):
    return _index(spark, sf).postings_with_df()


@register("a1_stats")
def a1_stats(spark, sf):
    st = _index(spark, sf).stats
    return st.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@register("j6_term_matches")
def j6_term_matches(spark, sf):
    from paperweave.operators.search import term_matches
    return term_matches(_index(spark, sf), dt.title_queries(spark, sf)).select("query_id", "term", "id", "tf")


@register("a2_bm25_scores")
def a2_bm25_scores(spark, sf):
    from paperweave.operators.search import bm25_scores
    return bm25_scores(_index(spark, sf), dt.title_queries(spark, sf))


@register("l1_search")
def l1_search(spark, sf):
    from paperweave.plans.search import search
    return search(dt.search_works(spark, sf), dt.search_queries(spark, sf)).hits


@register("l1_pruned_search")
def l1_pruned_search(spark, sf):
    """The best 20 of every passage from a saved index, with max-score pruning."""
    from paperweave.operators.search import bm25_pruned, load_title_index, save_title_index
    path = _scratch(spark, "index")
    save_title_index(_index(spark, sf), path)
    return bm25_pruned(load_title_index(spark, path), dt.title_queries(spark, sf)).top


@register("l1_stemmed_search")
def l1_stemmed_search(spark, sf):
    """The best 20 of every passage by Porter stems, without stop words."""
    from paperweave.operators.search import bm25_top, build_title_index
    index = build_title_index(dt.search_works(spark, sf), stopwords=STOPWORDS, stem=True)
    return bm25_top(index, dt.title_queries(spark, sf))


@register("a1_segment_search")
def a1_segment_search(spark, sf):
    """The works come in ten loads; the best 20 of every passage from the segments, some of them merged."""
    from paperweave.operators.search import bm25_top
    from paperweave.operators.segments import add_segment, load_segments
    path, works = _scratch(spark, "segments"), dt.search_works(spark, sf)
    load = F.pmod(F.xxhash64("id"), F.lit(10))
    for k in range(10):
        add_segment(works.where(load == k), path, f"load-{k}")
    return bm25_top(load_segments(spark, path), dt.title_queries(spark, sf))


@register("x5_doi_like")
def x5_doi_like(spark, sf):
    from paperweave.functions.text import is_doi_like
    return dt.search_queries(spark, sf).select("query_id", is_doi_like(F.col("q")).alias("doi_like"))


@register("l5_doi_first")
def l5_doi_first(spark, sf):
    from paperweave.operators.search import doi_first
    return doi_first(dt.works(spark, sf), dt.search_queries(spark, sf))


@register("f7_trim")
def f7_trim(spark, sf):
    from paperweave.functions.text import py_strip
    """Queries inside a no-break and an ideographic space."""
    q = F.concat(F.lit("\u00a0 "), F.col("q"), F.lit("\u3000"))
    return dt.search_queries(spark, sf).select("query_id", py_strip(q).alias("q_trimmed"))


@register("x8_valid_queries")
def x8_valid_queries(spark, sf):
    from paperweave.functions.text import is_valid_query
    return dt.word_queries(spark, sf).select("query_id", is_valid_query(F.col("q")).alias("accepted"))


@register("x7_substring_hits")
def x7_substring_hits(spark, sf):
    from paperweave.operators.search import substring_hits
    return substring_hits(dt.search_works(spark, sf), dt.substring_queries(spark, sf))


@register("l4_substring_top")
def l4_substring_top(spark, sf):
    from paperweave.operators.search import substring_top
    return substring_top(dt.search_works(spark, sf), dt.substring_queries(spark, sf))


@register("f8_ilike_top")
def f8_ilike_top(spark, sf):
    from paperweave.operators.search import substring_top
    return substring_top(dt.search_works(spark, sf), dt.substring_queries(spark, sf), wildcards=True)


# ---------------------------------------------------------------- ingest rows

@register("p1_flatten_works")
def p1_flatten_works(spark, sf):
    from paperweave.operators.project import flatten_works
    return flatten_works(dt.raw_works(spark, sf))


@register("p2_first_author")
def p2_first_author(spark, sf):
    from paperweave.functions.records import first_author
    return dt.raw_works(spark, sf).select("id", first_author(F.col("authorships")).alias("first_author"))


@register("p3_venue")
def p3_venue(spark, sf):
    from paperweave.functions.records import venue
    return dt.raw_works(spark, sf).select("id", venue(F.col("primary_location")).alias("venue"))


@register("p4_short_id")
def p4_short_id(spark, sf):
    from paperweave.functions.records import concept_ids, short_id
    raw = dt.raw_works(spark, sf)
    return raw.select(F.col("id").alias("raw_id"), short_id(F.col("id")).alias("id"),
                      F.array_join(concept_ids(F.col("concepts")), ",").alias("concepts"))


@register("x1_filter_publications")
def x1_filter_publications(spark, sf):
    from paperweave.operators.filters import filter_publications
    return filter_publications(dt.raw_works(spark, sf)).select("id", "type")


@register("x2_filter_concepts")
def x2_filter_concepts(spark, sf):
    from paperweave.operators.filters import filter_concepts
    return filter_concepts(dt.raw_works(spark, sf), ["C1", "C3"]).select("id")


@register("x3_with_references")
def x3_with_references(spark, sf):
    from paperweave.operators.filters import with_references
    return with_references(dt.raw_works(spark, sf)).select(
        "id", F.size("referenced_works").alias("n_refs"))


@register("k3_extract_citations")
def k3_extract_citations(spark, sf):
    from paperweave.plans.load import extract_citations
    return extract_citations(dt.raw_works(spark, sf))


@register("f5_unnest_short_ids")
def f5_unnest_short_ids(spark, sf):
    from paperweave.plans.load import extract_citations
    return extract_citations(dt.raw_works(spark, sf), normalize_ids=True)


@register("f1_parse_json")
def f1_parse_json(spark, sf):
    from paperweave.functions.records import first_author, venue
    from paperweave.sources.snapshot import parse_records
    lines = dt.raw_works(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    rec = parse_records(lines)
    return rec.select("id", "title", "publication_year", first_author(F.col("authorships")).alias("first_author"),
                      venue(F.col("primary_location")).alias("venue"))


@register("f6_rebuild_abstract")
def f6_rebuild_abstract(spark, sf):
    from paperweave.functions.abstract import rebuild_abstract
    return dt.works(spark, sf).select("id", rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"))


@register("p7_embedding_text")
def p7_embedding_text(spark, sf):
    from paperweave.operators.project import embedding_text
    return embedding_text(dt.works(spark, sf), abstract="plain")


@register("p7_embedding_text_raw")
def p7_embedding_text_raw(spark, sf):
    from paperweave.operators.project import embedding_text
    return embedding_text(dt.works(spark, sf), abstract="raw")


@register("a3_ingest_metrics")
def a3_ingest_metrics(spark, sf):
    """A3 over the derived snapshot records, one input file per work: records
    read, works kept by the concept filter (X2), files done and the running
    total of kept works in file order."""
    from paperweave.operators.filters import filter_concepts
    from paperweave.plans.load import ingest_metrics
    from paperweave.sources.snapshot import FILE_COL
    raw = dt.raw_works(spark, sf).withColumn(FILE_COL, F.concat(F.lit("part-"), F.col("id")))
    return ingest_metrics(raw, filter_concepts(raw, ["C1", "C3"]))


@register("x2_filter_concepts_table")
def x2_filter_concepts_table(spark, sf):
    """A concept table larger than the array bound: two ids per document."""
    from paperweave.operators.filters import filter_concepts
    wanted = dt._table(spark, sf, "documents").select(F.explode(F.array(
        F.concat(F.lit("C"), F.col("doc_id") * 2 + 1), F.concat(F.lit("D"), F.col("doc_id")))).alias("concept_id"))
    return filter_concepts(dt.raw_works(spark, sf), wanted).select("id")


@register("x7_short_patterns")
def x7_short_patterns(spark, sf):
    """The first character and the first two of every benchmark passage."""
    from paperweave.operators.search import substring_hits
    b = dt._table(spark, sf, "benchmark")
    q = b.select(F.explode(F.array(F.struct((F.col("item_id") * 2).alias("query_id"), F.substring("text", 1, 1).alias("q")),
                                   F.struct((F.col("item_id") * 2 + 1).alias("query_id"), F.substring("text", 1, 2).alias("q")))).alias("s"))
    return substring_hits(dt.search_works(spark, sf), q.select("s.*"))


# ---------------------------------------------------------------- snapshot files

def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"queries/{name}-{uuid.uuid4().hex}")


@register("c1_partitioned_scan")
def c1_partitioned_scan(spark, sf):
    from paperweave.sources.snapshot import read_works
    path = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "c1"))
    return read_works(spark, path).select("id", "title", "publication_year", F.col("updated_date").cast("string").alias("updated_date"))


@register("c2_file_selection")
def c2_file_selection(spark, sf):
    """Plain text files of other records lie among the gzip files, a level deeper too."""
    from paperweave.sources.snapshot import read_works
    lines = dt.snapshot_lines(spark, sf)
    path = dt.write_snapshot(lines, _scratch(spark, "c2") + "/works")
    dt.write_snapshot(lines.withColumn("value", F.regexp_replace("value", "/W", "/not-selected-W")), path, compression="none")
    return read_works(spark, path.rsplit("/", 1)[0], glob="*.gz", recursive=True).select("id")


@register("c3_lenient_scan")
def c3_lenient_scan(spark, sf):
    """Beside every record a cut line, one that is no object and one without an id."""
    from paperweave.sources.snapshot import read_works
    bad = F.array("value", F.expr("substr(value, 1, length(value) div 2)"), F.lit("[]"),
                  F.regexp_replace("value", '"id":"[^"]*/W[0-9]+",', ""))
    lines = dt.snapshot_lines(spark, sf)
    by_day = {day: 4 * n for day, n in dt.lines_by_day(lines).items()}
    path = dt.write_snapshot(lines.select(F.explode(bad).alias("value"), "updated_date"), _scratch(spark, "c3"), by_day=by_day)
    return read_works(spark, path).select("id", "type")


@register("c4_corrupt_files")
def c4_corrupt_files(spark, sf):
    """Whole files, and a copy of each that breaks off in the middle."""
    from paperweave.session import hadoop_path
    from paperweave.sources.snapshot import read_works
    path = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "c4"))
    fs, root = hadoop_path(spark, path)
    files = fs.listFiles(root, True)
    whole = []
    while files.hasNext():
        status = files.next()
        if status.getPath().getName().endswith(".gz"):
            whole.append((status.getPath().toString(), status.getLen()))
    for name, size in whole:
        source, target = hadoop_path(spark, name)[1], hadoop_path(spark, name.replace(".txt.gz", ".cut.txt.gz"))[1]
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(source), fs.create(target), size // 2, True)
    return read_works(spark, path, ignore_corrupt_files=True).select("id").distinct()


@register("c5_strict_scan")
def c5_strict_scan(spark, sf):
    from paperweave.sources.snapshot import STRICT, read_works
    path = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "c5"))
    return read_works(spark, path, STRICT).select("id", "cited_by_count")


@register("f4_abstract_text")
def f4_abstract_text(spark, sf):
    from paperweave.sources.snapshot import read_works
    path = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "f4"))
    return read_works(spark, path).select("id", "abstract_inverted_index")


@register("j8_resolve_concepts")
def j8_resolve_concepts(spark, sf):
    """Topic names are whole benchmark passages, concepts the documents' first lines."""
    terms = dt._table(spark, sf, "benchmark").select(F.col("item_id").alias("term_pos"), F.col("text").alias("term"))
    return joins.resolve_concepts(terms, dt.concept_names(spark, sf))


@register("k1_create_tables")
def k1_create_tables(spark, sf):
    """Created, filled, and created again: nothing is lost."""
    from paperweave.operators.tables import append, create_tables, read_table, table_path
    root = _scratch(spark, "k1")
    create_tables(spark, root)
    append(dt.works_table(spark, sf), table_path(root, "works"))
    append(dt.citations(spark, sf), table_path(root, "citations"))
    create_tables(spark, root)
    return read_table(spark, root, "works").select("id", "title", "venue").join(
        read_table(spark, root, "citations").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_refs")), "id", "left")


@register("k5_insert_strict")
def k5_insert_strict(spark, sf):
    from paperweave.operators.tables import insert_strict
    w = dt.works(spark, sf)
    return insert_strict(w.where("type = 'article'"), w.where("type <> 'article'")).select("id", "type")


@register("k6_overwrite")
def k6_overwrite(spark, sf):
    """Written, then rebuilt from its own content."""
    from paperweave.operators.tables import overwrite
    path = _scratch(spark, "k6") + "/works"
    overwrite(dt.works_table(spark, sf), path)
    overwrite(spark.read.parquet(path).withColumn("cited_by_count", F.col("cited_by_count") + 1), path)
    return spark.read.parquet(path).select("id", "title", "cited_by_count")


def _loaded(works: DataFrame, citations: DataFrame) -> DataFrame:
    return works.select(F.lit("work").alias("kind"), F.col("id").alias("a"), F.col("title").alias("b")).unionByName(
        citations.select(F.lit("citation").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@register("n1_load_filtered")
def n1_load_filtered(spark, sf):
    from paperweave.plans.load import load_filtered
    path = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "n1"))
    out = load_filtered(spark, path, ["C1", "C3"], _scratch(spark, "n1-tables"))
    return _loaded(out.works, out.citations)


@register("n2_load_generic")
def n2_load_generic(spark, sf):
    from paperweave.plans.load import load_generic
    path = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "n2"))
    out = load_generic(spark, path, _scratch(spark, "n2-tables"))
    return _loaded(out.works, out.citations)


@register("n3_stream_filtered")
def n3_stream_filtered(spark, sf):
    from paperweave.operators.tables import read_table
    from paperweave.streaming.incremental import stream_filtered
    path, root = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "n3")), _scratch(spark, "n3-tables")
    wanted = spark.createDataFrame([("C1",), ("C3",)], "concept_id string")
    stream_filtered(spark, path, wanted, root, _scratch(spark, "n3-stream"), max_files_per_trigger=10).awaitTermination()
    return _loaded(read_table(spark, root, "works"), read_table(spark, root, "citations"))


# ---------------------------------------------------------------- tables

@register("k2_insert_ignore")
def k2_insert_ignore(spark, sf):
    from paperweave.operators.tables import insert_ignore
    w = dt.works(spark, sf)
    existing = w.where(F.col("type") == "article").drop("type")
    batch = (w.drop("type").withColumn("_ord", F.lit(0))
             .unionByName(w.drop("type").withColumn("title", F.upper("title")).withColumn("_ord", F.lit(1))))
    return insert_ignore(existing, batch, "id", [F.col("_ord")]).select("id", "title", "publication_year")


@register("k4_upsert_vectors")
def k4_upsert_vectors(spark, sf):
    from paperweave.operators.tables import upsert
    w, _, v, _ = _tables(spark, sf)
    new = v.join(w.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").select(
        "paper_id", F.reverse("embedding").alias("embedding"))
    out = upsert(v, new, ["paper_id"])
    return out.select("paper_id", F.size("embedding").alias("dim"),
                      F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


@register("k4_bucket_upsert")
def k4_bucket_upsert(spark, sf):
    """All vectors, then every fiftieth one reversed: only its buckets are rewritten."""
    from paperweave.operators.bucketed import create_bucketed, read_bucketed, upsert_bucketed
    v = dt.vector_cache(spark, sf)
    path = _scratch(spark, "k4-buckets")
    create_bucketed(spark, path, v.schema, ["paper_id"], 64)
    upsert_bucketed(v, path)
    some = v.where(F.expr("cast(substr(paper_id, 2) as bigint) % 50 = 0"))
    upsert_bucketed(some.select("paper_id", F.reverse("embedding").alias("embedding")), path)
    return read_bucketed(spark, path).select("paper_id", F.size("embedding").alias("dim"),
                                             F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


@register("n3_tracked_stream")
def n3_tracked_stream(spark, sf):
    """The file stream with an id table and a segmented index: what it has stored, and the best 20 of every passage over its titles."""
    from paperweave.operators.search import bm25_top
    from paperweave.operators.segments import load_segments
    from paperweave.operators.tables import read_table
    from paperweave.streaming.incremental import stream_filtered
    path, root = dt.write_snapshot(dt.snapshot_lines(spark, sf), _scratch(spark, "n3t")), _scratch(spark, "n3t-tables")
    segments = _scratch(spark, "n3t-index")
    stream_filtered(spark, path, ["C1", "C3"], root, _scratch(spark, "n3t-stream"), max_files_per_trigger=10, segments_path=segments,
                    ids_path=_scratch(spark, "n3t-ids")).awaitTermination()
    top = bm25_top(load_segments(spark, segments), dt.title_queries(spark, sf))
    hits = top.select(F.lit("hit").alias("kind"), F.concat_ws("#", "query_id", "rank").alias("a"), F.col("id").alias("b"))
    return _loaded(read_table(spark, root, "works"), read_table(spark, root, "citations")).unionByName(hits)


@register("j3_cached_vectors")
def j3_cached_vectors(spark, sf):
    _, _, v, s = _tables(spark, sf)
    return joins.cached_vectors(v, s, id_col="seed_id").select("paper_id", F.size("embedding").alias("dim"))


@register("j4_missing_vectors")
def j4_missing_vectors(spark, sf):
    w, _, v, _ = _tables(spark, sf)
    return joins.missing_vectors(w, v).select("id")


@register("f3_cosine_citations")
def f3_cosine_citations(spark, sf):
    from paperweave.operators.similarity import cosine_pairs
    _, c, v, _ = _tables(spark, sf)
    return cosine_pairs(c, v)


@register("l2_similar_top5")
def l2_similar_top5(spark, sf):
    _, _, v, s = _tables(spark, sf)
    return similar(v, s, limit=5)


@register("x6_doi_matches")
def x6_doi_matches(spark, sf):
    from paperweave.operators.search import doi_matches
    return doi_matches(dt.works(spark, sf), dt.search_queries(spark, sf))


@register("x6_doi_ilike")
def x6_doi_ilike(spark, sf):
    """X6 + F8: every DOI query as an ILIKE pattern (``_`` in a DOI is a
    wildcard), answered by the trigram pattern join."""
    from paperweave.operators.search import doi_matches
    return doi_matches(dt.works(spark, sf), dt.search_queries(spark, sf), wildcards=True)


# ---------------------------------------------------------------- graph

def _merged(spark, sf):
    from paperweave.operators.graph import merge_graph
    w, c, v, s = _tables(spark, sf)
    full = expand(w, c, v, s)
    cit = full.cited
    n0 = cit.nodes.drop("seed_id").limit(0)
    e0 = cit.edges.drop("seed_id").limit(0)
    n1, e1 = merge_graph(n0, e0, cit.nodes.drop("seed_id"), cit.edges.drop("seed_id"))
    return merge_graph(n1, e1, full.nodes.drop("seed_id"), full.edges.drop("seed_id"))


@register("u4_merge_nodes")
def u4_merge_nodes(spark, sf):
    return _merged(spark, sf)[0]


@register("u4_merge_edges")
def u4_merge_edges(spark, sf):
    return _merged(spark, sf)[1]


def _explored(spark, sf):
    from paperweave.plans.expand import explore
    w, c, v, s = _tables(spark, sf)
    return explore(w, c, v, s.select(F.col("seed_id").alias("root_id")), hops=2)


@register("u5_explore_nodes")
def u5_explore_nodes(spark, sf):
    return _explored(spark, sf).nodes


@register("u5_explore_edges")
def u5_explore_edges(spark, sf):
    return _explored(spark, sf).edges


@register("u6_response")
def u6_response(spark, sf):
    from paperweave.operators.graph import as_response
    w, c, v, s = _tables(spark, sf)
    ex = expand(w, c, v, s)
    return as_response(ex.nodes, ex.edges).select("seed_id", "response")


# ---------------------------------------------------------------- embeddings

def _length_encoder():
    """An encoder whose values SQL can state: how many [a-z] words have each
    length modulo 8."""
    import re

    import numpy as np

    def predict(texts):
        return np.stack([np.bincount([len(w) % 8 for w in re.findall("[a-z]+", str(t))], minlength=8)
                         for t in texts]).astype(np.float32)

    return predict


def _rounded_vector(c):
    """To four places; a negative zero becomes zero."""
    return F.transform(c, lambda x: F.round(x.cast("double"), 4) + 0.0)


@register("v1_embed")
def v1_embed(spark, sf):
    from paperweave.operators.embed import embed
    docs = dt._table(spark, sf, "documents").select(F.concat(F.lit("W"), F.col("doc_id")).alias("paper_id"), "text")
    return embed(docs, _length_encoder).select("paper_id", _rounded_vector(F.col("embedding")).alias("embedding"))


@register("v2_refresh_vectors")
def v2_refresh_vectors(spark, sf):
    from paperweave.operators.embed import refresh_vectors
    w, _, v, _ = _tables(spark, sf)
    return refresh_vectors(w, v, _length_encoder).select("paper_id", _rounded_vector(F.col("embedding")).alias("embedding"))
