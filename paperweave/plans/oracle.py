"""DuckDB SQL for every registered query (the driver's correctness oracle).

Only the base tables are registered in DuckDB, so each statement inlines the
derived views of ``paperweave.sources.driver_tables`` as CTEs. Scores are
rounded to 6 places and ties broken by id, like the Spark side.
"""

from __future__ import annotations

# --------------------------------------------------------------- base views
_VIEWS = {
    "works_v": """
  SELECT 'W' || doc_id AS id,
    'https://doi.org/10.' || (1000 + doc_id % 9000) || '/d_' || doc_id AS doi,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
    CASE doc_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'preprint'
      WHEN 2 THEN 'proceedings-article' WHEN 3 THEN 'dataset' ELSE 'paratext' END AS type,
    CAST(1990 + doc_id % 35 AS INTEGER) AS publication_year,
    CAST((doc_id * 37) % 500 AS INTEGER) AS cited_by_count,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'Author ' || (doc_id % 40) END AS first_author,
    source AS venue,
    doc_id
  FROM documents""",
    "citations_v": """
  SELECT 'W' || l_partkey AS source_id,
    'W' || (l_orderkey % (SELECT count(*) FROM part)) AS target_id
  FROM lineitem""",
    "vectors_v": """
  SELECT 'W' || vec_id AS paper_id, embedding FROM embeddings""",
    "seeds_v": """
  SELECT 'W' || doc_id AS seed_id FROM documents UNION ALL SELECT 'W-none' AS seed_id""",
    "papers_v": """
  SELECT id, title, publication_year AS year, first_author, venue, cited_by_count FROM works_v""",
    "found_v": """
  SELECT DISTINCT s.seed_id FROM seeds_v s JOIN works_v w ON w.id = s.seed_id""",
}

_PAPER = "id, title, year, first_author, venue, cited_by_count"


def _neighbours(seed_end: str, other_end: str, seeds: str, limit: int) -> str:
    return f"""
  SELECT seed_id, CAST(rank AS INTEGER) AS rank, {_PAPER} FROM (
    SELECT s.seed_id, p.*,
      row_number() OVER (PARTITION BY s.seed_id
                         ORDER BY p.cited_by_count DESC NULLS LAST, p.id) AS rank
    FROM (SELECT DISTINCT seed_id FROM {seeds}) s
    JOIN citations_v c ON c.{seed_end} = s.seed_id
    JOIN papers_v p ON p.id = c.{other_end})
  WHERE rank <= {limit}"""


def _similar(seeds: str, limit: int) -> str:
    return f"""
  SELECT seed_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT seed_id, id, score,
      row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id) AS rank
    FROM (
      SELECT q.paper_id AS seed_id, v.paper_id AS id,
        round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
      FROM (SELECT DISTINCT vv.paper_id, vv.embedding FROM vectors_v vv
            WHERE vv.paper_id IN (SELECT seed_id FROM {seeds})) q
      JOIN vectors_v v ON v.paper_id <> q.paper_id)
    WHERE score IS NOT NULL AND NOT isnan(score))
  WHERE rank <= {limit}"""


_EXPAND = {
    "refs_x": _neighbours("source_id", "target_id", "found_v", 20),
    "cits_x": _neighbours("target_id", "source_id", "found_v", 20),
    "sim_x": _similar("found_v", 5),
    "cite_nodes_x": """
  SELECT seed_id, seed_id AS id FROM found_v
  UNION SELECT seed_id, id FROM refs_x
  UNION SELECT seed_id, id FROM cits_x""",
    "fresh_x": """
  SELECT s.seed_id, s.id FROM sim_x s
  WHERE NOT EXISTS (SELECT 1 FROM cite_nodes_x n WHERE n.seed_id = s.seed_id AND n.id = s.id)
    AND s.id IN (SELECT id FROM works_v)""",
    "edges_x": """
  SELECT seed_id, seed_id AS source, id AS target, CAST(NULL AS VARCHAR) AS type FROM refs_x
  UNION ALL SELECT seed_id, id AS source, seed_id AS target, CAST(NULL AS VARCHAR) AS type FROM cits_x
  UNION ALL SELECT seed_id, seed_id AS source, id AS target, 'similarity' AS type FROM fresh_x""",
    "nodes_x": f"""
  SELECT n.seed_id, p.id, p.title, p.year, p.first_author, p.venue, p.cited_by_count
  FROM (SELECT seed_id, id FROM cite_nodes_x UNION SELECT seed_id, id FROM fresh_x) n
  JOIN papers_v p ON p.id = n.id""",
}


_TOK = "regexp_extract_all(lower(strip_accents({0})), '[a-z]+')"

_QUERIES = {
    "title_q": """
  SELECT item_id AS query_id, text AS q FROM benchmark""",
    "search_q": """
  SELECT item_id AS query_id, text AS q FROM benchmark
  UNION ALL
  SELECT 1000000000000 + doc_id AS query_id,
    ' ' || upper('https://doi.org/10.' || (1000 + doc_id % 9000) || '/d_' || doc_id) || ' ' AS q
  FROM documents""",
    "substr_q": """
  SELECT item_id * 100000 + pos AS query_id, q FROM (
    SELECT item_id, unnest(string_split(text, '.')) AS q,
      unnest(range(len(string_split(text, '.')))) AS pos FROM benchmark)
  WHERE length(q) >= 3""",
    "word_q": """
  SELECT item_id * 100000 + pos AS query_id, q FROM (
    SELECT item_id, unnest(string_split(text, ' ')) AS q,
      unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark)""",
}

_INDEX = {
    "docs_i": f"""
  SELECT id, {_TOK.format('title')} AS toks FROM works_v WHERE title IS NOT NULL""",
    "stats_i": """
  SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM docs_i""",
    "tf_i": """
  SELECT term, id, count(*) AS tf, CAST(any_value(doc_len) AS INTEGER) AS doc_len
  FROM (SELECT id, len(toks) AS doc_len, unnest(toks) AS term FROM docs_i)
  GROUP BY term, id""",
    "postings_i": """
  SELECT t.term, t.id, t.tf, t.doc_len, d.df
  FROM tf_i t JOIN (SELECT term, count(*) AS df FROM tf_i GROUP BY term) d ON d.term = t.term""",
}


def _bm25_scores(queries: str) -> str:
    return f"""
  SELECT query_id, id, round(sum(
      log10((s.n_docs - p.df + 0.5) / (p.df + 0.5) + 1) * p.tf * 2.2
      / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.doc_len / s.avgdl))), 6) AS score
  FROM (SELECT DISTINCT query_id, term FROM (
          SELECT query_id, unnest({_TOK.format('q')}) AS term FROM {queries})) qt
  JOIN postings_i p ON p.term = qt.term
  CROSS JOIN stats_i s
  GROUP BY query_id, id"""


def _top(inner: str, order: str, limit: int, cols: str) -> str:
    return f"""
  SELECT {cols}, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({inner}))
  WHERE rank <= {limit}"""


_DOI = {
    "doi_hits": """
  SELECT q.query_id, w.id FROM (
    SELECT query_id, lower(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) AS k FROM search_q
    WHERE length(q) >= 3 AND contains(q, '10.') AND contains(q, '/')) q
  JOIN (SELECT id, lower(doi) AS k FROM works_v WHERE title IS NOT NULL) w ON w.k = q.k""",
}
_DOI["doi_first"] = _top("SELECT * FROM doi_hits", "id", 1, "query_id, id")
_DOI_ILIKE = {
    "doi_ilike": """
  SELECT q.query_id, w.id FROM (
    SELECT query_id, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS p FROM search_q
    WHERE length(q) >= 3 AND contains(q, '10.') AND contains(q, '/')) q
  JOIN (SELECT id, doi FROM works_v WHERE title IS NOT NULL) w ON w.doi ILIKE q.p""",
}
_SEARCH = dict(_DOI)
_SEARCH["rest_q"] = """
  SELECT query_id, q FROM search_q
  WHERE length(q) >= 3 AND query_id NOT IN (SELECT query_id FROM doi_first)"""
_SEARCH["bm25_top"] = _top(_bm25_scores("rest_q"), "score DESC, id", 20, "query_id, id, score")
_SEARCH["hits_s"] = f"""
  SELECT h.query_id, h.route, h.rank, {", ".join("p." + c for c in _PAPER.split(", "))}, h.score
  FROM (SELECT query_id, 'doi' AS route, rank, id, CAST(NULL AS DOUBLE) AS score FROM doi_first
        UNION ALL SELECT query_id, 'bm25' AS route, rank, id, score FROM bm25_top) h
  JOIN papers_v p ON p.id = h.id"""

_TITLE_TOP = {"title_top": _top(_bm25_scores("title_q"), "score DESC, id", 20, "query_id, id, score")}

_SUBSTR_HITS = """
  SELECT q.query_id, w.id FROM works_v w JOIN substr_q q
    ON w.title IS NOT NULL AND contains(lower(w.title), lower(q.q))"""
_ILIKE_HITS = """
  SELECT q.query_id, w.id FROM works_v w JOIN substr_q q
    ON w.title IS NOT NULL AND w.title ILIKE '%' || q.q || '%'"""


_RAW = {
    "n_docs_r": """
  SELECT count(*) AS c FROM documents""",
    "raw_v": """
  SELECT 'https://works.example/' || w.id AS id, w.doc_id, w.title, w.type, w.publication_year,
    w.first_author, w.venue,
    'https://works.example/C' || (w.cited_by_count % 7) AS c1,
    'https://works.example/C' || (w.publication_year % 5) AS c2,
    CASE WHEN w.doc_id % 13 <> 0 THEN list_slice([
      'https://works.example/W' || ((w.doc_id * 7 + 13) % n.c),
      'https://works.example/W' || ((w.doc_id * 7 + 26) % n.c),
      'https://works.example/W' || ((w.doc_id * 7 + 39) % n.c)], 1, w.doc_id % 4) END AS referenced_works
  FROM works_v w CROSS JOIN n_docs_r n""",
}

_ABSTRACT = {
    "body_a": """
  SELECT doc_id, list_filter(regexp_split_to_array(
      CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END,
      '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws
  FROM documents""",
    "aii_a": """
  SELECT doc_id, '{' || string_agg(to_json(w) || ':' || to_json(ps), ',' ORDER BY fp) || '}' AS aii
  FROM (SELECT doc_id, w, list(pos ORDER BY pos) AS ps, min(pos) AS fp
        FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM body_a)
        GROUP BY doc_id, w)
  GROUP BY doc_id""",
    "text_a": """
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN NULL ELSE array_to_string(ws, ' ') END AS abstract FROM body_a""",
}

_MERGE = {
    "m_nodes": f"""
  SELECT DISTINCT {_PAPER} FROM nodes_x""",
    "m_edges": """
  SELECT source, target,
    CASE WHEN bool_or(type IS NULL) THEN CAST(NULL AS VARCHAR) ELSE 'similarity' END AS type
  FROM edges_x GROUP BY source, target""",
}


# U5 with two hops: a paper's expansion does not depend on the other seeds, so
# hop 2 of a root is the expansion of each node first reached at hop 1.
_EXPLORE = {
    "hop2_f": """
  SELECT DISTINCT seed_id AS root_id, id AS f FROM nodes_x WHERE id <> seed_id""",
    "e_nodes": f"""
  SELECT DISTINCT root_id, {_PAPER} FROM (
    SELECT seed_id AS root_id, {_PAPER} FROM nodes_x
    UNION ALL
    SELECT h.root_id, {", ".join("n." + c for c in _PAPER.split(", "))}
    FROM hop2_f h JOIN nodes_x n ON n.seed_id = h.f)""",
    "e_edges": """
  SELECT root_id, source, target,
    CASE WHEN bool_or(type IS NULL) FILTER (WHERE hop = best) THEN CAST(NULL AS VARCHAR)
         ELSE 'similarity' END AS type
  FROM (SELECT *, min(hop) OVER (PARTITION BY root_id, source, target) AS best FROM (
          SELECT seed_id AS root_id, source, target, type, 1 AS hop FROM edges_x
          UNION ALL
          SELECT h.root_id, e.source, e.target, e.type, 2 AS hop
          FROM hop2_f h JOIN edges_x e ON e.seed_id = h.f))
  GROUP BY root_id, source, target""",
}


_TITLE = "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title"


def _whole(body: str, *extra: dict[str, str]) -> str:
    """Over works whose title is the document's whole text."""
    views = {"works_v": _VIEWS["works_v"].replace(_TITLE, "text AS title")}
    return _with(body, views, *extra)


def _with(body: str, *extra: dict[str, str]) -> str:
    ctes = dict(_VIEWS)
    for e in extra:
        ctes.update(e)
    defs = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes.items())
    return f"WITH {defs}\n{body}"


# What the concept-filtered load leaves in both tables, with short ids.
_LOADED = """
  SELECT 'work' AS kind, split_part(id, '/', -1) AS a, title AS b FROM kept
  UNION ALL SELECT 'citation' AS kind, split_part(id, '/', -1) AS a, split_part(t, '/', -1) AS b
  FROM (SELECT id, unnest(referenced_works) AS t FROM kept WHERE referenced_works IS NOT NULL)"""
_RAW["kept"] = """
  SELECT * FROM raw_v WHERE list_has_any([split_part(c1, '/', -1), split_part(c2, '/', -1)], ['C1', 'C3'])"""

# How many [a-z] words have each length modulo 8.
_LENGTHS = """
  SELECT paper_id, list_transform([0, 1, 2, 3, 4, 5, 6, 7],
    lambda k: CAST(len(list_filter(ws, lambda w: length(w) % 8 = k)) AS DOUBLE)) AS embedding
  FROM (SELECT paper_id, regexp_extract_all(text, '[a-z]+') AS ws FROM {0})"""

ORACLE: dict[str, str] = {
    "u3_expand_edges": _with("SELECT seed_id, source, target, type FROM edges_x", _EXPAND),
    "u3_expand_nodes": _with(f"SELECT seed_id, {_PAPER} FROM nodes_x", _EXPAND),
    "j1_references": _with(_neighbours("source_id", "target_id", "seeds_v", 20)),
    "j2_citing": _with(_neighbours("target_id", "source_id", "seeds_v", 20)),
    "j7_missing_seeds": _with("SELECT seed_id FROM seeds_v WHERE seed_id NOT IN (SELECT id FROM works_v)"),
    "v3_similar": _with(_similar("seeds_v", 20)),
    "p5_as_paper": _with(f"SELECT {_PAPER} FROM papers_v"),
    "x4_lookup": _with(f"SELECT {_PAPER} FROM papers_v WHERE id IN (SELECT seed_id FROM seeds_v)"),
    "f2_tokenize": _whole(f"""
  SELECT id, CAST(pos AS INTEGER) AS pos, term FROM (
    SELECT id, unnest(toks) AS term, unnest(range(len(toks))) AS pos
    FROM (SELECT id, {_TOK.format("concat_ws(' ', title, replace(replace(title, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), chr(8491) || 'ngström')")} AS toks
          FROM works_v))"""),
    "a1_postings": _whole("SELECT term, id, tf, doc_len, df FROM postings_i", _INDEX),
    "a1_stats": _whole("SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats_i", _INDEX),
    "j6_term_matches": _whole(f"""
  SELECT qt.query_id, qt.term, p.id, p.tf
  FROM (SELECT DISTINCT query_id, term FROM (
          SELECT query_id, unnest({_TOK.format('q')}) AS term FROM title_q)) qt
  JOIN postings_i p ON p.term = qt.term""", _QUERIES, _INDEX),
    "a2_bm25_scores": _whole(_bm25_scores("title_q"), _QUERIES, _INDEX),
    "l1_search": _whole("SELECT * FROM hits_s", _QUERIES, _INDEX, _SEARCH),
    "l1_pruned_search": _whole("SELECT query_id, id, score, rank FROM title_top", _QUERIES, _INDEX, _TITLE_TOP),
    "a1_segment_search": _whole("SELECT query_id, id, score, rank FROM title_top", _QUERIES, _INDEX, _TITLE_TOP),
    "x5_doi_like": _with("SELECT query_id, contains(q, '10.') AND contains(q, '/') AS doi_like FROM search_q",
                         _QUERIES),
    "l5_doi_first": _with("SELECT query_id, id, rank FROM doi_first", _QUERIES, _DOI),
    "f7_trim": _with("""
  SELECT query_id, regexp_replace(chr(160) || ' ' || q || chr(12288),
    '\\A[\\s\\pZ\\x{85}\\x{0b}\\x{1c}-\\x{1f}]+|[\\s\\pZ\\x{85}\\x{0b}\\x{1c}-\\x{1f}]+\\z', '', 'g') AS q_trimmed
  FROM search_q""", _QUERIES),
    "x8_valid_queries": _with("SELECT query_id, q IS NOT NULL AND length(q) >= 3 AS accepted FROM word_q",
                              _QUERIES),
    "x7_substring_hits": _whole(_SUBSTR_HITS, _QUERIES),
    "l4_substring_top": _whole(_top(_SUBSTR_HITS, "id", 20, "query_id, id"), _QUERIES),
    "f8_ilike_top": _whole(_top(_ILIKE_HITS, "id", 20, "query_id, id"), _QUERIES),
    "x6_doi_matches": _with("SELECT query_id, id FROM doi_hits", _QUERIES, _DOI),
    "x6_doi_ilike": _with("SELECT query_id, id FROM doi_ilike", _QUERIES, _DOI_ILIKE),
    "p1_flatten_works": _with("""
  SELECT 'https://works.example/' || w.id AS id, w.doi, w.title, w.publication_year, w.cited_by_count,
    w.first_author, w.venue, a.aii AS abstract_inverted_index
  FROM works_v w LEFT JOIN aii_a a ON a.doc_id = w.doc_id""", _ABSTRACT),
    "p2_first_author": _with("SELECT 'https://works.example/' || id AS id, first_author FROM works_v"),
    "p3_venue": _with("SELECT 'https://works.example/' || id AS id, venue FROM works_v"),
    "p4_short_id": _with("""
  SELECT id AS raw_id, split_part(id, '/', -1) AS id,
    split_part(c1, '/', -1) || ',' || split_part(c2, '/', -1) AS concepts FROM raw_v""", _RAW),
    "x1_filter_publications": _with("""
  SELECT id, type FROM raw_v
  WHERE title IS NOT NULL AND type IN ('article', 'preprint', 'proceedings-article')""", _RAW),
    "x2_filter_concepts": _with("""
  SELECT id FROM raw_v
  WHERE list_has_any([split_part(c1, '/', -1), split_part(c2, '/', -1)], ['C1', 'C3'])""", _RAW),
    "x3_with_references": _with("""
  SELECT id, CAST(len(referenced_works) AS INTEGER) AS n_refs FROM raw_v
  WHERE referenced_works IS NOT NULL""", _RAW),
    "k3_extract_citations": _with("""
  SELECT id AS source_id, unnest(referenced_works) AS target_id FROM raw_v
  WHERE referenced_works IS NOT NULL""", _RAW),
    "f5_unnest_short_ids": _with("""
  SELECT split_part(id, '/', -1) AS source_id, split_part(t, '/', -1) AS target_id
  FROM (SELECT id, unnest(referenced_works) AS t FROM raw_v WHERE referenced_works IS NOT NULL)""", _RAW),
    "f1_parse_json": _with("""
  SELECT 'https://works.example/' || id AS id, title, publication_year, first_author, venue FROM works_v"""),
    "f6_rebuild_abstract": _with("""
  SELECT w.id, t.abstract FROM works_v w JOIN text_a t ON t.doc_id = w.doc_id""", _ABSTRACT),
    "p7_embedding_text": _with("""
  SELECT w.id AS paper_id, coalesce(w.title, '') || ' ' || coalesce(t.abstract, '') AS text
  FROM works_v w JOIN text_a t ON t.doc_id = w.doc_id""", _ABSTRACT),
    "p7_embedding_text_raw": _with("""
  SELECT w.id AS paper_id, coalesce(w.title, '') || ' ' || coalesce(a.aii, '') AS text
  FROM works_v w LEFT JOIN aii_a a ON a.doc_id = w.doc_id""", _ABSTRACT),
    "a3_ingest_metrics": _with("""
  SELECT file, records, kept, CAST(row_number() OVER (ORDER BY file) AS INTEGER) AS files_done,
    CAST(sum(kept) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_kept
  FROM (
    SELECT 'part-' || id AS file, count(*) AS records,
      count(*) FILTER (WHERE list_has_any([split_part(c1, '/', -1), split_part(c2, '/', -1)], ['C1', 'C3'])) AS kept
    FROM raw_v GROUP BY 1)""", _RAW),
    "x2_filter_concepts_table": _with("""
  SELECT id FROM raw_v WHERE split_part(c1, '/', -1) IN (SELECT 'C' || (doc_id * 2 + 1) FROM documents)
    OR split_part(c2, '/', -1) IN (SELECT 'C' || (doc_id * 2 + 1) FROM documents)""", _RAW),
    "x7_short_patterns": _whole("""
  SELECT q.query_id, w.id FROM works_v w JOIN (
      SELECT item_id * 2 AS query_id, substr(text, 1, 1) AS q FROM benchmark
      UNION ALL SELECT item_id * 2 + 1, substr(text, 1, 2) FROM benchmark) q
    ON w.title IS NOT NULL AND contains(lower(w.title), lower(q.q))"""),
    "c1_partitioned_scan": _with("""
  SELECT id, title, publication_year, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS updated_date FROM raw_v""", _RAW),
    "c2_file_selection": _with("SELECT id FROM raw_v", _RAW),
    "c3_lenient_scan": _with("SELECT id, type FROM raw_v", _RAW),
    "c4_corrupt_files": _with("SELECT DISTINCT id FROM raw_v", _RAW),
    "c5_strict_scan": _with("""
  SELECT 'https://works.example/' || id AS id, cited_by_count FROM works_v"""),
    "f4_abstract_text": _with("""
  SELECT 'https://works.example/' || w.id AS id, a.aii AS abstract_inverted_index
  FROM works_v w LEFT JOIN aii_a a ON a.doc_id = w.doc_id""", _ABSTRACT),
    "j8_resolve_concepts": _with(f"""
  SELECT term_pos, term, concept_id FROM (
    SELECT term_pos, term, split_part(id, '/', -1) AS concept_id, row_number() OVER (PARTITION BY term_pos
      ORDER BY shared DESC, exact DESC, length(display_name), id) AS rank
    FROM (SELECT t.term_pos, t.term, c.id, c.display_name, count(*) AS shared,
            CAST(lower(trim(t.term)) = lower(trim(c.display_name)) AS INTEGER) AS exact
          FROM (SELECT item_id AS term_pos, text AS term, unnest(list_distinct({_TOK.format('text')})) AS tok FROM benchmark) t
          JOIN (SELECT 'https://works.example/C' || doc_id AS id, split_part(text, chr(10), 1) AS display_name,
                  unnest(list_distinct({_TOK.format("split_part(text, chr(10), 1)")})) AS tok FROM documents) c ON c.tok = t.tok
          GROUP BY t.term_pos, t.term, c.id, c.display_name))
  WHERE rank = 1"""),
    "k1_create_tables": _with("""
  SELECT w.id, w.title, w.venue, c.n_refs FROM works_v w
  LEFT JOIN (SELECT source_id, count(*) AS n_refs FROM citations_v GROUP BY 1) c ON c.source_id = w.id"""),
    "k5_insert_strict": _with("SELECT id, type FROM works_v WHERE type <> 'article'"),
    "k6_overwrite": _with("SELECT id, title, cited_by_count + 1 AS cited_by_count FROM works_v"),
    "n1_load_filtered": _with(_LOADED, _RAW),
    "n2_load_generic": _with("""
  SELECT 'work' AS kind, id AS a, title AS b FROM raw_v
  WHERE title IS NOT NULL AND type IN ('article', 'preprint', 'proceedings-article')
  UNION ALL SELECT 'citation' AS kind, id AS a, unnest(referenced_works) AS b FROM raw_v WHERE referenced_works IS NOT NULL""", _RAW),
    "n3_stream_filtered": _with(_LOADED, _RAW),
    "k2_insert_ignore": _with("SELECT id, title, publication_year FROM works_v WHERE type <> 'article'"),
    "n3_tracked_stream": _with(f"""{_LOADED}
  UNION ALL SELECT 'hit' AS kind, query_id || '#' || rank AS a, id AS b FROM title_top""", _RAW, _QUERIES, {**_INDEX, "docs_i": f"""
  SELECT split_part(id, '/', -1) AS id, {_TOK.format('title')} AS toks FROM kept WHERE title IS NOT NULL"""}, _TITLE_TOP),
    "k4_bucket_upsert": _with("""
  SELECT paper_id, CAST(len(e) AS INTEGER) AS dim, round(CAST(e[1] AS DOUBLE), 6) AS first FROM (
    SELECT paper_id, CASE WHEN CAST(substr(paper_id, 2) AS BIGINT) % 50 = 0 THEN list_reverse(embedding) ELSE embedding END AS e
    FROM vectors_v)"""),
    "k4_upsert_vectors": _with("""
  SELECT paper_id, CAST(len(e) AS INTEGER) AS dim, round(CAST(e[1] AS DOUBLE), 6) AS first FROM (
    SELECT paper_id, CASE WHEN paper_id IN (SELECT id FROM works_v) THEN list_reverse(embedding)
                          ELSE embedding END AS e
    FROM vectors_v)"""),
    "j3_cached_vectors": _with("""
  SELECT paper_id, CAST(len(embedding) AS INTEGER) AS dim FROM vectors_v
  WHERE paper_id IN (SELECT seed_id FROM seeds_v)"""),
    "j4_missing_vectors": _with("SELECT id FROM works_v WHERE id NOT IN (SELECT paper_id FROM vectors_v)"),
    "f3_cosine_citations": _with("""
  SELECT c.source_id, c.target_id,
    CASE WHEN isnan(x) THEN NULL ELSE round(x, 6) END AS score
  FROM (SELECT c.source_id, c.target_id,
          list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x
        FROM citations_v c JOIN vectors_v a ON a.paper_id = c.source_id
        JOIN vectors_v b ON b.paper_id = c.target_id) c"""),
    "l2_similar_top5": _with(_similar("seeds_v", 5)),
    "u4_merge_nodes": _with("SELECT * FROM m_nodes", _EXPAND, _MERGE),
    "u4_merge_edges": _with("SELECT * FROM m_edges", _EXPAND, _MERGE),
    "u5_explore_nodes": _with("SELECT * FROM e_nodes", _EXPAND, _EXPLORE),
    "u5_explore_edges": _with("SELECT * FROM e_edges", _EXPAND, _EXPLORE),
    "u6_response": _with(f"""
  SELECT n.seed_id, to_json({{'nodes': n.nodes, 'edges': coalesce(e.edges, [])}}) AS response
  FROM (SELECT seed_id, list({{'id': id, 'title': title, 'year': year, 'first_author': first_author,
                               'venue': venue, 'cited_by_count': cited_by_count}} ORDER BY id) AS nodes
        FROM nodes_x GROUP BY seed_id) n
  LEFT JOIN (SELECT seed_id, list({{'source': source, 'target': target, 'type': type}}
                                  ORDER BY source, target, type NULLS FIRST) AS edges
             FROM edges_x GROUP BY seed_id) e ON e.seed_id = n.seed_id""", _EXPAND),
    "v1_embed": _with(_LENGTHS.format("(SELECT 'W' || doc_id AS paper_id, text FROM documents)")),
    "v2_refresh_vectors": _with("""
  SELECT paper_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN round(x, 4) = 0 THEN 0.0::DOUBLE ELSE round(x, 4) END) AS embedding FROM vectors_v
  UNION ALL """ + _LENGTHS.format("""(
    SELECT w.id AS paper_id, coalesce(w.title, '') || ' ' || coalesce(a.aii, '') AS text
    FROM works_v w LEFT JOIN aii_a a ON a.doc_id = w.doc_id WHERE w.id NOT IN (SELECT paper_id FROM vectors_v))"""), _ABSTRACT),
}


def oracle() -> dict[str, str]:
    return dict(ORACLE)
