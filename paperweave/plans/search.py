"""Batch search: a table of queries in, a table of ranked works out.

Routing (per query): queries shorter than 3 characters are rejected (X8);
a DOI-like query (X5) whose trimmed text equals a stored DOI returns only that
work (X6, L5); every other query is answered by BM25 over titles (L1), or by
case-insensitive substring match (X7, L4) with ``mode="substring"``. Works
without a title are never returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.functions.text import is_valid_query, tokens
from paperweave.operators.project import as_paper
from paperweave.operators.search import (
    PUSHED_TERMS,
    SEARCH_LIMIT,
    TitleIndex,
    bm25_top,
    build_title_index,
    doi_first,
    substring_top,
)
from paperweave.operators.topn import BROADCAST_BYTES, BROADCAST_ROWS
from paperweave.schemas import PAPER_COLUMNS
from paperweave.session import staged

RESULT_COLUMNS = ["query_id", "route", "rank", *PAPER_COLUMNS, "score"]


@dataclass
class SearchResult:
    hits: DataFrame        # RESULT_COLUMNS
    rejected: DataFrame    # query_id, q  (X8)


def valid_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by length."""
    ok = is_valid_query(F.col("q"))
    return queries.where(ok), queries.where(~ok | F.col("q").isNull())


def _broadcast_fits(accepted: DataFrame) -> tuple[bool, bool, bool]:
    """One bounded job over the accepted queries decides both broadcasts:
    of the queries (DOI route) and of their terms (BM25 route), and whether
    the terms are few enough for a scan filter. Terms are
    distinct ASCII runs of a query, so their bytes are at most the query's;
    both tables get 8 bytes per row for the query id. Checking all accepted
    queries (a superset of those left after DOI routing) needs no DOI join."""
    r = accepted.limit(BROADCAST_ROWS + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("q")), F.lit(0)).alias("b"),
        F.coalesce(F.sum(F.size(F.array_distinct(tokens(F.col("q"))))), F.lit(0)).alias("t")).first()
    n, b, t = r["n"], r["b"], r["t"]
    queries_fit = n <= BROADCAST_ROWS and b + 8 * n <= BROADCAST_BYTES
    terms_fit = queries_fit and t <= BROADCAST_ROWS and b + 8 * t <= BROADCAST_BYTES
    return queries_fit, terms_fit, terms_fit and t <= PUSHED_TERMS


def search(works: DataFrame, queries: DataFrame, index: TitleIndex | None = None,
           limit: int = SEARCH_LIMIT, mode: str = "bm25", wildcards: bool = False,
           strip_doi_prefix: bool = False) -> SearchResult:
    if mode not in ("bm25", "substring"):
        raise ValueError(f"mode must be 'bm25' or 'substring', not {mode!r}")
    accepted, rejected = valid_queries(queries.select("query_id", "q"))
    queries_fit, terms_fit, few_terms = _broadcast_fits(accepted)
    doi = doi_first(works, accepted, wildcards, strip_doi_prefix, broadcast_queries=queries_fit).select(
        "query_id", F.lit("doi").alias("route"), "rank", "id", F.lit(None).cast("double").alias("score"))
    rest = accepted.join(doi.select("query_id"), "query_id", "left_anti")
    if not terms_fit:
        # most of many queries may be answered by a DOI; what is left decides on the broadcast of its terms
        rest, _ = staged(rest, "search-rest")
        _, terms_fit, few_terms = _broadcast_fits(rest)
    if mode == "bm25":
        if index is None:
            index = build_title_index(works)
        ranked = bm25_top(index, rest, limit, broadcast_terms=terms_fit, few_terms=few_terms).select(
            "query_id", F.lit("bm25").alias("route"), "rank", "id", "score")
    else:
        ranked = substring_top(works, rest, limit, wildcards).select(
            "query_id", F.lit("substring").alias("route"), "rank", "id",
            F.lit(None).cast("double").alias("score"))
    hits = doi.unionByName(ranked).join(as_paper(works), "id").select(*RESULT_COLUMNS)
    return SearchResult(hits=hits, rejected=rejected)
