"""Column-level functions: pure expressions over Spark columns."""

from paperweave.functions.abstract import inverted_index_json, rebuild_abstract
from paperweave.functions.records import concept_ids, first_author, short_id, venue
from paperweave.functions.text import (
    is_doi_like,
    is_valid_query,
    like_pattern,
    py_strip,
    strip_accents,
    tokens,
)
from paperweave.functions.vectors import cosine, dot, norm, rounded

__all__ = [
    "inverted_index_json", "rebuild_abstract", "concept_ids", "first_author",
    "short_id", "venue", "is_doi_like", "is_valid_query",
    "like_pattern", "py_strip", "strip_accents", "tokens", "cosine", "dot",
    "norm", "rounded",
]
