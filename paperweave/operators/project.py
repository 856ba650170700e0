"""Projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.abstract import rebuild_abstract
from paperweave.functions.records import first_author, short_id, venue
from paperweave.schemas import PAPER_COLUMNS


def flatten_works(raw: DataFrame, normalize_ids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Nested snapshot record -> the 8 ``works`` columns (plus ``keep``).

    ``normalize_ids`` keeps only the text after the last ``/`` of the id (the
    concept-filtered loader's form); the generic loader keeps ids as found.
    """
    wid = short_id(F.col("id")) if normalize_ids else F.col("id")
    return raw.select(
        wid.alias("id"),
        "doi",
        "title",
        "publication_year",
        "cited_by_count",
        first_author(F.col("authorships")).alias("first_author"),
        venue(F.col("primary_location")).alias("venue"),
        "abstract_inverted_index",
        *keep,
    )


def as_paper(works: DataFrame) -> DataFrame:
    """P5: the node / search-hit projection, ``publication_year`` as ``year``."""
    return works.select(
        "id", "title", F.col("publication_year").alias("year"),
        "first_author", "venue", "cited_by_count",
    ).select(*PAPER_COLUMNS)


def edge(source: Column, target: Column, etype: str | None = None) -> list[Column]:
    """The columns of an edge; ``type`` is null for a citation."""
    return [source.alias("source"), target.alias("target"),
            F.lit(etype).cast("string").alias("type")]


def embedding_text(works: DataFrame, abstract: str = "raw") -> DataFrame:
    """Text fed to the encoder: title, a space, then the abstract.

    ``raw`` uses the inverted-index JSON text itself as the abstract (what the
    reference feeds its model); ``plain`` rebuilds the prose first (F6).
    Missing parts count as empty strings.
    """
    if abstract == "raw":
        abs_text = F.col("abstract_inverted_index")
    elif abstract == "plain":
        abs_text = rebuild_abstract(F.col("abstract_inverted_index"))
    else:
        raise ValueError(f"abstract must be 'raw' or 'plain', not {abstract!r}")
    text = F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.coalesce(abs_text, F.lit("")))
    return works.select(F.col("id").alias("paper_id"), text.alias("text"))
