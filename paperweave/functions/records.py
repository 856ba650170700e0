"""Null-safe accessors on the nested raw record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_author(authorships: Column) -> Column:
    """Display name of the first authorship; null when the list is empty,
    missing or of the wrong type. ``F.get`` is null out of bounds, where
    ``[0]`` would raise under ANSI mode."""
    return F.get(authorships, 0).getField("author").getField("display_name")


def venue(primary_location: Column) -> Column:
    """``primary_location.source.display_name``, null anywhere on the path."""
    return primary_location.getField("source").getField("display_name")


def short_id(col: Column) -> Column:
    """Text after the last ``/`` (the whole value when there is none)."""
    return F.substring_index(col, "/", -1)


def concept_ids(concepts: Column) -> Column:
    """Short ids of all concepts of a record."""
    return F.transform(concepts, lambda c: short_id(c.getField("id")))
