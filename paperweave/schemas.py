"""Explicit schemas: the snapshot is never read with inference."""

from __future__ import annotations

from pyspark.sql import types as T

STR = T.StringType()
INT = T.IntegerType()

# One raw work record of the JSON-lines snapshot. Only the fields any operator
# reads are declared; the JSON source skips the rest while parsing.
# ``abstract_inverted_index`` is declared as a string so the reader keeps the
# raw JSON text of the object (JSON null becomes SQL NULL).
RAW_WORK = T.StructType([
    T.StructField("id", STR),
    T.StructField("doi", STR),
    T.StructField("title", STR),
    T.StructField("type", STR),
    T.StructField("publication_year", INT),
    T.StructField("cited_by_count", INT),
    T.StructField("authorships", T.ArrayType(T.StructType([
        T.StructField("author", T.StructType([T.StructField("display_name", STR)])),
    ]))),
    T.StructField("primary_location", T.StructType([
        T.StructField("source", T.StructType([T.StructField("display_name", STR)])),
    ])),
    T.StructField("concepts", T.ArrayType(T.StructType([T.StructField("id", STR)]))),
    T.StructField("referenced_works", T.ArrayType(STR)),
    T.StructField("abstract_inverted_index", STR),
])

WORKS = T.StructType([
    T.StructField("id", STR),
    T.StructField("doi", STR),
    T.StructField("title", STR),
    T.StructField("publication_year", INT),
    T.StructField("cited_by_count", INT),
    T.StructField("first_author", STR),
    T.StructField("venue", STR),
    T.StructField("abstract_inverted_index", STR),
])

CITATIONS = T.StructType([
    T.StructField("source_id", STR),
    T.StructField("target_id", STR),
])

VECTOR_CACHE = T.StructType([
    T.StructField("paper_id", STR),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

TABLE_SCHEMAS = {"works": WORKS, "citations": CITATIONS, "vector_cache": VECTOR_CACHE}

# Columns of a search / graph node (``publication_year`` is exposed as ``year``).
PAPER_COLUMNS = ["id", "title", "year", "first_author", "venue", "cited_by_count"]

ABSTRACT_MAP = T.MapType(STR, T.ArrayType(INT))
