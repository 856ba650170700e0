"""Scalar column functions on hand-written rows (FIXTURES section 4)."""

import pytest
from pyspark.sql import functions as F

from paperweave.functions.abstract import inverted_index_json, rebuild_abstract
from paperweave.functions.records import first_author, short_id, venue
from paperweave.functions.text import is_doi_like, is_valid_query, like_pattern, py_strip, tokens
from paperweave.functions.vectors import cosine, rounded


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_f2_tokens(spark):
    got = one(spark, tokens(F.col("s")), s="The CRISPR-Cas9 v2.0, Été!")
    assert got == ["the", "crispr", "cas", "v", "ete"]


def test_f2_letters_without_decomposition_split(spark):
    assert one(spark, tokens(F.col("s")), s="Straße Ørsted") == ["stra", "e", "rsted"]


def test_f3_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5]), ([1.0, 0.0], [0.0, 0.0])],
                               "a array<float>, b array<float>")
    got = [r["x"] for r in df.select(rounded(cosine("a", "b")).alias("x")).collect()]
    assert got == [0.707107, None]


def test_f6_rebuild(spark):
    assert one(spark, rebuild_abstract(F.col("j")), j='{"The":[0,2],"cat":[1]}') == "The cat The"


def test_f4_index_roundtrip(spark):
    df = spark.createDataFrame([("The cat  The\tdog",), ("",), (None,)], "t string")
    got = df.select(inverted_index_json("t").alias("j")).select("j", rebuild_abstract(F.col("j")).alias("r"))
    rows = got.collect()
    assert rows[0]["j"] == '{"The":[0,2],"cat":[1],"dog":[3]}'
    assert rows[0]["r"] == "The cat The dog"
    assert rows[1]["j"] is None and rows[2]["j"] is None


@pytest.mark.parametrize("q,want", [("10.1/x", True), ("10.1", False), ("a/b", False)])
def test_x5_doi_like(spark, q, want):
    assert one(spark, is_doi_like(F.col("q")), q=q) is want


@pytest.mark.parametrize("q,want", [("ab", False), ("abc", True), ("Été", True)])
def test_x8_length(spark, q, want):
    assert one(spark, is_valid_query(F.col("q")), q=q) is want


def test_f7_trim_tabs_and_newlines(spark):
    assert one(spark, py_strip(F.col("q")), q=" \t10.1/a_b\n ") == "10.1/a_b"


def test_f8_wildcards(spark):
    df = spark.createDataFrame([("axb", "a_b"), ("a\\b", "a\\b")], "t string, q string")
    lit = df.select((F.lower("t") == F.lower("q")).alias("x")).collect()
    wild = df.select(F.ilike(F.col("t"), like_pattern(F.col("q"))).alias("x")).collect()
    assert [r.x for r in lit] == [False, True]
    assert [r.x for r in wild] == [True, True]


def test_p2_p3_p4_null_safe(spark):
    df = spark.createDataFrame(
        [([], None, "https://x.org/W1"), (None, {"source": None}, "W2"),
         ([{"author": {"display_name": "A"}}], {"source": {"display_name": "V"}}, "a/b/W3")],
        "au array<struct<author:struct<display_name:string>>>, "
        "pl struct<source:struct<display_name:string>>, id string")
    rows = df.select(first_author(F.col("au")).alias("a"), venue(F.col("pl")).alias("v"),
                     short_id(F.col("id")).alias("i")).collect()
    assert [tuple(r) for r in rows] == [(None, None, "W1"), (None, None, "W2"), ("A", "V", "W3")]
