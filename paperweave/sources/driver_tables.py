"""The scholarly tables derived from the driver's test tables.

The test data has no scholarly snapshot, so the works, citations, vectors,
seed and query tables are defined as per-row projections of ``documents``,
``lineitem``, ``embeddings`` and ``benchmark``. Every view reads its whole
source table, so the work of each query grows with the data. The same
definitions are written as DuckDB SQL in ``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions.abstract import inverted_index_json
from paperweave.functions.text import is_valid_query

# Fixed values of the derived views (shared with the oracle SQL).
DOI_PREFIX = "https://doi.org/10."
RAW_ID_PREFIX = "https://works.example/"
WORK_TYPES = ["article", "preprint", "proceedings-article", "dataset", "paratext"]
MISSING_SEED = "W-none"
DOI_QUERY_OFFSET = 1_000_000_000_000
# Lines of a snapshot file, about; twice as many at most.
FILE_LINES = 16_384


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _body(text: Column) -> Column:
    """Everything after the first line break ('' when there is none)."""
    nl = F.instr(text, "\n")
    return F.when(nl > 0, text.substr(nl + 1, F.length(text))).otherwise(F.lit(""))


def works(spark: SparkSession, sf_dir: str, whole_text: bool = False) -> DataFrame:
    """The title is the first line, missing for some works; with
    ``whole_text``, the whole text of the document."""
    d = _table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    wtype = F.element_at(F.array(*[F.lit(t) for t in WORK_TYPES]), (k % 5 + 1).cast("int"))
    return d.select(
        F.concat(F.lit("W"), k).alias("id"),
        F.concat(F.lit(DOI_PREFIX), F.lit(1000) + k % 9000, F.lit("/d_"), k).alias("doi"),
        (F.col("text") if whole_text else F.when(k % 17 != 0, _first_line(F.col("text")))).alias("title"),
        wtype.alias("type"),
        (F.lit(1990) + k % 35).cast("int").alias("publication_year"),
        ((k * 37) % 500).cast("int").alias("cited_by_count"),
        F.when(k % 11 != 0, F.concat(F.lit("Author "), k % 40)).alias("first_author"),
        F.col("source").alias("venue"),
        inverted_index_json(_body(F.col("text"))).alias("abstract_inverted_index"),
    )


def search_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``works`` whose searched field is the whole text of the document."""
    return works(spark, sf_dir, whole_text=True)


def works_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 columns of the ``works`` table (without ``type``)."""
    return works(spark, sf_dir).drop("type")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag of directed edges: dangling endpoints, self loops and duplicate
    edges all occur."""
    li = _table(spark, sf_dir, "lineitem")
    n_part = _table(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    return li.select(
        F.concat(F.lit("W"), F.col("l_partkey")).alias("source_id"),
        F.concat(F.lit("W"), F.col("l_orderkey") % n_part).alias("target_id"),
    )


def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("W"), F.col("vec_id")).alias("paper_id"), "embedding")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work is a seed, plus one id that does not exist."""
    w = _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("W"), F.col("doc_id")).alias("seed_id"))
    return w.unionByName(spark.range(1).select(F.lit(MISSING_SEED).alias("seed_id")))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages as title queries, plus every work's DOI typed
    in upper case with stray spaces (DOI route)."""
    b = _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    d = _table(spark, sf_dir, "documents").select(
        (F.lit(DOI_QUERY_OFFSET) + F.col("doc_id")).alias("query_id"),
        F.concat(F.lit(" "), F.upper(F.concat(F.lit(DOI_PREFIX), F.lit(1000) + F.col("doc_id") % 9000,
                                               F.lit("/d_"), F.col("doc_id"))), F.lit(" ")).alias("q"))
    return b.unionByName(d)


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages only."""
    return _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def substring_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring probes: every sentence (text between full stops, untrimmed)
    of every benchmark passage, so the whole text is searched. Only
    sentences the search accepts are kept (X8: at least 3 characters);
    shorter ones, such as the empty text after a final full stop, never
    reach substring search."""
    b = _table(spark, sf_dir, "benchmark")
    return (b.select("item_id", F.posexplode(F.split(F.col("text"), r"\.", -1)).alias("pos", "q"))
            .where(is_valid_query(F.col("q")))
            .select((F.col("item_id") * 100_000 + F.col("pos")).alias("query_id"), "q"))


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested snapshot records (the JSON shape) built row by row from
    ``documents``; reference lists are a per-row rule over the document id
    (null for some records, empty for others)."""
    w = works(spark, sf_dir)
    k = F.expr("cast(substr(id, 2) as bigint)")
    n_docs = _table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()

    def ref(j: int) -> Column:
        return F.concat(F.lit(RAW_ID_PREFIX + "W"), (k * 7 + 13 * j) % n_docs)

    refs = F.when(k % 13 != 0, F.slice(F.array(ref(1), ref(2), ref(3)), 1, (k % 4).cast("int")))
    concept = lambda v: F.struct(F.concat(F.lit(RAW_ID_PREFIX + "C"), v).alias("id"))
    author = F.struct(F.struct(F.col("first_author").alias("display_name")).alias("author"))
    return w.select(
        F.concat(F.lit(RAW_ID_PREFIX), F.col("id")).alias("id"),
        "doi", "title", "type", "publication_year", "cited_by_count",
        F.when(F.col("first_author").isNotNull(), F.array(author))
         .otherwise(F.array().cast("array<struct<author:struct<display_name:string>>>"))
         .alias("authorships"),
        F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        F.array(concept(F.col("cited_by_count") % 7), concept(F.col("publication_year") % 5)).alias("concepts"),
        refs.alias("referenced_works"),
        "abstract_inverted_index",
    )


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every space-separated word of every benchmark passage as a query
    (short ones exercise the length check)."""
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.posexplode(F.split(F.col("text"), " ")).alias("pos", "q")).select(
        (F.col("item_id") * 100_000 + F.col("pos")).alias("query_id"), "q")


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as JSON lines, the abstract as a JSON object in them,
    with the day (28 of them) that names their folder."""
    r = raw_works(spark, sf_dir)
    head = F.to_json(F.struct(*[c for c in r.columns if c != "abstract_inverted_index"]))
    k = F.expr(f"cast(substr(id, {len(RAW_ID_PREFIX) + 2}) as bigint)")
    return r.select(
        F.concat(F.regexp_replace(head, r"\}\z", ""),
                 F.lit(',"abstract_inverted_index":'), F.coalesce("abstract_inverted_index", F.lit("null")), F.lit("}")).alias("value"),
        F.format_string("2024-01-%02d", (k % 28 + 1).cast("int")).alias("updated_date"))


def lines_by_day(lines: DataFrame) -> dict[str, int]:
    """How many lines each day has; the lines themselves aren't built for it."""
    return dict(lines.groupBy("updated_date").agg(F.count(F.lit(1))).collect())


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that ``repartition(n, number)`` deals to different parts, but for a few at most."""
    tried = n * (n.bit_length() + 6)
    found = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()
    return [r[1] for r in found] + list(range(tried, tried + n - len(found)))


def write_snapshot(lines: DataFrame, path: str, compression: str = "gzip", by_day: dict[str, int] | None = None) -> str:
    """Text files below ``path``, one folder per day; a day has as many files
    as its lines need (``by_day``, counted here by default), FILE_LINES a file, so
    neither a task nor a file grows with the data. Lines are dealt to a day's files by a hash of their position in the
    scan, and each file is written by a task of its own."""
    by_day = lines_by_day(lines) if by_day is None else by_day
    files = {day: -(-n // FILE_LINES) for day, n in by_day.items()}
    if files:
        many = F.create_map(*[F.lit(x) for day in files.items() for x in day])[F.col("updated_date")]
        before = F.create_map(*[F.lit(x) for day, at in zip(files, accumulate([0, *files.values()])) for x in (day, at)])[F.col("updated_date")]
        # hashed: a day may follow from the position, and then all its lines have the same remainder
        number = (before + F.pmod(F.xxhash64(F.monotonically_increasing_id()), many)).cast("int")
        keys = F.lit(_apart(lines.sparkSession, sum(files.values())))
        lines = lines.withColumn("_key", F.get(keys, number).cast("long")).repartition(sum(files.values()), "_key").drop("_key")
    (lines.write.mode("append").partitionBy("updated_date").option("compression", compression)
     .option("maxRecordsPerFile", 2 * FILE_LINES).text(path))
    return path


def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One named concept per document: its first line."""
    return _table(spark, sf_dir, "documents").select(
        F.concat(F.lit(RAW_ID_PREFIX + "C"), F.col("doc_id")).alias("id"), _first_line(F.col("text")).alias("display_name"))
