"""Snapshot loading end to end (N1, N2) and ingest metrics (A3).

Loader "filtered" (N1): lenient scan, keep works sharing a wanted concept,
short ids, insert-or-ignore into ``works`` (first record per id in file and
line order; stored rows stay), append every kept record's references to
``citations``, then rebuild the title index.

Loader "generic" (N2): strict scan, works with a title and a publication
type, ids as found, strict insert (a duplicate id rejects the load); the
citations of *all* records with a reference list. Both outputs are checked
before either table is written.

Both tables take each load in a sub-folder of its own (``load=<id>``), so a
re-run of the same load id replaces its own files instead of duplicating
them, and a load that died between the two tables can be run again. A commit
record, written after both, makes the load count in both at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.functions.records import short_id
from paperweave.operators.filters import filter_concepts, filter_publications, mark_concepts, with_references
from paperweave.operators.bucketed import create_bucketed, unknown_rows, upsert_bucketed
from paperweave.operators.manifest import commit_load, committed_loads, read_manifest, withdraw_load
from paperweave.operators.project import flatten_works
from paperweave.operators.search import build_title_index, save_title_index
from paperweave.operators.segments import add_segment
from paperweave.operators.topn import running_totals, top_n
from paperweave.operators.tables import create_tables, insert_ignore, insert_strict, read_table, table_path
from paperweave.schemas import CITATIONS, WORKS
from paperweave.session import cut_lineage, remove_path, staged
from paperweave.sources.snapshot import FILE_COL, LENIENT, LINE_COL, STRICT, list_files, load_order, read_works


@dataclass
class LoadBatch:
    works: DataFrame          # rows to append to ``works``
    citations: DataFrame      # rows to append to ``citations``
    metrics: DataFrame | None  # per-file counters (A3)


def extract_citations(raw: DataFrame, normalize_ids: bool = False) -> DataFrame:
    """K3 + F5: one (source_id, target_id) per reference; null and empty
    lists give no rows (``explode``, not ``explode_outer``). A bag: repeated
    references repeat."""
    src = short_id(F.col("id")) if normalize_ids else F.col("id")
    edges = with_references(raw).select(src.alias("source_id"), F.explode("referenced_works").alias("target_id"))
    if normalize_ids:
        edges = edges.select("source_id", short_id(F.col("target_id")).alias("target_id"))
    return edges


def ingest_metrics(scanned: DataFrame, kept: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A3: per input file the records read and works kept, and the running
    total of kept works (before de-duplication) in file order.

    ``scanned`` may hold invalid records (null id, ``keep_invalid``): a file
    without a valid one counts as a file with no records. ``files``
    (``list_files``) adds those without any line. The per-file table has one
    row per file; its running counters are a distributed prefix sum
    (``running_totals``), so no task holds all files.
    """
    read = scanned.groupBy(FILE_COL).agg(F.count("id").alias("records"))
    found = kept.groupBy(FILE_COL).agg(F.count(F.lit(1)).alias("kept"))
    per_file = read.join(found, FILE_COL, "left")
    if files is not None:
        per_file = files.select(FILE_COL).distinct().join(per_file, FILE_COL, "left")
    return (running_totals(per_file.fillna(0, ["records", "kept"]), FILE_COL, ["kept"], count_as="files_done")
            .withColumnRenamed("kept_total", "total_kept")
            .withColumnRenamed(FILE_COL, "file"))


def filtered_batch(raw: DataFrame, concept_ids: Iterable[str] | DataFrame,
                   existing_works: DataFrame, metrics: bool = True, normalize_ids: bool = True,
                   kept: DataFrame | None = None, files: DataFrame | None = None,
                   unknown: Callable[[DataFrame], DataFrame] | None = None) -> LoadBatch:
    """N1 without the writes: what a lenient scan adds to the tables.
    ``normalize_ids`` (default on, like this loader's reference) applies P4 to
    work ids and to both citation endpoints. ``kept``: the records of ``raw``
    that pass the concept filter, when the caller has already staged them. ``unknown``
    takes the place of the anti join with ``existing_works``: which of these rows are new."""
    if kept is None:
        kept = filter_concepts(raw.where(F.col("id").isNotNull()), concept_ids)  # X2
    rows = flatten_works(kept, normalize_ids=normalize_ids, keep=(FILE_COL, LINE_COL))   # P1-P4
    if unknown is None:
        works = insert_ignore(existing_works, rows, "id", load_order())         # K2
    else:
        works = unknown(top_n(rows, ["id"], load_order(), 1).select(*WORKS.fieldNames()))
    return LoadBatch(works=works.select(*WORKS.fieldNames()),
                     citations=extract_citations(kept, normalize_ids=normalize_ids),     # K3
                     metrics=ingest_metrics(raw, kept, files) if metrics else None)


def stage_filtered(raw: DataFrame, concept_ids: Iterable[str] | DataFrame,
                   observed: Observation | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Parse a lenient scan (``keep_invalid``) once, into a staged table: every
    record's position and id, and the whole record where the concept filter
    keeps it. Returns the staged records, the kept ones, and the folder. ``observed``
    counts both on the way (``records``, ``kept``)."""
    narrow = (FILE_COL, LINE_COL, "id")
    marked = mark_concepts(raw, concept_ids, "_wanted").withColumn("_wanted", F.col("_wanted") & F.col("id").isNotNull())
    if observed is not None:
        marked = marked.observe(observed, F.count("id").alias("records"), F.count(F.when(F.col("_wanted"), 1)).alias("kept"))
    wide = [c for c in raw.columns if c not in (*narrow, "concepts", "type")]
    rows, folder = staged(marked.select(*narrow, "_wanted", *[F.when(F.col("_wanted"), F.col(c)).alias(c) for c in wide]),
                          "snapshot")
    return rows, rows.where("_wanted").drop("_wanted"), folder


def generic_batch(raw: DataFrame, existing_works: DataFrame, normalize_ids: bool = False) -> LoadBatch:
    """N2 without the writes; raises ``DuplicateKeyError`` (K5). Ids are kept
    as found unless ``normalize_ids`` (then both loaders' ids join)."""
    rows = flatten_works(filter_publications(raw), normalize_ids=normalize_ids)  # X1, P1
    works = insert_strict(existing_works, rows, "id")                            # K5
    return LoadBatch(works=works, citations=extract_citations(raw, normalize_ids), metrics=None)


def _write(spark: SparkSession, root: str, works: DataFrame, citations: DataFrame, load_id: str) -> None:
    """Both tables take the load in a folder of its own, which a re-run
    replaces. The rows count when both are written: until the commit record is there, readers see neither."""
    withdraw_load(spark, root, load_id)
    works.write.mode("overwrite").parquet(f"{table_path(root, 'works')}/load={load_id}")
    citations.write.mode("overwrite").parquet(f"{table_path(root, 'citations')}/load={load_id}")
    commit_load(spark, root, load_id)


IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("load", T.StringType())])


def track_ids(spark: SparkSession, root: str, ids_path: str, buckets: int = 64) -> None:
    """Keep the ids of ``works`` and the loads that brought them in a bucketed table with filters at
    ``ids_path``, made from the stored works if it isn't there. Loads that are given it find their new works by
    it, without reading all stored ids."""
    if read_manifest(spark, ids_path)[1]:
        return
    create_bucketed(spark, ids_path, IDS, ["id"], buckets)
    upsert_bucketed(read_table(spark, root, "works").select("id", F.lit(None).cast("string").alias("load")), ids_path)


def _unknown(spark: SparkSession, root: str, ids_path: str, load_id: str) -> Callable[[DataFrame], DataFrame]:
    """New works: those that no committed load, other than this one, has brought."""
    done = [x for x in committed_loads(spark, root) or [] if x != load_id]
    return lambda rows: unknown_rows(rows, ids_path, F.col("load").isNull() | F.col("load").isin(done))


def _remember(works: DataFrame, ids_path: str, load_id: str) -> None:
    """Before the commit: ids of a load that is never committed don't count."""
    upsert_bucketed(works.select("id", F.lit(load_id).alias("load")), ids_path)


def load_filtered(spark: SparkSession, path: str, concept_ids: Iterable[str] | DataFrame, root: str,
                  glob: str | None = "*.gz", ignore_corrupt_files: bool = True,
                  load_id: str | None = None, index_path: str | None = None,
                  normalize_ids: bool = True, segments_path: str | None = None,
                  ids_path: str | None = None) -> LoadBatch:
    """Concept-filtered load of a snapshot folder into the tables at ``root``.
    ``segments_path``: this load's works become a segment of the title index there
    (``operators.segments``); ``index_path``: the index is built anew from all stored works.
    ``ids_path``: new works are found by the id table there (``track_ids``).

    The snapshot is decompressed and parsed once, into a staged table that the
    works, the citations and the metrics read. Each load writes folders of its
    own: run again with the same ``load_id`` after a failure, it replaces what
    the first try has left and leaves all other loads alone.
    """
    create_tables(spark, root)
    load_id = load_id or uuid.uuid4().hex
    if ids_path:
        track_ids(spark, root, ids_path)
    raw = read_works(spark, path, LENIENT, glob=glob, ignore_corrupt_files=ignore_corrupt_files, keep_invalid=True)
    rows, kept, folder = stage_filtered(raw, concept_ids)
    batch = filtered_batch(rows, concept_ids, read_table(spark, root, "works", without_load=load_id),
                           normalize_ids=normalize_ids, kept=kept, files=list_files(spark, path, glob),
                           unknown=_unknown(spark, root, ids_path, load_id) if ids_path else None)
    # small: one row per file; it must outlive the staged records
    metrics = cut_lineage(batch.metrics)
    # the works rows depend on the table they are added to
    works, works_folder = staged(batch.works, "works")
    if ids_path:
        _remember(works, ids_path, load_id)
    _write(spark, root, works, batch.citations, load_id)
    for f in (folder, works_folder):
        remove_path(spark, f)
    if index_path:
        save_title_index(build_title_index(read_table(spark, root, "works")), index_path)
    stored = _stored(spark, root, load_id)
    if segments_path:
        add_segment(stored[0], segments_path, load_id)
    return LoadBatch(*stored, metrics=metrics)


def _stored(spark: SparkSession, root: str, load_id: str) -> tuple[DataFrame, DataFrame]:
    """The rows that a load has written."""
    return (spark.read.schema(WORKS).parquet(f"{table_path(root, 'works')}/load={load_id}"),
            spark.read.schema(CITATIONS).parquet(f"{table_path(root, 'citations')}/load={load_id}"))


def load_generic(spark: SparkSession, path: str, root: str, glob: str | None = "*.gz",
                 load_id: str | None = None, normalize_ids: bool = False) -> LoadBatch:
    """Strict load; any malformed line or duplicate id raises before
    either table is written. Parsed once; restartable like ``load_filtered``."""
    create_tables(spark, root)
    load_id = load_id or uuid.uuid4().hex
    raw, folder = staged(read_works(spark, path, STRICT, glob=glob), "snapshot")
    try:
        batch = generic_batch(raw, read_table(spark, root, "works", without_load=load_id), normalize_ids)
        _write(spark, root, batch.works, batch.citations, load_id)
    finally:
        remove_path(spark, folder)
    return LoadBatch(*_stored(spark, root, load_id), metrics=None)
