"""The concept-filtered load as a file stream.

New snapshot files are picked up as they arrive (``readStream`` on the
folder); each micro-batch runs the same plan as the batch loader (X2, P1-P4,
K2 against the stored works, K3). The stream's checkpoint records which files
were read, so a re-run never loads a file twice.

A micro-batch is parsed once, into a staged table. Its works and citations go
to folders of their own (``load=stream-<name>-<batch_id>``) which a replay
after a failure overwrites; ``name`` defaults to a digest of the checkpoint
location, so two streams into the same tables never share a folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperweave.operators.search import build_title_index, save_title_index
from paperweave.operators.segments import add_segment
from paperweave.operators.tables import create_tables, read_table
from paperweave.plans.load import _remember, _unknown, _write, filtered_batch, stage_filtered, track_ids
from paperweave.schemas import RAW_WORK
from paperweave.session import remove_path, staged
from paperweave.sources.snapshot import FILE_COL, LINE_COL


@dataclass
class Progress:
    """Counters of a micro-batch: records read, records that the filter keeps,
    works that are new, citations."""
    batch_id: int
    records: int
    kept: int
    works: int
    citations: int


def stream_filtered(spark: SparkSession, path: str, concept_ids: Iterable[str] | DataFrame, root: str,
                    checkpoint_location: str, glob: str | None = "*.gz",
                    max_files_per_trigger: int | None = None, available_now: bool = True,
                    ignore_corrupt_files: bool = True, name: str | None = None,
                    index_path: str | None = None, segments_path: str | None = None, ids_path: str | None = None,
                    on_progress: Callable[[Progress], None] | None = None) -> StreamingQuery:
    """``concept_ids``: a list or a table, as for the batch loader.

    ``segments_path``: each micro-batch adds its own works to the title index there, as
    a segment (``operators.segments``). ``ids_path``: new works are found by the id table there
    (``plans.load.track_ids``), which reads as much as the batch asks for, not all stored ids. ``index_path``: the title index is built anew from the stored works after
    each micro-batch that adds some, as after a batch load. ``on_progress`` gets the
    counters of each micro-batch (A3), observed while its rows are staged and written: no pass of their own."""
    create_tables(spark, root)
    if ids_path:
        track_ids(spark, root, ids_path)
    name = name or hashlib.sha1(checkpoint_location.encode()).hexdigest()[:12]
    if not isinstance(concept_ids, DataFrame):
        concept_ids = list(concept_ids)
    reader = (spark.readStream.schema(RAW_WORK).option("mode", "PERMISSIVE")
              .option("ignoreCorruptFiles", str(ignore_corrupt_files).lower()))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.json(path).withColumn(FILE_COL, F.col("_metadata.file_path"))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        load_id = f"stream-{name}-{batch_id}"
        raw = batch.withColumn(LINE_COL, F.monotonically_increasing_id())
        scanned, added, edges = Observation(), Observation(), Observation()
        rows, kept, folder = stage_filtered(raw, concept_ids, scanned)
        out = filtered_batch(rows, concept_ids, read_table(spark, root, "works", without_load=load_id),
                             metrics=False, kept=kept, unknown=_unknown(spark, root, ids_path, load_id) if ids_path else None)
        works, works_folder = staged(out.works.observe(added, F.count(F.lit(1)).alias("works")), "works")
        if ids_path:
            _remember(works, ids_path, load_id)
        _write(spark, root, works, out.citations.observe(edges, F.count(F.lit(1)).alias("citations")), load_id)
        if index_path and added.get["works"]:
            save_title_index(build_title_index(read_table(spark, root, "works")), index_path)
        if segments_path and added.get["works"]:
            add_segment(works, segments_path, load_id)
        if on_progress:
            on_progress(Progress(batch_id=batch_id, records=scanned.get["records"], kept=scanned.get["kept"],
                                 works=added.get["works"], citations=edges.get["citations"]))
        for f in (folder, works_folder):
            remove_path(spark, f)

    writer = src.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
