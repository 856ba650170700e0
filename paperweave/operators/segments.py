"""The title index in segments, for tables that grow load by load.

A segment is the title index of one load's works: postings, term dictionary with
bounds, and statistics of its own. It is written once and never changed; a manifest names the live
ones. A load adds its own postings only. When ``fanout`` segments are of about one size, they are merged into one, so
there are few, and each posting is rewritten about once per power of
``fanout``. Search reads the union of the postings and adds up the segments'
document frequencies of its query terms, numbers of works and lengths, so its
scores are those of an index built anew over all works. Each work must be in one load (K2).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators.manifest import read_manifest, update_manifest
from paperweave.operators.search import (
    TitleIndex,
    build_title_index,
    index_of,
    merged_stats,
    save_title_index,
)
from paperweave.session import hadoop_path, remove_path

FANOUT = 8


def add_segment(works: DataFrame, path: str, name: str, stopwords=(), stem: bool = False, fanout: int = FANOUT) -> None:
    """Index ``works`` as the segment ``name`` of the index at ``path``. A
    segment of this name is replaced, and one that is merged with others already is left as it is, so a replayed load counts once. No titles:
    nothing is added. The first segment decides ``stopwords`` and ``stem`` of the whole index; another choice raises."""
    spark, folder = works.sparkSession, f"segments/{uuid.uuid4().hex}"
    kind = {"stopwords": list(stopwords), "stem": stem}
    _, now = read_manifest(spark, path)
    if any(name in s["names"] and len(s["names"]) > 1 for s in now.get("segments", [])):
        return
    if now and now["kind"] != kind:
        raise ValueError(f"the index at {path} was built with {now['kind']}")
    save_title_index(build_title_index(works, stopwords, stem=stem), f"{path}/{folder}")
    docs = spark.read.parquet(f"{path}/{folder}/stats").first()["n_docs"]

    def change(content: dict) -> dict:
        live = [s for s in content.get("segments", []) if s["names"] != [name]]
        return {"kind": kind, "segments": live + ([{"names": [name], "folder": folder, "docs": docs}] if docs else [])}

    update_manifest(spark, path, change)
    if not docs:
        remove_path(spark, f"{path}/{folder}")
    merge_segments(spark, path, fanout)


def has_segment(spark: SparkSession, path: str, name: str) -> bool:
    """Whether the load ``name`` is in the index, by itself or merged with others."""
    return any(name in s["names"] for s in read_manifest(spark, path)[1].get("segments", []))


def merge_segments(spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
    """Merge ``fanout`` segments of about one size into one, as long as there
    are so many. The old folders stay for readers that have begun; ``vacuum`` deletes them."""
    while True:
        _, content = read_manifest(spark, path)
        tiers: dict[int, list] = {}
        for s in content.get("segments", []):
            tiers.setdefault(int(math.log(max(1, s["docs"]), fanout)), []).append(s)
        some = next((t for _, t in sorted(tiers.items()) if len(t) >= fanout), None)
        if some is None:
            return
        folder = f"segments/{uuid.uuid4().hex}"
        save_title_index(_index(spark, path, some, content["kind"]), f"{path}/{folder}", clustered=False)
        gone = {s["folder"] for s in some}
        new = {"names": [n for s in some for n in s["names"]], "folder": folder, "docs": sum(s["docs"] for s in some)}

        def change(now: dict) -> dict:
            if not gone <= {s["folder"] for s in now["segments"]}:       # another writer has merged or replaced one
                return now
            return {**now, "segments": [s for s in now["segments"] if s["folder"] not in gone] + [new]}  # noqa: B023

        update_manifest(spark, path, change)


def _index(spark: SparkSession, path: str, segments: list[dict], kind: dict) -> TitleIndex:
    read = lambda part: spark.read.parquet(*[f"{path}/{s['folder']}/{part}" for s in segments])
    return index_of(read("postings"), read("bounds"), merged_stats(read("stats")), kind["stopwords"], kind["stem"], parts=len(segments))


def load_segments(spark: SparkSession, path: str) -> TitleIndex:
    """The index that the live segments make up, as ``search`` takes it."""
    _, content = read_manifest(spark, path)
    if not content.get("segments"):
        raise FileNotFoundError(f"no title index at {path}")
    return _index(spark, path, content["segments"], content["kind"])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the segment folders that the manifest doesn't name; their names. Only when no reader of an older state and no
    writer is left."""
    live = {s["folder"].rsplit("/", 1)[1] for s in read_manifest(spark, path)[1].get("segments", [])}
    fs, folder = hadoop_path(spark, f"{path}/segments")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    for n in set(names) - live:
        remove_path(spark, f"{path}/segments/{n}")
    return sorted(set(names) - live)
