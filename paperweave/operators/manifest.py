"""Small files that say which data files count.

A *manifest* is a numbered JSON file below ``<path>/_manifest``: the newest
complete one names the folders that make up a table, so a new state appears at
once, by creating one file, and readers of the old state keep their folders. A
*commit record* is an empty file below ``<root>/_loads``, one per load: a
load's rows count in all tables from the moment it exists. Any Hadoop file
system will do; both hold names only, never rows.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from paperweave.session import hadoop_path

KEPT_MANIFESTS = 10


class ConflictError(RuntimeError):
    """Another writer has published a newer state in the meantime."""


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _read(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: str) -> None:
    """Fails if the file exists."""
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def read_manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest number in use, and the newest complete content ({} if there is none). A file whose
    writer died is no JSON: the one before it holds."""
    numbers = sorted((int(n[:-5]) for n in _names(spark, f"{path}/_manifest") if n.endswith(".json")), reverse=True)
    for n in numbers:
        try:
            return numbers[0], json.loads(_read(spark, f"{path}/_manifest/{n:012d}.json"))
        except ValueError:
            continue
    return (numbers[0] if numbers else 0), {}


def publish(spark: SparkSession, path: str, after: int, content: dict) -> None:
    """The state that follows number ``after``; ``ConflictError`` if another one does."""
    try:
        _create(spark, f"{path}/_manifest/{after + 1:012d}.json", json.dumps(content))
    except Exception as e:
        if f"{after + 1:012d}.json" in _names(spark, f"{path}/_manifest"):
            raise ConflictError(path) from e
        raise
    fs, folder = hadoop_path(spark, f"{path}/_manifest")
    for n in _names(spark, f"{path}/_manifest"):
        if n.endswith(".json") and int(n[:-5]) <= after + 1 - KEPT_MANIFESTS:
            fs.delete(hadoop_path(spark, f"{path}/_manifest/{n}")[1], False)


def update_manifest(spark: SparkSession, path: str, change, tries: int = 5) -> dict:
    """Publish ``change(content)``, again from the newest state if another writer was first."""
    for left in reversed(range(tries)):
        number, content = read_manifest(spark, path)
        new = change(content)
        try:
            publish(spark, path, number, new)
            return new
        except ConflictError:
            if not left:
                raise
    raise AssertionError


def track_loads(spark: SparkSession, root: str) -> None:
    """From now on, loads count in the tables at ``root`` only when they are committed."""
    fs, folder = hadoop_path(spark, f"{root.rstrip('/')}/_loads")
    fs.mkdirs(folder)


def committed_loads(spark: SparkSession, root: str) -> list[str] | None:
    """The loads that count, or None if the tables don't track them."""
    fs, folder = hadoop_path(spark, f"{root.rstrip('/')}/_loads")
    return sorted(_names(spark, f"{root.rstrip('/')}/_loads")) if fs.exists(folder) else None


def commit_load(spark: SparkSession, root: str, load_id: str) -> None:
    fs, p = hadoop_path(spark, f"{root.rstrip('/')}/_loads/{load_id}")
    fs.create(p, True).close()


def withdraw_load(spark: SparkSession, root: str, load_id: str) -> None:
    fs, p = hadoop_path(spark, f"{root.rstrip('/')}/_loads/{load_id}")
    fs.delete(p, False)
