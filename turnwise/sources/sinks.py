"""Sinks: fixed-column CSV, one-row JSON documents. An output is replaced only by a whole new one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, columns: Sequence[str], *, compression: str = "none") -> None:
    """Write the listed columns with a header; other columns are dropped, NULL is empty text."""
    rows = df.select(*columns)
    swapped(rows, path, lambda to: rows.write.option("header", True).option("escape", '"').csv(to, compression=compression))


def write_document(row: DataFrame, path: str) -> None:
    """Write a one-row frame of nested columns as a JSON document."""
    swapped(row, path, lambda to: row.write.option("ignoreNullFields", False).json(to))


def swapped(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """Writes beside ``path`` and takes its place by renames once the job has committed.

    A job that fails leaves the old output as it was, and so does one whose input is the old output
    itself. Between the two renames nothing stands at ``path``; if the second fails, the old output is put back.
    """
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    target, fresh, old = place(path), place(f"{path}.{mark}.new"), place(f"{path}.{mark}.old")
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    try:
        write(fresh.toString())
        replaced = system.exists(target)
        if replaced and not system.rename(target, old):
            raise OSError(f"could not move {path} aside")
        if not system.rename(fresh, target):
            if replaced:
                system.rename(old, target)
            raise OSError(f"could not move the new output to {path}")
        if replaced:
            system.delete(old, True)
    finally:
        system.delete(fresh, True)


def engine_output_path(base: str) -> str:
    """Where the enriched copy of ``base`` goes, so that it never replaces it."""
    stem, dot, suffix = base.rpartition(".")
    if not dot or "/" in suffix:
        return f"{base}_engine_analysis"
    return f"{stem}_engine_analysis.{suffix}"


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Save as a catalog table bucketed and sorted by ``keys``.

    Plies and engine lines saved with the same keys and bucket count join, and aggregate
    per position, without a shuffle. Rows are placed by bucket first, so that each bucket
    is one file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
