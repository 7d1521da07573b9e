"""Sinks: checked output folders, verified Parquet, single CSV files, text."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def check_output_folder(spark: SparkSession, output: str) -> None:
    """Stop before expensive work: the output's folder must exist and be writable."""
    made, fs = _path(spark, output)
    folder = made.getParent()
    if folder is None or not fs.exists(folder):
        raise SystemExit(f"output folder does not exist: {folder}")
    probe = spark._jvm.org.apache.hadoop.fs.Path(folder, f".probe-{uuid.uuid4().hex}")
    try:
        fs.create(probe).close()
        fs.delete(probe, False)
    except Exception as error:
        raise SystemExit(f"output folder is not writable: {folder}: {error}") from error


def make_folder(spark: SparkSession, folder: str) -> None:
    made, fs = _path(spark, folder)
    fs.mkdirs(made)


def write_parquet_verified(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> tuple[int, list[str]]:
    """Write, read back, compare columns, types and the number of rows; rows and columns as read.

    Rows are counted while they are written. Columns of `partition_by` are folder names, read with
    types of their own.
    """
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if sorted(back.columns) != sorted(df.columns):
        raise RuntimeError(f"{path} has columns {back.columns}, not {df.columns}")
    own, read = (sorted(t for t in d.dtypes if t[0] not in partition_by) for d in (df, back))
    if own != read:
        raise RuntimeError(f"{path} has types {read}, not {own}")
    rows = back.count()
    if rows != written.get["n"]:
        raise RuntimeError(f"{path} has {rows} rows, not {written.get['n']}")
    return rows, back.columns


def write_bytes(spark: SparkSession, parts: Iterable[bytes], path: str) -> None:
    """One file on any file system of the session, part by part; parent folders are made."""
    made, fs = _path(spark, path)
    if made.getParent() is not None:
        fs.mkdirs(made.getParent())
    out = fs.create(made, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file on any file system of the session."""
    write_bytes(spark, [text.encode()], path)


def write_csv(df: DataFrame, path: str) -> int:
    """All rows in their order as one CSV file; the driver holds a partition at a time."""
    rows = 0

    def parts() -> Iterator[bytes]:
        nonlocal rows
        held = io.StringIO()
        out = csv.writer(held, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(row)
            rows += 1
            if held.tell() >= 1 << 16:
                yield held.getvalue().encode()
                held.seek(0)
                held.truncate()
        yield held.getvalue().encode()

    write_bytes(df.sparkSession, parts(), path)
    return rows


def write_report_csv(df: DataFrame, path: str, index: str | None = None) -> int:
    """A report of about a hundred rows as one CSV file; `index` becomes an unnamed first column."""
    rows = df.toPandas()
    if index is not None:
        rows = rows.set_index(index).rename_axis(None)
    write_text(df.sparkSession, rows.to_csv(index=index is not None), path)
    return len(rows)
