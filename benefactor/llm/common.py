"""Helpers that the corpus operators share: column picking, checkpoints, Arrow text access."""

from __future__ import annotations

import gc
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+` is a word of the contracts that speak of plain words.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, found by exact name, whatever else the table holds.

    Other columns may repeat a name or differ from one only in case: they are renamed by
    position first, so no reference is ambiguous. A column that is missing is an error.
    """
    seen: set[str] = set()
    names = []
    for i, name in enumerate(df.columns):
        keep = name in columns and name not in seen
        names.append(name if keep else f"__other_{i}")
        seen.add(name)
    return df.toDF(*names).select(*columns)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; an absent id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Only in a session on one machine (master local) that names none, a temporary folder is taken; on a
    cluster that is an error, as executors would write where nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "benefactor-checkpoints")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder all executors share.

    The driver's garbage is collected after it: plans and their states are dead by then, and a long
    chain of checkpoints would let the driver's heap grow to its limit before it collects them itself.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    written = df.checkpoint(eager=True)
    context._jvm.System.gc()
    return written


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop broadcasts, shuffle files and checkpoints of tables that nothing refers to any more.

    It learns of them when the driver's JVM collects garbage, which a driver with much memory may not do for hours.
    """
    gc.collect()  # Python's references first
    spark.sparkContext._jvm.System.gc()


def share_below(key: Column, fraction: float | Column, seed: int) -> Column:
    """True for about `fraction` of the keys, decided by a hash: the same rows on every run."""
    limit = (fraction if isinstance(fraction, Column) else F.lit(float(fraction))) * F.lit(float(1 << 30))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < limit


def text_hash(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
