"""Readers of the sources, all lazy: files are found and listed through Spark's file systems."""

from __future__ import annotations

from functools import reduce

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from benefactor.operators.aliases import AliasDictionary
from benefactor.sources import schemas as T
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet", limit: int | None = None) -> list[str]:
    """Paths of the files directly in a folder that fit a pattern, sorted; the first `limit` if given."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return sorted(r["path"] for r in found.select("path").collect())[:limit]


def read_articles(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Article metadata; the id is in pmcid_pmc or, where a table has no such column, in pmcid."""
    paths = list_files(spark, folder, limit=limit) if limit is not None else [folder]
    if not paths:
        raise ValueError(f"no Parquet files in {folder}")
    raw = spark.read.option("mergeSchema", "true").parquet(*paths)
    if "pmcid_pmc" not in raw.columns and "pmcid" in raw.columns:
        raw = raw.withColumnRenamed("pmcid", "pmcid_pmc")
    return T.padded(raw, T.ARTICLES)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return T.padded(spark.read.parquet(path), T.DETECTIONS)


def _no_such_table(spark: SparkSession, error: Exception) -> bool:
    """Whether a database says that a table does not exist; any other fault is not this one.

    SQL states of class 42 name it: 42S02, 42P01 or 42X05. A database without states says so in words.
    """
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        if is_instance_of(spark.sparkContext._gateway, cause, "java.sql.SQLException"):
            state = cause.getSQLState()
            return state in ("42S02", "42P01", "42X05") or (state is None and "no such table" in str(cause.getMessage()))
        cause = cause.getCause()
    return False


#: Names under which the registry table is looked for, in order.
REGISTRY_TABLES = ("pmcid_registry", "pmcids")


def read_registry(spark: SparkSession, path: str, **jdbc: str) -> DataFrame:
    """The registry: a Parquet table, a folder holding one under a known name, or a JDBC source.

    For JDBC, `path` is the URL and `jdbc` the further options; the known names are tried in turn.
    """
    if path.startswith("jdbc:"):

        def load(name: str) -> DataFrame:
            return spark.read.format("jdbc").options(url=path, dbtable=name, **jdbc).load()

        def missing(error: Exception) -> bool:
            return _no_such_table(spark, error)

    else:

        def load(name: str) -> DataFrame:
            return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")

        def missing(error: Exception) -> bool:
            return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"

        if path.endswith(".parquet"):
            return T.padded(spark.read.parquet(path), T.REGISTRY)
    for name in REGISTRY_TABLES:
        try:
            return T.padded(load(name), T.REGISTRY)
        except (AnalysisException, Py4JJavaError) as error:
            if not missing(error):
                raise
    raise ValueError(f"no registry table in {path}; looked for {', '.join(REGISTRY_TABLES)}")


def read_filelists(spark: SparkSession, folder: str, licenses: tuple[str, ...] = ("comm", "noncomm")) -> DataFrame:
    """The CSV filelists of each license, all columns as text; the license comes from the file's name.

    Files may order or spell their columns differently: those with one header are one scan.
    """
    parts = []
    for license_type in licenses:
        pattern = f"oa_{license_type}_xml.PMC*.baseline.*.filelist.csv"
        paths = list_files(spark, folder, pattern)
        by_header: dict[tuple[str, ...], list[str]] = {}
        for path in paths:  # some dozen files; only a header is read
            by_header.setdefault(tuple(spark.read.option("header", "true").csv(path).columns), []).append(path)
        for same in by_header.values():
            raw = spark.read.option("header", "true").csv(same)
            raw = raw.toDF(*[c.replace("Accession ID", "AccessionID") for c in raw.columns])
            parts.append(T.padded(raw.withColumn("license", F.regexp_extract(F.input_file_name(), r"oa_([a-z]+)_xml[^/]*$", 1)), T.FILELIST))
    if not parts:
        raise ValueError(f"no filelists in {folder}")
    return reduce(DataFrame.unionByName, parts)


def read_aliases(spark: SparkSession, path: str) -> AliasDictionary:
    return AliasDictionary.from_frame(spark.read.option("header", "true").csv(path))


def read_discovered(spark: SparkSession, path: str) -> DataFrame:
    return T.padded(spark.read.option("header", "true").csv(path), T.DISCOVERED)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return T.padded(spark.read.option("header", "true").csv(path), T.SUMMARY)


def read_wide(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A wide results CSV whose unnamed first column is the display name; `kind` is the years' type."""
    try:
        raw = spark.read.option("header", "true").csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    raw = raw.toDF("display_name", *raw.columns[1:])
    return raw.select("display_name", *[F.col(c).cast(kind) for c in raw.columns[1:]])
