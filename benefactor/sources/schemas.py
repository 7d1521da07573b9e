"""Schemas of the sources. Text columns are read as strings and cast by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLES = (
    "pmid string, pmcid_pmc string, journal string, affiliation_country string, year_epub string, year_ppub string, "
    "fund_text string, fund_pmc_source string, fund_pmc_institute string, fund_pmc_anysource string"
)
DETECTIONS = "pmcid string, article string, filename string, is_open_data boolean, is_open_code boolean"
REGISTRY = "pmcid string, article_type string"
FILELIST = "File string, AccessionID string, PMID string, license string"
ALIASES = "canonical_name string, variant string, variant_type string, country string, parent_funder string, variant_count string, merged_count string, selection_method string"
DISCOVERED = "name string, count bigint"
SUMMARY = "funder string, total_pubs bigint, data_sharing_pubs bigint, data_sharing_pct double"


def columns_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in schema.split(", ")]


def padded(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, typed; one that lacks is null. Numeric ids are written without an exponent."""
    kinds = dict(df.dtypes)
    out = []
    for name, kind in columns_of(schema):
        if name not in kinds:
            c = F.lit(None)
        elif kind == "string" and kinds[name] in ("double", "float"):
            # a float id prints as 12345678.0, not in scientific notation
            c = F.when(F.col(name) == F.floor(name), F.concat(F.col(name).cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.col(name).cast("string"))
        else:
            c = F.col(name)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)
