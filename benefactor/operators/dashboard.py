"""The article-level dashboard: filelists joined with metadata and detections, funders, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benefactor.functions import scalars as S
from benefactor.operators.aliases import AliasDictionary
from benefactor.operators.matching import with_funders
from benefactor.operators.rollup import roll_lists

#: Columns of the dashboard in order.
COLUMNS = {
    "pmid": "bigint",
    "journal": "string",
    "affiliation_country": "string",
    "is_open_data": "boolean",
    "is_open_code": "boolean",
    "year": "int",
    "funder": "array<string>",
    "data_tags": "array<string>",
    "created_at": "string",
}


def filelist_rows(filelists: DataFrame) -> DataFrame:
    """pmcid, pmid_filelist, license of all listed articles; the prefix is looked for before trimming."""
    listed = filelists.where(F.col("AccessionID").isNotNull() & F.col("AccessionID").startswith("PMC"))
    return listed.select(F.trim("AccessionID").alias("pmcid"), S.to_bigint(F.col("PMID")).alias("pmid_filelist"), "license")


def distinct_ids(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each pmcid: the first by license, then by pmid (nulls last); the first `limit` ids if given."""
    own = Window.partitionBy("pmcid").orderBy("license", F.asc_nulls_last("pmid_filelist"))
    kept = rows.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").drop("__nth")
    return kept.orderBy("pmcid").limit(limit) if limit is not None else kept


def scan_articles(articles: DataFrame) -> DataFrame:
    return articles.where("pmcid_pmc is not null").select(
        "pmid", S.prefix_pmcid(F.col("pmcid_pmc")).alias("pmcid"), "journal", "affiliation_country", "year_epub", "year_ppub",
        "fund_text", "fund_pmc_source", "fund_pmc_institute", "fund_pmc_anysource",
    )


def scan_detections(detections: DataFrame) -> DataFrame:
    return detections.where("pmcid is not null").select("pmcid", "is_open_data", "is_open_code")


def merge(ids: DataFrame, articles: DataFrame, detections: DataFrame, dictionary: AliasDictionary | None = None) -> DataFrame:
    """The ids with what is known of them; several articles or detections of an id fan out.

    With a dictionary, funders are recognised on the side of the articles, before the join, and
    the funding text does not go through it (`combined_funding` is left out then).
    """
    own = scan_articles(articles)
    text = S.dashboard_funding(F.col("fund_text"), F.col("fund_pmc_source"), F.col("fund_pmc_institute"), F.col("fund_pmc_anysource"))
    own = own.select(
        "pmcid", S.to_bigint(F.col("pmid")).alias("__pmid"), "journal", "affiliation_country",
        S.year_rounded(F.col("year_epub"), F.col("year_ppub")).alias("year"), text.alias("combined_funding"),
    )
    extra = F.coalesce("combined_funding", F.lit(" " * 3)).alias("combined_funding")
    if dictionary is not None:
        own = with_funders(own, "combined_funding", dictionary).drop("combined_funding")
        extra = F.coalesce("funder", F.array().cast("array<string>")).alias("funder")
    met = ids.join(own, "pmcid", "left").join(scan_detections(detections).withColumn("__seen", F.lit(True)), "pmcid", "left")
    return met.select(
        F.coalesce("__pmid", "pmid_filelist").alias("pmid"), "pmcid", "license", "journal", "affiliation_country", "year",
        S.flag(F.col("is_open_data")).alias("is_open_data"), S.flag(F.col("is_open_code")).alias("is_open_code"),
        F.coalesce("__seen", F.lit(False)).alias("has_detection"), extra,
    )


def finish(merged: DataFrame, created_at: str, dictionary: AliasDictionary, aggregate_children: bool = False) -> DataFrame:
    """The dashboard's columns in order; a column that lacks is null."""
    rows = merged.withColumn("data_tags", S.data_tags(F.col("license"))).withColumn("created_at", F.lit(created_at))
    if aggregate_children:
        rows = rows.withColumn("funder", roll_lists(F.col("funder"), dictionary))
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def build(filelists: DataFrame, articles: DataFrame, detections: DataFrame, dictionary: AliasDictionary, created_at: str, aggregate_children: bool = False, limit: int | None = None) -> DataFrame:
    """Filelists, articles and detections to the dashboard, as one lazy plan."""
    ids = distinct_ids(filelist_rows(filelists), limit)
    return finish(merge(ids, articles, detections, dictionary), created_at, dictionary, aggregate_children)


def license_distribution(ids: DataFrame) -> DataFrame:
    return ids.groupBy("license").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "license")


def load_stats(ids: DataFrame, articles: DataFrame, detections: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: rows loaded and matched; detections matched are counted as such, not after the default."""
    counts = [
        ids.agg(F.count("*").alias("ids")),
        scan_articles(articles).agg(F.count("*").alias("articles")),
        scan_detections(detections).agg(F.count("*").alias("detections")),
        merged.agg(F.count("*").alias("merged"), F.count_if(F.col("journal").isNotNull()).alias("articles_matched"), F.count_if("has_detection").alias("detections_matched")),
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.join(one)  # rows of aggregates: one each
    return out


def stats(dashboard: DataFrame) -> DataFrame:
    """Rows, and numbers and rates of open data, open code and articles with a funder."""
    funded = F.size("funder") > 0

    def rate(c: Column) -> Column:
        return F.avg(c.cast("double")) * 100

    return dashboard.agg(
        F.count("*").alias("n_rows"),
        F.count_if("is_open_data").alias("open_data"), rate(F.col("is_open_data")).alias("open_data_pct"),
        F.count_if("is_open_code").alias("open_code"), rate(F.col("is_open_code")).alias("open_code_pct"),
        F.count_if(funded).alias("with_funder"), rate(funded).alias("with_funder_pct"),
    )
