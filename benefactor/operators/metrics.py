"""Counts per funder and year: the summary (strict policy) and the trends (lenient policy).

Funders are recognised right at the scan, and only ids, years and funder arrays go on: the
joins never shuffle funding texts, and articles that name no funder leave before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benefactor.functions import scalars as S
from benefactor.operators.aliases import AliasDictionary
from benefactor.operators.matching import explode_funders, with_funders
from benefactor.operators.rollup import roll_counts

SUMMARY_YEARS = (2010, 2024)
TREND_YEARS = (2000, 2025)


def articles_with_year(articles: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """pmcid (normalized), year and combined_funding of the articles with a usable year in range."""
    rows = articles.select(
        S.normalize_pmcid(F.col("pmcid_pmc")).alias("pmcid"),
        S.year_truncated(F.col("year_epub"), F.col("year_ppub")).alias("year"),
        S.analysis_funding(F.col("fund_text"), F.col("fund_pmc_institute"), F.col("fund_pmc_source"), F.col("fund_pmc_anysource")).alias("combined_funding"),
    ).where("year is not null")
    return rows.where(F.col("year").between(*years)) if years else rows


def funded_articles(articles: DataFrame, dictionary: AliasDictionary, years: tuple[int, int]) -> DataFrame:
    """pmcid, year, funder (array) of the articles that name a funder."""
    return with_funders(articles_with_year(articles, years), "combined_funding", dictionary).drop("combined_funding").where(F.size("funder") > 0)


# ---- ids with open data, article types -----------------------------------------------------


def open_data_ids(detections: DataFrame) -> DataFrame:
    """Distinct ids with open data, by the summary's rule (a null id may be among them)."""
    return detections.where("is_open_data").select(S.detection_pmcid(F.col("pmcid"), F.col("article")).alias("pmcid")).distinct()


def open_data_ids_multi(detections: DataFrame) -> DataFrame:
    """Distinct ids with open data from all three id columns, by the trends' rule."""
    ids = F.array("article", "pmcid", "filename")
    return detections.where("is_open_data").select(F.explode(ids).alias("raw")).where("raw is not null").select(S.normalize_pmcid(F.col("raw")).alias("pmcid")).distinct()


def registry_allowed(registry: DataFrame) -> DataFrame:
    return registry.where(S.allowed_strict(F.col("article_type"))).select("pmcid", "article_type")


def registry_types(registry: DataFrame) -> DataFrame:
    """One type for each id: of several the greatest (the source keeps an arbitrary one)."""
    return registry.where("article_type is not null").groupBy("pmcid").agg(F.max("article_type").alias("article_type"))


def lenient(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows (pmcid, ...) whose type the lenient policy allows; ids that are null or not registered pass."""
    return rows.join(registry_types(registry), "pmcid", "left").where(S.allowed_lenient(F.col("article_type"))).drop("article_type")


def flag_open(rows: DataFrame, open_ids: DataFrame, name: str = "has_open_data") -> DataFrame:
    ids = open_ids.select(F.col("pmcid").alias("__open"))
    return rows.join(ids, F.col("pmcid") == F.col("__open"), "left").withColumn(name, F.col("__open").isNotNull()).drop("__open")


# ---- summary -------------------------------------------------------------------------------


def funder_counts(articles: DataFrame, detections: DataFrame, registry: DataFrame, dictionary: AliasDictionary, years: tuple[int, int] = SUMMARY_YEARS) -> DataFrame:
    """funder, total_pubs, data_sharing_pubs for every canonical funder, 0 where it has none."""
    rows = funded_articles(articles, dictionary, years).join(registry_allowed(registry).select("pmcid"), "pmcid")
    flagged = flag_open(rows, open_data_ids(detections))
    counts = explode_funders(flagged).groupBy("funder").agg(F.count("*").alias("total_pubs"), F.count_if("has_open_data").alias("data_sharing_pubs"))
    zero = F.lit(0).cast("long")
    names = dictionary.frame(articles.sparkSession).select(F.col("canonical_name").alias("funder"))
    return names.join(counts, "funder", "left").select("funder", F.coalesce("total_pubs", zero).alias("total_pubs"), F.coalesce("data_sharing_pubs", zero).alias("data_sharing_pubs"))


def with_rates(counts: DataFrame) -> DataFrame:
    """data_sharing_pct with two digits."""
    rate = S.round_half_even(S.percentage(F.col("data_sharing_pubs"), F.col("total_pubs")))
    return counts.select("funder", "total_pubs", "data_sharing_pubs", rate.alias("data_sharing_pct"))


def funder_summary(
    articles: DataFrame,
    detections: DataFrame,
    registry: DataFrame,
    dictionary: AliasDictionary,
    years: tuple[int, int] = SUMMARY_YEARS,
    aggregate_children: bool = True,
    min_data_sharing: int | None = None,
) -> DataFrame:
    """The summary, most shared first; ties by name."""
    counts = funder_counts(articles, detections, registry, dictionary, years)
    if aggregate_children:
        counts = roll_counts(counts, dictionary, values=("total_pubs", "data_sharing_pubs"))
    rates = with_rates(counts)
    if min_data_sharing is not None:
        rates = rates.where(F.col("data_sharing_pubs") >= min_data_sharing)
    return rates.orderBy(F.desc("data_sharing_pubs"), "funder")


# ---- trends --------------------------------------------------------------------------------


def trend_cube(
    articles: DataFrame,
    detections: DataFrame,
    registry: DataFrame,
    dictionary: AliasDictionary,
    years: tuple[int, int] = TREND_YEARS,
    aggregate_children: bool = False,
) -> DataFrame:
    """funder, year, total, shared in one pass over the articles.

    An article with a null id counts in the totals, as its type is unknown, and is never shared.
    """
    rows = lenient(funded_articles(articles, dictionary, years), registry)
    flagged = flag_open(rows, lenient(open_data_ids_multi(detections), registry))
    cube = explode_funders(flagged).groupBy("funder", "year").agg(F.count("*").alias("total"), F.count_if("has_open_data").alias("shared"))
    return roll_trend(cube, dictionary) if aggregate_children else cube


def roll_trend(cube: DataFrame, dictionary: AliasDictionary) -> DataFrame:
    """Every canonical funder has a place in the trends, so all children go to their parents."""
    from benefactor.operators.rollup import parent_map

    up = F.coalesce(parent_map(dictionary)[F.col("funder")], F.col("funder")).alias("funder")
    return cube.groupBy(up, "year").agg(F.sum("total").alias("total"), F.sum("shared").alias("shared"))


def trend_counts(cube: DataFrame) -> DataFrame:
    return cube.where("shared > 0").select("funder", "year", F.col("shared").alias("n"))


def trend_totals(cube: DataFrame) -> DataFrame:
    return cube.select("funder", "year", F.col("total").alias("n"))


def trend_percentages(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """funder, year, pct for the years with a count; a missing total gives 0."""
    whole = totals.withColumnRenamed("n", "total")
    return counts.join(whole, ["funder", "year"], "left").select(
        "funder", "year", S.percentage(F.col("n"), F.coalesce("total", F.lit(0))).alias("pct")
    )


def cube_percentages(cube: DataFrame) -> DataFrame:
    """What trend_percentages gives for the counts and totals of one cube, which has both in a row."""
    return cube.where("shared > 0").select("funder", "year", S.percentage(F.col("shared"), F.col("total")).alias("pct"))


def remaining_funders(spark: SparkSession, dictionary: AliasDictionary, aggregate_children: bool) -> DataFrame:
    names = [c for c in dictionary.names() if not (aggregate_children and c in dictionary.parent)]
    return spark.createDataFrame([(c,) for c in names], "funder string")
