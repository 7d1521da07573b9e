"""One query for each operator, over tables derived from the driver's, with an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benefactor.functions import scalars as S
from benefactor.operators import dashboard, metrics, ranking, rollup, suggest
from benefactor.operators.aliases import AliasDictionary
from benefactor.operators.matching import explode_funders, fold, mentions, with_funders
from benefactor.plans.derive import derived
from benefactor.plans.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

CREATED_AT = "2025-01-01 00:00:00.000-04"
SHOWN_YEARS = range(2010, 2025)
MIN_SHARING = {"summary": 20, "suggest": 1000}


@cache
def shipped() -> AliasDictionary:
    return AliasDictionary.shipped()


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


def _cube(t: dict[str, DataFrame], children: bool = False) -> DataFrame:
    return metrics.trend_cube(t["articles"], t["detections"], t["registry"], shipped(), aggregate_children=children)


def _counts(t: dict[str, DataFrame]) -> DataFrame:
    return metrics.funder_counts(t["articles"], t["detections"], t["registry"], shipped())


def _ids(t: dict[str, DataFrame]) -> DataFrame:
    return dashboard.distinct_ids(dashboard.filelist_rows(t["filelists"]))


def _summary(t: dict[str, DataFrame], **more) -> DataFrame:
    return metrics.funder_summary(t["articles"], t["detections"], t["registry"], shipped(), **more)


def _dashboard(t: dict[str, DataFrame], children: bool = False) -> DataFrame:
    return dashboard.build(t["filelists"], t["articles"], t["detections"], shipped(), CREATED_AT, children)


def _funders(t: dict[str, DataFrame]) -> DataFrame:
    rows = metrics.articles_with_year(t["articles"])
    return with_funders(rows, "combined_funding", shipped())


def _names(spark: SparkSession) -> DataFrame:
    return metrics.remaining_funders(spark, shipped(), True)


def _wide_counts(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    return ranking.counts_wide(metrics.trend_counts(_cube(t, True)), _names(spark), SHOWN_YEARS, shipped())


def _wide_percentages(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    cube = _cube(t, True)
    rates = metrics.cube_percentages(cube)
    return ranking.percentages_wide(rates, _names(spark), SHOWN_YEARS, shipped())


def _rounded_years(df: DataFrame) -> DataFrame:
    return df.select(*[S.round_half_even(F.col(c), 6).alias(c) if c.isdigit() else F.col(c) for c in df.columns])


def _topk(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    counts = ranking.unpivot_years(_wide_counts(spark, t).drop("funder", "total"), "n")
    rates = ranking.unpivot_years(_wide_percentages(spark, t).drop("funder"), "pct")
    return ranking.topk_combined(counts, rates, 5)


def _rolled(t: dict[str, DataFrame]) -> DataFrame:
    return rollup.roll_counts(_counts(t), shipped(), values=("total_pubs", "data_sharing_pubs"))


def _dim(spark: SparkSession) -> DataFrame:
    return shipped().frame(spark)


def _discovered_counts(t: dict[str, DataFrame]) -> DataFrame:
    return t["discovered"].select("name", F.col("count").alias("n"))


def _on_tables(run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(spark, derived(spark, sf_dir))


_RAW = ("year_epub", "year_ppub")


def queries() -> dict[str, Query]:
    dictionary = shipped()
    made: dict[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]] = {
        # scans
        "scan_articles": lambda s, t: dashboard.scan_articles(t["articles"]),
        "scan_detections": lambda s, t: dashboard.scan_detections(t["detections"]),
        "filelist_union": lambda s, t: dashboard.filelist_rows(t["filelists"]),
        "filelist_distinct_on": lambda s, t: _ids(t),
        "filelist_limit": lambda s, t: dashboard.distinct_ids(dashboard.filelist_rows(t["filelists"]), 50),
        "license_distribution": lambda s, t: dashboard.license_distribution(_ids(t)),
        "registry_allowed": lambda s, t: metrics.registry_allowed(t["registry"]),
        "alias_dim": lambda s, t: _dim(s),
        # scalar functions
        "pmcid_normalize": lambda s, t: t["articles"].select("pmid", S.normalize_pmcid(F.col("pmcid_pmc")).alias("pmcid")),
        "pmcid_prefix": lambda s, t: t["articles"].select("pmid", S.prefix_pmcid(F.col("pmcid_pmc")).alias("pmcid")),
        "detection_pmcid": lambda s, t: t["spellings"].select("pmcid", "article", S.detection_pmcid(F.col("pmcid"), F.col("article")).alias("id")),
        "try_cast_year": lambda s, t: t["articles"].select("pmid", S.to_bigint(F.col("pmid")).alias("pmid_number"), S.year_rounded(*map(F.col, _RAW)).alias("year")),
        "year_coalesce": lambda s, t: t["articles"].select("pmid", S.year_truncated(*map(F.col, _RAW)).alias("year")),
        "combined_funding_dash": lambda s, t: t["articles"].select(
            "pmid", S.dashboard_funding(*[F.col(f"fund_{c}") for c in ("text", "pmc_source", "pmc_institute", "pmc_anysource")]).alias("combined_funding")
        ),
        "combined_funding": lambda s, t: t["articles"].select(
            "pmid", S.analysis_funding(*[F.col(f"fund_{c}") for c in ("text", "pmc_institute", "pmc_source", "pmc_anysource")]).alias("combined_funding")
        ),
        "data_tags": lambda s, t: _ids(t).select("pmcid", _joined(S.data_tags(F.col("license"))).alias("data_tags")),
        "display_name": lambda s, t: _dim(s).select("canonical_name", ranking.display_name(F.col("canonical_name"), dictionary).alias("display_name")),
        "color_scale": lambda s, t: ranking.color_scale(_summary(t), "data_sharing_pct").select("funder", "red", "green", "blue"),
        "color_scale_log": lambda s, t: ranking.color_scale(_summary(t), "total_pubs", log=True).select("funder", "red", "green", "blue"),
        # ids, policies, joins
        "open_data_ids": lambda s, t: metrics.open_data_ids(t["spellings"]),
        "open_data_ids_multi": lambda s, t: metrics.open_data_ids_multi(t["spellings"]),
        "registry_inner": lambda s, t: metrics.articles_with_year(t["articles"], metrics.SUMMARY_YEARS)
        .join(metrics.registry_allowed(t["registry"]), "pmcid")
        .select("pmcid", "year", "article_type"),
        "flag_open_data": lambda s, t: metrics.flag_open(metrics.articles_with_year(t["articles"]).select("pmcid", "year"), metrics.open_data_ids(t["detections"])),
        "open_data_semi": lambda s, t: metrics.articles_with_year(t["articles"])
        .select("pmcid", "year")
        .join(metrics.lenient(metrics.open_data_ids_multi(t["spellings"]), t["registry"]), "pmcid", "left_semi"),
        "article_type_lenient": lambda s, t: metrics.lenient(metrics.articles_with_year(t["articles"], metrics.TREND_YEARS).select("pmcid", "year"), t["registry"]),
        # recognition
        "funder_match": lambda s, t: _funders(t).select("pmcid", "year", _joined(F.col("funder")).alias("funder")),
        "funder_explode": lambda s, t: explode_funders(_funders(t).select("pmcid", "year", "funder")),
        "mentions_fallback": lambda s, t: metrics.articles_with_year(t["articles"])
        .withColumn("folded", fold(F.col("combined_funding")))
        .select(
            "pmcid",
            mentions(F.col("folded"), dictionary, "Common Source").alias("unknown"),
            mentions(F.col("folded"), dictionary, "Wellcome Trust").alias("wellcome"),
        ),
        # summary
        "funder_counts": lambda s, t: _counts(t),
        "funder_summary": lambda s, t: _summary(t),
        "funder_summary_children": lambda s, t: _summary(t, aggregate_children=False),
        "summary_threshold": lambda s, t: _summary(t, min_data_sharing=MIN_SHARING["summary"]),
        "table_sorted_limit": lambda s, t: ranking.top(_summary(t), "data_sharing_pct", 10, "funder", descending=False),
        "rollup_counts": lambda s, t: _rolled(t),
        "rollup_parents": lambda s, t: rollup.roll_generic(_counts(t).select("funder", F.col("total_pubs").alias("n")), dictionary),
        "rollup_with_children": lambda s, t: rollup.roll_generic(_counts(t).select("funder", F.col("total_pubs").alias("n")), dictionary, include_children=True),
        # trends
        "trend_counts": lambda s, t: metrics.trend_counts(_cube(t)),
        "trend_totals": lambda s, t: metrics.trend_totals(_cube(t)),
        "trend_percentages": lambda s, t: metrics.trend_percentages(metrics.trend_counts(_cube(t)), metrics.trend_totals(_cube(t))).withColumn(
            "pct", S.round_half_even(F.col("pct"), 6)
        ),
        "trend_counts_wide": lambda s, t: _wide_counts(s, t),
        "trend_percentages_wide": lambda s, t: _rounded_years(_wide_percentages(s, t)),
        "trend_top10": lambda s, t: _wide_counts(s, t).limit(10),
        "topk_combined": lambda s, t: _topk(s, t),
        "top20_console": lambda s, t: ranking.top(
            _names(s).join(metrics.trend_counts(_cube(t, True)).groupBy("funder").agg(F.sum("n").alias("n")), "funder", "left").select("funder", F.coalesce("n", F.lit(0).cast("long")).alias("total")),
            "total",
            20,
            "funder",
        ).select(ranking.display_name(F.col("funder"), dictionary).alias("display_name"), "total"),
        # dashboard
        "dashboard_merge": lambda s, t: dashboard.merge(_ids(t), t["articles"], t["detections"]),
        "dashboard_output": lambda s, t: _dashboard(t).select(*[_joined(F.col(c)).alias(c) if c in ("funder", "data_tags") else F.col(c) for c in dashboard.COLUMNS]),
        "rollup_lists": lambda s, t: _dashboard(t, True).select("pmid", "year", _joined(F.col("funder")).alias("funder")),
        "dashboard_stats": lambda s, t: _rounded_pct(dashboard.stats(_dashboard(t))),
        "load_stats": lambda s, t: dashboard.load_stats(_ids(t), t["articles"], t["detections"], dashboard.merge(_ids(t), t["articles"], t["detections"])),
        # dictionary
        "canonical_lookup": lambda s, t: suggest.with_canonical(t["discovered"], "name", dictionary),
        "variants_of": lambda s, t: dictionary.variant_frame(s),
        "children_of": lambda s, t: _dim(s).where("parent_funder is not null").select(F.col("parent_funder").alias("parent"), F.col("canonical_name").alias("child")),
        "funder_country": lambda s, t: _dim(s).groupBy("canonical_name").agg(F.min("country").alias("country")),
        "normalize_counts": lambda s, t: suggest.normalize_counts(_discovered_counts(t), dictionary),
        "normalize_counts_compat": lambda s, t: suggest.normalize_counts(_discovered_counts(t), dictionary, compat=True),
        "alias_suggest": lambda s, t: suggest.suggest_aliases(t["discovered"], dictionary, MIN_SHARING["suggest"]),
    }
    return {name: _on_tables(run) for name, run in made.items()}


def _rounded_pct(df: DataFrame) -> DataFrame:
    return df.select(*[S.round_half_even(F.col(c), 6).alias(c) if c.endswith("_pct") else F.col(c) for c in df.columns])


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
