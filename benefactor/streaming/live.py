"""Funder counts over a stream of article files: the batch operators on a streaming source.

Recognition is a projection, so it runs unchanged on a stream; counts are kept per funder and
year, whose number is bounded by the dictionary, so the state does not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benefactor.operators.aliases import AliasDictionary
from benefactor.operators.matching import explode_funders
from benefactor.operators.metrics import TREND_YEARS, funded_articles
from benefactor.sources import schemas as T


def article_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(T.ARTICLES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def live_counts(articles: DataFrame, dictionary: AliasDictionary, years: tuple[int, int] = TREND_YEARS) -> DataFrame:
    """funder, year, count of all articles so far; to be written in update or complete mode."""
    return explode_funders(funded_articles(articles, dictionary, years)).groupBy("funder", "year").count()
