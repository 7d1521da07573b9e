"""Display names, wide tables, top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefactor.operators.aliases import AliasDictionary

#: Display names of well-known funders.
DISPLAY_NAMES = {
    "National Institutes of Health": "NIH (USA)",
    "National Natural Science Foundation of China": "NSFC (China)",
    "National Science Foundation": "NSF (USA)",
    "European Commission": "EC (Europe)",
    "Howard Hughes Medical Institute": "HHMI (USA)",
    "Biotechnology and Biological Sciences Research Council": "BBSRC (UK)",
    "European Research Council": "ERC (Europe)",
    "Wellcome Trust": "Wellcome (UK)",
    "Deutsche Forschungsgemeinschaft": "DFG (Germany)",
    "Agence Nationale de la Recherche": "ANR (France)",
    "Medical Research Council": "MRC (UK)",
    "Japan Society for the Promotion of Science": "JSPS (Japan)",
    "National Research Foundation of Korea": "NRF (Korea)",
    "Swiss National Science Foundation": "SNSF (Switzerland)",
    "Austrian Science Fund": "FWF (Austria)",
}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


def display_name(funder: Column, dictionary: AliasDictionary) -> Column:
    """A fixed short name, else `name (country)`, else the name."""
    country = _literal_map({k: v for k, v in dictionary.country.items() if v and v != "Unknown"})[funder]
    return F.coalesce(_literal_map(DISPLAY_NAMES)[funder], F.concat(funder, F.lit(" ("), country, F.lit(")")), funder)


def widen(long: DataFrame, names: DataFrame, value: str, years: range, dictionary: AliasDictionary) -> DataFrame:
    """One row a funder in `names`, one column a year (0 where it has none); labelled last."""
    wide = long.groupBy("funder").pivot("year", list(years)).agg(F.first(value))
    columns = [str(y) for y in years]
    zero = F.lit(0).cast(long.schema[value].dataType)
    full = names.join(wide, "funder", "left")
    return full.select("funder", display_name(F.col("funder"), dictionary).alias("display_name"), *[F.coalesce(F.col(c), zero).alias(c) for c in columns])


def counts_wide(counts: DataFrame, names: DataFrame, years: range, dictionary: AliasDictionary) -> DataFrame:
    """With the total of the years shown, largest first."""
    wide = widen(counts, names, "n", years, dictionary)
    total = sum((F.col(str(y)) for y in years), F.lit(0).cast("long"))
    return wide.withColumn("total", total).orderBy(F.desc("total"), "funder")


def percentages_wide(percentages: DataFrame, names: DataFrame, years: range, dictionary: AliasDictionary) -> DataFrame:
    """By the rate of the last year, highest first."""
    return widen(percentages, names, "pct", years, dictionary).orderBy(F.desc(str(years[-1])), "funder")


def unpivot_years(wide: DataFrame, value: str) -> DataFrame:
    """display_name, year, value from a table with year columns."""
    years = [c for c in wide.columns if c.isdigit()]
    return wide.unpivot(["display_name"], years, "year", value).withColumn("year", F.col("year").cast("int"))


def topk_combined(counts: DataFrame, percentages: DataFrame, n_each: int = 5, recent: int = 2022) -> DataFrame:
    """position, display_name: the first `n_each` by total, then those by mean recent rate that are new.

    counts: display_name, year, n; percentages: display_name, year, pct; both with a row for each
    year shown, zeros included. Without a recent year, the mean is over all years.
    """
    by_total = counts.groupBy("display_name").agg(F.sum("n").alias("score")).orderBy(F.desc("score"), "display_name").limit(n_each)
    late = F.when(F.col("year") >= recent, F.col("pct"))
    by_rate = (
        percentages.groupBy("display_name").agg(F.coalesce(F.avg(late), F.avg("pct")).alias("score")).orderBy(F.desc("score"), "display_name").limit(n_each)
    )

    def numbered(ranked: DataFrame, first: int) -> DataFrame:
        """A row number over at most `n_each` rows."""
        rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "display_name")))
        return ranked.agg(rows.alias("rows")).select(F.posexplode("rows").alias("at", "row")).select((F.col("at") + first).alias("place"), "row.display_name")

    both = numbered(by_total, 0).union(numbered(by_rate, n_each)).groupBy("display_name").agg(F.min("place").alias("place"))
    rows = F.array_sort(F.collect_list(F.struct("place", "display_name")))
    return both.agg(rows.alias("rows")).select(F.posexplode("rows").alias("position", "row")).select("position", "row.display_name")


def top(df: DataFrame, by: str, n: int, *ties: str, descending: bool = True) -> DataFrame:
    """Sort by a column, then by `ties`, and keep the first n: no full sort of a large input."""
    return df.orderBy(F.desc(by) if descending else F.asc(by), *ties).limit(n)


def color_scale(df: DataFrame, value: str, log: bool = False) -> DataFrame:
    """`df` with `position` (0 to 1) of a value on the blue, white, red scale, and red, green, blue.

    The extremes come from one aggregate; equal extremes give the middle. Parts are cut, not rounded.
    """
    shown = F.col(value).cast("double")
    if log:
        shown = F.log10(F.when(shown <= 0, 1.0).otherwise(shown))
    marked = df.withColumn("__v", shown)
    low_high = df.agg(F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high"))
    if log:
        low_high = low_high.select(*[F.log10(F.greatest(F.col(c), F.lit(1.0))).alias(c) for c in ("__low", "__high")])
    met = marked.join(F.broadcast(low_high))  # one row
    place = F.when(F.col("__high") == F.col("__low"), 0.5).otherwise((F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low")))
    met = met.withColumn("position", place)
    cold, warm = F.col("position") * 2, (F.col("position") - 0.5) * 2
    is_cold = F.col("position") < 0.5

    def part(when_cold: Column, when_warm: Column) -> Column:
        return (F.when(is_cold, when_cold).otherwise(when_warm) * 255).cast("int")

    one = F.lit(1.0)
    return (
        met.withColumn("red", part(0.7 + 0.3 * cold, one)).withColumn("green", part(0.7 + 0.3 * cold, 1.0 - 0.4 * warm)).withColumn("blue", part(one, 1.0 - 0.6 * warm))
    ).drop("__v", "__low", "__high")
