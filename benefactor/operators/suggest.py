"""Dictionary upkeep: lookups by name, merged counts, suggested aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefactor.operators.aliases import AliasDictionary


def with_canonical(df: DataFrame, name: str, dictionary: AliasDictionary) -> DataFrame:
    """`df` with canonical_name: the funder of a variant in any case, else the name itself."""
    lookup = dictionary.lookup_frame(df.sparkSession)  # the dictionary's size
    return df.join(F.broadcast(lookup), F.lower(F.col(name)) == F.col("variant_key"), "left").withColumn("canonical_name", F.coalesce("canonical_name", F.col(name))).drop("variant_key")


def normalize_counts(counts: DataFrame, dictionary: AliasDictionary, compat: bool = False) -> DataFrame:
    """name, n of discovered names to funder, n.

    By default counts of a canonical name and of its variants are summed; with `compat`, the
    count under a name that is its own canonical replaces the sum of its variants.
    """
    named = with_canonical(counts, "name", dictionary)
    if not compat:
        return named.groupBy(F.col("canonical_name").alias("funder")).agg(F.sum("n").alias("n"))
    own = F.col("canonical_name") == F.col("name")
    sums = named.groupBy(F.col("canonical_name").alias("funder")).agg(F.max(F.when(own, F.col("n"))).alias("kept"), F.sum(F.when(~own, F.col("n"))).alias("merged"))
    return sums.select("funder", F.coalesce("kept", "merged").alias("n"))


def acronym(name: str) -> str:
    return "".join(w[0] for w in name.split() if w[0].isupper())


def suggest_aliases(discovered: DataFrame, dictionary: AliasDictionary, min_count: int = 1000) -> DataFrame:
    """discovered_name, count, potential_canonical, num_matches of frequent unknown names.

    Every canonical is looked at inside one expression over the dictionary as a literal array;
    a name that is both the acronym and a part of a canonical matches it twice. An empty input
    gives an empty table.
    """
    unknown = with_canonical(discovered.where(F.col("count") >= min_count), "name", dictionary).where(F.col("canonical_name") == F.col("name"))
    known = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(acronym(c)).alias("acronym"), F.lit(c.lower()).alias("low")) for c in dictionary.names()])
    name, low = F.col("name"), F.lower("name")
    shouted = (F.char_length(name) <= 6) & (F.upper(name) == name) & (low != name)
    hits = F.flatten(
        F.transform(
            known,
            lambda k: F.array_compact(F.array(F.when(shouted & (k["acronym"] == name), k["name"]), F.when(k["low"].contains(low) | low.contains(k["low"]), k["name"]))),
        )
    )
    found = unknown.withColumn("__hits", hits)
    n = F.size("__hits")
    listed = F.concat(F.lit("['"), F.array_join("__hits", "', '"), F.lit("']"))
    best = F.when(n == 0, "NEW_FUNDER").when(n == 1, F.try_element_at("__hits", F.lit(1))).otherwise(listed)
    return found.select(F.col("name").alias("discovered_name"), "count", best.alias("potential_canonical"), n.alias("num_matches")).orderBy(F.desc("count"), "discovered_name")
