"""Funder recognition in text, as one projection: no join, no UDF.

The text is folded once. Plain variants are byte searches in the folded text; acronyms, which
match as whole words only, are looked up among its words. Both go over the dictionary as literal
arrays, so the generated code stays small whatever the dictionary's size. Folding maps the few
non-ASCII letters that equal an ASCII letter without regard to case (long s, Kelvin sign, dotted
and dotless i), so a search in it is a Unicode case-insensitive search, the variants being ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefactor.operators.aliases import AliasDictionary, is_acronym

_BOUND = r"[\p{L}\p{N}_]"


def fold(text: Column) -> Column:
    return F.lower(F.translate(text, "ſKİı", "skii"))


def _has(folded: Column, variant: str) -> Column:
    if not variant.isascii():
        return folded.rlike("(?iu)" + re.escape(variant))
    low = variant.lower()
    found = folded.contains(low)
    if is_acronym(variant):
        found = found & folded.rlike(f"(?<!{_BOUND}){re.escape(low)}(?!{_BOUND})")
    return found


def mentions(folded: Column, dictionary: AliasDictionary, canonical: str) -> Column:
    """Whether the folded text names the funder in any variant; an unknown funder by its own name."""
    variants = dictionary.variants.get(canonical)
    if variants is None:
        return F.coalesce(folded.contains(canonical.lower()), F.lit(False))
    return F.coalesce(reduce(Column.__or__, [_has(folded, v) for v in variants]), F.lit(False))


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def found_variants(folded: Column, dictionary: AliasDictionary) -> Column:
    """All variants, in lower case, that the folded text has."""
    every = sorted({v for known in dictionary.variants.values() for v in known})
    words = sorted({v.lower() for v in every if is_acronym(v) and re.fullmatch(r"\w+", v)})
    plain = sorted({v.lower() for v in every if v.isascii() and not is_acronym(v)})
    found = F.filter(_literals(plain), lambda v: folded.contains(v))
    if words:
        found = F.concat(found, F.array_intersect(F.split(folded, f"[^{_BOUND[1:]}+"), _literals(words)))
    rest = [v for v in every if v.lower() not in words and v.lower() not in plain]
    if rest:  # acronyms of several words, variants beyond ASCII
        found = F.concat(found, F.array_compact(F.array(*[F.when(_has(folded, v), F.lit(v.lower())) for v in rest])))
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def with_funders(df: DataFrame, text: str, dictionary: AliasDictionary, name: str = "funder") -> DataFrame:
    """`df` with an array of all funders named in column `text`, in dictionary order."""
    known = F.array(*[F.struct(F.lit(c).alias("name"), _literals(sorted({v.lower() for v in vs})).alias("variants")) for c, vs in dictionary.variants.items()])

    def named(found: Column) -> Column:
        hits = F.transform(F.filter(known, lambda d: F.arrays_overlap(d["variants"], found)), lambda d: d["name"])
        return F.when(F.size(found) > 0, hits).otherwise(F.array().cast("array<string>"))

    folded = fold(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(name, _let(_let(folded, lambda f: found_variants(f, dictionary)), named))


def explode_funders(df: DataFrame, name: str = "funder") -> DataFrame:
    """A row for each funder of each article; articles without one vanish."""
    return df.withColumn(name, F.explode(name))
