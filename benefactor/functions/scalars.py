"""Column functions: identifiers, years, funding text, article policies, rates.

All are built-in expressions, so they stay inside generated code and add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Article types that count as research.
ALLOWED_TYPES = ("research-article", "brief-report", "data-paper", "systematic-review", "other")

_NUMBER = r"(?U)\A\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*\z"


def strip_all(text: Column) -> Column:
    """Without white space of any kind at either end (plain `trim` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_pmcid(raw: Column) -> Column:
    """Strip, upper case, one PMC prefix, no .TXT suffix; null stays null. The order of steps matters.

    A chain of replacements, each naming its input once: nested conditions would be copied at
    every level into the generated code.
    """
    text = F.upper(strip_all(raw.cast("string")))
    text = F.regexp_replace(text, r"\APMCPMC", "PMC")
    text = F.regexp_replace(text, r"\.TXT\z", "")
    return F.regexp_replace(text, r"\A(?!PMC)", "PMC")


def prefix_pmcid(raw: Column) -> Column:
    """The PMC prefix where it lacks, and nothing else: the case and white space stay."""
    return F.when(raw.startswith("PMC"), raw).when(raw.isNotNull(), F.concat(F.lit("PMC"), raw))


def detection_pmcid(pmcid: Column, article: Column) -> Column:
    """The id of a detection: `pmcid` trimmed, else `article` in one of three spellings."""
    upper = F.upper(article)
    from_article = (
        F.when(upper.startswith("PMCPMC"), F.substring(upper, 4, 1 << 30)).when(upper.startswith("PMC"), upper).otherwise(F.concat(F.lit("PMC"), upper))
    )
    return F.when(pmcid.isNotNull(), F.upper(F.trim(pmcid))).when(article.isNotNull(), from_article)


def to_number(raw: Column) -> Column:
    """Double, or null for anything but a plain decimal number (no suffixes, hex or NaN)."""
    return F.regexp_extract(raw.cast("string"), _NUMBER, 1).try_cast("double")


def to_bigint(raw: Column) -> Column:
    """Whole numbers only; null otherwise."""
    return raw.cast("string").try_cast("bigint")


def year_truncated(epub: Column, ppub: Column) -> Column:
    """The first usable year, cut to an integer: the rule of the summary and the trends. Beyond integers: null."""
    return F.coalesce(to_number(epub), to_number(ppub)).try_cast("int")


def year_rounded(epub: Column, ppub: Column) -> Column:
    """Each year rounded, then the first: the rule of the dashboard."""
    return F.coalesce(*[F.round(to_number(raw)).try_cast("int") for raw in (epub, ppub)])


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def dashboard_funding(text: Column, source: Column, institute: Column, anysource: Column) -> Column:
    return F.concat(_or_empty(text), F.lit(" "), _or_empty(source), F.lit(" "), _or_empty(institute), F.lit(" "), _or_empty(anysource))


def analysis_funding(text: Column, institute: Column, source: Column, anysource: Column) -> Column:
    """Another order of fields, and a leading space: a name can match across two fields, so both matter."""
    return F.concat(*[x for c in (text, institute, source, anysource) for x in (F.lit(" "), _or_empty(c))])


def allowed_strict(article_type: Column) -> Column:
    """The summary's policy: an allowed type as spelled, or null."""
    return article_type.isNull() | article_type.isin(*ALLOWED_TYPES)


def allowed_lenient(article_type: Column) -> Column:
    """The trends' policy: an allowed type in any case, empty, null or not registered."""
    return F.lower(_or_empty(article_type)).isin(*ALLOWED_TYPES, "")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def percentage(part: Column, whole: Column) -> Column:
    """part / whole * 100; 0 where the whole is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Scaled, then to the nearest integer, ties to even (`round` would take ties up)."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def data_tags(license_type: Column) -> Column:
    return F.array(F.lit("pmc_oa"), F.coalesce(license_type, F.lit("unknown")))
