import pytest
from pyspark.sql import functions as F

from benefactor.functions import scalars as S


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_pmcid_spellings(spark):
    raw = [None, " pmc12 ", "PMCPMC12", "PMC12.txt", "12", "", "\tPMC1\n", " PMC1"]
    got = one(spark, "x string", [(r,) for r in raw], S.normalize_pmcid(F.col("x")))
    assert [g[0] for g in got] == [None, "PMC12", "PMC12", "PMC12", "PMC12", "PMC", "PMC1", "PMC1"]


def test_prefix_keeps_case_and_space(spark):
    got = one(spark, "x string", [(None,), ("PMC1",), ("1",), ("pmc1",), (" PMC1",)], S.prefix_pmcid(F.col("x")))
    assert [g[0] for g in got] == [None, "PMC1", "PMC1", "PMCpmc1", "PMC PMC1"]


def test_detection_prefers_pmcid(spark):
    rows = [(" pmc1 ", "9"), (None, "pmcpmc2.txt"), (None, "pmc3"), (None, "4"), (None, None)]
    got = one(spark, "p string, a string", rows, S.detection_pmcid(F.col("p"), F.col("a")))
    assert [g[0] for g in got] == ["PMC1", "PMC2.TXT", "PMC3", "PMC4", None]


def test_years(spark):
    rows = [("2015", None), ("n/a", "2014"), ("2015.7", None), (None, None), ("5d", "2001"), ("NaN", "2002"), ("0x1p3", "2003"), ("1_0", None), (" 5\t", None), ("+5", None), ("1e400", "7")]
    got = one(spark, "e string, p string", rows, S.year_truncated(F.col("e"), F.col("p")), S.year_rounded(F.col("e"), F.col("p")))
    assert [g[0] for g in got] == [2015, 2014, 2015, None, 2001, 2002, 2003, None, 5, 5, None]
    assert got[2][1] == 2016 and got[1][1] == 2014


def test_round_half_even(spark):
    got = one(spark, "x double", [(0.125,), (2.675,), (1.005,), (13.425,)], S.round_half_even(F.col("x")))
    assert [g[0] for g in got] == [0.12, 2.68, 1.0, 13.42]


@pytest.mark.parametrize(
    "kind,strict,lenient",
    [("research-article", True, True), ("Research-Article", False, True), ("", False, True), (None, True, True), ("editorial", False, False)],
)
def test_article_policies(spark, kind, strict, lenient):
    got = one(spark, "t string", [(kind,)], F.coalesce(S.allowed_strict(F.col("t")), F.lit(False)), S.allowed_lenient(F.col("t")))
    assert got == [(strict, lenient)]


def test_published_rates(spark):
    rows = [(57220, 426267, 13.42), (38274, 420824, 9.1), (2503, 10189, 24.57), (4328, 20060, 21.58), (1990, 10188, 19.53), (2865, 47528, 6.03), (1, 0, 0.0)]
    got = one(spark, "a long, b long, pct double", rows, S.round_half_even(S.percentage(F.col("a"), F.col("b"))), "pct")
    assert all(a == b for a, b in got)


def test_funding_forms_differ(spark):
    c = [F.col(x) for x in "tsia"]
    rows = [("T", "S", None, "A")]
    got = one(spark, "t string, s string, i string, a string", rows, S.dashboard_funding(*c), S.analysis_funding(c[0], c[2], c[1], c[3]))
    assert got == [("T S  A", " T  S A")]
