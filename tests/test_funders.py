import re

import pytest
from pyspark.sql import functions as F

from benefactor.operators import ranking, rollup, suggest
from benefactor.operators.aliases import AliasDictionary
from benefactor.operators.matching import explode_funders, fold, mentions, with_funders

D = AliasDictionary.shipped()


def test_dictionary_shape():
    assert len(D.names()) == 57 and sum(map(len, D.variants.values())) == 138 and len(D.parent) == 10
    assert D.canonical("nih") == "National Institutes of Health" and D.canonical("nobody") == "nobody"
    assert D.variants_of("nobody") == {"nobody"} and len(D.children_of("National Institutes of Health")) == 5


def test_chained_parents_are_refused():
    with pytest.raises(ValueError):
        AliasDictionary.from_rows([("a", "a", None, "b"), ("b", "b", None, "c")])


def test_alias_table_with_and_without_optional_columns(spark):
    df = spark.createDataFrame([("X Fund", "XF")], "canonical_name string, variant string")
    made = AliasDictionary.from_frame(df)
    assert made.variants == {"X Fund": ["XF", "X Fund"]} and not made.country


PROBES = {
    "éNIH grant": False,
    "NIHé": False,
    "cafe_NIH": False,
    "NIH.": True,
    "xNIH": False,
    "NİH": True,
    "NIH́": True,
    "nih": True,
    "": False,
}


@pytest.mark.parametrize("text,hit", PROBES.items())
def test_word_boundaries(spark, text, hit):
    row = with_funders(spark.createDataFrame([(text,)], "t string"), "t", D).first()
    assert ("National Institutes of Health" in row["funder"]) == hit


def test_matching_agrees_with_regular_expressions(spark):
    import random

    random.seed(3)
    words = [v for vs in D.variants.values() for v in vs] + ["the most common", "é", "ſNSF", "nRf", "KNRF", "DÖE DOE", "grant", "of", "(", "-", "wellcome", "FUNDAÇÃO NSF"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 6))) for _ in range(150)] + [None]
    rows = with_funders(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", D).collect()

    def pattern(c):
        return "|".join(rf"\b{re.escape(v)}\b" if len(v) <= 6 and v.isupper() else re.escape(v) for v in D.variants[c])

    compiled = {c: re.compile(pattern(c), re.IGNORECASE) for c in D.names()}
    for r in rows:
        assert r["funder"] == [c for c in D.names() if r["t"] and compiled[c].search(r["t"])], r["t"]


def test_unknown_funder_by_own_name(spark):
    df = spark.createDataFrame([("the Foo FUND paid",), (None,)], "t string")
    got = df.select(mentions(fold(F.col("t")), D, "foo fund").alias("m")).collect()
    assert [r["m"] for r in got] == [True, False]


def test_explode_drops_articles_without_funder(spark):
    df = with_funders(spark.createDataFrame([(1, "NIH and NSF"), (2, "nothing")], "i int, t string"), "t", D)
    assert sorted(r["i"] for r in explode_funders(df).collect()) == [1, 1]


NIH, NCI, NIAID = "National Institutes of Health", "National Cancer Institute", "National Institute of Allergy and Infectious Diseases"
EC, ERC = "European Commission", "European Research Council"


def test_rollups(spark):
    counts = spark.createDataFrame([(NCI, 100), (NIAID, 50), (NIH, 200), (ERC, 75), (EC, 30)], "funder string, n long")

    def as_dict(df):
        return {r["funder"]: r["n"] for r in df.collect()}

    assert as_dict(rollup.roll_counts(counts, D)) == {NIH: 350, EC: 105}
    assert as_dict(rollup.roll_generic(counts, D)) == {NIH: 350, EC: 105}
    assert as_dict(rollup.roll_generic(counts, D, include_children=True)) == {NCI: 100, NIAID: 50, NIH: 350, ERC: 75, EC: 105}
    orphan = counts.where(F.col("funder") == ERC)
    assert as_dict(rollup.roll_counts(orphan, D)) == {ERC: 75} and as_dict(rollup.roll_generic(orphan, D)) == {EC: 75}


def test_list_rollup(spark):
    df = spark.createDataFrame([([NIH, NCI],), ([ERC],), ([],)], "f array<string>")
    got = [r[0] for r in df.select(rollup.roll_lists(F.col("f"), D)).collect()]
    assert got == [[NIH], [EC], []]


def test_normalize_counts(spark):
    df = spark.createDataFrame([("NIH", 100), (NIH, 50), ("unknown", 3)], "name string, n long")

    def as_dict(df):
        return {r["funder"]: r["n"] for r in df.collect()}

    assert as_dict(suggest.normalize_counts(df, D)) == {NIH: 150, "unknown": 3}
    assert as_dict(suggest.normalize_counts(df, D, compat=True)) == {NIH: 50, "unknown": 3}


def test_suggestions(spark):
    df = spark.createDataFrame([("NSF", 5000), ("NCSF", 4000), ("Wellcome Trust UK", 3000), ("rare", 10)], "name string, count long")
    got = {r["discovered_name"]: (r["potential_canonical"], r["num_matches"]) for r in suggest.suggest_aliases(df, D).collect()}
    assert got == {"NCSF": ("NEW_FUNDER", 0), "Wellcome Trust UK": ("Wellcome Trust", 1)}
    assert suggest.suggest_aliases(df.limit(0), D).count() == 0


def test_color_scale_published_cells(spark):
    rows = [("HHMI", 10189, 24.57), ("NSFC", 420824, 9.1), ("NIH", 426267, 13.42), ("low", 3000, 3.0)]
    df = spark.createDataFrame(rows, "funder string, total_pubs long, data_sharing_pct double")
    got = {r["funder"]: (r["red"], r["green"], r["blue"]) for r in ranking.color_scale(df, "data_sharing_pct").collect()}
    assert got["HHMI"] == (255, 153, 102) and got["low"] == (178, 178, 255)
    same = ranking.color_scale(df.where("funder = 'NIH'"), "total_pubs", log=True).first()
    assert same["position"] == 0.5


def test_topk_combined(spark):
    counts = spark.createDataFrame([(n, 2024, v) for n, v in (("a", 9), ("b", 8), ("c", 1))], "display_name string, year int, n long")
    rates = spark.createDataFrame([("a", 2024, 1.0), ("b", 2021, 99.0), ("b", 2024, 0.0), ("c", 2024, 5.0)], "display_name string, year int, pct double")
    got = [r["display_name"] for r in ranking.topk_combined(counts, rates, 2).orderBy("position").collect()]
    assert got == ["a", "b", "c"]
