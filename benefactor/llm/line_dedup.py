"""Cross-site boilerplate removal by the spread of a line over distinct sites.

A HyperLogLog sketch of the sites is built for each line hash and merged by aggregation. Lines
whose estimate is clearly at or over the threshold are boilerplate; those within the sketch's
error of it get an exact distinct count. Boilerplate lines are taken out of all documents.

The threshold is a share of the table's distinct sites, within fixed bounds: on a table of a
few sites a line on several of them is boilerplate, on a web crawl one on `most_sites`.

`dedup_lines` (op2) exempts no document. `clean_lines` (the pipeline's stage) leaves a text of which more
than `most_removed` of the words would go whole, for near-duplicate removal, if it is proven a copy:
another such document has its text or links with it in the n-gram join. All others lose their lines.

Lines are cut at line feeds and compared without spaces, tabs and carriage returns around them; lines of
fewer than `min_words` words are never boilerplate. Two 64-bit hashes stand for a line, and two for a
text, whose lines are looked up once for all rows that hold it.

Edge cases: a null text stays null; an empty text has one empty line; a null site counts as a
site of its own; rows without a doc_id or with a repeated one are cleaned by their texts; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefactor.llm.common import PLAIN_WORD, cut_lineage, pick, text_hash, tidy
from benefactor.llm.ngram_join import JoinParams, similarity_components


@dataclass(frozen=True)
class LineParams:
    share: float = 0.2  # of the distinct sites: a line on so many is boilerplate
    least_sites: int = 3
    most_sites: int = 10
    min_words: int = 3
    most_removed: float = 0.5  # of a document's words, before `clean_lines` asks whether it is a copy
    lg_k: int = 10  # size of the sketches
    errors: float = 4.0  # standard errors around the threshold that count as near


def _line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(" \t\r"))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLAIN_WORD))


def _hash(text: Column) -> Column:
    a, b = text_hash(text)
    return F.struct(a.alias("a"), b.alias("b"))


def _site(site: Column) -> Column:
    return F.coalesce(site.cast("string"), F.lit("\u0000"))


def threshold(docs: DataFrame, params: LineParams = LineParams()) -> int:
    """The number of distinct sites that makes a line boilerplate; docs: site."""
    sites = docs.agg(F.countDistinct(_site(F.col("site")))).first()[0]
    return min(params.most_sites, max(params.least_sites, math.ceil(params.share * sites)))


def boilerplate(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """hash (of a text), and in `lines` the hashes of its boilerplate lines; texts without one are left out.

    docs: text, site. What is kept between the passes are occurrences of widespread lines.
    """
    least = threshold(docs, params)
    seen = (
        docs.where(F.col("text").isNotNull())
        .select(_hash(F.col("text")).alias("hash"), _site(F.col("site")).alias("site"), F.explode(F.split("text", "\n")).alias("raw"))
        .withColumn("line", _line(F.col("raw")))
        .where(_words(F.col("line")) >= params.min_words)
        .select("hash", "site", _hash(F.col("line")).alias("line"))
    )
    spread = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(params.lg_k))).alias("sites"))
    error = params.errors * 1.04 / 2 ** (params.lg_k / 2)
    # checkpointed, so that the join's both sides are plain exchanges and a hot line can be split
    wide = cut_lineage(
        spread.where(F.col("sites") >= least * (1 - error)).select(F.col("line").alias("wide"), (F.col("sites") < least * (1 + error)).alias("near"))
    )
    met = cut_lineage(seen.join(wide, F.col("line") == F.col("wide")).select("hash", "site", "line", "near"))
    # (line, site) pairs are few however many documents hold the line: each task sends a pair once
    exact = met.where("near").groupBy("line").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= least).select(F.col("line").alias("sure"))
    tidy(docs.sparkSession)
    near = met.where("near").select("hash", "line").join(cut_lineage(exact), F.col("line") == F.col("sure"), "left_semi")
    return met.where("not near").select("hash", "line").union(near).groupBy("hash").agg(F.collect_set("line").alias("lines"))


def with_copies(docs: DataFrame, lines: DataFrame, params: LineParams, join: JoinParams) -> DataFrame:
    """`lines` and `copy`, whether the text would lose too much and is a proven copy.

    Only texts that would lose too much are compared, with one another: a partner outside of them is
    cleaned itself, and near-duplicate removal finds the cleaned pair.
    """
    over = _cleaned(docs.select("text"), lines, params).where("__much").select("text", _hash(F.col("text")).alias("hash"))
    texts = over.groupBy("hash").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("several"))
    texts = cut_lineage(texts.withColumn("doc_id", F.monotonically_increasing_id()))
    found = similarity_components(texts.select("doc_id", "text"), join).select("doc_id", "component_id")
    groups = found.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select("component_id")
    linked = found.join(groups, "component_id", "left_semi").select(F.col("doc_id").alias("linked"))
    proven = texts.join(linked, F.col("doc_id") == F.col("linked"), "left").where("several or linked is not null")
    copies = proven.select(F.col("hash").alias("own"))
    return cut_lineage(lines.join(copies, F.col("hash") == F.col("own"), "left").select("hash", "lines", F.col("own").isNotNull().alias("copy")))


def _cleaned(docs: DataFrame, lines: DataFrame, params: LineParams) -> DataFrame:
    """`docs` with __clean, __removed (lines) and __much (whether more than `most_removed` would go).

    Where `lines` has `copy`, texts that it marks are left whole.
    """
    own = lines.select(F.col("hash").alias("__hash"), F.col("lines").alias("__lines"), *([F.col("copy").alias("__copy")] if "copy" in lines.columns else []))
    met = docs.join(own, _hash(F.col("text")) == F.col("__hash"), "left")
    all_lines = F.split("text", "\n")

    def gone(raw: Column) -> Column:
        line = _line(raw)
        return (_words(line) >= params.min_words) & F.array_contains(F.col("__lines"), _hash(line))

    change = F.col("__lines").isNotNull() & F.col("text").isNotNull()
    if "copy" in lines.columns:
        change = change & ~F.col("__copy")
    met = met.withColumn("__left", F.when(change, F.filter(all_lines, lambda raw: ~gone(raw)))).withColumn("__text", F.array_join("__left", "\n"))
    words = _words(F.col("text"))
    much = (words - F.coalesce(_words(F.col("__text")), F.lit(0))) > words * F.lit(params.most_removed)
    return (
        met.withColumn("__much", change & much)
        .withColumn("__clean", F.when(change, F.col("__text")).otherwise(F.col("text")))
        .withColumn("__removed", F.when(change, F.size(all_lines) - F.size("__left")).otherwise(F.lit(0)).cast("long"))
        .drop("__hash", "__lines", "__copy", "__left", "__text")
    )


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """doc_id, text (cleaned), n_lines and n_removed of every document."""
    rows = pick(docs, "doc_id", "text", "source")
    lines = boilerplate(rows.select("text", F.col("source").alias("site")), params)
    clean = _cleaned(rows.select("doc_id", "text"), lines, params)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return clean.select("doc_id", F.col("__clean").alias("text"), n_lines.cast("long").alias("n_lines"), F.col("__removed").alias("n_removed"))


def clean_lines(docs: DataFrame, params: LineParams = LineParams(), join: JoinParams = JoinParams()) -> DataFrame:
    """All rows and columns of `docs`, the texts cleaned and n_chars, if there, counted anew.

    join: what near-duplicate removal links by; a text is left whole only as a copy by it.
    """
    names = list(docs.columns)
    held = ("doc_id", "text", "source", "n_chars")
    plain = docs.toDF(*[n if names.index(n) == i and n in held else f"__c{i}" for i, n in enumerate(names)])
    rows = pick(docs, "text", "source").withColumnRenamed("source", "site")
    lines = cut_lineage(boilerplate(rows, params))
    clean = _cleaned(plain, with_copies(rows, lines, params, join), params)
    out = []
    for c in plain.columns:
        if c == "text":
            out.append(F.col("__clean").alias(c))
        elif c == "n_chars":
            counted = F.char_length("__clean").cast(plain.schema[c].dataType)
            out.append(F.when(F.col("__removed") > 0, counted).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return clean.select(*out).toDF(*names)
