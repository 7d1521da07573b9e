"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

A source's target is its share of the total; the expected number of copies of each of its
documents is target / source size. Within a source the expected copies are summed up in order
of size; a random offset is added, and a document is emitted once for each integer that its
interval crosses. With equal expectations the sum is rank times expectation, so only ranks are
needed. They come from counts by (source, size, bucket), summed up level by level, and a
row_number inside one bucket: no window holds a source, or a group of equal sizes, as a whole.

Sorting by size bounds a source's error by its largest document: with one offset, what is taken
differs from the target by less than that document's size (tests hold it). On a table of few documents
a source that one document dominates is off by so much; at scale it is a vanishing share.

Targets are worked out on the table of sources, which is never collected: a source's place in the
order comes from ranges and their counts, and the common level that reshares the excess from a few sums.

Edge cases: a null source is a source, the last in order; a null or empty text has size 0 and
is given its copies like others (0 words); repeated rows are ranked separately; rows without an id come
after all others of their source and size, and those are alike; with no words
at all every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benefactor.llm.common import PLAIN_WORD, cut_lineage, fresh, pick


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in order, repeating
    share: float = 1.5  # of all sizes, to be taken
    most: float = 2.0  # times a source's own size
    buckets: int = 1024  # of rows of one source and size, and as many of those without an id
    seed: int = 7
    broadcast_sources: int = 100_000  # a table of more sources is joined by a shuffle


def _numbered(sources: DataFrame) -> DataFrame:
    """`sources` (source, ...) with `place`, from 0 in the order of code points, null last.

    Ranges of sources are counted, and the counts summed up: no task holds all sources.
    """
    order = (F.col("source").isNull(), F.col("source"))
    ranged = cut_lineage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(before.drop("n"), "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def targets(sources: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """`sources` (source, source_size) with target words: shares by weight, capped; the excess goes to the others by weight.

    All sources that are not full take `level` words for each unit of weight. A higher level fills more
    sources, whose excess raises it, until no further source is full.
    """
    weights = F.array(*[F.lit(w) for w in params.weights])
    plan = _numbered(sources).withColumn("weight", weights[F.pmod("place", F.lit(len(params.weights))).cast("int")].cast("double"))
    plan = cut_lineage(plan.withColumn("most", params.most * F.col("source_size")).drop("place"))
    level, full = 0.0, -1
    while True:
        is_full = F.col("weight") * level > F.col("most")
        row = plan.agg(
            F.sum("source_size").alias("size"),
            F.sum(F.when(is_full, F.col("most")).otherwise(0.0)).alias("given"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(is_full.cast("long")).alias("full"),
        ).first()
        if row["size"] is None or row["full"] == full or not row["open"]:
            break
        level, full = max(0.0, params.share * row["size"] - row["given"]) / row["open"], row["full"]
    return plan.withColumn("target", F.least("most", F.col("weight") * level)).select("source", "source_size", "target")


def _hash(text: Column, seed: int) -> Column:
    """28 bits of a digest that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), text).cast("binary")), 1, 7), 16, 10).cast("long")


def _copies(rank: Column, expected: Column, offset: Column) -> Column:
    return (F.floor(rank * expected + offset) - F.floor((rank - 1) * expected + offset)).cast("long")


def mix(sized: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """`sized` (key, source, size) with source_size, target and copies."""
    salt = _hash(F.col("key").cast("string"), params.seed) % params.buckets
    # rows without an id would share one bucket: they are alike, and dealt by their place in the table
    lone = F.lit(params.buckets) + F.pmod(F.monotonically_increasing_id(), F.lit(params.buckets))
    rows = cut_lineage(sized.withColumn("bucket", F.when(F.col("key").isNull(), lone).otherwise(salt).cast("int")))
    cells = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    levels = rows.groupBy("source", "size").agg(F.count("*").alias("n"))

    plan = cut_lineage(targets(levels.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), params))
    n_sources = plan.count()
    offset = _hash(F.coalesce("source", F.lit("\u0000")), params.seed) / F.lit(float(1 << 28))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(params.share))
    plan = plan.withColumn("expected", expected).withColumn("offset", offset)

    # rows of the source before this size, then before this bucket of the size
    by_size = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    in_size = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = levels.withColumn("before_size", F.coalesce(F.sum("n").over(by_size), zero)).drop("n")
    inside = cells.withColumn("before_bucket", F.coalesce(F.sum("n").over(in_size), zero)).drop("n")

    def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        """An inner join in which null equals null; what `b` adds is kept."""
        renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return a.join(renamed, on).drop(*[f"__{k}" for k in keys])

    offsets = same(inside, before, "source", "size")
    own = Window.partitionBy("source", "size", "bucket").orderBy("key")
    ranked = same(rows.withColumn("place", F.row_number().over(own)), offsets, "source", "size", "bucket").withColumn(
        "rank", F.col("before_size") + F.col("before_bucket") + F.col("place")
    )
    final = same(ranked, F.broadcast(plan) if n_sources <= params.broadcast_sources else plan, "source")
    return final.withColumn("copies", _copies(F.col("rank"), F.col("expected"), F.col("offset"))).select(
        "key", "source", "size", "source_size", "target", "copies"
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long"), F.lit(0).cast("long"))


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    sized = pick(docs, "doc_id", "text", "source").select(
        F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    )
    return mix(sized, params).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def take_copies(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix emits it.

    Rows that repeat a doc_id get their copies one by one: the rank inside a doc_id pairs them.
    """
    names = list(docs.columns)
    plain = docs.toDF(*[n if names.index(n) == i and n in ("doc_id", "text", "source") else f"__c{i}" for i, n in enumerate(names)])
    sized = pick(docs, "doc_id", "text", "source").select(
        F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    )
    same_id = Window.partitionBy("key", "source", "size").orderBy(F.desc("copies"))
    copies = mix(sized, params).withColumn("nth", F.row_number().over(same_id)).where("copies > 0")
    copies = copies.select(F.col("key").alias("__key"), F.col("source").alias("__source"), F.col("size").alias("__size"), "nth", "copies")
    own = Window.partitionBy("doc_id", F.col("source").cast("string"), "__words").orderBy("text")
    numbered = plain.withColumn("__words", word_count(F.col("text"))).withColumn("__nth", F.row_number().over(own))
    met = numbered.join(
        copies,
        F.col("doc_id").eqNullSafe(F.col("__key"))
        & F.col("source").cast("string").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
        & (F.col("__nth") == F.col("nth")),
    )
    each = met.withColumn(fresh(met, "__copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*plain.columns).toDF(*names)
