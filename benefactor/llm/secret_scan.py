"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every version of every path is addressed by the SHA-256 of its content. The ledger has a row for
each scan of a blob: the rules (kind and version) that were applied and what they found, each finding
with its rule's version. A run scans each blob once, for those rule versions that no ledger row has
for it, and joins findings back to all paths and versions of the blob. Only findings of the rule
versions that are asked for count: what an older version of a rule found stays in the ledger, unreported.

`secret_digest` (op4) brings a ledger up to date in two increments of the documents; the second scans only
blobs that the first has not met.

Positions come from built-in functions: matches are enclosed in control characters (first
taken out of the text, which no rule can match), the text is split there, and lengths of the
parts are summed up.

Edge cases: a null text is the empty blob; repeated rows each get the findings of their blob;
an empty table adds nothing; offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benefactor.llm.common import fold_of, pick, shared_folder


@dataclass(frozen=True)
class Rule:
    """pattern: Java syntax. With `value`, group 1 comes before the value and group `value` is the last part of the match."""

    kind: str
    version: int
    pattern: str
    hint: str  # a text without a match of this can't match the pattern
    value: int | None = None
    least: int = 0  # characters of the value

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Rules in the order in which kinds are listed. The first three are the base kinds.
RULES = (
    Rule("assign", 1, r"""((?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", r"(?i)password|passwd|secret|token|api_?key", 3, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", r"AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

_EDGE, _PART, _OTHER = "\u0001", "\u0002", "\u0003"
_FOUND = "array<struct<start:long,rank:int,kind:string,end:long,version:int>>"
LEDGER = f"blob binary, rules array<string>, found {_FOUND}"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of one rule, as structs (start, rank, kind, end, version)."""
    inner = f"$1{_PART}${rule.value}" if rule.value else "$0"
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{_EDGE}{inner}{_EDGE}"))

    def step(state: Column, part: Column) -> Column:
        size = F.char_length(part).cast("long")
        if rule.value:
            size = size - F.when(state["odd"], F.lit(1)).otherwise(F.lit(0))  # the mark before the value
            enough = F.char_length(F.substring_index(part, _PART, -1)) >= rule.least
        else:
            enough = F.lit(True)
        end = state["at"] + size
        span = F.struct(state["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.version).alias("version"))
        return F.struct(
            end.alias("at"),
            (~state["odd"]).alias("odd"),
            F.when(state["odd"] & enough, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("odd"), F.array().cast(_FOUND).alias("out"))
    found = F.aggregate(F.split(marked, _EDGE), begin, step)["out"]
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(_FOUND))


def with_blob(versions: DataFrame) -> DataFrame:
    """`versions` (key, text, ...) with `blob`, the SHA-256 of the content."""
    return versions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that this run adds: one for each blob with pending rules.

    versions: key, text and blob. The least key of a blob stands for it, so a text moves once.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    chosen = versions.groupBy("blob").agg(F.min("key").alias("rep_key"))
    if ledger is None:
        pending = chosen.withColumn("pending", names)
    else:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        pending = (
            chosen.join(done, "blob", "left")
            .withColumn("pending", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("pending") > 0)
            .drop("done")
        )
    pending = pending.withColumnRenamed("blob", "rep_blob")
    texts = versions.join(pending, F.col("key").eqNullSafe(F.col("rep_key")) & (F.col("blob") == F.col("rep_blob")))
    clean = texts.withColumn("text", F.translate("text", _EDGE + _PART, _OTHER * 2))
    found = F.flatten(
        F.array(*[F.when(F.array_contains("pending", r.name), _spans(F.col("text"), r, i)).otherwise(F.array().cast(_FOUND)) for i, r in enumerate(rules)])
    )
    rows = clean.select("blob", F.col("pending").alias("rules"), F.array_sort(found).alias("found"))
    return rows.dropDuplicates(["blob"])  # a repeated row of the least key was scanned twice


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def bring_up_to_date(rows: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Add to the ledger at `path` what the blobs of `rows` (key, text, blob) still lack."""
    scan_unseen(rows, read_ledger(rows.sparkSession, path), rules).write.mode("append").parquet(path)


def scan_incremental(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at `path` up to date for `versions` (key, text); findings by key."""
    rows = with_blob(versions)
    bring_up_to_date(rows, path, rules)
    return findings(rows.select("key", "blob"), read_ledger(versions.sparkSession, path), rules)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`paths` (key, blob, ...) and `found`, sorted by start and the place of the kind in `rules`.

    Findings of other rules or versions are left out; one that two runs have both written counts once.
    Blobs without a finding take no part in the join.
    """
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    current = F.filter("found", lambda s: s["version"] == versions[s["kind"]])
    ranked = F.transform(current, lambda s: s.withField("rank", ranks[s["kind"]]))
    held = ledger.select(F.col("blob").alias("hit"), ranked.alias("found")).where(F.size("found") > 0)
    merged = held.groupBy("hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    joined = paths.join(merged, F.col("blob") == F.col("hit"), "left")
    return joined.withColumn("found", F.coalesce("found", F.array().cast(_FOUND))).drop("hit")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of all documents as a digest, by way of a ledger that two increments fill.

    The ledger is a folder below the one that all executors share, new in each run.
    """
    rows = with_blob(pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "key"))
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    for later in (False, True):
        bring_up_to_date(rows.where((fold_of(F.col("key")) >= 2) == F.lit(later)), path, rules)
    found = findings(rows.select("key", "blob"), read_ledger(spark, path), rules)

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("key").alias("doc_id"),
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
