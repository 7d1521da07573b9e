"""The corpus queries: each applies one operator to its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benefactor.llm import fingerprints, langid, license_scan, line_dedup, mixing, ngram_join, ogg, packing, secret_scan, toxicity
from benefactor.llm.common import table

#: Four words and 85 of 100, as the query's contract says.
JOIN = ngram_join.JoinParams(width=4, numerator=85)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def docs(run):
        return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))

    return {
        "op1_language_id": docs(langid.language_id),
        "op2_line_dedup": docs(line_dedup.dedup_lines),
        "op3_ngram_jaccard_join": docs(lambda d: ngram_join.similarity_components(d, JOIN)),
        "op4_secret_scan": docs(secret_scan.secret_digest),
        "op5_license_scan": docs(license_scan.license_digest),
        "op6_toxicity": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op7_ogg_media": docs(ogg.media_digest),
        "op8_best_fit_packing": docs(packing.pack),
        "op9_source_mixing": docs(mixing.mix_documents),
        "op10_minhash_fingerprints": docs(fingerprints.with_next),
    }
