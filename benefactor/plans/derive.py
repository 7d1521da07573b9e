"""Source tables derived from the driver's documents and labels, in SQL that both engines read.

The corpus tables have no funding metadata, so articles, detections, a registry, filelists and
discovered names are made from ids and texts by fixed rules that reach the operators' edge
cases: odd id spellings, unusable years, null fields, funders in any case and next to accents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names written into funding texts, by number.
WRITTEN = (
    "NIH", "NCI", "National Cancer Institute", "NSF", "ERC", "European Union", "MRC", "UKRI", "Wellcome", "MOST", "FWF",
)

_VARIANTS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(WRITTEN)) + ") AS v(vi, variant)"
_N = len(WRITTEN)

TABLES: dict[str, str] = {
    "articles": f"""
SELECT CASE WHEN d.doc_id % 97 = 96 THEN NULL
            WHEN d.doc_id % 5 = 0 THEN 'PMC' || CAST(d.doc_id AS STRING)
            WHEN d.doc_id % 5 = 1 THEN CAST(d.doc_id AS STRING)
            WHEN d.doc_id % 5 = 2 THEN 'pmc' || CAST(d.doc_id AS STRING)
            WHEN d.doc_id % 5 = 3 THEN ' PMCPMC' || CAST(d.doc_id AS STRING) || ' '
            ELSE 'PMC' || CAST(d.doc_id AS STRING) || '.txt' END AS pmcid_pmc,
       CAST(d.doc_id AS STRING) AS pmid, d.source AS journal, d.lang AS affiliation_country,
       CASE WHEN d.doc_id % 11 = 3 THEN NULL
            WHEN d.doc_id % 13 = 5 THEN 'n/a'
            WHEN d.doc_id % 17 = 4 THEN CAST(2008 + d.doc_id % 19 AS STRING) || '.0'
            ELSE CAST(2008 + d.doc_id % 19 AS STRING) END AS year_epub,
       CASE WHEN d.doc_id % 23 = 7 THEN NULL ELSE CAST(2007 + (d.doc_id * 7) % 19 AS STRING) END AS year_ppub,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.text || ' Supported by the ' || v1.variant || '.' END AS fund_text,
       CASE WHEN d.doc_id % 4 = 1 THEN lower(v2.variant) ELSE NULL END AS fund_pmc_source,
       CASE WHEN d.doc_id % 6 = 2 THEN 'x' || v2.variant || 'é' ELSE NULL END AS fund_pmc_institute,
       CASE WHEN d.doc_id % 8 = 5 THEN 'the most common source' ELSE NULL END AS fund_pmc_anysource
FROM {{documents}} d
JOIN ({_VARIANTS}) v1 ON v1.vi = d.doc_id % {_N}
JOIN ({_VARIANTS}) v2 ON v2.vi = (d.doc_id * 3 + 1) % {_N}""",
    "detections": """
SELECT 'PMC' || CAST(doc_id AS STRING) AS pmcid, CAST(NULL AS STRING) AS article, CAST(NULL AS STRING) AS filename,
       quality = 1 AS is_open_data, toxic = 1 AS is_open_code
FROM {labels}""",
    "spellings": """
SELECT CASE WHEN doc_id % 3 = 0 THEN ' pmc' || CAST(doc_id AS STRING) || ' ' ELSE NULL END AS pmcid,
       CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'PMCPMC' || CAST(doc_id AS STRING) || '.txt'
            WHEN doc_id % 4 = 2 THEN 'pmc' || CAST(doc_id AS STRING) ELSE CAST(doc_id AS STRING) END AS article,
       CASE WHEN doc_id % 2 = 0 THEN 'PMC' || CAST(doc_id AS STRING) || '.txt' ELSE NULL END AS filename,
       quality = 1 AS is_open_data, toxic = 1 AS is_open_code
FROM {labels}""",
    "registry": """
SELECT 'PMC' || CAST(doc_id AS STRING) AS pmcid,
       CASE doc_id % 9 WHEN 0 THEN 'research-article' WHEN 1 THEN 'review-article' WHEN 2 THEN 'brief-report' WHEN 3 THEN NULL
            WHEN 4 THEN '' WHEN 5 THEN 'editorial' WHEN 6 THEN 'data-paper' WHEN 7 THEN 'Research-Article' ELSE 'other' END AS article_type
FROM {documents} WHERE doc_id % 29 <> 0""",
    "filelists": """
SELECT CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN ' PMC' || CAST(doc_id AS STRING)
            ELSE 'PMC' || CAST(doc_id AS STRING) END AS AccessionID,
       CASE WHEN doc_id % 6 = 1 THEN 'x' ELSE CAST(doc_id + 1000 AS STRING) END AS PMID,
       CASE WHEN doc_id % 2 = 0 THEN 'comm' ELSE 'noncomm' END AS license
FROM {documents}
UNION ALL
SELECT 'PMC' || CAST(doc_id AS STRING) || ' ' AS AccessionID, CAST(doc_id + 5000 AS STRING) AS PMID,
       CASE WHEN doc_id % 2 = 0 THEN 'noncomm' ELSE 'comm' END AS license
FROM {documents} WHERE doc_id % 10 = 0""",
    "discovered": """
SELECT name, count FROM (
  SELECT source AS name, count(*) * 40 AS count FROM {documents} GROUP BY source
  UNION ALL SELECT upper(lang) AS name, count(*) * 20 AS count FROM {documents} GROUP BY lang
  UNION ALL SELECT * FROM (VALUES ('NIH', 5000), ('national institutes of health', 7000), ('National Institutes of Health', 300), ('NCSF', 4000),
    ('National Science', 2500), ('UBRI', 2100), ('RSF', 1900), ('NSFC', 1800), ('Medical Research', 1500), ('EC', 1200), ('CSF', 1100), ('Royal', 900)) AS w(name, count)) u""",
}


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables as lazy DataFrames."""
    base = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels")}
    out = {}
    for name, text in TABLES.items():
        used = {n: df for n, df in base.items() if "{" + n + "}" in text}
        out[name] = spark.sql(text, **used)
    return out


def with_clause(*names: str) -> str:
    """The tables as common table expressions over the driver's views."""
    return ",\n".join(f"{n} AS ({TABLES[n].format(documents='documents', labels='labels')})" for n in names)
