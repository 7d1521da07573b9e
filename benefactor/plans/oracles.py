"""Independent SQL of the catalog's queries, for DuckDB over the driver's views."""

from __future__ import annotations

from benefactor.data.funders import FUNDERS
from benefactor.operators.aliases import is_acronym
from benefactor.operators.ranking import DISPLAY_NAMES
from benefactor.plans.derive import with_clause

TYPES = "('research-article', 'brief-report', 'data-paper', 'systematic-review', 'other')"
YEARS = range(2010, 2025)
_EDGE = r"[^\p{L}\p{N}_]"


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _q(x) for x in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS {name}_({columns}))"


def _regex(name: str, more: tuple[str, ...]) -> str:
    return "|".join(f"(?:^|{_EDGE}){v}(?:$|{_EDGE})" if is_acronym(v) else v for v in (*more, name))


_DIM = _values([(i, n, c, p, len({*m, n})) for i, (n, c, p, m) in enumerate(FUNDERS)], "position, canonical_name, country, parent_funder, n_variants", "dim")
_VARIANTS = _values([(n, v) for n, _, _, m in FUNDERS for v in dict.fromkeys((*m, n))], "canonical_name, variant", "variants")


def _matches(table: str, columns: str, text: str) -> str:
    """The rows of a table for each funder whose pattern, a constant, matches."""
    return " UNION ALL ".join(
        f"SELECT {columns}, {i} AS position, {_q(n)} AS canonical_name FROM {table} WHERE regexp_matches({text}, {_q(_regex(n, m))}, 'i')" for i, (n, _, _, m) in enumerate(FUNDERS)
    )


_SHOWN = _values(list(DISPLAY_NAMES.items()), "canonical_name, shown", "shown_names")


def _clean(x: str) -> str:
    u = rf"upper(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"
    a = f"regexp_replace({u}, '^PMCPMC', 'PMC')"
    b = rf"regexp_replace({a}, '\.TXT$', '')"
    return f"CASE WHEN {b} LIKE 'PMC%' THEN {b} ELSE 'PMC' || {b} END"


_YEAR = "CAST(trunc(coalesce(try_cast(year_epub AS DOUBLE), try_cast(year_ppub AS DOUBLE))) AS INT)"
_DASH_YEAR = "coalesce(CAST(round(try_cast(year_epub AS DOUBLE)) AS INT), CAST(round(try_cast(year_ppub AS DOUBLE)) AS INT))"
_TEXT = "' ' || coalesce(fund_text, '') || ' ' || coalesce(fund_pmc_institute, '') || ' ' || coalesce(fund_pmc_source, '') || ' ' || coalesce(fund_pmc_anysource, '')"
_DASH_TEXT = "coalesce(fund_text, '') || ' ' || coalesce(fund_pmc_source, '') || ' ' || coalesce(fund_pmc_institute, '') || ' ' || coalesce(fund_pmc_anysource, '')"
_PREFIX = "CASE WHEN pmcid_pmc LIKE 'PMC%' THEN pmcid_pmc WHEN pmcid_pmc IS NOT NULL THEN 'PMC' || pmcid_pmc END"
_DETECTED = """CASE WHEN pmcid IS NOT NULL THEN upper(trim(pmcid, ' ')) WHEN upper(article) LIKE 'PMCPMC%' THEN substr(upper(article), 4)
 WHEN upper(article) LIKE 'PMC%' THEN upper(article) WHEN article IS NOT NULL THEN 'PMC' || upper(article) END"""

#: Steps that several queries share, each with the steps it needs.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "arts": (("articles",), f"arts AS (SELECT * FROM (SELECT pmid, {_clean('pmcid_pmc')} AS pmcid, {_YEAR} AS year, {_TEXT} AS txt FROM articles) WHERE year IS NOT NULL)"),
    "hits": (("arts",), f"hits AS (SELECT pmid, pmcid, year, position, canonical_name AS funder FROM ({_matches('arts', 'pmid, pmcid, year', 'txt')}))"),
    "dim": ((), _DIM),
    "variants": ((), _VARIANTS),
    "shown_names": ((), _SHOWN),
    "allowed": (("registry",), f"allowed AS (SELECT pmcid, article_type FROM registry WHERE article_type IN {TYPES} OR article_type IS NULL)"),
    "typed": (("registry",), "typed AS (SELECT pmcid, max(article_type) AS article_type FROM registry WHERE article_type IS NOT NULL GROUP BY pmcid)"),
    "open_ids": (("detections",), f"open_ids AS (SELECT DISTINCT {_DETECTED} AS pmcid FROM detections WHERE is_open_data)"),
    "counts": (
        ("hits", "allowed", "open_ids", "dim"),
        """found AS (SELECT h.funder, count(*) AS total, count(o.pmcid) AS shared FROM hits h JOIN allowed a ON h.pmcid = a.pmcid
 LEFT JOIN open_ids o ON h.pmcid = o.pmcid WHERE h.year BETWEEN 2010 AND 2024 GROUP BY h.funder),
counts AS (SELECT d.canonical_name AS funder, d.parent_funder, coalesce(f.total, 0) AS total_pubs, coalesce(f.shared, 0) AS data_sharing_pubs
 FROM dim d LEFT JOIN found f ON d.canonical_name = f.funder)""",
    ),
    "rolled": (
        ("counts",),
        "rolled AS (SELECT coalesce(parent_funder, funder) AS funder, sum(total_pubs)::bigint AS total_pubs, sum(data_sharing_pubs)::bigint AS data_sharing_pubs FROM counts GROUP BY 1)",
    ),
    "summary": (
        ("rolled",),
        "summary AS (SELECT funder, total_pubs, data_sharing_pubs, CASE WHEN total_pubs > 0 THEN round_even(data_sharing_pubs / total_pubs * 100 * 100, 0) / 100 ELSE 0.0 END AS data_sharing_pct FROM rolled)",
    ),
    "open_multi": (
        ("detections", "typed"),
        f"""open_multi AS (SELECT DISTINCT i.pmcid FROM (SELECT {_clean('raw')} AS pmcid FROM (SELECT unnest([article, pmcid, filename]) AS raw FROM detections WHERE is_open_data) WHERE raw IS NOT NULL) i
 LEFT JOIN typed t ON i.pmcid = t.pmcid WHERE lower(coalesce(t.article_type, '')) IN {TYPES} OR coalesce(t.article_type, '') = '')""",
    ),
    "cube": (
        ("hits", "typed", "open_multi"),
        f"""cube_ AS (SELECT h.funder, h.year, count(*) AS total, count(o.pmcid) AS shared FROM hits h LEFT JOIN typed t ON h.pmcid = t.pmcid
 LEFT JOIN open_multi o ON h.pmcid = o.pmcid WHERE h.year BETWEEN 2000 AND 2025 AND (lower(coalesce(t.article_type, '')) IN {TYPES} OR coalesce(t.article_type, '') = '')
 GROUP BY h.funder, h.year)""",
    ),
    "rolled_cube": (
        ("cube", "dim"),
        "rolled_cube AS (SELECT coalesce(d.parent_funder, c.funder) AS funder, c.year, sum(c.total)::bigint AS total, sum(c.shared)::bigint AS shared FROM cube_ c JOIN dim d ON c.funder = d.canonical_name GROUP BY 1, 2)",
    ),
    "labelled": (
        ("dim", "shown_names"),
        "labelled AS (SELECT d.canonical_name AS funder, d.parent_funder, coalesce(s.shown, d.canonical_name || ' (' || d.country || ')', d.canonical_name) AS display_name FROM dim d LEFT JOIN shown_names s ON d.canonical_name = s.canonical_name)",
    ),
    "wide_counts": (
        ("rolled_cube", "labelled"),
        "wide_counts AS (SELECT l.funder, l.display_name, "
        + ", ".join(f'coalesce(sum(c.shared) FILTER (WHERE c.year = {y}), 0)::bigint AS "{y}"' for y in YEARS)
        + f", coalesce(sum(c.shared) FILTER (WHERE c.year BETWEEN {YEARS[0]} AND {YEARS[-1]}), 0)::bigint AS total FROM labelled l LEFT JOIN rolled_cube c ON l.funder = c.funder WHERE l.parent_funder IS NULL GROUP BY l.funder, l.display_name)",
    ),
    "wide_rates": (
        ("rolled_cube", "labelled"),
        "wide_rates AS (SELECT l.funder, l.display_name, "
        + ", ".join(f'round_even(coalesce(max(c.shared / c.total * 100) FILTER (WHERE c.year = {y}), 0.0) * 1000000, 0) / 1000000 AS "{y}"' for y in YEARS)
        + " FROM labelled l LEFT JOIN rolled_cube c ON l.funder = c.funder WHERE l.parent_funder IS NULL GROUP BY l.funder, l.display_name)",
    ),
    "listed": (("filelists",), "listed AS (SELECT trim(AccessionID, ' ') AS pmcid, TRY_CAST(PMID AS BIGINT) AS pmid_filelist, license FROM filelists WHERE AccessionID LIKE 'PMC%')"),
    "ids": (
        ("listed",),
        "ids AS (SELECT pmcid, pmid_filelist, license FROM (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY license, pmid_filelist NULLS LAST) AS nth FROM listed) WHERE nth = 1)",
    ),
    "merged": (
        ("ids", "articles", "detections"),
        f"""meta AS (SELECT *, {_PREFIX} AS pmcid FROM articles WHERE pmcid_pmc IS NOT NULL),
merged AS (SELECT coalesce(TRY_CAST(m.pmid AS BIGINT), i.pmid_filelist) AS pmid, i.pmcid, i.license, m.journal, m.affiliation_country, {_DASH_YEAR} AS year,
 coalesce(o.is_open_data, false) AS is_open_data, coalesce(o.is_open_code, false) AS is_open_code, o.pmcid IS NOT NULL AS has_detection, {_DASH_TEXT} AS combined_funding
 FROM ids i LEFT JOIN meta m ON i.pmcid = m.pmcid LEFT JOIN (SELECT * FROM detections WHERE pmcid IS NOT NULL) o ON i.pmcid = o.pmcid)""",
    ),
    "board": (
        ("merged", "dim"),
        f"""texts AS (SELECT DISTINCT combined_funding FROM merged),
spots AS ({_matches('texts', 'combined_funding', 'combined_funding')}),
named AS (SELECT combined_funding, string_agg(canonical_name, '|' ORDER BY position) AS funder FROM spots GROUP BY 1),
lifted AS (SELECT combined_funding, string_agg(f, '|' ORDER BY f COLLATE "C") AS funder FROM (SELECT DISTINCT s.combined_funding, coalesce(d.parent_funder, d.canonical_name) AS f
 FROM spots s JOIN dim d ON s.canonical_name = d.canonical_name) GROUP BY 1),
board AS (SELECT m.*, coalesce(n.funder, '') AS funder, coalesce(l.funder, '') AS lifted FROM merged m LEFT JOIN named n ON m.combined_funding = n.combined_funding LEFT JOIN lifted l ON m.combined_funding = l.combined_funding)""",
    ),
    "looked": (
        ("discovered", "variants"),
        "keys AS (SELECT lower(variant) AS k, canonical_name FROM variants),\nlooked AS (SELECT d.name, d.count, coalesce(k.canonical_name, d.name) AS canonical_name FROM discovered d LEFT JOIN keys k ON lower(d.name) = k.k)",
    ),
}


def _with(*steps: str) -> str:
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done:
            return
        if name in STEPS:
            before, text = STEPS[name]
            for b in before:
                need(b)
            done[name] = text
        else:
            done[name] = with_clause(name)

    for s in steps:
        need(s)
    return "WITH " + ",\n".join(done.values()) + "\n"


def _sql(steps: str, text: str) -> str:
    return _with(*steps.split()) + text


def _swap(sql: str, name: str) -> str:
    """The same steps over the table of odd spellings."""
    return sql.replace("detections AS (" + with_clause("detections")[len("detections AS (") :], "detections AS (" + with_clause("spellings")[len("spellings AS (") :])


def _color(column: str, log: bool) -> str:
    v = f"log10(greatest({column}, 1))" if log else column
    return _sql(
        "summary",
        f"""SELECT funder, trunc((CASE WHEN p < 0.5 THEN 0.7 + 0.3 * (p * 2) ELSE 1 END) * 255)::int AS red,
 trunc((CASE WHEN p < 0.5 THEN 0.7 + 0.3 * (p * 2) ELSE 1.0::double - 0.4::double * ((p - 0.5) * 2) END) * 255)::int AS green,
 trunc((CASE WHEN p < 0.5 THEN 1 ELSE 1.0::double - 0.6::double * ((p - 0.5) * 2) END) * 255)::int AS blue
 FROM (SELECT funder, CASE WHEN max(v) OVER () = min(v) OVER () THEN 0.5::double ELSE (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) END AS p
 FROM (SELECT funder, {v}::double AS v FROM summary))""",
    )


_LENIENT = f"(lower(coalesce(t.article_type, '')) IN {TYPES} OR coalesce(t.article_type, '') = '')"
_RECENT = " + ".join(f'"{y}"' for y in range(2022, 2025))

ORACLES: dict[str, str] = {
    "scan_articles": _sql("articles", f"SELECT pmid, {_PREFIX} AS pmcid, journal, affiliation_country, year_epub, year_ppub, fund_text, fund_pmc_source, fund_pmc_institute, fund_pmc_anysource FROM articles WHERE pmcid_pmc IS NOT NULL"),
    "scan_detections": _sql("detections", "SELECT pmcid, is_open_data, is_open_code FROM detections WHERE pmcid IS NOT NULL"),
    "filelist_union": _sql("listed", "SELECT * FROM listed"),
    "filelist_distinct_on": _sql("ids", "SELECT * FROM ids"),
    "filelist_limit": _sql("ids", "SELECT * FROM ids ORDER BY pmcid LIMIT 50"),
    "license_distribution": _sql("ids", "SELECT license, count(*) AS cnt FROM ids GROUP BY license"),
    "registry_allowed": _sql("allowed", "SELECT * FROM allowed"),
    "alias_dim": _sql("dim", "SELECT * FROM dim"),
    "pmcid_normalize": _sql("articles", f"SELECT pmid, {_clean('pmcid_pmc')} AS pmcid FROM articles"),
    "pmcid_prefix": _sql("articles", f"SELECT pmid, {_PREFIX} AS pmcid FROM articles"),
    "detection_pmcid": _swap(_sql("detections", f"SELECT pmcid, article, {_DETECTED} AS id FROM detections"), "spellings"),
    "try_cast_year": _sql("articles", f"SELECT pmid, TRY_CAST(pmid AS BIGINT) AS pmid_number, {_DASH_YEAR} AS year FROM articles"),
    "year_coalesce": _sql("articles", f"SELECT pmid, {_YEAR} AS year FROM articles"),
    "combined_funding_dash": _sql("articles", f"SELECT pmid, {_DASH_TEXT} AS combined_funding FROM articles"),
    "combined_funding": _sql("articles", f"SELECT pmid, {_TEXT} AS combined_funding FROM articles"),
    "data_tags": _sql("ids", "SELECT pmcid, 'pmc_oa|' || coalesce(license, 'unknown') AS data_tags FROM ids"),
    "display_name": _sql("labelled", "SELECT funder AS canonical_name, display_name FROM labelled"),
    "color_scale": _color("data_sharing_pct", False),
    "color_scale_log": _color("total_pubs", True),
    "open_data_ids": _swap(_sql("open_ids", "SELECT pmcid FROM open_ids"), "spellings"),
    "open_data_ids_multi": _swap(
        _sql("detections", f"SELECT DISTINCT {_clean('raw')} AS pmcid FROM (SELECT unnest([article, pmcid, filename]) AS raw FROM detections WHERE is_open_data) WHERE raw IS NOT NULL"), "spellings"
    ),
    "registry_inner": _sql("arts allowed", "SELECT a.pmcid, a.year, r.article_type FROM arts a JOIN allowed r ON a.pmcid = r.pmcid WHERE a.year BETWEEN 2010 AND 2024"),
    "flag_open_data": _sql("arts open_ids", "SELECT a.pmcid, a.year, o.pmcid IS NOT NULL AS has_open_data FROM arts a LEFT JOIN open_ids o ON a.pmcid = o.pmcid"),
    "open_data_semi": _swap(_sql("arts open_multi", "SELECT pmcid, year FROM arts WHERE pmcid IN (SELECT pmcid FROM open_multi)"), "spellings"),
    "article_type_lenient": _sql("arts typed", f"SELECT a.pmcid, a.year FROM arts a LEFT JOIN typed t ON a.pmcid = t.pmcid WHERE a.year BETWEEN 2000 AND 2025 AND {_LENIENT}"),
    "funder_match": _sql("hits", "SELECT a.pmcid, a.year, coalesce(h.funder, '') AS funder FROM arts a LEFT JOIN (SELECT pmid, string_agg(funder, '|' ORDER BY position) AS funder FROM hits GROUP BY pmid) h ON a.pmid = h.pmid"),
    "funder_explode": _sql("hits", "SELECT pmcid, year, funder FROM hits"),
    "mentions_fallback": _sql("arts", "SELECT pmcid, contains(lower(txt), 'common source') AS unknown, regexp_matches(txt, 'wellcome', 'i') AS wellcome FROM arts"),
    "funder_counts": _sql("counts", "SELECT funder, total_pubs, data_sharing_pubs FROM counts"),
    "funder_summary": _sql("summary", "SELECT * FROM summary"),
    "funder_summary_children": _sql(
        "counts", "SELECT funder, total_pubs, data_sharing_pubs, CASE WHEN total_pubs > 0 THEN round_even(data_sharing_pubs / total_pubs * 100 * 100, 0) / 100 ELSE 0.0 END AS data_sharing_pct FROM counts"
    ),
    "summary_threshold": _sql("summary", "SELECT * FROM summary WHERE data_sharing_pubs >= 20"),
    "table_sorted_limit": _sql("summary", "SELECT * FROM summary ORDER BY data_sharing_pct, funder LIMIT 10"),
    "rollup_counts": _sql("rolled", "SELECT * FROM rolled"),
    "rollup_parents": _sql("rolled", "SELECT funder, total_pubs AS n FROM rolled"),
    "rollup_with_children": _sql("counts rolled", "SELECT funder, total_pubs AS n FROM rolled UNION ALL SELECT funder, total_pubs FROM counts WHERE parent_funder IS NOT NULL"),
    "trend_counts": _sql("cube", "SELECT funder, year, shared AS n FROM cube_ WHERE shared > 0"),
    "trend_totals": _sql("cube", "SELECT funder, year, total AS n FROM cube_"),
    "trend_percentages": _sql("cube", "SELECT funder, year, round_even(shared / total * 100 * 1000000, 0) / 1000000 AS pct FROM cube_ WHERE shared > 0"),
    "trend_counts_wide": _sql("wide_counts", "SELECT * FROM wide_counts"),
    "trend_percentages_wide": _sql("wide_rates", "SELECT * FROM wide_rates"),
    "trend_top10": _sql("wide_counts", "SELECT * FROM wide_counts ORDER BY total DESC, funder LIMIT 10"),
    "topk_combined": _sql(
        "wide_counts wide_rates",
        f"""SELECT (row_number() OVER (ORDER BY place, display_name) - 1)::int AS position, display_name FROM (
 SELECT display_name, min(place) AS place FROM (
  SELECT display_name, row_number() OVER (ORDER BY total DESC, display_name) AS place FROM wide_counts QUALIFY place <= 5
  UNION ALL
  SELECT display_name, 5 + row_number() OVER (ORDER BY {_RECENT} DESC, display_name) AS place FROM wide_rates QUALIFY place <= 10) GROUP BY display_name)""",
    ),
    "top20_console": _sql(
        "rolled_cube labelled",
        """SELECT l.display_name, coalesce(sum(c.shared), 0)::bigint AS total FROM labelled l LEFT JOIN rolled_cube c ON l.funder = c.funder
 WHERE l.parent_funder IS NULL GROUP BY l.funder, l.display_name ORDER BY total DESC, l.funder LIMIT 20""",
    ),
    "dashboard_merge": _sql("merged", "SELECT * FROM merged"),
    "dashboard_output": _sql("board", "SELECT pmid, journal, affiliation_country, is_open_data, is_open_code, year, funder, 'pmc_oa|' || coalesce(license, 'unknown') AS data_tags, '2025-01-01 00:00:00.000-04' AS created_at FROM board"),
    "rollup_lists": _sql("board", "SELECT pmid, year, lifted AS funder FROM board"),
    "dashboard_stats": _sql(
        "board",
        "SELECT count(*) AS n_rows, "
        + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}, round_even(avg(({c})::int::double) * 100 * 1000000, 0) / 1000000 AS {n}_pct" for c, n in (("is_open_data", "open_data"), ("is_open_code", "open_code"), ("funder <> ''", "with_funder")))
        + " FROM board",
    ),
    "load_stats": _sql(
        "merged",
        "SELECT (SELECT count(*) FROM ids) AS ids, (SELECT count(*) FROM meta) AS articles, (SELECT count(*) FROM detections WHERE pmcid IS NOT NULL) AS detections, "
        "count(*) AS merged, count(journal) AS articles_matched, count(*) FILTER (WHERE has_detection) AS detections_matched FROM merged",
    ),
    "canonical_lookup": _sql("looked", "SELECT * FROM looked"),
    "variants_of": _sql("variants", "SELECT * FROM variants"),
    "children_of": _sql("dim", "SELECT parent_funder AS parent, canonical_name AS child FROM dim WHERE parent_funder IS NOT NULL"),
    "funder_country": _sql("dim", "SELECT canonical_name, country FROM dim"),
    "normalize_counts": _sql("looked", "SELECT canonical_name AS funder, sum(count)::bigint AS n FROM looked GROUP BY 1"),
    "normalize_counts_compat": _sql(
        "looked",
        "SELECT canonical_name AS funder, coalesce(max(count) FILTER (WHERE canonical_name = name), sum(count) FILTER (WHERE canonical_name <> name))::bigint AS n FROM looked GROUP BY 1",
    ),
    "alias_suggest": _sql(
        "looked dim",
        r"""SELECT l.name AS discovered_name, l.count, CASE len(h) WHEN 0 THEN 'NEW_FUNDER' WHEN 1 THEN h[1] ELSE '[''' || array_to_string(h, ''', ''') || ''']' END AS potential_canonical, len(h)::int AS num_matches
 FROM (SELECT l.name, l.count, coalesce((SELECT list(x.canonical_name ORDER BY x.position, x.kind) FROM (
   SELECT d.canonical_name, d.position, 1 AS kind FROM dim d WHERE length(l.name) <= 6 AND upper(l.name) = l.name AND lower(l.name) <> l.name
     AND l.name = array_to_string(list_transform(list_filter(string_split(d.canonical_name, ' '), lambda w: w[1] BETWEEN 'A' AND 'Z'), lambda w: w[1]), '')
   UNION ALL SELECT d.canonical_name, d.position, 2 FROM dim d WHERE contains(lower(d.canonical_name), lower(l.name)) OR contains(lower(l.name), lower(d.canonical_name))) x), []) AS h
  FROM looked l WHERE l.canonical_name = l.name AND l.count >= 1000) l""",
    ),
}
