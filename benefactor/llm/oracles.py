"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from benefactor.llm.line_dedup import LineParams
from benefactor.llm.mixing import MixParams
from benefactor.llm.ngram_join import JoinParams
from benefactor.llm.queries import JOIN
from benefactor.llm.secret_scan import BASE_KINDS, RULES

_WORD = r"[^\x20\x09-\x0D]+"


def _lines(params: LineParams = LineParams()) -> str:
    """Exact distinct counts instead of sketches."""
    site = "coalesce(source, chr(0))"
    return rf"""
with lines as (
  select doc_id, text, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
marked as (
  select doc_id, text, source, raw, pos, trim(raw, ' ' || chr(9) || chr(13)) as line,
         len(regexp_extract_all(raw, '{_WORD}')) as words from lines),
least as (
  select least({params.most_sites}, greatest({params.least_sites}, ceil({params.share} * count(distinct {site})))) as sites
  from documents),
wide as (
  select line from marked where words >= {params.min_words}
  group by line having count(distinct {site}) >= (select sites from least)),
judged as (
  select m.*, (words >= {params.min_words} and w.line is not null) as gone from marked m left join wide w on m.line = w.line)
select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') as text,
       count(*)::bigint as n_lines, sum(gone::int)::bigint as n_removed
from judged group by doc_id, text
union all select doc_id, null, 0, 0 from documents where text is null
"""


def _secrets() -> str:
    """The same marks around matches, in the other engine's regular expressions."""
    columns, unions = [], []
    for rank, rule in enumerate(RULES):
        inner = rf"\1' || chr(2) || '\{rule.value}" if rule.value else r"\0"
        pattern = rule.pattern.replace("'", "''")
        columns.append(f"string_split(regexp_replace(safe, '{pattern}', chr(1) || '{inner}' || chr(1), 'g'), chr(1)) as s{rank}")
        value = f"length(split_part(s{rank}[i], chr(2), 2)) >= {rule.least}" if rule.value else "true"
        unions.append(
            f"list_transform(list_filter(range(2, len(s{rank}) + 1, 2), lambda i: {value}), "
            f"lambda i: {{'start': coalesce(list_sum(list_transform(s{rank}[1:i - 1], lambda p: length(replace(p, chr(2), '')))), 0)::bigint, "
            f"'rank': {rank}, 'kind': '{rule.kind}', 'size': length(replace(s{rank}[i], chr(2), ''))}})"
        )
    base = " or ".join(f"s.kind = '{k}'" for k in BASE_KINDS)
    text = "list_transform({}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.size))"
    counts = ", ".join(f"len(list_filter(found, lambda s: s.kind = '{k}'))::bigint as n_{k}" for k in BASE_KINDS)
    return f"""
with safe as (select doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as safe from documents),
parts as (select doc_id, {", ".join(columns)} from safe),
spans as (select doc_id, list_sort({" || ".join(unions)}) as found from parts)
select doc_id, {counts},
       sha256(array_to_string({text.format(f"list_filter(found, lambda s: {base})")}, ',')) as base_sha256,
       array_to_string({text.format("found")}, ',') as spans
from spans
"""


def _join(params: JoinParams = JOIN) -> str:
    """All pairs of classes that share a shingle, and the closure of their links."""
    w = params.width
    return rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
sets as (
  select doc_id, list_sort(case when len(ws) >= {w} then list_distinct(list_transform(range(1, len(ws) - {w - 2}), lambda i: array_to_string(ws[i:i + {w - 1}], ' ')))
                                when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingles from words),
classes as (select shingles, min(doc_id) as c, len(shingles) as n from sets where len(shingles) > 0 group by shingles),
entries as (select c, n, unnest(shingles) as shingle from classes),
links as (
  select a.c as x, b.c as y from entries a join entries b on a.shingle = b.shingle and a.c < b.c
  group by a.c, b.c, a.n, b.n having {params.denominator} * count(*) >= {params.numerator} * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach as (select c as a, c as b from classes union select r.a, l.y from reach r join both_ways l on r.b = l.x),
components as (select a as c, min(b) as component from reach group by a)
select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(p.component, s.doc_id) as component_id, coalesce(k.c, s.doc_id) as class_id
from sets s left join classes k on s.shingles = k.shingles left join components p on k.c = p.c
"""


def _mix(params: MixParams = MixParams()) -> str:
    """One pass over all sources and over all documents of a source."""
    weights = ", ".join(f"{w}.0" for w in params.weights)

    def hashed(text: str) -> str:
        return f"('0x' || substr(md5('{params.seed}:' || {text}), 1, 7))::bigint"

    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, ([{weights}])[(row_number() over (order by source nulls last) - 1) % {len(params.weights)} + 1]::double as weight,
         {params.most} * source_size as most from sources),
filled as (
  select row_number() over (order by most / weight, source) as nth, most / weight as full_at, {params.share} * sum(source_size) over () as total,
         coalesce(sum(most) over before, 0) as given, sum(weight) over () - coalesce(sum(weight) over before, 0) as open_
  from weighted window before as (order by most / weight, source rows between unbounded preceding and 1 preceding)),
level as (select arg_min(greatest(0.0, total - given) / open_, nth) filter (where greatest(0.0, total - given) / open_ <= full_at) as level from filled),
plan as (select source, source_size, least(most, weight * (select level from level)) as target from weighted),
ranked as (
  select s.doc_id, s.size, p.source_size, p.target, case when p.source_size > 0 then p.target / p.source_size else {params.share} end as expected,
         {hashed("coalesce(s.source, chr(0))")} / {float(1 << 28)} as start,
         row_number() over (partition by s.source order by s.size desc, {hashed("s.doc_id::varchar")} % {params.buckets}, s.doc_id) as place
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size, source_size, target::double as target,
       (size * (floor(place * expected + start) - floor((place - 1) * expected + start)))::bigint as taken
from ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _lines(), "op3_ngram_jaccard_join": _join(), "op4_secret_scan": _secrets(), "op9_source_mixing": _mix()}
