"""The funder table in LaTeX. The relational part is done by Spark; here are about fifty rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefactor.operators.aliases import AliasDictionary
from benefactor.operators.ranking import color_scale, top

#: The table's frame, line by line, and the characters to escape, in order.
HEAD = r"""% Requires: \usepackage[table]{xcolor}, \usepackage{siunitx}, \usepackage{booktabs}
% Define COL5 color in preamble, e.g.: \definecolor{COL5}{HTML}{4472C4}

\begingroup
\arrayrulecolor{COL5}
\rowcolors{2}{COL5!10}{white}
\setlength{\tabcolsep}{24pt}
\begin{tabular}{llS[table-format=6.0]S[table-format=5.0]S[table-format=2.2]}
\toprule
\textbf{} & \textbf{}
& \textbf{Research Pubs}
& \textbf{Pubs w/}
& \textbf{\% Pubs w/} \\
\textbf{Funder Name}
& \textbf{Country}
& \textbf{2010--2024}
& \textbf{Data Sharing}
& \textbf{Data Sharing} \\
\midrule"""
FOOT = r"""\bottomrule
\end{tabular}
\arrayrulecolor{black}
\endgroup"""
ESCAPES = (
    ("&", r"\&"),
    ("%", r"\%"),
    ("$", r"\$"),
    ("#", r"\#"),
    ("_", r"\_"),
    ("{", r"\{"),
    ("}", r"\}"),
    ("~", r"\textasciitilde{}"),
    ("^", r"\textasciicircum{}"),
)
SORT_KEYS = ("total_pubs", "data_sharing_pct", "data_sharing_pubs")


def escape(text: str) -> str:
    for plain, escaped in ESCAPES:
        text = text.replace(plain, escaped)
    return text


def thousands(n: int) -> str:
    return f"{n:,}"


def table_rows(summary: DataFrame, dictionary: AliasDictionary, sort_by: str = "total_pubs", ascending: bool = False, limit: int | None = None) -> DataFrame:
    """The rows of the table in order, with country and both colours; colours scale over the rows shown."""
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort by one of {', '.join(SORT_KEYS)}")
    shown = top(summary, sort_by, limit, "funder", descending=not ascending) if limit is not None else summary
    for column, log, prefix in (("total_pubs", True, "pubs"), ("data_sharing_pct", False, "pct")):
        shown = color_scale(shown, column, log).drop("position").withColumnsRenamed({c: f"{prefix}_{c}" for c in ("red", "green", "blue")})
    country = F.create_map(*[F.lit(x) for pair in dictionary.country.items() for x in pair]) if dictionary.country else F.create_map().cast("map<string,string>")
    order = F.asc(sort_by) if ascending else F.desc(sort_by)
    return shown.withColumn("country", F.coalesce(country[F.col("funder")], F.lit(""))).orderBy(order, "funder")


def render(rows: DataFrame, color_pubs: bool = False, color_pct: bool = False) -> str:
    """The LaTeX text of the rows of `table_rows`."""

    def cell(row, prefix: str, value: str, colored: bool) -> str:
        if not colored:
            return value
        red, green, blue = (row[f"{prefix}_{c}"] for c in ("red", "green", "blue"))
        return f"\\cellcolor{{rgb,255:red,{red};green,{green};blue,{blue}}}{value}"

    body = []
    for row in rows.collect():
        pubs = cell(row, "pubs", str(row["total_pubs"]), color_pubs)
        pct = cell(row, "pct", f"{row['data_sharing_pct']:.1f}\\%", color_pct)
        body.append(f"{escape(row['funder'])} & {row['country']} & {pubs} & {row['data_sharing_pubs']} & {pct} \\\\")
    return "\n".join([HEAD, *body, FOOT])
