"""The programs: dashboard, summary, trends, plot, table, suggest."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benefactor.operators import dashboard, metrics, ranking, suggest
from benefactor.operators.aliases import AliasDictionary
from benefactor.reports import charts, latex
from benefactor.session import build_session
from benefactor.sources import readers, sinks

COUNTS_FILE, RATES_FILE = "funder_counts_by_year", "funder_percentages_by_year"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="benefactor")
    programs = parser.add_subparsers(dest="program", required=True)

    def program(name: str, *options: tuple) -> None:
        own = programs.add_parser(name)
        for *flags, settings in options:
            own.add_argument(*flags, **settings)

    need, switch = {"required": True}, {"action": "store_true"}
    aliases = ("--funder-aliases", {"default": None, "help": "alias CSV; by default the shipped dictionary"})
    years = ("--year-range", {"nargs": 2, "type": int, "default": list(metrics.SUMMARY_YEARS)})
    limit = ("--limit", {"type": int, "default": None})
    sources = (("--oddpub-file", need), ("--rtrans-dir", need))
    program(
        "dashboard", ("--filelist-dir", need), *sources, ("--output", need), ("--licenses", {"default": "comm,noncomm"}), limit, aliases, ("--aggregate-children", switch),
        # kept for callers: Spark's own settings decide about parallelism
        ("--workers", {"type": int, "default": None}), ("--chunk-size", {"type": int, "default": 100_000}), ("--threads", {"type": int, "default": None}),
    )
    program("summary", *sources, ("--registry", need), ("--output", need), years, ("--min-data-sharing", {"type": int, "default": 1000}), limit, aliases, ("--aggregate-children", switch))
    program(
        "trends", *sources, ("--registry", need), aliases, ("--output-dir", need), ("--graph", {"choices": ["counts", "percentages", "both"], "default": "both"}), years, limit, ("--aggregate-children", switch)
    )
    program(
        "plot", ("--input-dir", need), ("--output-dir", need), ("--format", {"nargs": "+", "choices": ["png", "svg", "pdf"], "default": ["png"]}),
        ("--separate-legends", switch), ("--legend-orientation", {"choices": ["vertical", "horizontal"], "default": "vertical"}), ("--top-n-each", {"type": int, "default": 5}),
    )
    program(
        "table", ("--input", "-i", need), ("--aliases", "-a", {"default": None}), ("--output", "-o", {"default": None}), ("--sort-by", {"choices": list(latex.SORT_KEYS), "default": "total_pubs"}),
        ("--ascending", switch), ("--color-pubs", switch), ("--color-pct", switch), ("--limit", "-n", {"type": int, "default": None}),
    )
    program("suggest", ("--discovered", need), aliases, ("--output", need), ("--min-count", {"type": int, "default": 1000}))
    return parser


def _dictionary(spark: SparkSession, path: str | None) -> AliasDictionary:
    return readers.read_aliases(spark, path) if path else AliasDictionary.shipped()


def _show(title: str, rows: DataFrame) -> None:
    """At most twenty rows."""
    print(f"\n{title}")
    for row in rows.collect():
        print("  " + "  ".join(f"{v:>12,}" if isinstance(v, int) else f"{v:>8.1f}" if isinstance(v, float) else f"{v:<55}" for v in row))


def run_dashboard(spark: SparkSession, args: argparse.Namespace) -> None:
    sinks.check_output_folder(spark, args.output)
    licenses = tuple(x.strip() for x in args.licenses.split(","))
    now = datetime.now().strftime("%Y-%m-%d %H:%M:%S.%f")[:-3] + "-04"
    board = dashboard.build(
        readers.read_filelists(spark, args.filelist_dir, licenses),
        readers.read_articles(spark, args.rtrans_dir),
        readers.read_detections(spark, args.oddpub_file),
        _dictionary(spark, args.funder_aliases),
        now,
        args.aggregate_children,
        args.limit,
    )
    rows, columns = sinks.write_parquet_verified(board, args.output)
    print(f"{rows:,} rows, {len(columns)} columns")
    _show("rows, open data, open code, with funder", dashboard.stats(spark.read.parquet(args.output)))


def _sources(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, AliasDictionary]:
    return (
        readers.read_articles(spark, args.rtrans_dir, args.limit),
        readers.read_detections(spark, args.oddpub_file),
        readers.read_registry(spark, args.registry),
        _dictionary(spark, args.funder_aliases),
    )


def run_summary(spark: SparkSession, args: argparse.Namespace) -> None:
    articles, detections, registry, dictionary = _sources(spark, args)
    counted = metrics.funder_summary(articles, detections, registry, dictionary, tuple(args.year_range), args.aggregate_children)
    full = spark.createDataFrame(counted.collect(), counted.schema)  # a row a funder; the corpus is read once
    passed = full.where(F.col("data_sharing_pubs") >= args.min_data_sharing)
    sinks.write_report_csv(passed, args.output)
    stem = args.output[: -len(".csv")] if args.output.endswith(".csv") else args.output
    sinks.write_report_csv(full, f"{stem}_all.csv")
    _show(f"funders with at least {args.min_data_sharing:,} publications that share data", passed.limit(20))


def run_trends(spark: SparkSession, args: argparse.Namespace) -> None:
    articles, detections, registry, dictionary = _sources(spark, args)
    counted = metrics.trend_cube(articles, detections, registry, dictionary, aggregate_children=args.aggregate_children)
    cube = spark.createDataFrame(counted.collect(), counted.schema)  # a row a funder and year
    names = metrics.remaining_funders(spark, dictionary, args.aggregate_children)
    years = range(args.year_range[0], args.year_range[1] + 1)
    counts = metrics.trend_counts(cube)
    sinks.make_folder(spark, args.output_dir)
    if args.graph in ("counts", "both"):
        wide = ranking.counts_wide(counts, names, years, dictionary).drop("funder")
        sinks.write_report_csv(wide, f"{args.output_dir}/{COUNTS_FILE}.csv", index="display_name")
        _chart(spark, wide.drop("total").limit(10), f"{args.output_dir}/{COUNTS_FILE}", ["png"], "Open data research articles", "Articles", False)
    if args.graph in ("percentages", "both"):
        rates = metrics.cube_percentages(cube)
        wide = ranking.percentages_wide(rates, names, years, dictionary).drop("funder")
        sinks.write_report_csv(wide, f"{args.output_dir}/{RATES_FILE}.csv", index="display_name")
        _chart(spark, wide.limit(10), f"{args.output_dir}/{RATES_FILE}", ["png"], "Open data rate", "Rate (%)", True)
    totals = names.join(counts.groupBy("funder").agg(F.sum("n").alias("n")), "funder", "left").select("funder", F.coalesce("n", F.lit(0)).alias("total"))
    labelled = ranking.top(totals, "total", 20, "funder").select(ranking.display_name(F.col("funder"), dictionary).alias("display_name"), "total")
    _show("top 20 funders by open data articles", labelled)


def _chart(spark: SparkSession, wide: DataFrame, stem: str, formats: list[str], title: str, label: str, percent: bool, **more):
    """Ten lines at most."""
    table = wide.toPandas().set_index("display_name")
    outputs = [f"{stem}.{f}" for f in formats]
    return charts.line_chart(table, more.pop("names", list(table.index)), outputs, title, label, percent, write=_writer(spark), **more)


def _writer(spark: SparkSession) -> charts.Writer:
    return lambda path, data: sinks.write_bytes(spark, [data], path)


def run_plot(spark: SparkSession, args: argparse.Namespace) -> None:
    counts = readers.read_wide(spark, f"{args.input_dir}/{COUNTS_FILE}.csv", "bigint").drop("total")
    rates = readers.read_wide(spark, f"{args.input_dir}/{RATES_FILE}.csv", "double")
    top = ranking.topk_combined(ranking.unpivot_years(counts, "n"), ranking.unpivot_years(rates, "pct"), args.top_n_each)
    names = [r["display_name"] for r in top.orderBy("position").collect()]
    colour_of, legend = charts.colors(names), not args.separate_legends
    for wide, file, title, label, percent in ((counts, COUNTS_FILE, "Open data articles of top funders", "Articles", False), (rates, RATES_FILE, "Articles with open data, top funders", "Rate (%)", True)):
        shown = wide.where(F.col("display_name").isin(names))
        drawn = _chart(spark, shown, f"{args.output_dir}/{file}", args.format, title, label, percent, names=names, legend=legend, colour_of=colour_of)
        if args.separate_legends:
            charts.save_legend(*drawn, [f"{args.output_dir}/{file}_legend.{f}" for f in args.format], args.legend_orientation, _writer(spark))


def run_table(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = latex.table_rows(readers.read_summary(spark, args.input), _dictionary(spark, args.aliases), args.sort_by, args.ascending, args.limit)
    text = latex.render(rows, args.color_pubs, args.color_pct)
    if args.output:
        sinks.write_text(spark, text, args.output)
    else:
        print(text)


def run_suggest(spark: SparkSession, args: argparse.Namespace) -> None:
    sinks.check_output_folder(spark, args.output)
    discovered = readers.read_discovered(spark, args.discovered)
    rows = sinks.write_csv(suggest.suggest_aliases(discovered, _dictionary(spark, args.funder_aliases), args.min_count), args.output)
    print(f"{rows:,} suggestions")


PROGRAMS = {"dashboard": run_dashboard, "summary": run_summary, "trends": run_trends, "plot": run_plot, "table": run_table, "suggest": run_suggest}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    PROGRAMS[args.program](spark or build_session(), args)


if __name__ == "__main__":
    main()
