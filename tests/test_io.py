import csv
import os

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from benefactor import cli
from benefactor.operators import dashboard, metrics, suggest
from benefactor.operators.aliases import AliasDictionary
from benefactor.plans.derive import derived
from benefactor.reports import latex
from benefactor.sources import readers, schemas, sinks
from benefactor.streaming import live

D = AliasDictionary.shipped()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """The derived tables as the files that the programs read."""
    base = tmp_path_factory.mktemp("store")
    tables = derived(spark, DATA)
    tables["articles"].repartition(3).write.parquet(str(base / "articles"))
    tables["detections"].write.parquet(str(base / "detections.parquet"))
    tables["registry"].write.parquet(str(base / "pmcids.parquet"))
    (base / "lists").mkdir()
    for kind in ("comm", "noncomm"):
        rows = tables["filelists"].where(F.col("license") == kind).toPandas()
        rows.insert(0, "File", "x.xml")
        rows.rename(columns={"AccessionID": "Accession ID"}).drop(columns="license").to_csv(base / "lists" / f"oa_{kind}_xml.PMC000xxxxxx.baseline.2025-06-01.filelist.csv", index=False)
    return str(base)


def test_filelists(spark, store):
    got = readers.read_filelists(spark, f"{store}/lists")
    assert {r["license"] for r in got.select("license").distinct().collect()} == {"comm", "noncomm"}
    want = dashboard.filelist_rows(derived(spark, DATA)["filelists"]).count()
    assert dashboard.filelist_rows(got).count() == want
    with pytest.raises(ValueError):
        readers.read_filelists(spark, f"{store}/lists", ("other",))


def test_file_limit_and_registry(spark, store):
    every = readers.list_files(spark, f"{store}/articles")
    assert len(every) == 3 and every == sorted(every)
    assert readers.read_articles(spark, f"{store}/articles", limit=1).count() < readers.read_articles(spark, f"{store}/articles").count()
    assert readers.read_registry(spark, store).columns == ["pmcid", "article_type"]
    with pytest.raises(ValueError):
        readers.read_registry(spark, f"{store}/lists")


def test_missing_columns_are_null(spark, tmp_path):
    spark.createDataFrame([(12345678.0,)], "pmcid double").write.parquet(str(tmp_path / "a"))
    row = readers.read_articles(spark, str(tmp_path / "a")).first()
    assert row["pmcid_pmc"] == "12345678.0" and row["fund_text"] is None
    assert [c for c, _ in schemas.columns_of(schemas.ARTICLES)] == readers.read_articles(spark, str(tmp_path / "a")).columns


def test_output_folder_is_checked(spark, tmp_path):
    sinks.check_output_folder(spark, str(tmp_path / "out.parquet"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(SystemExit):
        sinks.check_output_folder(spark, str(tmp_path / "no" / "out.parquet"))


def test_programs_end_to_end(spark, store, tmp_path):
    out = str(tmp_path)
    common = ["--oddpub-file", f"{store}/detections.parquet", "--rtrans-dir", f"{store}/articles"]
    cli.main(["summary", *common, "--registry", store, "--output", f"{out}/s/summary.csv", "--min-data-sharing", "3", "--aggregate-children"], spark)
    assert os.path.exists(f"{out}/s/summary.csv")
    full = readers.read_summary(spark, f"{out}/s/summary_all.csv")
    assert full.count() == 47 and readers.read_summary(spark, f"{out}/s/summary.csv").count() == full.where("data_sharing_pubs >= 3").count()
    cli.main(["trends", *common, "--registry", store, "--output-dir", f"{out}/t", "--aggregate-children"], spark)
    wide = readers.read_wide(spark, f"{out}/t/funder_counts_by_year.csv", "bigint")
    assert wide.columns[0] == "display_name" and wide.columns[-1] == "total" and wide.count() == 47
    cli.main(["dashboard", "--filelist-dir", f"{store}/lists", "--rtrans-dir", f"{store}/articles", "--oddpub-file", f"{store}/detections.parquet", "--output", f"{out}/dash.parquet", "--limit", "40"], spark)
    board = spark.read.parquet(f"{out}/dash.parquet")
    assert board.columns == list(dashboard.COLUMNS) and board.count() == 40
    cli.main(["table", "-i", f"{out}/s/summary_all.csv", "-o", f"{out}/table.tex", "--color-pubs", "--color-pct", "-n", "5"], spark)
    text = open(f"{out}/table.tex").read()
    assert text.count("\\cellcolor") == 10 and text.endswith("\\endgroup")
    cli.main(["plot", "--input-dir", f"{out}/t", "--output-dir", f"{out}/p", "--format", "svg", "--separate-legends"], spark)
    drawn = open(f"{out}/p/funder_counts_by_year.svg").read()
    assert "<circle" in drawn and "<polygon" in drawn  # markers by rank
    assert "<polygon" in open(f"{out}/p/funder_counts_by_year_legend.svg").read()


def test_suggestions_are_written(spark, tmp_path):
    names = [("NSF, the big one", 5000), ("NSF", 9000), ("Nowhere, Inc", 4000), ("rare", 10)]
    with open(tmp_path / "found.csv", "w", newline="") as file:
        csv.writer(file).writerows([("name", "count"), *names])
    cli.main(["suggest", "--discovered", str(tmp_path / "found.csv"), "--output", str(tmp_path / "more.csv")], spark)
    with open(tmp_path / "more.csv", newline="") as file:
        header, *got = csv.reader(file)
    assert header == ["discovered_name", "count", "potential_canonical", "num_matches"]
    want = suggest.suggest_aliases(spark.createDataFrame(names, schemas.DISCOVERED), D).collect()
    assert got == [[str(v) for v in row] for row in want] and ["Nowhere, Inc", "4000", "NEW_FUNDER", "0"] in got
    assert sinks.write_csv(spark.range(20000).orderBy(F.desc("id")), str(tmp_path / "long.csv")) == 20000
    assert open(tmp_path / "long.csv").read().split() == ["id", *map(str, range(19999, -1, -1))]


def test_filelists_with_other_headers(spark, tmp_path):
    for name, header, row in (("a", "File,Accession ID,PMID", "x,PMC1,11"), ("b", "PMID,AccessionID,File", "22,PMC2,y")):
        (tmp_path / f"oa_comm_xml.PMC00{name}xxxxxx.baseline.2025-06-01.filelist.csv").write_text(f"{header}\n{row}\n")
    got = readers.read_filelists(spark, str(tmp_path), ("comm",)).select("File", "AccessionID", "PMID", "license").collect()
    assert sorted(map(tuple, got)) == [("x", "PMC1", "11", "comm"), ("y", "PMC2", "22", "comm")]


def test_registry_from_a_database(spark):
    url = "jdbc:derby:memory:registry"
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{url};create=true")
    connection.createStatement().execute('create table pmcids ("pmcid" varchar(20), "article_type" varchar(40))')
    connection.createStatement().execute("insert into pmcids values ('PMC1', 'research-article'), ('PMC2', null)")
    got = readers.read_registry(spark, url)  # the first known name is missing there
    assert sorted(map(tuple, got.collect())) == [("PMC1", "research-article"), ("PMC2", None)]
    connection.createStatement().execute("drop table pmcids")
    connection.close()
    with pytest.raises(ValueError):
        readers.read_registry(spark, url)
    with pytest.raises(Exception, match="not found") as fault:  # a database that is not there is no missing table
        readers.read_registry(spark, "jdbc:derby:memory:elsewhere")
    assert not isinstance(fault.value, ValueError)


def test_written_rows_are_compared(spark, tmp_path, monkeypatch):
    df = spark.range(50).select("id", (F.col("id") % 3).cast("int").alias("part"))
    assert sinks.write_parquet_verified(df, str(tmp_path / "a"), ("part",))[0] == 50
    other = spark.range(49).select("id", F.lit(1).alias("part"))
    other.write.parquet(str(tmp_path / "other"))
    back = spark.read.parquet(str(tmp_path / "other"))
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, path: back)
    with pytest.raises(RuntimeError, match="49 rows, not 50"):
        sinks.write_parquet_verified(df, str(tmp_path / "b"))
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, path: back.withColumn("id", F.col("id").cast("int")))
    with pytest.raises(RuntimeError, match="types"):
        sinks.write_parquet_verified(df, str(tmp_path / "c"))


def test_percentages_of_a_cube(spark):
    t = derived(spark, DATA)
    cube = metrics.trend_cube(t["articles"], t["detections"], t["registry"], D)
    joined = metrics.trend_percentages(metrics.trend_counts(cube), metrics.trend_totals(cube))
    assert sorted(map(tuple, metrics.cube_percentages(cube).collect())) == sorted(map(tuple, joined.collect()))


def test_table_cells(spark):
    rows = [("A & B_c", 100, 10, 10.0), ("National Institutes of Health", 1000, 250, 25.0)]
    df = spark.createDataFrame(rows, schemas.SUMMARY)
    text = latex.render(latex.table_rows(df, D))
    assert "A \\& B\\_c &  & 100 & 10 & 10.0\\% \\\\" in text and "National Institutes of Health & USA & 1000 & 250 & 25.0\\% \\\\" in text
    assert latex.thousands(1234567) == "1,234,567"
    with pytest.raises(ValueError):
        latex.table_rows(df, D, sort_by="funder")


def test_stream_equals_batch(spark, store, tmp_path):
    stream = live.live_counts(live.article_stream(spark, f"{store}/articles", 1), D)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = live.live_counts(readers.read_articles(spark, f"{store}/articles"), D)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, batch.collect()))


def test_trends_in_one_pass_equal_two(spark):
    t = derived(spark, DATA)
    cube = metrics.trend_cube(t["articles"], t["detections"], t["registry"], D)
    open_ids = metrics.lenient(metrics.open_data_ids_multi(t["detections"]), t["registry"])
    rows = metrics.funded_articles(t["articles"], D, metrics.TREND_YEARS).join(open_ids, "pmcid", "left_semi")
    two = rows.select(F.explode("funder").alias("funder"), "year").groupBy("funder", "year").count()
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, metrics.trend_counts(cube).collect()))
