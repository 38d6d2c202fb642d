import pytest
from pyspark.sql import functions as F

from blocklens.sources import labels, logs, lookup, sinks
from checks import fixtures as X


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok line\r\ncaf\xe9 bad\n\nlast\n")
    (tmp_path / "b.TXT").write_text("081109 203518 1 INFO a: b\n\n  \nrest\n")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "empty.csv").write_text("")
    return tmp_path


def test_discovery_by_extension(spark, folder):
    found = logs.discover_files(spark, str(folder)).collect()
    assert [r.file_name for r in found] == ["a.log", "b.TXT"]


def test_required_inputs(spark, folder):
    assert logs.validate_inputs(spark, str(folder), ["a.log"]).count() == 3
    with pytest.raises(logs.InputError, match="missing or empty: empty.csv, nope.log"):
        logs.validate_inputs(spark, str(folder), ["a.log", "empty.csv", "nope.log"])


def test_lines_and_encoding(spark, folder):
    rows = logs.read_lines(spark, str(folder / "a.log"))
    assert [r.raw_line for r in rows.collect()] == ["ok line", "café bad", "", "last"]


def test_file_stats_and_report(spark, folder):
    rows = logs.read_lines(spark, [str(folder / "a.log"), str(folder / "b.TXT")])
    stats = {r.file_name: r for r in logs.file_stats(rows).collect()}
    assert (stats["b.TXT"].line_count, stats["b.TXT"].empty_line_count, stats["b.TXT"].malformed_line_count) == (4, 2, 1)
    assert logs.file_stats(rows, validate=False).first().malformed_line_count is None
    samples = logs.sample_lines(rows.withColumn("at", F.monotonically_increasing_id()), "at", 2)
    report = {r.file_name: r for r in logs.file_report(logs.file_stats(rows), samples).collect()}
    assert report["a.log"].sample_lines == ["ok line", "café bad"]
    assert report["b.TXT"].warning == "b.TXT: 25.00% of lines do not match the expected log format."
    totals = logs.collection_totals(logs.file_stats(rows)).first()
    assert (totals.total_files, totals.total_lines, totals.warning_count) == (2, 8, 2)


def test_line_ids_are_contiguous_over_many_splits(spark, tmp_path):
    for name, n in (("a.log", 900), ("b.log", 37), ("c.log", 400)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" + ("\n" if i % 10 == 0 else "") for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = logs.number_file_lines(logs.read_lines(spark, str(tmp_path))).orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"{name} {i}" for name, n in (("a.log", 900), ("b.log", 37), ("c.log", 400)) for i in range(n)]
    assert [r.line_id for r in rows] == list(range(1, len(want) + 1))
    assert [r.raw_line for r in rows] == want


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1, Normal\nblk_2,Anomaly\nblk_3,Odd\n")
    rows = labels.read_labels(spark, str(tmp_path / "l.csv"))
    assert {r.label: r.n for r in labels.label_counts(rows).collect()} == {"Normal": 1, "Anomaly": 1, "Odd": 1}
    with pytest.raises(logs.InputError, match="Odd"):
        labels.require_known_labels(rows)
    (tmp_path / "bad.csv").write_text("Block,Label\nblk_1,Normal\n")
    with pytest.raises(logs.InputError, match="BlockId"):
        labels.read_labels(spark, str(tmp_path / "bad.csv"))


def test_parsed_logs_as_csv_keep_parameters(spark, data, tmp_path):
    sinks.write_parsed(X.events(spark, data), str(tmp_path / "p"), "csv")
    back = spark.read.option("header", "true").csv(str(tmp_path / "p"))
    assert back.count() == X.events(spark, data).count()
    heart = back.filter("content LIKE 'Received block%'").first()
    assert heart.params.startswith('["blk_')


def test_feature_input_prunes_columns(spark, data, tmp_path):
    sinks.write_parsed(X.events(spark, data), str(tmp_path / "p"))
    plan = sinks.read_feature_input(spark, str(tmp_path / "p"))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "raw_line" not in schema and "content" not in schema and "event_id" in schema


def test_report_is_one_json_document(spark, tmp_path):
    sinks.write_report(spark.range(1).select(F.array(F.array(F.lit(1), F.lit(2))).alias("matrix")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().matrix == [[1, 2]]


def test_lookup_filter_reaches_the_scan(spark, data, tmp_path):
    lookup.write_lookup(X.events(spark, data), str(tmp_path / "l"), 4)
    rows = lookup.block_logs(spark, str(tmp_path / "l"), "blk_2")
    assert "EqualTo(block_id,blk_2)" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == X.events(spark, data).filter("block_id = 'blk_2'").count()


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "app.log").write_text("x\n" * n)
    rows = logs.read_lines(spark, str(tmp_path / "*"))
    stats = logs.file_stats(rows)
    assert sorted((r.file_name, r.line_count, r.size_bytes) for r in stats.collect()) == [("app.log", 3, 6), ("app.log", 5, 10)]
    totals = logs.collection_totals(stats).first()
    assert (totals.total_files, totals.total_lines, totals.total_bytes) == (2, 8, 16)
    samples = logs.sample_lines(rows.withColumn("at", F.monotonically_increasing_id()), "at", 4)
    assert sorted(len(r.sample_lines) for r in logs.file_report(stats, samples).collect()) == [3, 4]


def test_numbered_lines_survive_other_splits(spark, tmp_path):
    """The size of splits changes between the call and the action: no line is lost."""
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        rows = logs.number_file_lines(logs.read_lines(spark, str(tmp_path)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "170000")
        got = rows.select("line_id", "raw_line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_id, r.raw_line) for r in got) == [(i + 1, f"line {i}") for i in range(50_000)]
