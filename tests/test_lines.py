import time

from pyspark.sql import functions as F

from blocklens.functions import text
from blocklens.operators import lines


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).first().r


def parse(spark, *raw):
    rows = [(i + 1, "a.log", r) for i, r in enumerate(raw)]
    return spark.createDataFrame(rows, "line_id long, file_name string, raw_line string")


def test_header_fields(spark):
    row = lines.parse_headers(
        parse(spark, "081109 203518 143 INFO dfs.DataNode$X: Receiving block blk_-16 src: /10.0.0.1:54106")
    ).first()
    assert (row.date, row.time, row.pid, row.level, row.component) == ("081109", "203518", "143", "INFO", "dfs.DataNode$X")
    assert row.content == "Receiving block blk_-16 src: /10.0.0.1:54106"
    assert row.block_id == "blk_-16" and row.ts_raw == "081109203518"
    assert str(row.ts) == "2008-11-09 20:35:18"


def test_bad_lines_are_routed_not_lost(spark):
    raw = parse(spark, "", "   ", "garbage", "081109 203518 1 INFO no component here", "081109 203518 1 INFO a: b")
    assert lines.parse_headers(raw).count() == 1
    assert sorted(r.line_id for r in lines.rejected_lines(raw).collect()) == [3, 4]
    counts = lines.parse_counts(raw).first()
    assert (counts.total_lines_read, counts.total_lines_parsed, counts.total_lines_failed) == (3, 1, 2)
    assert counts.parsing_success_rate == 0.333333


def test_empty_input_has_zero_rate(spark):
    assert lines.parse_counts(parse(spark).filter("false")).first().parsing_success_rate == 0.0


def test_loose_format_accepts_what_header_rejects(spark):
    line = "081109 203518 1 INFO no component here"
    assert one(spark, line, text.matches_line_format) and not one(spark, line, text.has_header)


def test_invalid_time_is_null_and_pivot_is_optional(spark):
    assert one(spark, "081109999999", text.parse_timestamp) is None
    assert one(spark, "850101000000", text.parse_timestamp).year == 2085
    assert one(spark, "850101000000", lambda c: text.parse_timestamp(c, 69)).year == 1985
    assert one(spark, "240101000000", lambda c: text.parse_timestamp(c, 69)).year == 2024


def test_several_block_ids(spark):
    raw = parse(spark, "081109 203518 1 INFO a: ask blk_1 to blk_-2 and blk_1", "081109 203518 1 INFO a: none")
    assert [r.block_id for r in lines.parse_headers(raw).orderBy("line_id").collect()] == ["blk_1", None]
    exploded = lines.parse_headers(raw, explode_ids=True).collect()
    assert sorted(str(r.block_id) for r in exploded) == ["None", "blk_-2", "blk_1"]


def test_masks_apply_in_order(spark):
    masked = one(spark, "blk_-5 at 10.1.2.3:50 and 10.1.2.3 end", text.mask)
    assert masked == "<BlockId> at <IPPORT> and <IP> end"


def test_signature_and_tokens(spark):
    content = "task_x  of blk_9 size 67108864 from /10.0.0.1"
    assert one(spark, content, text.tokens) == ["task", "x", "of", "<BlockId>", "size", "67108864", "from", "/<IP>"]
    assert one(spark, content, text.signature)[5] == "<*>"
    assert one(spark, content, text.raw_tokens) == ["task", "x", "of", "blk_9", "size", "67108864", "from", "/10.0.0.1"]


def test_parameters_come_back_from_masks_and_wildcards(spark):
    template = F.array(*[F.lit(t) for t in "Got <BlockId> from /<IPPORT>, /<IPPORT> in <*>".split()])
    content = "Got blk_-7 from /10.0.0.1:80, /10.0.0.2:90 in part1"
    values = one(spark, content, lambda c: text.parameters(c, template))
    assert values == ["blk_-7", "10.0.0.1:80", "10.0.0.2:90", "part1"]


def test_only_line_feeds_end_a_line(spark):
    """U+0085 and U+2028 inside a line belong to it, in the strict and in the loose format."""
    line = "081109 203518 143 INFO dfs.DataNode: caf\u0085 and \u2028 more"
    rows = spark.createDataFrame([(1, line)], "line_id long, raw_line string")
    assert lines.parse_headers(rows).first().content == "caf\u0085 and \u2028 more"
    assert rows.filter(text.matches_line_format(F.col("raw_line"))).count() == 1


def test_signature_text_is_the_joined_signature(spark):
    texts = ["a blk_-12 10.0.0.1:80  b7", "\tx 1\t", " y  10.1.1.1 z_9 é3", "", "blk_1", "a_b\u00a0c 1_x"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    out = rows.select(text.signature_text(F.col("s")).alias("a"), F.array_join(text.signature(F.col("s")), " ").alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out]


def test_signature_of_a_very_long_token_is_linear(spark):
    """A megabyte without white space or digit takes no longer than any other megabyte."""
    rows = spark.createDataFrame([("a" * 1_000_000,), ("b/" * 500_000 + " x1 y",), ("c" * 500_000 + "7" + "c" * 500_000,)], "s string")
    begin = time.monotonic()
    out = [r.r for r in rows.coalesce(1).select(text.signature_text(F.col("s")).alias("r")).collect()]
    assert time.monotonic() - begin < 20
    assert out == ["a" * 1_000_000, "b/" * 500_000 + " <*> y", "<*>"]


def test_signature_text_spells_the_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ("", " ", "1", "a1 b", "a_1_b  c", "blk_-5 10.0.0.1:80 x", "\tno digits here ", "é1 ü", "a\u00a01")], "s string")
    got = rows.select(text.signature_text(F.col("s")).alias("a"), F.array_join(text.signature(F.col("s")), " ").alias("b")).collect()
    assert all(r.a == r.b for r in got)
