"""Checks of sources, line parsing and template mining."""

import uuid

from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions import text
from blocklens.functions.scale import checkpointed
from blocklens.operators import lines, templates
from blocklens.sources import labels, logs, lookup, sinks
from checks import fixtures as X
from checks.registry import check, cte, shared

BLANK = "trim(raw_line) = ''"
LOOSE = f"regexp_matches(raw_line, '{C.LINE_FORMAT}')"


def folder(spark, name):
    """A new folder beside the session's checkpoints, which every executor can reach."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@shared
def text_files(spark, sf_dir):
    """The log lines as text files, one folder per log file."""
    path = folder(spark, "log-text")
    rows = X.log_lines(spark, sf_dir).repartitionByRange("file_name", "line_id").sortWithinPartitions("file_name", "line_id")
    rows.select("file_name", "raw_line").write.partitionBy("file_name").text(path)
    return path


def scanned(spark, sf_dir):
    path = text_files(spark, sf_dir)
    rows = logs.read_lines(spark, path)
    return rows.withColumn("file_name", F.regexp_extract("path", "file_name=([^/]+)", 1))


@check("a1_required_inputs", "SELECT count(DISTINCT file_name) AS n_found, true AS missing_is_error FROM log_lines")
def a1(spark, sf_dir):
    """Every log is found in its folder, and a name that is in none is an error."""
    path = text_files(spark, sf_dir)
    present = logs.list_files(spark, path).filter(F.col("extension").isin(*C.LOG_EXTENSIONS))
    names = [r.file_name for r in present.select("file_name").distinct().collect()]
    found = logs.validate_inputs(spark, path, names).select(F.regexp_extract("path", "file_name=([^/]+)", 1).alias("log"))
    try:
        logs.validate_inputs(spark, path, [*names, "absent.log"])
        error = False
    except logs.InputError as problem:
        error = "absent.log" in str(problem)
    found = found.filter("log <> ''")
    return found.agg(F.count_distinct("log").alias("n_found"), F.lit(error).alias("missing_is_error"))


@check("a2_discover_files", """
SELECT file_name, '.txt' AS extension, sum(strlen(raw_line) + 1)::BIGINT AS size_bytes FROM log_lines GROUP BY file_name""")
def a2(spark, sf_dir):
    """Logs by folder: the bytes of their files are those of their lines with line ends."""
    found = logs.discover_files(spark, text_files(spark, sf_dir))
    log = F.regexp_extract("path", "file_name=([^/]+)", 1).alias("file_name")
    return found.groupBy(log, "extension").agg(F.sum("size_bytes").alias("size_bytes"))


@check("a3_scan_lines", "SELECT file_name, raw_line FROM log_lines")
def a3(spark, sf_dir):
    return scanned(spark, sf_dir).select("file_name", "raw_line")


@check("a4_encoding_fallback", "SELECT doc_id, line_no, raw_line FROM text_lines")
def a4(spark, sf_dir):
    """Lines with letters outside ASCII, half of them in Latin-1 bytes, all come back."""
    rows = X.text_lines(spark, sf_dir)
    latin = F.encode("raw_line", "ISO-8859-1")
    fits = (F.decode(latin, "ISO-8859-1") == F.col("raw_line")) & ~F.is_valid_utf8(latin.cast("string"))
    raw = F.when(fits & (F.col("line_no") % 2 == 0), latin.cast("string")).otherwise(F.col("raw_line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.decode_line(raw).alias("raw_line"))


_STATS = f"""
SELECT file_name, count(*) AS line_count, count(*) FILTER (WHERE {BLANK}) AS empty_line_count,
       count(*) FILTER (WHERE NOT {BLANK} AND NOT {LOOSE}) AS malformed_line_count FROM source_rows GROUP BY file_name"""


def _stats(source):
    return _STATS.replace("source_rows", source)


@check("a5_file_stats", _stats("log_lines"))
def a5(spark, sf_dir):
    return logs.file_stats(X.log_lines(spark, sf_dir))


@check("a5_document_stats", _stats("text_lines"))
def a5_documents(spark, sf_dir):
    return logs.file_stats(X.text_lines(spark, sf_dir))


@check("a5_scanned_stats", _stats("log_lines"))
def a5_scanned(spark, sf_dir):
    return logs.file_stats(scanned(spark, sf_dir).drop("size_bytes", "path"))


@check("a6_sample_lines", f"""
SELECT * FROM (SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY line_id) AS sample_no, raw_line
FROM log_lines WHERE NOT {BLANK}) WHERE sample_no <= 5""")
def a6(spark, sf_dir):
    rows = logs.sample_lines(X.log_lines(spark, sf_dir), "line_id")
    return rows.withColumn("sample_no", F.col("sample_no").cast("long"))


@check("a7_malformed_ratio", f"""
SELECT file_name, round(malformed_line_count / greatest(line_count, 1), 9) AS malformed_ratio,
       malformed_line_count / greatest(line_count, 1) > 0.01 AS warned FROM ({_stats('log_lines')})""")
def a7(spark, sf_dir):
    rows = logs.malformed_warnings(logs.file_stats(X.log_lines(spark, sf_dir)))
    return rows.select("file_name", F.round("malformed_ratio", 9).alias("malformed_ratio"), F.col("warning").isNotNull().alias("warned"))


@check("a8_collection_totals", f"""
SELECT count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(empty_line_count) AS BIGINT) AS total_empty_lines,
       count(*) FILTER (WHERE malformed_line_count > 0.01 * line_count) AS warning_count FROM ({_stats('log_lines')})""")
def a8(spark, sf_dir):
    return logs.collection_totals(logs.file_stats(X.log_lines(spark, sf_dir)))


@check("a9_label_counts", "SELECT label, count(*) AS n FROM dirty_labels GROUP BY label")
def a9(spark, sf_dir):
    return labels.label_counts(labels.clean_labels(X.dirty_labels(spark, sf_dir)))


@check("a9_bad_labels", "SELECT label, count(*) AS n FROM dirty_labels WHERE label NOT IN ('Normal', 'Anomaly') GROUP BY label")
def a9_bad(spark, sf_dir):
    return labels.unexpected_labels(labels.clean_labels(X.dirty_labels(spark, sf_dir)))


@check("a10_parsed_round_trip", """
SELECT line_id, date, time, ts_raw, pid, level, component, content, block_id, event_id, event_template, raw_line FROM log_events""")
def a10(spark, sf_dir):
    path = folder(spark, "parsed")
    sinks.write_parsed(X.events(spark, sf_dir), path)
    return spark.read.parquet(path).drop("params")


@check("a11_feature_input", "SELECT ts_raw, level, component, block_id, event_id FROM log_events")
def a11(spark, sf_dir):
    path = folder(spark, "parsed")
    sinks.write_parsed(X.events(spark, sf_dir), path)
    return sinks.read_feature_input(spark, path)


@check("a12_prediction_round_trip", "SELECT block_id, round(fusion_score, 9) AS fusion_score, fusion_prediction FROM fused_pairs")
def a12(spark, sf_dir):
    path = folder(spark, "predictions")
    kept = X.fused_pairs(spark, sf_dir).select("block_id", "fusion_score", "fusion_prediction")
    sinks.write_table(kept, path, "csv")
    back = spark.read.option("header", "true").schema(kept.schema).csv(path)
    return back.withColumn("fusion_score", F.round("fusion_score", 9))


@check("g18_block_logs", """
SELECT line_id, ts_raw, component, event_id, content FROM log_events WHERE block_id = 'blk_-7' ORDER BY line_id""")
def g18(spark, sf_dir):
    path = folder(spark, "lookup-g18")
    lookup.write_lookup(X.events(spark, sf_dir), path)
    return lookup.block_logs(spark, path, "blk_-7").select("line_id", "ts_raw", "component", "event_id", "content")


@check("a16_block_lookup", """
SELECT line_id, block_id, ts_raw, component, event_id, event_template, content FROM log_events WHERE block_id = 'blk_0'""")
def a16(spark, sf_dir):
    path = folder(spark, "lookup")
    lookup.write_lookup(X.events(spark, sf_dir), path)
    return lookup.block_logs(spark, path, "blk_0")


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@check("b1_header", "SELECT line_id, date, time, ts_raw, pid, level, component, content FROM parsed_lines")
def b1(spark, sf_dir):
    return X.parsed(spark, sf_dir).select("line_id", "date", "time", "ts_raw", "pid", "level", "component", "content")


@check("b2_rejects", f"SELECT line_id, raw_line FROM log_lines WHERE NOT {BLANK} AND NOT regexp_matches(raw_line, '{C.HEADER}')")
def b2(spark, sf_dir):
    return lines.rejected_lines(X.log_lines(spark, sf_dir)).select("line_id", "raw_line")


@check("b2_reject_sample", f"""
SELECT line_id, raw_line FROM log_lines WHERE NOT {BLANK} AND NOT regexp_matches(raw_line, '{C.HEADER}') ORDER BY line_id LIMIT 20""")
def b2_sample(spark, sf_dir):
    return lines.reject_sample(X.log_lines(spark, sf_dir)).select("line_id", "raw_line")


@check("b3_line_format", f"SELECT line_id, {LOOSE} AS well_formed FROM log_lines")
def b3(spark, sf_dir):
    return X.log_lines(spark, sf_dir).select("line_id", text.matches_line_format(F.col("raw_line")).alias("well_formed"))


@check("b4_block_id", "SELECT line_id, block_id FROM parsed_lines")
def b4(spark, sf_dir):
    return X.parsed(spark, sf_dir).select("line_id", "block_id")


@check("b4_block_ids_all", """
SELECT DISTINCT line_id, block_id FROM (
  SELECT line_id, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS block_id
  FROM (SELECT line_id, regexp_extract_all(content, 'blk_-?[0-9]+') AS ids FROM parsed_lines))""")
def b4_all(spark, sf_dir):
    return lines.parse_headers(X.log_lines(spark, sf_dir), explode_ids=True).select("line_id", "block_id")


@check("b6_timestamp", f"SELECT line_id, {TS} AS ts, ts IS NULL AS bad FROM parsed_lines")
def b6(spark, sf_dir):
    return X.parsed(spark, sf_dir).select("line_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("ts").isNull().alias("bad"))


@check("b7_line_id", f"""
SELECT line_id AS source_line, row_number() OVER (ORDER BY line_id) AS line_id FROM log_lines WHERE NOT {BLANK}""")
def b7(spark, sf_dir):
    rows = X.log_lines(spark, sf_dir).withColumnRenamed("line_id", "source_line")
    return logs.number_lines(rows, "source_line").select("source_line", "line_id")


@check("b7_file_line_id", f"SELECT count(*) AS n, count(*) AS n_ids, 1 AS first_id, count(*) AS last_id FROM log_lines WHERE NOT {BLANK}")
def b7_files(spark, sf_dir):
    """Ids over text files are contiguous from one."""
    rows = logs.number_file_lines(scanned(spark, sf_dir))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("line_id").alias("n_ids"),
        F.min("line_id").cast("int").alias("first_id"),
        F.max("line_id").alias("last_id"),
    )


@check("b8_mask", f"SELECT line_id, {X.duck_mask('content')} AS masked FROM parsed_lines")
def b8(spark, sf_dir):
    return X.parsed(spark, sf_dir).select("line_id", text.mask(F.col("content")).alias("masked"))


@check("b8_mask_documents", f"SELECT doc_id, {X.duck_mask('text')} AS masked FROM documents")
def b8_documents(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.mask(F.col("text")).alias("masked"))


@check("b9_tokens", "SELECT line_id, array_to_string(tokens, '|') AS tokens, len(tokens) AS n_tok FROM signed_lines")
def b9(spark, sf_dir):
    tokens = text.tokens(F.col("content"))
    return X.parsed(spark, sf_dir).select(
        "line_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("long").alias("n_tok")
    )


@check("b10_signature", "SELECT line_id, signature FROM signed_lines")
def b10(spark, sf_dir):
    return templates.with_signature(X.parsed(spark, sf_dir)).select("line_id", "signature")


@check("b11_templates", "SELECT event_id, template, n_lines, first_line FROM mined_templates")
def b11(spark, sf_dir):
    return X.mined(spark, sf_dir).dictionary.select("event_id", "template", "n_lines", "first_line")


# Three families of lines whose words vary: one by its middle, one by what follows the first
# words, one that begins with what varies most, so every first word has a leaf of its own.
_PART_LINES = """
SELECT p_partkey * 3 + k + 1 AS line_id,
       CASE k WHEN 0 THEN concat('stock of ', p_name, ' is low')
              WHEN 1 THEN concat('order for ', p_type, ' went to customer with ', p_name, ' inside')
              ELSE concat(noun, ' from ', p_type, ' shelf was counted twice') END AS content
FROM (SELECT *, split_part(p_name, ' ', 2) AS noun FROM {part}) CROSS JOIN (VALUES (0), (1), (2)) v(k)
"""
cte("part_lines", _PART_LINES.format(part="part"))
cte("part_families", """
SELECT line_id, string_split(content, ' ') AS tokens,
       CASE (line_id - 1) % 3 WHEN 2 THEN string_split(content, ' ')[1] ELSE CAST((line_id - 1) % 3 AS STRING) END AS family FROM part_lines""")
cte("part_templates", """
SELECT family, concat('E', CAST(row_number() OVER (ORDER BY first_line) AS STRING)) AS event_id, template, n_lines, first_line FROM (
  SELECT family, string_agg(token, ' ' ORDER BY i) AS template, any_value(n_lines) AS n_lines, min(first_line) AS first_line FROM (
    SELECT family, i, CASE WHEN count(DISTINCT tokens[i]) = 1 THEN min(tokens[i]) ELSE '<*>' END AS token, count(*) AS n_lines, min(line_id) AS first_line
    FROM part_families, range(1, 20) r(i) WHERE i <= len(tokens) GROUP BY family, i) GROUP BY family)""")


@shared
def part_lines(spark, sf_dir):
    return checkpointed(spark.sql(_PART_LINES.format(part=f"parquet.`{sf_dir}/part.parquet`")))


@shared
def part_templates(spark, sf_dir):
    return templates.mine_templates(part_lines(spark, sf_dir))


@check("b11_merging_templates", "SELECT event_id, template, n_lines, first_line FROM part_templates")
def b11_merging(spark, sf_dir):
    """Families that merge: by their first fixed tokens, by their last ones, and by what is left."""
    return part_templates(spark, sf_dir).dictionary.select("event_id", "template", "n_lines", "first_line")


@check("b14_merged_match", """
SELECT line_id, event_id, round(len(list_filter(string_split(template, ' '), lambda t: t <> '<*>')) / len(tokens), 6) AS similarity
FROM part_families JOIN part_templates USING (family)""")
def b14_merged(spark, sf_dir):
    """Every line matched to the merged templates through the inverted index."""
    rows = templates.match_templates(part_lines(spark, sf_dir), part_templates(spark, sf_dir).dictionary)
    return rows.select("line_id", "event_id", F.round("similarity", 6).alias("similarity"))


@check("b11_document_templates")
def b11_documents(spark, sf_dir):
    """Mining free text, every line of every document."""
    rows = X.text_lines(spark, sf_dir).filter(~text.is_blank(F.col("raw_line")))
    ids = F.col("doc_id") * 1_000_000 + F.col("line_no")
    rows = rows.select(ids.alias("line_id"), F.col("raw_line").alias("content"))
    return templates.mine_templates(rows).dictionary.select("event_id", "template", "n_lines", "first_line")


@check("b12_event_ids", "SELECT line_id, event_id, event_template FROM log_events")
def b12(spark, sf_dir):
    return X.events(spark, sf_dir).select("line_id", "event_id", "event_template")


# Masked values and digit-bearing tokens in order: in these lines every raw token with a
# digit holds exactly the values, except the block-id underscore that also splits tokens.
_PARAMS = r"""
SELECT line_id, array_to_string(regexp_extract_all(content,
  'blk_-?[0-9]+|([0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{1,5}|([0-9]{1,3}\.){3}[0-9]{1,3}|[0-9]+'), '|') AS params
FROM parsed_lines"""


@check("b13_params", _PARAMS)
def b13(spark, sf_dir):
    return X.events(spark, sf_dir).select("line_id", F.array_join("params", "|").alias("params"))


@check("b14_match", "SELECT line_id, event_id, true AS matched FROM log_events")
def b14(spark, sf_dir):
    rows = templates.match_templates(X.parsed(spark, sf_dir), X.mined(spark, sf_dir).dictionary)
    return rows.select("line_id", "event_id", "matched")


@check("b15_top_templates", """
SELECT event_id, template, n_lines, first_line FROM mined_templates ORDER BY n_lines DESC, first_line LIMIT 20""")
def b15(spark, sf_dir):
    return templates.top_templates(X.events(spark, sf_dir), X.mined(spark, sf_dir).dictionary)


@check("b16_parse_report", f"""
SELECT *, round(total_lines_parsed / total_lines_read, 6) AS parsing_success_rate FROM (
SELECT count(*) AS total_lines_read, count(*) FILTER (WHERE regexp_matches(raw_line, '{C.HEADER}')) AS total_lines_parsed,
       count(*) FILTER (WHERE NOT regexp_matches(raw_line, '{C.HEADER}')) AS total_lines_failed,
       (SELECT count(*) FROM mined_templates) AS unique_template_count
FROM log_lines WHERE NOT {BLANK})""")
def b16(spark, sf_dir):
    return lines.parse_report(X.log_lines(spark, sf_dir), X.mined(spark, sf_dir).dictionary)


@check("a13_parsing_report", f"""
SELECT *, round(total_lines_parsed / total_lines_read, 6) AS parsing_success_rate FROM (
SELECT count(*) AS total_lines_read, count(*) FILTER (WHERE regexp_matches(raw_line, '{C.HEADER}')) AS total_lines_parsed,
       count(*) FILTER (WHERE NOT regexp_matches(raw_line, '{C.HEADER}')) AS total_lines_failed,
       (SELECT count(*) FROM mined_templates) AS unique_template_count
FROM log_lines WHERE NOT {BLANK})""")
def a13(spark, sf_dir):
    """The report as JSON, read back."""
    path = folder(spark, "report")
    sinks.write_report(lines.parse_report(X.log_lines(spark, sf_dir), X.mined(spark, sf_dir).dictionary), path)
    return spark.read.json(path)


@check("a13_collection_report", f"""
SELECT count(*) AS total_files, sum(n)::BIGINT AS total_lines, sum(blank)::BIGINT AS total_empty_lines FROM (
  SELECT file_name, count(*) AS n, count(*) FILTER (WHERE {BLANK}) AS blank FROM log_lines GROUP BY file_name)""")
def a13_collection(spark, sf_dir):
    path = folder(spark, "collection")
    sinks.write_report(logs.collection_totals(logs.file_stats(X.log_lines(spark, sf_dir))), path)
    return spark.read.json(path).select("total_files", "total_lines", "total_empty_lines")


@check("a15_resume", "SELECT event_id, template, n_lines FROM mined_templates")
def a15(spark, sf_dir):
    """A stored dictionary, loaded and continued over the same lines: the same ids, texts and counts."""
    path = folder(spark, "dictionary")
    sinks.write_table(X.mined(spark, sf_dir).dictionary, path)
    again = templates.mine_templates(X.parsed(spark, sf_dir), spark.read.parquet(path))
    return again.dictionary.select("event_id", "template", "n_lines")


@check("b17_template_map", "SELECT event_id, template FROM mined_templates")
def b17(spark, sf_dir):
    return templates.template_map(X.mined(spark, sf_dir).dictionary)


PATTERNS = {
    "P1": "Receiving block [*] src: [*] dest: [*]",
    "P2": "Served block [*] to [*]",
    "P3": "[*]Verification succeeded for[*]",
    "P4": "Rec[*] block [*]",
    "P5": "Deleting block [*] file [*]",
}
_PATTERN_ROWS = " UNION ALL ".join(
    f"SELECT '{k}' AS pattern_id, '{v}' AS pattern, '{v.replace('[*]', '%')}' AS shape" for k, v in PATTERNS.items()
)


@check("b18_cross_check", f"""
SELECT pattern_id, pattern, count(event_id) AS n_templates, CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS n_lines
FROM ({_PATTERN_ROWS}) LEFT JOIN mined_templates ON template LIKE shape GROUP BY pattern_id, pattern""")
def b18(spark, sf_dir):
    return templates.cross_check(X.mined(spark, sf_dir).dictionary, PATTERNS)
