"""Input views over the test tables, in Spark and as subqueries of the reference SQL."""

from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed, spread, stored
from blocklens.functions.scoring import normalise_all
from blocklens.operators import features, fusion, lines, splits, templates, triage
from checks.registry import cte, shared

# Log lines shaped from `events`: four files, with blank, malformed and header-less
# lines, bad times, an unknown level, lines without a block id and lines with two.
_LOG_LINES = """
SELECT event_id + 1 AS line_id,
       concat('part', CAST(event_id % 4 AS STRING), '.log') AS file_name,
       CASE
         WHEN event_id % 101 = 0 THEN ''
         WHEN event_id % 97 = 0 THEN concat('garbage line ', CAST(event_id AS STRING))
         WHEN event_id % 89 = 0 THEN concat(d6, ' ', t6, ' 7 INFO message without component')
         ELSE concat(d6, ' ', CASE WHEN event_id % 211 = 0 THEN '999999' ELSE t6 END, ' ',
              CAST(event_id % 400 AS STRING), ' ',
              CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
                              WHEN 'purchase' THEN 'DEBUG' ELSE 'INFO' END,
              ' dfs.', event_type, '$W', CAST(user_id % 3 AS STRING), ': ',
              CASE
                WHEN event_id % 53 = 0 THEN concat('Heartbeat from /', ip)
                WHEN event_type = 'click' THEN concat('Receiving block ', blk, ' src: /', ip, ':',
                     CAST(50000 + event_id % 1000 AS STRING), ' dest: /10.0.0.1:50010')
                WHEN event_type = 'view' THEN concat('Served block ', blk, ' to /', ip)
                WHEN event_type = 'purchase' THEN concat('Received block ', blk, ' of size ',
                     CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING), ' from /', ip)
                WHEN event_type = 'signup' AND event_id % 10 = 3 THEN
                     concat('ask to replicate ', blk, ' blk_', CAST(user_id + 1000 AS STRING))
                WHEN event_type = 'signup' THEN concat('Verification succeeded for ', blk)
                WHEN event_id % 2 = 0 THEN
                     concat('Exception in receiveBlock for block ', blk, ' java.io.IOException: Broken pipe')
                ELSE concat('PendingReplicationMonitor timed out block ', blk)
              END)
       END AS raw_line
FROM (SELECT *, {d6} AS d6, {t6} AS t6,
             concat('blk_', CASE WHEN user_id % 2 = 1 THEN '-' ELSE '' END, CAST(user_id AS STRING)) AS blk,
             concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING)) AS ip
      FROM {events})
"""

_BLOCK_LABELS = """
SELECT concat('blk_', CASE WHEN user_id % 2 = 1 THEN '-' ELSE '' END, CAST(user_id AS STRING)) AS block_id,
       CASE WHEN avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 0.28 OR user_id % 15 = 0
            THEN 'Anomaly' ELSE 'Normal' END AS label
FROM {events} GROUP BY user_id
"""

_PAIRS = """
SELECT concat('blk_', CAST(l_orderkey AS STRING)) AS block_id,
       CASE WHEN max(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) = 1
            THEN 'Anomaly' ELSE 'Normal' END AS label,
       round((max(l_quantity) - 1) / 49, 6) AS if_score,
       round(max(l_extendedprice) / 105000, 6) AS ae_score
FROM {lineitem} GROUP BY l_orderkey
"""

_ATTRIBUTIONS = """
SELECT block_id, model, feature, avg(phi) AS phi, max(value) AS value FROM (
  SELECT concat('blk_', CAST(l_orderkey AS STRING)) AS block_id,
         CASE WHEN l_linenumber % 2 = 0 THEN 'ae' ELSE 'if' END AS model,
         CASE WHEN l_partkey % 5 = 0 THEN 'event_density'
              ELSE concat('tmpl_E', CAST(l_partkey % 48 + 1 AS STRING), '_count') END AS feature,
         l_discount - 0.05 + l_partkey / 1000000 AS phi, l_quantity AS value
  FROM {lineitem}) GROUP BY block_id, model, feature
"""

_TEXT_LINES_DUCK = """
SELECT doc_id, source AS file_name, n - 1 AS line_no, string_split(text, chr(10))[n] AS raw_line
FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
"""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark, sf_dir, sql, **names):
    sources = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "lineitem")}
    return spark.sql(sql.format(**{**sources, **names}))


@shared
def log_lines(spark, sf_dir):
    # Events are dealt out before they become lines, which are much longer.
    spread(table(spark, sf_dir, "events")).createOrReplaceTempView("spread_events")
    rows = _view(spark, sf_dir, _LOG_LINES, events="spread_events", d6="date_format(ts, 'yyMMdd')", t6="date_format(ts, 'HHmmss')")
    return checkpointed(rows)


def block_labels(spark, sf_dir):
    return _view(spark, sf_dir, _BLOCK_LABELS)


def dirty_labels(spark, sf_dir):
    """Labels with a padded and an unknown value."""
    extra = spark.createDataFrame([("blk_x", " Normal "), ("blk_y", "Unknown")], "block_id string, label string")
    return block_labels(spark, sf_dir).unionByName(extra)


@shared
def pairs(spark, sf_dir):
    return checkpointed(_view(spark, sf_dir, _PAIRS))


def attributions(spark, sf_dir):
    return _view(spark, sf_dir, _ATTRIBUTIONS)


def text_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.col("source").alias("file_name"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw_line"),
    )


def vectors(spark, sf_dir):
    """Embeddings as feature columns; label 0 plays the anomaly."""
    rows = spread(table(spark, sf_dir, "embeddings"))
    wide = [F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(64)]
    label = F.when(F.col("label") == 0, C.ANOMALY).otherwise(C.NORMAL)
    return rows.select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("block_id"), label.alias("label"), *wide)


# Derived tables used by many checks.


@shared
def parsed(spark, sf_dir):
    """Parsed lines with their signatures, stored: no later step evaluates an expression over raw lines again."""
    return stored(templates.with_signature(lines.parse_headers(log_lines(spark, sf_dir))))


@shared
def mined(spark, sf_dir):
    return templates.mine_templates(parsed(spark, sf_dir))


@shared
def events(spark, sf_dir):
    return templates.assign_events(parsed(spark, sf_dir), mined(spark, sf_dir))


@shared
def event_ids(spark, sf_dir):
    return sorted(r.event_id for r in mined(spark, sf_dir).dictionary.select("event_id").collect())


@shared
def long_counts(spark, sf_dir):
    return features.template_counts_long(features.partial_counts(events(spark, sf_dir)))


@shared
def raw_matrix(spark, sf_dir):
    """Feature matrix before missing values are filled."""
    return checkpointed(features.feature_matrix(events(spark, sf_dir), event_ids(spark, sf_dir)))


@shared
def matrix(spark, sf_dir):
    return features.fill_missing(raw_matrix(spark, sf_dir))


@shared
def log_splits(spark, sf_dir):
    blocks = matrix(spark, sf_dir).select("block_id").join(block_labels(spark, sf_dir), "block_id")
    return checkpointed(splits.assign_splits(blocks))


@shared
def pair_splits(spark, sf_dir):
    return checkpointed(splits.assign_splits(pairs(spark, sf_dir)))


@shared
def log_alerts(spark, sf_dir):
    """Log blocks with simple scores that every engine can recompute."""
    base = matrix(spark, sf_dir).select("block_id", "event_density", "error_count")
    scored = normalise_all(base, "event_density", "if_score")
    scored = normalise_all(scored, "error_count", "ae_score")
    fused = fusion.fuse(scored.drop("event_density", "error_count"), "if_score", "ae_score")
    return triage.with_severity(fused)


@shared
def fused_pairs(spark, sf_dir):
    return triage.with_severity(fusion.fuse(pairs(spark, sf_dir), "if_score", "ae_score"))


# The same views for the reference SQL.

_DUCK = {
    "events": "events",
    "lineitem": "lineitem",
    "d6": "strftime(ts, '%y%m%d')",
    "t6": "strftime(ts, '%H%M%S')",
}
HEADER = C.HEADER
_X = lambda i: f"regexp_extract(raw_line, '{HEADER}', {i})"

cte("log_lines", _LOG_LINES.format(**_DUCK))
cte("block_labels", _BLOCK_LABELS.format(**_DUCK))
cte("dirty_labels", """
SELECT block_id, trim(label) AS label FROM block_labels
UNION ALL SELECT 'blk_x', 'Normal' UNION ALL SELECT 'blk_y', 'Unknown'""")
cte("score_pairs", _PAIRS.format(**_DUCK))
cte("attributions", _ATTRIBUTIONS.format(**_DUCK))
cte("text_lines", _TEXT_LINES_DUCK)
cte("parsed_lines", f"""
SELECT *, concat(date, time) AS ts_raw, try_strptime(concat(date, time), '%y%m%d%H%M%S') AS ts,
       nullif(regexp_extract(content, '{C.BLOCK_ID}', 0), '') AS block_id
FROM (SELECT line_id, file_name, raw_line, {_X(1)} AS date, {_X(2)} AS time, {_X(3)} AS pid, {_X(4)} AS level,
             {_X(5)} AS component, {_X(6)} AS content
      FROM log_lines WHERE regexp_matches(raw_line, '{HEADER}'))""")


def duck_mask(col: str) -> str:
    for rx, name in C.MASKS:
        col = f"regexp_replace({col}, '{rx}', '{name}', 'g')"
    return col


cte("signed_lines", f"""
SELECT *, array_to_string(list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS signature
FROM (SELECT *, string_split_regex(trim(replace({duck_mask('content')}, '_', ' ')), '\\s+') AS tokens FROM parsed_lines)""")
# The planted message families never merge, so signatures are the templates.
cte("mined_templates", """
SELECT concat('E', CAST(row_number() OVER (ORDER BY first_line) AS STRING)) AS event_id, signature AS template,
       n_lines, first_line
FROM (SELECT signature, count(*) AS n_lines, min(line_id) AS first_line FROM signed_lines GROUP BY signature)""")
cte("log_events", """
SELECT s.*, m.event_id, m.template AS event_template FROM signed_lines s JOIN mined_templates m ON s.signature = m.template""")
cte("long_counts", """
SELECT block_id, event_id, count(*) AS n FROM log_events WHERE block_id IS NOT NULL GROUP BY block_id, event_id""")
cte("base_features", """
SELECT *, total_log_events AS event_sequence_length, total_log_events / (time_duration_seconds + 1e-6) AS event_density
FROM (SELECT block_id, count(*) AS total_log_events, count(DISTINCT event_id) AS unique_template_count,
             count(DISTINCT component) AS unique_component_count,
             CAST(greatest(coalesce(epoch(max(ts)) - epoch(min(ts)), 0), 0) AS DOUBLE) AS time_duration_seconds,
             count(*) FILTER (WHERE upper(level) = 'INFO') AS info_count,
             count(*) FILTER (WHERE upper(level) = 'WARN') AS warn_count,
             count(*) FILTER (WHERE upper(level) = 'ERROR') AS error_count,
             count(*) FILTER (WHERE upper(level) NOT IN ('INFO', 'WARN', 'ERROR')) AS other_count
      FROM log_events WHERE block_id IS NOT NULL GROUP BY block_id)""")
EVENT_IDS = [f"E{i}" for i in range(1, 9)]
FEATURES = list(C.BASE_FEATURES) + [f"tmpl_{e}_count" for e in EVENT_IDS]
_WIDE = ", ".join(f"sum(CASE WHEN event_id = '{e}' THEN n END) AS tmpl_{e}_count" for e in EVENT_IDS)
cte("wide_counts", f"SELECT block_id, {_WIDE} FROM long_counts GROUP BY block_id")
_CELLS = ", ".join(f"coalesce(CAST(tmpl_{e}_count AS BIGINT), 0) AS tmpl_{e}_count" for e in EVENT_IDS)
cte("block_matrix", f"SELECT b.block_id, {', '.join(C.BASE_FEATURES)}, {_CELLS} FROM base_features b LEFT JOIN wide_counts USING (block_id)")


def duck_splits(source: str) -> str:
    """Exact-count splits by hash order; ``source`` has block_id and label."""
    return f"""
SELECT block_id, label, CASE WHEN train THEN 'train'
         WHEN row_number() OVER (PARTITION BY train, label ORDER BY h, block_id)
              <= floor(0.5 * count(*) OVER (PARTITION BY train, label)) THEN 'validation'
         ELSE 'test' END AS split
FROM (SELECT *, label = 'Normal' AND row_number() OVER (PARTITION BY label ORDER BY h, block_id)
                <= floor(0.8 * count(*) OVER (PARTITION BY label)) AS train
      FROM (SELECT block_id, label, md5(concat(block_id, '|42')) AS h FROM {source}))"""


cte("log_labelled", "SELECT block_id, label FROM block_matrix JOIN block_labels USING (block_id)")
cte("log_splits", duck_splits("log_labelled"))
cte("pair_splits", duck_splits("score_pairs"))
_SEVERITY = """CASE WHEN fusion_score >= 0.75 THEN 'CRITICAL' WHEN fusion_score >= 0.323459 THEN 'HIGH'
  WHEN fusion_score >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END"""
_DECIDED = f"""
SELECT *, CASE WHEN fusion_score >= 0.323459 THEN 'Anomaly' ELSE 'Normal' END AS fusion_prediction, {_SEVERITY} AS severity
FROM (SELECT *, CAST(0.1 AS DOUBLE) * if_score + CAST(0.9 AS DOUBLE) * ae_score AS fusion_score FROM {{source}})"""
cte("fused_pairs", _DECIDED.format(source="score_pairs"))
cte("log_scores", """
SELECT block_id, (event_density - min(event_density) OVER ()) / (max(event_density) OVER () - min(event_density) OVER ()) AS if_score,
       CAST(error_count - min(error_count) OVER () AS DOUBLE) / (max(error_count) OVER () - min(error_count) OVER ()) AS ae_score
FROM block_matrix""")
cte("log_alerts", _DECIDED.format(source="log_scores"))
cte("first_seen", """
SELECT block_id, try_strptime(min(ts_raw), '%y%m%d%H%M%S') AS first_seen
FROM parsed_lines WHERE block_id IS NOT NULL GROUP BY block_id""")
