"""Checks of block features, splits and feature selection."""

from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed
from blocklens.operators import features, selection, sparse, splits
from checks import fixtures as X
from checks.registry import check, cte, shared


@check("c1_dropped", """
SELECT count(*) AS rows_read, count(block_id) AS rows_kept, count(*) - count(block_id) AS rows_dropped FROM log_events""")
def c1(spark, sf_dir):
    return features.dropped_rows(X.events(spark, sf_dir))


@shared
def base(spark, sf_dir):
    return features.base_features(features.partial_counts(X.events(spark, sf_dir)))


@check("c2_base_features", """
SELECT block_id, total_log_events, unique_template_count, unique_component_count, event_sequence_length FROM base_features""")
def c2(spark, sf_dir):
    return base(spark, sf_dir).select(
        "block_id", "total_log_events", "unique_template_count", "unique_component_count", "event_sequence_length"
    )


@check("c5_duration", "SELECT block_id, time_duration_seconds FROM base_features")
def c5(spark, sf_dir):
    return base(spark, sf_dir).select("block_id", "time_duration_seconds")


@check("c7_density", "SELECT block_id, round(event_density, 9) AS event_density FROM base_features")
def c7(spark, sf_dir):
    return base(spark, sf_dir).select("block_id", F.round("event_density", 9).alias("event_density"))


@check("c8_levels", "SELECT block_id, info_count, warn_count, error_count, other_count FROM base_features")
def c8(spark, sf_dir):
    return base(spark, sf_dir).select("block_id", "info_count", "warn_count", "error_count", "other_count")


@check("c9_template_counts_long", "SELECT block_id, event_id, n FROM long_counts")
def c9_long(spark, sf_dir):
    return X.long_counts(spark, sf_dir)


_TMPL = [f"tmpl_{e}_count" for e in X.EVENT_IDS]


@check("c9_template_counts_wide", f"SELECT block_id, {', '.join(_TMPL)} FROM block_matrix")
def c9_wide(spark, sf_dir):
    return features.template_counts_wide(X.long_counts(spark, sf_dir), X.event_ids(spark, sf_dir))


_ROUNDED = ", ".join("round(event_density, 9) AS event_density" if f == "event_density" else f for f in X.FEATURES)


@check("c10_feature_matrix", f"SELECT block_id, {_ROUNDED} FROM block_matrix")
def c10(spark, sf_dir):
    return X.matrix(spark, sf_dir).withColumn("event_density", F.round("event_density", 9))


def full_outer_matrix(spark, sf_dir):
    """The matrix with labelled blocks that have no log line: their features are missing."""
    labelled = X.pairs(spark, sf_dir).select("block_id")
    return X.raw_matrix(spark, sf_dir).join(labelled, "block_id", "full_outer")


@check("c11_missing_filled", f"""
SELECT CAST({len(X.FEATURES)} * count(*) AS BIGINT) AS missing_cells FROM score_pairs ANTI JOIN block_matrix USING (block_id)""")
def c11(spark, sf_dir):
    return features.missing_cells(full_outer_matrix(spark, sf_dir))


@check("c12_zero_duration", "SELECT count(*) FILTER (WHERE time_duration_seconds = 0) AS blocks_with_zero_duration FROM base_features")
def c12(spark, sf_dir):
    return features.zero_duration(X.matrix(spark, sf_dir))


def _scaled(f, lo, hi):
    return f"round(CASE WHEN {hi} > {lo} THEN CAST({f} - {lo} AS DOUBLE) / ({hi} - {lo}) ELSE 0.0 END, 9) AS {f}"


_ALL = ", ".join(_scaled(f, f"min({f}) OVER ()", f"max({f}) OVER ()") for f in X.FEATURES)


@check("c13_minmax", f"SELECT block_id, {_ALL} FROM block_matrix")
def c13(spark, sf_dir):
    rows = X.matrix(spark, sf_dir)
    scaled = features.scale_min_max(rows, features.fit_min_max(rows), X.FEATURES)
    return scaled.select("block_id", *[F.round(f, 9).alias(f) for f in X.FEATURES])


_BACK = ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS {f}" for f in X.FEATURES)


@check("c14_inverse", f"SELECT block_id, {_BACK} FROM block_matrix")
def c14(spark, sf_dir):
    rows = X.matrix(spark, sf_dir)
    scaler = features.fit_min_max(rows)
    back = features.unscale_min_max(features.scale_min_max(rows, scaler, X.FEATURES), scaler, X.FEATURES)
    return back.select("block_id", *[F.round(f, 6).alias(f) for f in X.FEATURES])


@check("c15_feature_report", f"""
SELECT (SELECT count(block_id) FROM log_events) AS total_rows_read,
       (SELECT count(*) FROM log_events WHERE block_id IS NOT NULL AND ts IS NULL) AS bad_timestamps,
       count(*) AS total_blocks, count(*) FILTER (WHERE time_duration_seconds = 0) AS blocks_with_zero_duration,
       CAST(0 AS BIGINT) AS missing_value_cells_filled, CAST({len(X.FEATURES)} AS BIGINT) AS total_feature_columns,
       CAST({len(_TMPL)} AS BIGINT) AS template_feature_columns FROM base_features""")
def c15(spark, sf_dir):
    return features.feature_report(X.events(spark, sf_dir), X.raw_matrix(spark, sf_dir))


@check("d1_train_split", "SELECT block_id FROM pair_splits WHERE split = 'train'")
def d1(spark, sf_dir):
    return splits.training_ids(X.pairs(spark, sf_dir))


@check("d2_holdout", "SELECT block_id, label, if_score, ae_score FROM score_pairs JOIN (SELECT block_id FROM pair_splits WHERE split <> 'train') USING (block_id)")
def d2(spark, sf_dir):
    training = X.pair_splits(spark, sf_dir).filter("split = 'train'")
    return splits.holdout(X.pairs(spark, sf_dir), training)


@check("d3_val_test_split", "SELECT block_id, label, split FROM pair_splits")
def d3(spark, sf_dir):
    return splits.assign_splits(X.pairs(spark, sf_dir))


# Order lines as a deliberately overlapping split: one order's lines fall into several parts.
cte("line_splits", """
SELECT concat('blk_', CAST(l_orderkey AS STRING)) AS block_id,
       CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'validation' ELSE 'test' END AS split FROM lineitem""")


@check("d4_leakage", """
SELECT count(*) FILTER (WHERE train > 0 AND validation > 0) AS train_validation_overlap,
       count(*) FILTER (WHERE train > 0 AND test > 0) AS train_test_overlap,
       count(*) FILTER (WHERE validation > 0 AND test > 0) AS validation_test_overlap,
       CAST(sum(greatest(train - 1, 0)) AS BIGINT) AS train_duplicates,
       CAST(sum(greatest(validation - 1, 0)) AS BIGINT) AS validation_duplicates,
       CAST(sum(greatest(test - 1, 0)) AS BIGINT) AS test_duplicates
FROM (SELECT block_id, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
             count(*) FILTER (WHERE split = 'test') AS test FROM line_splits GROUP BY block_id)""")
def d4(spark, sf_dir):
    part = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "validation").otherwise("test")
    rows = X.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("blk_"), F.col("l_orderkey").cast("string")).alias("block_id"), part.alias("split")
    )
    return splits.leakage(rows)


@check("d4_no_leakage", """
SELECT CAST(0 AS BIGINT) AS train_validation_overlap, CAST(0 AS BIGINT) AS train_test_overlap,
       CAST(0 AS BIGINT) AS validation_test_overlap, CAST(0 AS BIGINT) AS train_duplicates,
       CAST(0 AS BIGINT) AS validation_duplicates, CAST(0 AS BIGINT) AS test_duplicates""")
def d4_clean(spark, sf_dir):
    return splits.leakage(X.pair_splits(spark, sf_dir))


@shared
def training_matrix(spark, sf_dir):
    train = X.log_splits(spark, sf_dir).filter("split = 'train'").select("block_id")
    return X.matrix(spark, sf_dir).join(train, "block_id", "left_semi")


cte("train_matrix", "SELECT * FROM block_matrix SEMI JOIN (SELECT block_id FROM log_splits WHERE split = 'train') USING (block_id)")
_CELLS = " UNION ALL ".join(
    f"SELECT block_id, {i} AS i, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM train_matrix" for i, f in enumerate(X.FEATURES)
)
cte("train_cells", _CELLS)
cte("feature_pairs", """
SELECT a.feature AS feature_a, b.feature AS feature_b,
       covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS r
FROM train_cells a JOIN train_cells b ON a.block_id = b.block_id AND a.i < b.i GROUP BY ALL""")
cte("feature_choice", """
SELECT feature, variance, coalesce(n, 0) AS n_correlated, coalesce(n, 0) = 0 AND variance >= 1e-6 AS selected
FROM (SELECT feature, var_samp(v) AS variance FROM train_cells GROUP BY feature)
LEFT JOIN (SELECT feature_b AS feature, count(*) AS n FROM feature_pairs WHERE abs(r) > 0.95 GROUP BY feature_b) USING (feature)""")


@check("d5_correlation", "SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM feature_pairs WHERE r IS NOT NULL")
def d5(spark, sf_dir):
    rows = selection.correlations(training_matrix(spark, sf_dir), X.FEATURES).filter("r IS NOT NULL")
    return rows.select("feature_a", "feature_b", (F.round("r", 6) + 0.0).alias("r"))


@check("d5_selected", "SELECT feature, n_correlated, selected FROM feature_choice")
def d5_selected(spark, sf_dir):
    return selection.selection(training_matrix(spark, sf_dir), X.FEATURES).select("feature", "n_correlated", "selected")


@check("d6_variance", "SELECT feature, CAST(printf('%.8e', variance) AS DOUBLE) AS variance FROM feature_choice")
def d6(spark, sf_dir):
    """Nine significant digits: variances of seconds and of counts differ by many powers of ten."""
    rows = selection.variances(training_matrix(spark, sf_dir), X.FEATURES)
    return rows.select("feature", F.format_string("%.8e", "variance").cast("double").alias("variance"))


@shared
def sparse_index(spark, sf_dir):
    return checkpointed(sparse.feature_index(X.mined(spark, sf_dir).dictionary))


@shared
def sparse_vectors(spark, sf_dir):
    return checkpointed(sparse.block_vectors(X.events(spark, sf_dir), sparse_index(spark, sf_dir)))


def _training(vectors, spark, sf_dir):
    return vectors.join(X.log_splits(spark, sf_dir).filter("split = 'train'").select("block_id"), "block_id", "left_semi")


def _named(cells, spark, sf_dir, *keys):
    index = sparse_index(spark, sf_dir).select("feature", "i")
    for key, name in keys:
        cells = cells.join(index.select(F.col("i").alias(key), F.col("feature").alias(name)), key)
    return cells


_MELTED = " UNION ALL ".join(f"SELECT block_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM block_matrix" for f in X.FEATURES)


@check("c10_sparse_vectors", f"SELECT block_id, feature, round(v, 9) AS value FROM ({_MELTED}) WHERE v <> 0")
def c10_sparse(spark, sf_dir):
    """The same features as sparse vectors: the values that are not 0."""
    cells = _named(sparse_vectors(spark, sf_dir).select("block_id", F.inline("cells")), spark, sf_dir, ("i", "feature"))
    return cells.select("block_id", "feature", F.round("v", 9).alias("value"))


@check("c13_sparse_minmax", f"""
SELECT block_id, feature, round(CAST(v - lo AS DOUBLE) / (hi - lo), 9) AS value FROM (
  SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM ({_MELTED})) WHERE hi > lo AND v > lo""")
def c13_sparse(spark, sf_dir):
    vectors = sparse_vectors(spark, sf_dir)
    scaled = sparse.scale_min_max(vectors, sparse.moments(vectors, sparse_index(spark, sf_dir)))
    cells = _named(scaled.select("block_id", F.inline("cells")), spark, sf_dir, ("i", "feature"))
    return cells.select("block_id", "feature", F.round("v", 9).alias("value"))


@check("d5_sparse_correlation", "SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM feature_pairs WHERE r IS NOT NULL")
def d5_sparse(spark, sf_dir):
    """The correlations from products of cells that occur together."""
    vectors = _training(sparse_vectors(spark, sf_dir), spark, sf_dir)
    found = _named(sparse.correlations(vectors, sparse_index(spark, sf_dir)).filter("r IS NOT NULL"), spark, sf_dir, ("i", "feature_a"), ("j", "feature_b"))
    return found.select("feature_a", "feature_b", (F.round("r", 6) + 0.0).alias("r"))


@check("d5_sparse_selected", "SELECT feature, n_correlated, selected FROM feature_choice")
def d5_sparse_selected(spark, sf_dir):
    """The same features are kept, by looking at strong pairs only."""
    vectors = _training(sparse_vectors(spark, sf_dir), spark, sf_dir)
    found = _named(sparse.selection(vectors, sparse_index(spark, sf_dir)), spark, sf_dir, ("i", "feature"))
    return found.select("feature", "n_correlated", "selected")


@shared
def document_words(spark, sf_dir):
    """Documents as blocks, their lines' first words as events: an index of thousands of features from the table itself."""
    rows = X.text_lines(spark, sf_dir).filter("trim(raw_line) <> ''")
    return checkpointed(rows.select(
        F.col("doc_id").cast("string").alias("block_id"), F.concat(F.lit("W"), F.md5(F.split(F.trim("raw_line"), " ")[0])).alias("event_id"),
        F.lit("text").alias("component"), F.lit("INFO").alias("level"), F.lit("240101000000").alias("ts_raw")))


@check("c10_sparse_documents", r"""
SELECT CAST(doc_id AS VARCHAR) AS block_id, count(*) AS n_templates, CAST(sum(n) AS BIGINT) AS n_lines FROM (
  SELECT doc_id, md5(string_split(trim(line), ' ')[1]) AS word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE trim(line) <> '' GROUP BY ALL) GROUP BY doc_id""")
def c10_documents(spark, sf_dir):
    """Vectors over as many features as documents have first words; no feature is a column."""
    events = document_words(spark, sf_dir)
    index = checkpointed(sparse.feature_index(events.select("event_id").distinct()))
    vectors = sparse.block_vectors(events, index)
    own = F.filter("cells", lambda c: c["i"] >= len(C.BASE_FEATURES))
    total = F.aggregate(own, F.lit(0.0), lambda a, c: a + c["v"])
    return vectors.select("block_id", F.size(own).cast("long").alias("n_templates"), total.cast("long").alias("n_lines"))


_LOCAL = ", ".join(
    _scaled(f, f"(SELECT min({f}) FROM train_matrix)", f"(SELECT max({f}) FROM train_matrix)") for f in C.BASE_FEATURES
)


@check("d7_local_scaler", f"SELECT block_id, {_LOCAL} FROM block_matrix")
def d7(spark, sf_dir):
    columns = list(C.BASE_FEATURES)
    scaler = features.fit_min_max(training_matrix(spark, sf_dir), columns)
    scaled = features.scale_min_max(X.matrix(spark, sf_dir), scaler, columns)
    return scaled.select("block_id", *[F.round(f, 9).alias(f) for f in columns])
