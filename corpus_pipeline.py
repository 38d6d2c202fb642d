"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the
columns of ``docs``; the last returns pieces with their places. ``run`` writes every
stage's result as Parquet in the shared folder and reads it again.
"""

import public_tokenizers
from pyspark.sql import functions as F

from blocklens.llm import language, linededup, neardup, packing, quality
from blocklens.llm.queries import QUALITY_THRESHOLD, shared_folder, table
from blocklens.llm.words import free_name, held_out, release
from blocklens.session import ship_package

#: The part of a text's n-grams that its language must hold; the number of languages plays no part.
LANGUAGE_SCORE = 0.5


def keep_quality(spark, docs, sf_dir):
    """Documents whose quality score is at least 0.3; learnt from ``labels`` rows that are not held out."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    model = quality.fit(docs.filter(~held_out()), labels)
    score = free_name("_score", docs)
    return quality.score(docs, model, out=score).filter(F.col(score) >= QUALITY_THRESHOLD).select(*docs.columns)


def keep_language(spark, docs, sf_dir):
    """Documents with a language: some letter, and a language that holds half of the n-grams or more."""
    ship_package(spark)
    filters = language.fit(docs.filter(~held_out()))
    lang, score = free_name("_lang", docs), free_name("_score", docs)
    found = language.predict(docs, filters, out=lang, score=score)
    return found.filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark, docs, sf_dir):
    """Documents without later occurrences of three lines in a row; those that lose every line go."""
    ship_package(spark)
    # Input columns named like the counts that the operator appends step aside.
    own = {c: free_name(f"_own_{c}", docs) for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    found = linededup.dedup(docs.withColumnsRenamed(own)).filter("n_lines = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each group of near-duplicates (five-word shingles, 0.8), that with the smallest id; rows without an id come last."""
    ship_package(spark)
    path, row, group = shared_folder(spark, "near-rows"), free_name("_row", docs), free_name("component_id", docs)
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)  # ids may repeat, numbers fixed by the stored table do not
    groups = neardup.group(rows.select(row, "text"), id_col=row, width=5, percent=80).select(row, F.col("component_id").alias(group))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", row)).alias("first")
    kept = groups.join(rows.select(row, "doc_id"), row).groupBy(group).agg(first).select(F.col("first").getField(row).alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens and their places in sequences."""
    ship_package(spark)
    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The classifier's and the language filter's decisions cannot be told in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    sf_dir = sf_dir.rstrip("/")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
