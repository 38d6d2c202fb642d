"""Registered queries of the operators in this folder, over whole tables with production parameters."""

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import functions as F

from blocklens.llm import audit, bytebpe, decontam, fingerprints, language, licenses, linededup, neardup, packing, quality, rules, trie, warc
from blocklens.llm.oracles import ORACLES  # noqa: F401
from blocklens.llm.words import held_out

QUERIES = {}

QUALITY_THRESHOLD = 0.3


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark, name):
    """A new folder under the cluster's ``spark.checkpoint.dir``; local sessions without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="blocklens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def op1_fingerprints(spark, sf_dir):
    """Fingerprint of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprints.with_next(docs, values=["text", "own"], make=lambda dealt: fingerprints.with_fingerprint(dealt, out="own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(edited)).alias("edited"), "own", "next_own")
    rows = fingerprints.with_fingerprint(rows, "edited", "changed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written(F.col("own")).alias("fingerprint"),
        fingerprints.written(F.col("changed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


@query
def op2_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query
def op3_line_dedup(spark, sf_dir):
    """What line dedup leaves of every document."""
    rows = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


@query
def op4_warc(spark, sf_dir):
    """Every page archived, revisits of equal payloads resolved, and the archives read back."""
    raw, clean = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc-deduplicated")
    warc.archive(table(spark, sf_dir, "pages"), raw)
    warc.resolve(spark, raw, clean, min_bytes=0)
    return warc.read_records(spark, clean).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_quality(spark, sf_dir):
    """Quality score of every document by a model learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality.score(docs, model).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@query
def op6_language(spark, sf_dir):
    """Language of every document by filters learnt from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    filters = language.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), filters).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_quality_rules(spark, sf_dir):
    """Base measures of every document and the verdict of the rule cascade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = rules.ranked(rules.trial(docs))
    out = rules.cascade(docs, order, report=rules.BASE)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *rules.BASE, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


@query
def op8_byte_bpe(spark, sf_dir):
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bytebpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_near_duplicates(spark, sf_dir):
    """Component of every document under 0.8 similarity of two-word shingles."""
    return neardup.group(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


@query
def op10_licenses(spark, sf_dir):
    """License notices found in every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))



@query
def op11_contamination(spark, sf_dir):
    """Words of every document inside windows of benchmark items, and the items whose windows occur."""
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, (F.col("n_hit") > 0).alias("contaminated"))


@query
def op12_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_filter_audit(spark, sf_dir):
    """What five filters remove in each of their orders, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shared_folder(spark, "term-matrix"))
