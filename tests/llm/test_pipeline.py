from functools import reduce

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blocklens.llm import language, quality
from blocklens.llm.words import held_out
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_packing import check_places, whole


def test_run_against_brute_force(spark, data):
    """Each stage's result is worked out again by brute force from what the stage before it kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").filter(~held_out())
    scored = quality.score(docs, quality.fit(docs.filter(~held_out()), labels)).filter("score >= 0.3").drop("score")
    named = language.predict(scored, language.fit(scored.filter(~held_out())), out="l", score="s").filter((F.col("l") != "und") & (F.col("s") >= corpus_pipeline.LANGUAGE_SCORE))
    rows = {r["doc_id"]: r["text"] for r in named.collect()}
    lines = {i: v for i, v in brute_lines(list(rows.items())).items() if v[1] == 0 or v[2] < v[1]}
    groups = brute_groups([(i, v[0]) for i, v in lines.items()], 5)
    kept = sorted(i for i, (_, c) in groups.items() if c == i)
    lengths = dict(zip(kept, (len(x) for x in whole([lines[i][0] for i in kept]))))
    out = corpus_pipeline.run(spark, data).collect()
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths
    check_places(out)


def test_stages_keep_the_columns_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "line_dedup", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    clean = corpus_pipeline.keep_quality(spark, docs, data).join(labels.filter("quality = 1"), "doc_id").count()
    assert clean == labels.filter("quality = 1").join(docs, "doc_id").count()
    assert corpus_pipeline.keep_language(spark, docs, data).count() >= 0.99 * docs.filter(F.col("text").rlike(r"\pL")).count()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows(spark, data, request, rows):
    docs = request.getfixturevalue(rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    pieces = corpus_pipeline.pack(spark, docs, data)
    assert (pieces.count() > 0) == (rows == "odd")


def test_stages_keep_columns_of_any_name(spark, data):
    """Names that helper columns have too stay as they are."""
    names = ["_score", "_lang", "_row", "row", "component_id", "kept", "_id", "id", "drop", "_drop", "_own", "_at", "at", "_gone", "_text", "h", "nid", "n_lines", "n_removed", "first"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() > 0, name
        wrong = [F.col(n) != F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names]
        assert out.filter(reduce(lambda a, b: a | b, wrong)).count() == 0, name
    assert corpus_pipeline.pack(spark, docs, data).count() > 0


def test_lines_stage_updates_length_and_drops_emptied(spark, data):
    rows = [(1, "a\nb\nc\nd", 7), (2, "a\nb\nc", 5), (3, "a\nb\nc\ne", 7), (4, "", 0), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, data).collect()}
    assert out == {1: ("a\nb\nc\nd", 7), 3: ("e", 1), 4: ("", 0), 5: (None, None)}


def test_near_duplicates_stage_decides_by_row(spark, data):
    """Ids that repeat: a clean text stays though another row of its id goes, and of exact repeats one stays."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(100)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a + " end"), (3, c), (3, c), (None, a), (None, d), (None, d), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect())
    assert out == [(0, d), (1, a), (2, b), (3, c), (4, ""), (4, "")]
