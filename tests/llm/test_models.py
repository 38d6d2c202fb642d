import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from blocklens.llm import language, quality
from blocklens.llm.words import held_out


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_is_crc32_of_the_id(spark):
    out = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    model = quality.fit(docs.filter(~held_out()), labels.filter(~held_out()))
    rows = quality.score(docs, model).filter(held_out()).join(labels, "doc_id").select("score", "quality").collect()
    right = np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows])
    assert len(rows) > 50 and right >= 0.97


def test_quality_model_does_not_depend_on_partitions_or_other_columns(larger):
    docs, labels = larger
    a = quality.fit(docs, labels, max_train=100)
    b = quality.fit(docs.repartition(7).drop("lang", "source"), labels.repartition(5), max_train=100)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_leader_matches_a_plain_loop():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 16, 5)), y) for y in rng.integers(0, 2, 40)]
    rows = [(i, np.ones(len(i)) / len(i), int(y)) for i, y in rows]
    z, n, alpha, beta, l1, l2 = [0.0] * 17, [0.0] * 17, 0.5, 1.0, 0.01, 0.1
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else (np.sign(z[k]) * l1 - z[k]) / ((beta + n[k] ** 0.5) / alpha + l2)
    for index, value, y in rows:
        own = [*zip(index, value), (16, 1.0)]
        p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in own)))
        for k, v in own:
            g, w = (p - y) * v, weight(k)
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w
            n[k] += g * g
    w, b = quality.follow_the_leader(rows, 4, alpha, beta, l1, l2, passes=1)
    assert np.allclose(w, [weight(k) for k in range(16)]) and np.isclose(b, weight(16))


def test_features_by_definition():
    index, value, rows, n = quality.features(pa.array(["a a b", "", None, "!!"]))
    assert n == 4 and set(rows) == {0, 3} and np.isclose(np.bincount(rows, value**2, 4), [1, 0, 0, 1]).all()
    assert (rows == 0).sum() == 4  # a (twice), b, and the pairs "same word" and a b
    joined = quality.features(pa.array(["a b", "a b"]))
    assert (joined[0][joined[2] == 0] == joined[0][joined[2] == 1]).all()


def test_quality_of_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(1, 1), (10, 0), (10, 1), (None, 0), (2, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = quality.score(odd, model)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and out.columns == [c for c in odd.columns if c != "score"] + ["score"]
    blank = {r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}
    assert len(blank) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    empty = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_language_on_held_out_rows(larger):
    docs, _ = larger
    filters = language.fit(docs.filter(~held_out()))
    out = language.predict(docs, filters).filter(held_out()).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert out >= 0.99


def set_grams(text):
    """All n-grams of a text's words, by definition, repeated as often as they are there."""
    out = []
    for word in regex.findall(r"[^\x20\x09-\x0D]+", text or ""):
        if regex.search(r"\pL", word):
            letters = " " + regex.sub(r"[^\pL\pM]+", "", word.lower()) + " "
            out += [letters[i : i + n] for n in language.SIZES for i in range(len(letters) - n + 1)]
    return out


def test_language_against_sets(larger):
    """Lookups return every language that holds the n-gram, and decisions are those of plain sets."""
    docs = larger[0].select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if r["text"] is not None]
    learnt = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    sets = {lang: {g for r in learnt if r["lang"] == lang for g in set_grams(r["text"])} for lang in {r["lang"] for r in learnt}}
    filters = language.fit(docs.filter(~held_out()), max_train=10**9)
    assert filters.languages == sorted(sets)
    words = sorted({w for r in rows for w in r["text"].split()})[:3000]
    held = extra = 0
    for word in words:
        grams, owner, n = language.word_grams(pa.array([word]))
        found = filters.holders(grams)[:, 0] if len(grams) else []
        for gram, bits in zip(sorted(set_grams(word), key=len), found):
            for k, lang in enumerate(filters.languages):
                there = bool(int(bits) >> k & 1)
                assert there or gram not in sets[lang]
                held, extra = held + (gram in sets[lang]), extra + (there and gram not in sets[lang])
    assert held > 1000 and extra < 0.02 * held
    got = {r["doc_id"]: r for r in language.predict(docs, filters).collect()}
    wrong = 0
    for r in rows:
        grams = set_grams(r["text"])
        share = sorted(((sum(g in s for g in grams) / max(1, len(grams)), lang) for lang, s in sets.items()), reverse=True)
        if not grams:
            assert got[r["doc_id"]]["lang_pred"] == "und"
        elif share[0][0] - share[1][0] > 0.01:
            assert abs(got[r["doc_id"]]["score"] - share[0][0]) < 0.01
            wrong += got[r["doc_id"]]["lang_pred"] != share[0][1]
    assert wrong == 0


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "e\u0301te\u0301", "fr"), (2, "\u0301\u0302 \u0303", "fr"), (3, "12 \u0301", "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs)).collect()} == {1: "fr", 2: "und", 3: "und"}


def test_filters_hold_what_was_put_in_and_state_their_rate():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 2**63, 4000).astype(np.uint64)
    masks = (np.uint64(1) << (np.arange(4000) % 3).astype(np.uint64))[:, None]
    f = language.SlicedFilters(grams, masks, ["a", "b", "c"])
    held = f.hits(grams, np.arange(4000), 4000)
    assert (held[np.arange(4000), np.arange(4000) % 3] == 1).all()
    owner = np.sort(rng.integers(0, 5, 50_000))
    fresh = f.hits(rng.integers(0, 2**63, 50_000).astype(np.uint64), owner, 5).sum(axis=0) / 50_000
    assert (np.abs(fresh - f.false_rate) < 0.01).all()


def test_more_than_64_languages(spark):
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, f"l{i:03d}") for i in range(100)], "doc_id long, text string, lang string")
    out = language.predict(docs, language.fit(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out)


def test_language_of_odd_rows(spark, odd, none, odd_rows):
    filters = language.fit(odd)
    out = language.predict(odd, filters, score="score")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(odd_rows)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (4, 5, 6, 14))
    assert rows[7]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, filters).count() == 0
