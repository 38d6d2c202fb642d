import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.operators import templates
from checks import fixtures as X


def content(spark, *texts):
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "line_id long, content string")


def mapping(mined):
    return {r.event_id: r.template for r in mined.dictionary.collect()}


def test_positions_that_differ_become_wildcards(spark):
    mined = templates.mine_templates(content(
        spark, "user alice logged in", "user bob logged in", "disk full on node", "user carol logged out"))
    assert mapping(mined) == {"E1": "user <*> logged <*>", "E2": "disk full on node"}


def test_unlike_lines_of_one_leaf_stay_apart(spark):
    mined = templates.mine_templates(content(spark, "a b c d e", "a x y z w", "a b c d f"))
    assert mapping(mined) == {"E1": "a b c d <*>", "E2": "a x y z w"}


def test_result_ignores_row_order_and_partitions(spark, data):
    rows = X.parsed(spark, data).select("line_id", "content")
    expected = mapping(X.mined(spark, data))
    shuffled = rows.orderBy(F.xxhash64("line_id")).repartition(7)
    assert mapping(templates.mine_templates(shuffled)) == expected


def text_rows(spark, data):
    rows = X.text_lines(spark, data).filter("trim(raw_line) <> ''")
    return rows.select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_id"), F.col("raw_line").alias("content"))


@pytest.mark.parametrize("options", [{}, {"max_children": 5}, {"max_children": 2}])
def test_every_line_matches_exactly_one_template(spark, data, options):
    rows = text_rows(spark, data)
    mined = templates.mine_templates(rows, **options)
    events = templates.assign_events(rows, mined)
    assert events.filter("event_id IS NULL").count() == 0
    assert events.count() == rows.count()
    assert events.groupBy("event_id").agg(F.count_distinct("event_template").alias("n")).filter("n > 1").count() == 0
    fits = F.forall(
        F.zip_with(F.split("signature", " "), F.split("event_template", " "), lambda a, b: (a == b) | (b == C.WILDCARD)), lambda x: x)
    again = templates.with_signature(events)
    assert again.filter(~fits).count() == 0
    assert mined.dictionary.agg(F.sum("n_lines")).first()[0] == rows.count()


def test_large_leaf_streams_through_batches(spark):
    """Mixed families of one leaf merge alike whether its signatures come in one batch or in many."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    kinds = ["open file for user {}", "open door {} is shut", "open {} of the day", "open file {} by user"]
    rows = content(spark, *[kinds[i % 4].format(w) for i, w in enumerate(words)])
    found = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(mapping(templates.mine_templates(rows)))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
    assert all(sum(k.replace("{}", C.WILDCARD) == t for t in found[0].values()) <= 1 for k in kinds)
    assert len(found[0]) < 20


def test_partitions_and_hot_leaf_give_one_dictionary(spark):
    """A leaf with most signatures: the same templates and members however rows are dealt out."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(3000)]
    rows = [f"open file {w} for user {words[-i]} now" for i, w in enumerate(words)] + [f"{w} closed by the last user" for w in words[:300]]
    rows += [f"open door {w} of {words[-i]} is shut" for i, w in enumerate(words[:200])]
    lines = content(spark, *rows)
    found = []
    for parts in (1, 9):
        mined = templates.mine_templates(lines.repartition(parts))
        members = sorted(tuple(r) for r in mined.signatures.collect())
        assert len(members) == len(set(rows)) == len({m[0] for m in members})
        found.append((mapping(mined), members))
    assert found[0] == found[1]
    assert "open file <*> for user <*> now" in found[0][0].values() and "open door <*> of <*> is shut" in found[0][0].values()


def brute_match(tokens, dictionary, threshold):
    best = None
    for event_id, like, key, seen in dictionary:
        if len(like) == len(tokens) and key in (tokens[0], C.WILDCARD):
            same = sum(a == b and a != C.WILDCARD for a, b in zip(like, tokens))
            wild = like.count(C.WILDCARD)
            if same + wild == len(tokens) if threshold is None else same / len(tokens) >= threshold:
                best = max(best or (-1,), (same / len(tokens), wild, -seen, event_id))
    return best and best[3]


@pytest.mark.parametrize("threshold", [None, 0.4, 0.75, 1.0])
def test_match_index_against_brute_force(spark, threshold):
    rng = random.Random(5)
    line = lambda n: [rng.choice(["a", "b", "c", "d", "the", "the", C.WILDCARD]) for _ in range(n)]
    dictionary = {}
    for i in range(150):
        tokens = line(rng.randint(1, 6))
        dictionary.setdefault(tuple(tokens), (f"E{i}", tokens, tokens[0] if rng.random() < 0.6 else C.WILDCARD, i))
    dictionary = list(dictionary.values())
    table = spark.createDataFrame([(e, len(t), k, t, s) for e, t, k, s in dictionary], "event_id string, n_tok int, key0 string, tokens array<string>, first_line long")
    sigs = {" ".join(t): t for t in (line(rng.randint(1, 7)) for _ in range(400))}
    rows = spark.createDataFrame([(s, len(t), t[0], t) for s, t in sigs.items()], "signature string, n_tok int, key0 string, tokens array<string>")
    got = {r.signature: r.event_id for r in templates.match_by_index(rows, table, threshold).collect()}
    assert got == {s: brute_match(t, dictionary, threshold) for s, t in sigs.items()}
    assert any(got.values())


def test_index_of_many_templates_under_the_wildcard_leaf(spark):
    """50,000 templates of one leaf: postings are rows of a table, no row carries the leaf."""
    n = 50_000
    entry = spark.range(n).select(
        F.concat(F.lit("E"), "id").alias("event_id"), F.lit(6).alias("n_tok"), F.lit(C.WILDCARD).alias("key0"),
        F.array(F.lit(C.WILDCARD), F.lit("sees"), F.concat(F.lit("w"), F.col("id") % 250), F.lit("and"), F.concat(F.lit("v"), F.floor(F.col("id") / 250)), F.lit("there")).alias("tokens"),
        F.col("id").alias("first_line"))
    rows = spark.range(0, n, 25).select("id", F.concat_ws(" ", F.lit("x"), F.lit("sees"), F.concat(F.lit("w"), F.col("id") % 250), F.lit("and"), F.concat(F.lit("v"), F.floor(F.col("id") / 250)), F.lit("there")).alias("signature"))
    rows = rows.withColumn("tokens", F.split("signature", " ")).withColumns({"n_tok": F.lit(6), "key0": F.lit("x")})
    got = templates.match_by_index(rows, entry)
    assert got.filter(F.col("event_id") != F.concat(F.lit("E"), "id")).count() == 0 and got.filter("event_id IS NULL").count() == 0


def test_rerun_continues_a_dictionary(spark):
    first = templates.mine_templates(content(spark, "disk full on node", "user alice logged in"))
    again = templates.mine_templates(content(spark, "user bob logged in", "fan stopped"), first.dictionary)
    assert mapping(again) == {"E1": "disk full on node", "E2": "user <*> logged in", "E3": "fan stopped"}
    counts = {r.event_id: r.n_lines for r in again.dictionary.collect()}
    assert counts == {"E1": 0, "E2": 1, "E3": 1}


def test_matching_leaves_strangers_unmatched(spark):
    mined = templates.mine_templates(content(spark, "user alice logged in", "user bob logged in"))
    found = templates.match_templates(content(spark, "user carol logged in", "user x y z", "fan stopped"), mined.dictionary)
    assert [(r.event_id, r.matched) for r in found.orderBy("line_id").collect()] == [("E1", True), (None, False), (None, False)]


def test_wildcard_first_token_shares_a_leaf(spark):
    mined = templates.mine_templates(content(spark, "10 files moved", "25 files moved", "x1 jobs left"))
    assert mapping(mined) == {"E1": "<*> files moved", "E2": "<*> jobs left"}


def test_first_tokens_beyond_the_limit_share_a_leaf(spark):
    rows = content(spark, *[f"{w} went to sleep" for w in ("anna", "ben", "cleo", "dan")])
    assert set(mapping(templates.mine_templates(rows)).values()) == {f"{w} went to sleep" for w in ("anna", "ben", "cleo", "dan")}
    few = templates.mine_templates(rows, max_children=2)
    assert set(mapping(few).values()) == {"anna went to sleep", "<*> went to sleep"}


def test_cross_check_quotes_literals(spark):
    mined = templates.mine_templates(content(spark, "a.b (c) done", "axb (c) done"))
    got = {r.pattern_id: r.n_templates for r in templates.cross_check(
        mined.dictionary, {"P1": "a.b (c)[*]", "P2": "[*](c)[*]"}).collect()}
    assert got == {"P1": 1, "P2": 2}


def test_unlike_signatures_of_a_leaf_are_looked_up(monkeypatch):
    """Signatures that are alike in common words only meet few templates each, and find the same ones as by comparing all."""
    rng = random.Random(5)
    tokens = [[f"w{i}_{rng.randrange(3 if i < 3 else 900)}" for i in range(12)] for _ in range(4_000)]
    codes = templates._token_codes(np.concatenate(tokens)).reshape(4_000, 12)
    wild = int(templates._token_codes([C.WILDCARD])[0])
    leaf, whole = (templates._Leaf(0.4, wild, 12) for _ in range(2))
    found = leaf.add(tokens, codes, [None] * 4_000)
    monkeypatch.setattr(templates, "TAIL", 1 << 40)
    assert whole.add(tokens, codes, [None] * 4_000) == found and leaf.texts == whole.texts
    assert leaf.compared < whole.compared / 5


def test_mining_free_text_writes_little_more_than_the_text(spark, tmp_path):
    """What is stored while lines that hardly merge are mined: a few times their text, not some for each token and step."""
    from blocklens.functions import scale

    rng = np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(3_000)])
    lines = [" ".join(rng.choice(words, 12)) for _ in range(12_000)]
    table = spark.createDataFrame(list(enumerate(lines)), "line_id long, content string").repartition(4)
    folder = Path(scale._checkpoint_folder(spark).removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = used()
    mined = templates.mine_templates(table)
    assert used() - before < 4 * sum(map(len, lines))
    assert mined.dictionary.agg(F.sum("n_lines")).first()[0] == len(lines)
    assert mined.signatures.filter("event_id IS NULL").count() == 0
