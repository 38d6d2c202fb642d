import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blocklens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    tool = Tokenizer.from_file(PATH)
    tool.encode_special_tokens = True
    return [e.ids + [0] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_hold_the_tokenizers_ids(spark, odd, odd_rows):
    expected = sorted((r[0] or -1, k, k * 2048, zlib.crc32(np.array(x[k * 2048 : (k + 1) * 2048], "<u4").tobytes())) for r, x in
                      zip(odd_rows, whole([r[1] for r in odd_rows])) for k in range(-(-len(x) // 2048)))
    rows = packing.pack(packing.cut_pieces(odd, PATH)).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["ids_crc32"]) for r in rows) == expected
    check_places(rows)


def test_documents_as_the_library_encodes_them(documents):
    rows = documents.select("doc_id", "text").collect()
    expected = dict(zip((r["doc_id"] for r in rows), whole([r["text"] for r in rows])))
    got = {}
    for r in packing.cut_pieces(documents, PATH, ids=True).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == expected


def test_odd_words_as_the_library_encodes_them():
    import pyarrow as pa

    texts = ["İ. x", "ΑΣ. ΑΣ, é. é.", "don't. we'll, 's", "a.b c.. d,. e", "<|endoftext|> <|startoftext|>.", "x y z. w", "1,2. 3.", "ǅ, ﬁ. ß."]
    ids, first = packing.tokenizer(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [x[:-1] for x in whole(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    patterns = packing.plan(counts, 64)
    used = np.zeros(65, int)
    for held, times in patterns:
        assert sum(held) <= 64 and times > 0
        for x in held:
            used[x] += times
    assert (used == counts).all()
    bins = sum(t for _, t in patterns)
    least = max(-(-sum(lengths) // 64), int(counts[33:].sum()))
    assert bins <= 1.3 * least + 1


def test_plan_is_tight_on_many_lengths():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048), minlength=2049)
    patterns = packing.plan(counts)
    assert sum(t for _, t in patterns) <= 1.002 * (counts @ np.arange(2049)) / 2048 + 1


def test_exact_sums_of_one_two_and_three():
    left = np.zeros(101, int)
    left[[60, 25, 15]] = 1
    assert packing._fill(60, left) == [60]
    assert packing._fill(40, left) == [25, 15]
    assert packing._fill(100, left) == [60, 25, 15]
    assert packing._fill(30, left) is None  # 15 is there once only
    left[10] = 3
    assert packing._fill(30, left) == [10, 10, 10]


def test_clashing_columns_and_no_rows(spark, none):
    pieces = packing.cut_pieces(none, PATH)
    assert packing.pack(pieces).count() == 0
    rows = spark.createDataFrame([(1, 0, 2048, 7, 7)] * 2 + [(None, 0, 5, 7, 7)], "doc_id long, piece int, length long, sequence_id long, offset long")
    assert check_places(packing.pack(rows).collect()) == 3


def test_hot_length_is_cut_into_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 10)
    rows = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "CAST(if(id % 3 = 0, 1000, 1 + id % 50) AS long) AS length")
    out = packing.pack(rows).collect()
    assert len(out) == 1000
    check_places(out)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_only_longer_documents_are_cut(spark, capacity):
    rows = spark.createDataFrame([(1, "a " * 15), (2, "a " * 16)], "doc_id long, text string")
    out = packing.cut_pieces(rows, PATH, capacity=capacity).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {1: 1, 2: 2 if capacity == 16 else 1}


def test_a_full_memory_keeps_the_words_met_again(monkeypatch):
    import pyarrow as pa

    from blocklens.llm import pieces

    monkeypatch.setattr(pieces, "MEMORY", 60)
    tool, learnt = pieces.WordTokenizer(PATH), []
    learn = tool.learn
    monkeypatch.setattr(tool, "learn", lambda words: learnt.extend(words) or learn(words))
    for k in range(30):
        text = " ".join([f"often{'abcdefghij'[i]}" for i in range(10)] + [f"once{chr(97 + k % 26)}{chr(97 + i)}{k}" for i in range(20)])
        ids, _ = tool.encode(pa.array([text, None, text]))
        assert ids.tolist() == whole([text])[0][:-1] * 2
    assert len(learnt) == len(set(learnt)) == 10 + 30 * 20
    assert len(tool.known) <= 60
