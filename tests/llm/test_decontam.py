import random
import re

import pytest

from blocklens.llm import decontam

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def words(text):
    """(word, first code point, last code point + 1), A-Z lower-cased and nothing else."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = tuple(x[0] for x in words(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(w[i : i + width], set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        found = words(text)
        w, hit, held = tuple(x[0] for x in found), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in windows:
                    hit.update(range(i, i + n))
                    held |= windows[w[i : i + n]]
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1][1] = found[i][2]
            else:
                spans.append([found[i][1], found[i][2]])
        out.append((doc_id, len(w), len(hit), tuple(sorted(held)), tuple(map(tuple, spans))))
    return sorted(out, key=str)


def rows(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["first"], s["last"]) for s in r["spans"])) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet")


def test_against_brute_force(documents, benchmark):
    got = rows(decontam.scan(documents, benchmark))
    assert got == brute([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    assert any(r[2] for r in got) and not all(r[2] for r in got)


@pytest.mark.parametrize("window_bytes", [decontam.WINDOW_BYTES, 120])
def test_short_overlapping_and_repeated_items(spark, window_bytes):
    """Items shorter than a window, one inside another, the same text twice; several automata give the same."""
    rng = random.Random(3)
    sign = lambda: rng.choice([" ", ", ", "\n", " - ", "_", " é ", " \U0001f642 "])
    text = lambda n: "".join(rng.choice(["a", "B", "c1", "Ét", "ét"]) + sign() for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)]
    items = [("x", "a B"), ("y", "A, b"), ("z", "c1"), (None, "a a a a"), ("none", " ... "), ("null", None), ("x", docs[5][1]), ("w", docs[7][1] + " q"), ("v", docs[9][1][:40])]
    found = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window_bytes=window_bytes)
    assert rows(found) == brute(docs, items)


def test_parts_of_words_and_text_borders_are_no_hits(spark):
    item = " ".join(f"w{i}" for i in range(10))
    docs = [(1, item), (2, "x" + item), (3, item + "x"), (4, " ".join(f"w{i}" for i in range(5))), (5, " ".join(f"w{i}" for i in range(5, 10))), (6, item.upper() + "!")]
    found = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect() if r["n_hit"] == 10} == {1, 6} and {r["doc_id"] for r in found.collect() if r["n_hit"]} == {1, 6}


def test_odd_rows(spark, odd, odd_rows, none, benchmark):
    items = [(1, odd_rows[7][1][:4000]), (2, "word " * 12), (3, "a")]
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan(odd, items)
    assert rows(found) == brute([r[:2] for r in odd_rows], [tuple(r) for r in items.collect()])
    assert found.columns[: len(odd.columns)] == odd.columns
    assert decontam.scan(none, items).count() == 0
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in decontam.scan(odd, items.limit(0)).collect())
    clash = spark.createDataFrame([("b a", 7, "k", 5, "t")], "text string, n_hit int, items string, Runs int, _text string")
    assert decontam.scan(clash, items).first().asDict(recursive=True) == {
        "text": "b a", "_text": "t", "n_words": 2, "n_hit": 1, "n_items": 1, "items": ["3"], "runs": [{"first": 1, "last": 2}], "spans": [{"first": 2, "last": 3}]
    }
