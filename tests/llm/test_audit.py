import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from blocklens.llm import audit

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/matrix"


def brute(docs, labels):
    """Apply the filters one after the other in each order; docs: (id, text, lang)."""
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    smallest, rows = {}, []
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and i > smallest[text]
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, steps, over = [r for r in rows if r[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                over[f] += len(gone)
                steps.append(("".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, *s, over[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def rows_of(out):
    assert out.columns == NAMES and [t for _, t in out.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    return sorted(tuple(r) for r in out.collect())


def test_against_brute_force(spark, documents, data, folder):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    assert rows_of(audit.audit(documents, labels, folder)) == brute(docs, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_borders_of_every_filter(spark, folder):
    rng = random.Random(8)
    docs = []
    for i in range(400):
        n, kinds = rng.choice([0, 1, 99, 100, 101, 125]), rng.choice([1.0, 0.8, 0.79])
        w = [f"w{k}" for k in range(max(1, round(n * kinds)))]
        text = " ".join((w * 2)[:n])
        text += rng.choice(["", "", " A", "\x1c", "#", "|", " ÉÉ", "A" * (len(text) // 9), "A" * (len(text) // 10)])
        docs.append((rng.choice([i, i // 2, None]), rng.choice([text, text, None, ""]), rng.choice(["en", "de", None, ""])))
    labels = [(rng.randint(0, 300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    assert rows_of(audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder)) == brute(docs, labels)


def test_odd_rows(spark, odd, odd_rows, none, folder):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = [(r[0], r[1], r[2]) for r in odd_rows]
    assert rows_of(audit.audit(odd, labels, folder)) == brute(docs, [tuple(r) for r in labels.collect()])
    assert audit.audit(none, labels, folder + "2").count() == 0
    clash = spark.createDataFrame([(1, "a A", "en", 5, 6, "x", "y")], "doc_id long, text string, lang string, id int, part int, _digest string, mask string")
    assert rows_of(audit.audit(clash, labels.limit(0), folder + "3")) == brute([(1, "a A", "en")], [])


def test_matrix_is_the_document_term_matrix(spark, documents, folder):
    """Every row of the encoded shards spells its document's word counts; the dictionary has no gaps."""
    found, known = audit.matrix(documents.repartition(6), folder, keep=("doc_id",))
    words = {r["code"]: r["word"] for r in known.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    seen = 0
    for shard in found.collect():
        starts, gaps, counts = np.frombuffer(shard["starts"], "<u4"), np.frombuffer(shard["gaps"], "<i8"), np.frombuffer(shard["counts"], "<u4")
        columns = audit.columns_of(gaps, starts.astype(int))
        for k, row in enumerate(shard["rows"]):
            own = slice(starts[k], starts[k + 1])
            got = {words[c]: n for c, n in zip(columns[own].tolist(), counts[own].tolist())}
            assert got == Counter(re.findall(r"[^\x20\x09-\x0D]+", texts[row["doc_id"]]))
            seen += 1
    assert seen == len(texts)


@pytest.mark.parametrize("hashed", ["length", "xxhash64"])
def test_words_that_share_a_hash_get_numbers_of_their_own(spark, folder, hashed):
    """Word lists are sorted by a hash, not by words; with lengths as hashes nearly all words share one, across batches too."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    lists = [(k, rng.sample([f"w{i}" for i in range(3000)], 900)) for k in range(30)]
    local = spark.createDataFrame(lists, "shard long, words array<string>")
    found = audit.encoded(local, f"{folder}/{hashed}", lambda c: getattr(F, hashed)(c).cast("long")).collect()
    words = {(r["part"], r["rank"]): r["word"] for r in found if r["word"] is not None}
    every = {w for _, ws in lists for w in ws}
    assert sorted(words.values()) == sorted(every) and len(words) == len(every)
    for part in {p for p, _ in words}:
        assert sorted(r for p, r in words if p == part) == list(range(sum(p == part for p, _ in words)))
    listed = {}
    for r in found:
        if r["shard"] is not None:
            for at, rank in zip(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["ranks"], "<u4")):
                listed[r["shard"], int(at)] = words[r["part"], int(rank)]
    assert listed == {(k, i): w for k, ws in lists for i, w in enumerate(ws)}
