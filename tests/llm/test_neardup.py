import random
import re

import numpy as np
import pyarrow as pa
import pytest

from blocklens.llm import neardup


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                top[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(df, **kw):
    rows = neardup.group(df, **kw).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}, rows


@pytest.mark.parametrize("width", [2, 5])
def test_documents_against_brute_force(documents, width):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got, out = found(documents, width=width)
    assert got == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_chains_and_families(spark):
    """Copies of copies, each a little further on: linked along the chain, not end to end."""
    rng = random.Random(8)
    rows, doc_id = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(15):
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
            for k in rng.sample(range(120), rng.choice([2, 4, 6])):
                words[k] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    got, _ = found(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    expected = brute(rows, 2)
    assert len({c for _, c in expected.values()}) >= 12
    wrong = [i for i in expected if got[i] != expected[i]]
    assert len(wrong) <= 2  # a pair right at 0.8 shares no table with a chance of 4e-4


def test_one_large_group(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(400):
        words = base[:]
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(50))) for i in range(200)]
    got, _ = found(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert {got[i][1] for i in range(400)} == {0} and all(got[i][1] == i for i in got if i >= 1000)


def test_collections_by_definition():
    keys, starts = neardup.shingles(pa.array(["a b c d", "c d a b", "a"]), 2)
    assert np.diff(starts).tolist() == [3, 3, 1]
    sig = neardup.collections(keys, starts, side=2, rows=1)
    own = keys[starts[0] : starts[1]]
    for j in range(4):
        assert sig[0, j] == neardup.mixed(np.array([neardup.mixed(own, 100 + j).min()]), 0)[0]


def test_odd_rows(spark, odd, odd_rows, none):
    got, out = found(odd, width=5)
    assert len(out) == len(odd_rows)
    known = [(r[0], r[1]) for r in {(r[0], r[1]) for r in odd_rows} if r[0] is not None]
    expected = brute(known, 5)
    assert all(got[i] == expected[i] for i, _ in known)
    blank = [r for r in out if r["n_shingles"] == 0]
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in blank)
    assert [r["component_id"] for r in out if r["doc_id"] is None and r["n_shingles"]] == [1]
    assert neardup.group(none).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, component_id int, node string")
    assert neardup.group(clash).first()["component_id"] == 1


def test_links_found_in_mixed_tables(spark):
    """b is held against a first (its best pivot) and refused; its link to c must still be found."""
    words = [f"w{k}" for k in range(100)]
    a = words[:]
    c = words[:]
    for k in (3, 23, 43, 63):
        c[k] = f"c{k}"
    b = c[:]
    for k in (13, 33, 53, 73):
        b[k] = f"b{k}"
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(c))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), width=2)[0] == brute(rows, 2)


def tables_of(text):
    sig = neardup.collections(*neardup.shingles(pa.array([text]), 2))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([sig[0].tobytes()], pa.binary())], names=["nid", "sig"])
    return set(next(neardup.key_batches([batch]))[0].tolist())


def test_links_found_in_tables_of_two(spark):
    """a and b (0.80) meet in tables of their own only, and b shares more tables with c, linked or refused.

    Where b has the largest number, it is held against c first. Every a shares a table with its b, so none may be missed.
    """
    rng = random.Random(10)
    rows, made = [], {4: 0, 6: 0}
    while min(made.values()) < 8:
        for differ in made:  # 4 words: 0.84, 6 words: 0.76
            b = [f"w{rng.randrange(10**9)}" for _ in range(91)]
            a, c, places = b[:], b[:], rng.sample(range(1, 45), 5 + differ)
            for k in places[:5]:
                a[2 * k] = f"a{rng.randrange(10**9)}"
            for k in places[5:]:
                c[2 * k] = f"c{rng.randrange(10**9)}"
            in_a, in_b, in_c = (tables_of(" ".join(x)) for x in (a, b, c))
            if made[differ] < 8 and in_a & in_b and not in_a & in_b & in_c and len(in_b & in_c) > len(in_a & in_b):
                made[differ] += 1
                rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((a, b, c))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), width=2)[0]
    assert got == brute(rows, 2)


def test_rounds_of_components_give_the_drivers_memory_back(spark, monkeypatch):
    """A chain takes several rounds; the plans and code of each are released before the next one."""
    rounds = []
    monkeypatch.setattr(neardup, "release", lambda spark: rounds.append(spark))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r.nid, r.comp) for r in neardup.components(chain).collect()} == {(i, 0) for i in range(41)}
    assert len(rounds) >= 3


def test_small_steps_are_strung_to_few_partitions(spark):
    """However many partitions shuffles have, a stored step has a few files for each core and Python starts a few times for each."""
    most = neardup.FILES * spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 2 * most)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a long, b long")
        labels = neardup.components(links)
        assert labels.rdd.getNumPartitions() <= most and labels.filter("comp <> nid - nid % 2").count() == 0
        sets = spark.range(402).selectExpr("id AS nid", "cast(concat('shingle', lpad(id - id % 2, 9, '0')) AS binary) AS full")
        found = neardup.confirmed(links.repartition(2 * most, "a"), sets, 80)
        assert found.count() == 200 and found.rdd.getNumPartitions() <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_workers_that_have_not_grown_go_on_at_once(monkeypatch):
    from blocklens.llm import words

    size, times = [100 << 20], []
    monkeypatch.setattr(words, "resident", lambda: size[0])
    monkeypatch.setattr(words, "give_back", lambda: times.append(size[0]))
    monkeypatch.setattr(words, "_settled", [])
    task = words.lean(lambda batches: iter(batches))
    for now in (100, 100, 110, 130, 130, 140, 160):
        size[0] = now << 20
        assert list(task([1, 2])) == [1, 2]
    assert times == [x << 20 for x in (100, 130, 160)]


def test_a_stored_step_gives_the_drivers_memory_back_before_the_next_one(spark, monkeypatch):
    """Links of a long chain take many rounds; none of their steps is stored while memory of the one before is held."""
    events = []
    store, release = neardup.checkpointed, neardup.release
    monkeypatch.setattr(neardup, "checkpointed", lambda df: (events.append("stored"), store(df))[1])
    monkeypatch.setattr(neardup, "release", lambda s: (events.append("released"), release(s))[1])
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(7, 7), (100, 90)], "a long, b long")
    labels = neardup.components(links).collect()
    assert sorted((r["nid"], r["comp"]) for r in labels) == [(k, 0) for k in range(41)] + [(90, 90), (100, 90)]
    assert len(events) > 6 and events == ["stored", "released"] * (len(events) // 2)


def test_few_links_are_connected_by_one_task_as_by_rounds(spark, monkeypatch):
    """Either way gives the same labels; few links take no rounds, whose jobs and broadcasts fill the driver's memory."""
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k + 1000, k + 1001) for k in range(60)]
    links = neardup.kept(spark.createDataFrame(links, "a long, b long"))
    labels = neardup.kept(spark.range(1100).selectExpr("id AS nid", "id - id % 3 AS comp"))
    stored = []
    keep = neardup.kept
    monkeypatch.setattr(neardup, "kept", lambda df: stored.append(df) or keep(df))
    here = sorted(neardup.joined(labels, links).collect())
    assert len(stored) == 2
    monkeypatch.setattr(neardup, "LOCAL_LINKS", 10)
    assert here == sorted(neardup.joined(labels, links).collect())
    assert len(stored) > 6


def test_connected_follows_chains_in_any_order():
    ends = np.arange(500)
    order = np.random.default_rng(3).permutation(499)
    nodes, low = neardup.connected((7 * ends + 3)[1:][order], (7 * ends + 3)[:-1][order])
    assert nodes.tolist() == (7 * ends + 3).tolist() and set(low.tolist()) == {3}


def test_joins_broadcast_little_whatever_the_session_allows(spark, monkeypatch):
    """A table is held in the driver's memory a few times while it is broadcast; the session's own limit comes back."""
    name, seen, store = "spark.sql.autoBroadcastJoinThreshold", [], neardup.checkpointed
    before = spark.conf.get(name)
    monkeypatch.setattr(neardup, "checkpointed", lambda df: seen.append(df.sparkSession.conf.get(name)) or store(df))
    rows = spark.createDataFrame([(k, f"a b c d e f g h {k // 2}") for k in range(8)], "doc_id long, text string")
    try:
        spark.conf.set(name, "64MB")
        assert found(rows, width=2)[0][1][1] == 0
        assert set(seen[1:]) == {str(neardup.BROADCAST)} and spark.conf.get(name) == "64MB"
        seen.clear()
        spark.conf.set(name, "-1")
        found(rows, width=2)
        assert set(seen) == {"-1"}
    finally:
        spark.conf.set(name, before)


def test_sketches_tell_sets_of_any_size_apart(spark):
    """No pair at the threshold is ruled out; large sets that differ in a third are, which 1,024 parities could not tell."""
    rng = np.random.default_rng(4)
    rows, pairs, near = [], [], set()
    for size in (1, 9, 90, 900, 9_000, 90_000):
        for share in (1.0, 0.9, 0.889, 0.6):
            x = rng.integers(0, 1 << 63, size).astype(np.uint64)
            y = np.concatenate([x[: round(size * share)], rng.integers(0, 1 << 63, size - round(size * share)).astype(np.uint64)])
            a, b = len(rows), len(rows) + 1
            rows += [(a, bytearray(np.sort(x).tobytes())), (b, bytearray(np.sort(y).tobytes()))]
            pairs.append((a, b))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (2 * size - common):
                near.add((a, b))
            elif size >= 900:
                near.add((-a, -b))
    rows.append((len(rows), bytearray(np.arange(7, dtype=np.uint64).tobytes())))
    pairs.append((len(rows) - 1, pairs[-1][0]))
    sets = spark.createDataFrame(rows, "nid long, full binary").repartition(3)
    left = {(r.a, r.b) for r in neardup.close_pairs(spark.createDataFrame(pairs, "a long, b long"), sets, 80).collect()}
    assert {p for p in near if p[0] >= 0} <= left and not any((-a, -b) in near for a, b in left)
    assert pairs[-1] not in left


def test_only_wanted_documents_are_shingled_again(spark, monkeypatch):
    """Sets are made again for nodes that share a table only, whatever ids repeat or are null."""
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    twins = [text() for _ in range(6)]
    rows = [(i % 3 if i % 2 else None, t + end) for i, t in enumerate(twins) for end in ("", " more")]
    rows += [(1000 + i, text()) for i in range(400)]
    made = []
    sets = neardup.full_sets
    monkeypatch.setattr(neardup, "full_sets", lambda *a: made.append(sets(*a)) or made[-1])
    out = neardup.group(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert made[0].count() < 40
    assert sum(r["component_id"] is None for r in out) == 6 and sorted(r["component_id"] for r in out if r["doc_id"] in (0, 1, 2)) == [0, 0, 1, 1, 2, 2]
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in out if (r["doc_id"] or 0) >= 1000)
