import hashlib
import random
import zlib
from collections import defaultdict

from blocklens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(turns.get(c - c % 100, [])[:h] + mine[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, path in full.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def rows_of(out):
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def test_against_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    assert rows_of(trie.trie(table)) == brute([tuple(r) for r in table.collect()])


def test_forks_nulls_ties_and_absent_bases(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 30), *range(100, 112), *range(205, 215), 407, 600, 601]:
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["a", "b", None, "", "long words " * 3, "é\U0001f642"]) if t > 1 else "hello"
            rows.append((c, rng.choice([t, None, 2]), rng.choice(["user", None, ""]), text))
    rows += [rows[0], rows[0], (None, 1, "user", "x"), (None, None, None, None), (7, 3, "us", "erx"), (8, 3, "user", "x")]
    for parts in (1, 7):
        assert rows_of(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))) == brute(rows)


def test_hot_and_long_conversations(spark):
    """One conversation holds a third of all turns, a third of all conversations are the same."""
    rows = [(100 * k, t, "user", f"same {t}") for k in range(150) for t in range(3)]
    rows += [(100 * k, t, "user", f"turn {k} {t}") for k in range(200, 400) for t in range(3)] + [(50_000, t, "user", f"long {t % 7}") for t in range(600)]
    assert rows_of(trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_digest_in_pieces(spark):
    ends = spark.createDataFrame([(bytes([i % 3]), i) for i in range(-40, 200)], "key binary, conv long").repartition(4)
    expected = {bytes([k]): hashlib.sha256(",".join(str(i) for i in range(-40, 200) if i % 3 == k).encode()).hexdigest() for k in range(3)}
    assert {bytes(r["key"]): r["ends_sha256"] for r in trie.ends_digest(ends, 5).collect()} == expected


def test_turnless_empty_and_clashing_columns(spark):
    # crc32("7") % 6 and crc32("9") % 6 tell how many own turns go when there is no base.
    rows = [(7, 0, "user", "x"), (9, 0, "user", "y")]
    assert rows_of(trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 0, "u", "t", 5, "k", 3), (1, 1, "u", "s", 6, "k", 3)], SCHEMA + ", depth int, key string, conv int")
    assert rows_of(trie.trie(clash)) == brute([(1, 0, "u", "t"), (1, 1, "u", "s")])
