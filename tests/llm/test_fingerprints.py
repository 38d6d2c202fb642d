import random

from pyspark.sql import functions as F

from blocklens.llm import fingerprints as fp


def printed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    out = fp.with_fingerprint(rows).select("i", fp.written(F.col("fingerprint")).alias("hex")).orderBy("i").collect()
    return [r["hex"] for r in out]


def test_order_does_not_count_and_content_does(spark):
    parts = [f"Paragraph {i} says this. And that." for i in range(30)]
    mixed = parts[:]
    random.Random(1).shuffle(mixed)
    a, b, c, d = printed(spark, ["\n".join(parts), "\n".join(mixed), "\n".join(parts[:-1]), "\n".join(parts + parts[:1])])
    assert a == b and len({a, c, d}) == 3


def test_insertion_and_deletion(spark):
    a, b = "One. Two.\nThree.", "Four.\nThree."
    rows = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, both string")
    f = {c: fp.fingerprint(F.col(c)) for c in ("a", "b", "both")}
    out = rows.select(
        fp.written(fp.added(f["a"], f["b"])).alias("sum"), fp.written(f["both"]).alias("both"),
        fp.written(fp.added(f["both"], f["b"], -1)).alias("rest"), fp.written(f["a"]).alias("a"),
    ).first()
    assert out["sum"] == out["both"] and out["rest"] == out["a"]


def test_likeness_follows_the_common_share(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    rows = []
    for n in (20, 200, 2000):
        for share in (0.0, 0.5, 0.9):
            a = [f"{word()} {word()}." for _ in range(n)]
            b = a[: int(n * share)] + [f"{word()} {word()}." for _ in range(n - int(n * share))]
            rows.append((" ".join(a), " ".join(b), share))
    table = spark.createDataFrame(rows, "a string, b string, share double")
    out = table.select("share", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("near")).collect()
    assert all(abs(r["near"] - r["share"]) < 0.2 for r in out)


def test_next_row_wraps_at_any_partitioning(spark):
    ids = random.Random(2).sample(range(100_000), 500)
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    ring = sorted(ids)
    expected = {a: f"t{b}" for a, b in zip(ring, ring[1:] + ring[:1])}
    for per_part in (1, 7):
        out = fp.with_next(rows, per_part=per_part).collect()
        assert {r["doc_id"]: r["next_text"] for r in out} == expected and len(out) == 500


def test_odd_rows(spark, odd, none):
    out = fp.with_next(fp.with_fingerprint(odd)).select("doc_id", "text", "next_text", fp.written(F.col("fingerprint")).alias("hex")).collect()
    assert len(out) == odd.count()
    by_text = {}
    for r in out:
        by_text.setdefault(r["text"] or "", set()).add(r["hex"])
    assert all(len(v) == 1 for v in by_text.values())
    assert [r["next_text"] for r in out if r["doc_id"] == 15] == [None]  # the first row: null id, null text
    assert fp.with_next(fp.with_fingerprint(none)).count() == 0
    single = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert fp.with_next(single).first()["next_text"] == "x"


def test_ids_of_other_types_and_clashing_names(spark):
    ids = [f"doc/é{i:03d}" for i in random.Random(4).sample(range(900), 300)] + ["", "\U0001f642"]
    rows = spark.createDataFrame([(i, f"t{i}", 1, "x", "y") for i in ids], "doc_id string, text string, _at int, _guest string, _dealt string").repartition(5)
    ring = sorted(ids)
    out = fp.with_next(rows).collect()
    assert {r["doc_id"]: r["next_text"] for r in out} == {a: f"t{b}" for a, b in zip(ring, ring[1:] + ring[:1])}
    assert len(out) == len(ids) and all((r["_at"], r["_guest"], r["_dealt"]) == (1, "x", "y") for r in out)


def test_no_python_in_the_plan(spark, data):
    from blocklens.llm.queries import op1_fingerprints

    plan = op1_fingerprints(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
