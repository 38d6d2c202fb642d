from blocklens.llm import linededup


def brute(rows, size=3):
    """Remove later occurrences, documents in order of their id."""
    seen, out = set(), {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        parts = (text or "").split("\n")
        real = [(i, p.strip(" \t\n\x0b\x0c\r")) for i, p in enumerate(parts)]
        real = [(i, p) for i, p in real if p]
        gone = set()
        for k in range(len(real) - size + 1):
            key = tuple(p for _, p in real[k : k + size])
            if key in seen:
                gone.update(i for i, _ in real[k : k + size])
            seen.add(key)
        out[doc_id] = (None if text is None else "\n".join(p for i, p in enumerate(parts) if i not in gone), len(real), len(gone))
    return out


def test_against_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup(documents).collect()}
    assert got == brute(rows)
    assert sum(v[2] for v in got.values()) > 0


def test_windows_merge_and_first_stays(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\n c \n\nd\ne\ny"), (3, "p\np\np\np\np"), (4, "a\nb")]
    out = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "a\nb\nc\nd\ne", 2: "x\n\ny", 3: "p", 4: "a\nb"}


def test_hot_window(spark):
    shared = "one line\ntwo line\nthree line"
    rows = [(i, shared + f"\nown {i}") for i in range(300)] + [(1000 + i, f"a{i}\nb{i}\nc{i}") for i in range(300)]
    out = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out if r["n_removed"]} == {i: 3 for i in range(1, 300)}


def test_odd_rows(spark, odd, odd_rows, none):
    out = linededup.dedup(odd).collect()
    assert len(out) == len(odd_rows) and linededup.dedup(odd).columns[: len(odd.columns)] == odd.columns
    expected = brute({(r[0], r[1]) for r in odd_rows})
    for r in out:
        if r["doc_id"] is not None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == expected[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    assert linededup.dedup(none).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, n_lines long, n_removed long")
    assert linededup.dedup(clash).first().asDict() == {"doc_id": 1, "text": "a", "n_lines": 1, "n_removed": 0}
