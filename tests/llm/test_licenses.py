import re

import pytest

from blocklens.llm import licenses


def normal(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[.,;:()\"']", "", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(rows, templates):
    out = {}
    for doc_id, text in rows:
        words = normal(text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        for name, template in templates.items():
            w = normal(template)
            wanted = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            size = licenses.shingle_class(len(wanted))
            best = max(((len(set(grams[s : s + 2 * size]) & wanted), -s) for s in range(0, len(grams), size)), default=(0, 0))
            if 100 * best[0] >= 80 * len(wanted):
                out[doc_id, name] = best[0], len(wanted), -best[1]
    return out


def found(df, **kw):
    return {(r["doc_id"], r["license"]): (r["matched"], r["shingles"], r["first_word"]) for r in licenses.scan(df, **kw).collect()}


def test_documents_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(documents) == brute(rows, licenses.TEMPLATES)


def test_notices_in_long_texts_and_with_edits(spark):
    import random

    rng = random.Random(1)
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k, text in enumerate(licenses.TEMPLATES.values()):
        rows.append((10 * k, f"{filler(3000)} {text.upper()}\n{filler(2000)}"))
        words = text.split()
        if len(words) > 40:
            words[20] = "changed"
            rows.append((10 * k + 1, filler(777) + " " + " ".join(words)))
            rows.append((10 * k + 2, filler(5) + " " + " ".join(words[: len(words) // 2])))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows, licenses.TEMPLATES) and len({n for _, n in got}) == len(licenses.TEMPLATES)


def test_bands_keep_the_promised_chance():
    for count in range(1, 200):
        need = -(-count * 80 // 100)
        worst = need / (2 * licenses.shingle_class(count) + count - need)
        assert (1 - worst) ** licenses.bands(count) <= licenses.MISS


def test_odd_rows(spark, odd, none):
    assert found(odd) == {} and licenses.scan(none).count() == 0
    notice = licenses.TEMPLATES["MIT"]
    rows = spark.createDataFrame([(1, notice, "x"), (1, notice, "x"), (None, notice, "x"), (2, notice + " " + notice, "y")], "doc_id long, text string, license string")
    out = licenses.scan(rows).collect()
    assert len(out) == 4 and {r["license"] for r in out} == {"MIT"}
    with pytest.raises(ValueError):
        licenses.scan(rows, {"short": "four words are few"})


def test_whole_licenses_are_told_by_their_parts(spark):
    """Texts of whole short licenses, reflowed and in other case, between other words; none is taken for another."""
    parts = {"MIT": ["MIT-permission", "MIT-warranty"], "BSD-3": ["BSD-2-Clause", "BSD-3-Clause-names", "BSD-disclaimer"], "ISC": ["ISC"], "Zlib": ["Zlib"], "MPL": ["MPL-2.0-header"], "LGPL": ["LGPL-2.1-header"]}
    rows = []
    for k, (name, own) in enumerate(parts.items()):
        text = " \n".join(licenses.TEMPLATES[p] for p in own)
        rows.append((k, f"Copyright (c) some one {k}\n\n" + text.replace(" the ", "\n  the ").lower() + "\nand then other words " * 30))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {k: set(own) for k, own in enumerate(parts.values())}
