import re
from collections import Counter

from blocklens.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_against_brute_force(documents, odd):
    for table in (documents.select("doc_id", "text"), odd):
        out = rules.cascade(table, list(rules.RULES), report=rules.BASE).collect()
        assert len(out) == table.count()
        for r in out:
            assert tuple(r[m] for m in rules.BASE) == brute(r["text"])


def test_order_changes_no_verdict(documents):
    verdicts = []
    for order in (list(rules.RULES), list(rules.RULES)[::-1]):
        verdicts.append({r["doc_id"]: r["kept"] for r in rules.cascade(documents, order).collect()})
    assert verdicts[0] == verdicts[1] and len(set(verdicts[0].values())) == 2


def test_later_rules_see_only_what_is_left(spark):
    seen = []
    made = {"short": lambda b: b.n_words < 3, "spy": lambda b: (seen.append(b.texts.to_pylist()), b.n_words < 0)[1]}
    import pyarrow as pa

    block = rules.Block(pa.array(["a", "a b c", None]))
    left = block.only(~made["short"](block))
    made["spy"](left)
    assert seen == [["a b c"]]
    table = spark.createDataFrame([(1, "a"), (2, "a b c")], "doc_id long, text string")
    out = rules.cascade(table, ["short"], {"short": made["short"]})
    assert {r["doc_id"]: r["kept"] for r in out.collect()} == {1: False, 2: True}


def test_trial_measures_and_ranks(documents):
    found = rules.trial(documents, sample_rows=100)
    assert set(found) == set(rules.RULES) and all(c > 0 and 0 <= s <= 1 for c, s in found.values())
    assert rules.ranked({"a": (1.0, 0.5), "b": (0.1, 0.2)}, ["c", "a", "b"]) == ["b", "a", "c"]


def test_no_rows(none):
    assert rules.trial(none) == {}
    assert rules.cascade(none, rules.ranked({}), report=rules.BASE).count() == 0
