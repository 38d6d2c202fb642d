"""Quality rules as a short-circuit cascade, cheapest rejection first."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.words import mixed, per_text, slices, split_words, text_numbers, with_columns

SAMPLE_ROWS = 2_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Block:
    """Texts of a block and what was measured on them so far; measures are taken at most once."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        self.got = {}

    def __getattr__(self, name):
        if name in ("texts", "got"):
            raise AttributeError(name)
        if name not in self.got:
            self.got[name] = MEASURES[name](self)
        return self.got[name]

    def only(self, rows: np.ndarray) -> "Block":
        """The block of some of the texts, with their measures."""
        part = Block(self.texts.take(pa.array(np.flatnonzero(rows))))
        part.got = {k: v[rows] for k, v in self.got.items() if k not in ("split", "lines")}
        return part


def _word_chars(b):
    codes, starts, distinct = b.split
    return per_text(pc.utf8_length(distinct).to_numpy().astype(np.int64)[codes], starts)


def _repeat_words(b):
    """Words inside three-word windows that occur twice or more in their text."""
    codes, starts, distinct = b.split
    doc = text_numbers(starts)
    n = len(codes)
    if n < 4:
        return np.zeros(len(starts) - 1, np.int64)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    a, b2, c = codes[at], codes[at + 1], codes[at + 2]
    # Equal windows of a text get equal keys: numbers of pairs first, then of (pair, third word, text).
    width = len(distinct) + 1
    pair = np.unique(a * width + b2, return_inverse=True)[1] if width < 2**31 else None
    key = pair * width + c
    triple = np.unique(key, return_inverse=True)[1]
    _, place, times = np.unique(triple * len(starts) + doc[at], return_inverse=True, return_counts=True)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[at[times[place] > 1] + shift] = True
    return per_text(covered.astype(np.int64), starts)


def _lines(b):
    parts = pc.split_pattern(b.texts, "\n")
    first = parts.offsets.to_numpy().astype(np.int64)
    return parts.flatten(), first - first[0]


def _dup_lines(b):
    """Lines with a word that equal an earlier line of their text."""
    flat, first = b.lines
    coded = flat.dictionary_encode()
    has_word = pc.match_substring_regex(coded.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    code, doc = coded.indices.to_numpy().astype(np.int64), text_numbers(first)
    _, at = np.unique(doc * (len(coded.dictionary) + 1) + code, return_index=True)
    later = np.ones(len(code), bool)
    later[at] = False
    return per_text((later & has_word[code]).astype(np.int64), first)


def _by_word(pattern):
    def count(b):
        codes, starts, distinct = b.split
        return per_text(pc.count_substring_regex(distinct, pattern).to_numpy().astype(np.int64)[codes], starts)

    return count


#: name -> function of a Block; each gives one number for every text.
MEASURES = {
    "split": lambda b: split_words(b.texts),
    "lines": _lines,
    "n_words": lambda b: np.diff(b.split[1]),
    "word_chars": _word_chars,
    "n_symbols": _by_word(r"[#*$%&|<>]"),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": _by_word(r"\p{Lu}"),
    "n_letters": _by_word(r"\p{L}"),
    "n_marks": _by_word(r"!!|\?\?|\.\.\."),
    "n_lines": lambda b: np.diff(b.lines[1]),
}

#: name -> rejects(Block), whole-number arithmetic only. A text is kept if no rule rejects it.
RULES = {
    "few_words": lambda b: b.n_words < 50,
    "repeated_words": lambda b: 100 * b.n_repeat_words > 50 * b.n_words,
    "symbols": lambda b: 100 * b.n_symbols > 10 * b.n_words,
    "word_length": lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 15 * b.n_words),
    "duplicate_lines": lambda b: 100 * b.n_dup_lines > 50 * b.n_lines,
    "shouting": lambda b: 100 * b.n_upper > 50 * b.n_letters,
    "marks": lambda b: 100 * b.n_marks > 20 * b.n_words,
}


def trial(docs: DataFrame, rules=RULES, id_col="doc_id", text="text", sample_rows=SAMPLE_ROWS) -> dict:
    """Seconds for a text and share of rejected texts of every rule, measured on about ``sample_rows`` texts.

    Each rule is timed on a block without earlier measures. The sample is chosen by hash of
    the id and bounded by ``sample_rows``; it decides the order of work, never a verdict.
    """
    share = F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.count()
    sample = docs.filter(share * rows < sample_rows).select(F.col(text).alias("_text"))
    names = list(rules)

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                for i, name in enumerate(names):
                    block = Block(part.column("_text"))
                    start = time.perf_counter()
                    rejected = int(np.sum(rules[name](block)))
                    spent = time.perf_counter() - start
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.num_rows]), pa.array([rejected]), pa.array([spent])], names=["rule", "n", "rejected", "seconds"])

    table = sample.mapInArrow(measure, "rule long, n long, rejected long, seconds double")
    found = table.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    return {names[r["rule"]]: (r["seconds"] / r["n"], r["rejected"] / r["n"]) for r in found}


def ranked(measured: dict, rules=RULES) -> list:
    """Rules by share of rejected texts for each second of work, highest first; unmeasured ones stay last in their order."""
    worth = {k: reject / max(cost, 1e-9) for k, (cost, reject) in measured.items()}
    return sorted(rules, key=lambda k: -worth.get(k, -1.0))


def cascade(docs: DataFrame, order: list, rules=RULES, report=(), text="text", out="kept") -> DataFrame:
    """Append the measures in ``report`` (for every text) and ``kept``.

    Rules run in ``order`` and each sees only the texts that no earlier rule rejected, so
    the order changes the time, not the result. Measures are shared between rules. A null
    text is an empty one.
    """
    ddl = ", ".join([f"{m} long" for m in report] + [f"{out} boolean"])

    def make(texts):
        block = Block(texts)
        columns = [np.asarray(getattr(block, m), np.int64) for m in report]
        alive, left = np.arange(len(texts)), block
        for name in order:
            bad = np.asarray(rules[name](left), bool)
            if bad.any():
                alive = alive[~bad]
                if not len(alive):
                    break
                left = left.only(~bad)
        kept = np.zeros(len(texts), bool)
        kept[alive] = True
        return [*columns, kept]

    return with_columns(docs, text, ddl, make)
