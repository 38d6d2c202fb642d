"""Language ID by bit-sliced Bloom filters over character n-grams."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.words import lean, mixed, per_text, slices, split_words, training_sample, with_columns

SIZES = (2, 3, 4)
#: Text bytes and n-grams worked on at a time.
BLOCK, CHUNK = 4 << 20, 1 << 18
MAX_TRAIN = 3_000
HASHES = 3
#: Bits of each language's filter for every n-gram it holds.
BITS_PER_GRAM = 12
UNKNOWN = "und"


def word_grams(distinct: pa.Array):
    """Hashes of the n-grams of each distinct word, and offsets: its letters only, lower-cased, with a mark at both ends."""
    lower = pc.utf8_lower(distinct)
    letters = pc.replace_substring_regex(lower, r"[^\pL\pM]+", "").to_pylist()
    points = np.frombuffer("".join(f" {w} " for w in letters).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in letters), np.int64, len(letters))
    word = np.repeat(np.arange(len(letters)), sizes)
    # Marks alone are no letters.
    real = np.repeat(pc.match_substring_regex(lower, r"\pL").to_numpy(zero_copy_only=False), sizes)
    hashes, owners = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        same = (word[n - 1 :] == word[: len(word) - n + 1]) & real[: len(word) - n + 1]
        key = np.full(int(same.sum()), np.uint64(n))
        for k in range(n):
            key = mixed(key ^ points[k : len(points) - n + 1 + k][same], k)
        hashes.append(key), owners.append(word[: len(word) - n + 1][same])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(letters)
    return np.concatenate(hashes), np.concatenate(owners), len(letters)


class SlicedFilters:
    """One Bloom filter for each language, stored by bit: entry i holds bit i of all of them.

    A lookup reads ``HASHES`` entries and their AND is the set of all languages that
    (probably) hold the n-gram. ``false_rate`` is each language's share of set bits to the
    power of ``HASHES``.
    """

    def __init__(self, grams: np.ndarray, masks: np.ndarray, languages: list):
        self.languages = languages
        members = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little").sum(axis=0)[: len(languages)] if len(masks) else np.zeros(1)
        self.size = int(max(1024, BITS_PER_GRAM * max(members.max(initial=0), 1)))
        self.bits = np.zeros((self.size, masks.shape[1]), np.uint64)
        for place in self.places(grams):
            np.bitwise_or.at(self.bits, place, masks)
        set_bits = np.unpackbits(self.bits.view(np.uint8), axis=1, bitorder="little")[:, : len(languages)]
        self.false_rate = set_bits.mean(axis=0) ** HASHES

    def places(self, grams):
        return [(mixed(grams, 40 + k) % np.uint64(self.size)).astype(np.int64) for k in range(HASHES)]

    def holders(self, grams) -> np.ndarray:
        """For each n-gram the bit set of the languages that hold it."""
        at = self.places(grams)
        found = self.bits[at[0]]
        for p in at[1:]:
            found = found & self.bits[p]
        return found

    def hits(self, grams, owner, n) -> np.ndarray:
        """For each of ``n`` owners and each language the number of its n-grams that the language holds."""
        out = np.zeros((n, len(self.languages)))
        for start in range(0, len(grams), CHUNK):
            own, found = owner[start : start + CHUNK], self.holders(grams[start : start + CHUNK])
            low = int(own.min())
            span = int(own.max()) - low + 1
            for k in range(len(self.languages)):
                held = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                out[low : low + span, k] += np.bincount(own - low, held, span)
        return out


def fit(docs: DataFrame, lang="lang", id_col="doc_id", text="text", max_train=MAX_TRAIN):
    """Filters from about ``max_train`` documents of each language (by hash of the id); None without any.

    An n-gram belongs to every language of whose sample it is part. What reaches the driver is
    one mask for each distinct n-gram of the bounded sample; it and the filters grow with the
    number of distinct languages.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sample = training_sample(rows, ["lang"], max_train, "id")

    def grams(batches):
        for batch in batches:
            for part in slices(batch, "text", BLOCK, tidy=True):
                names = part.column("lang").dictionary_encode()
                codes, starts, distinct = split_words(part.column("text"))
                found, owner, n = word_grams(distinct)
                doc_lang = np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(starts))
                for k, name in enumerate(names.dictionary.to_pylist()):
                    there = np.bincount(codes[doc_lang == k], minlength=n) > 0
                    own = np.unique(found[there[owner]])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.view(np.int64))], names=["lang", "gram"])

    table = sample.select("text", "lang").mapInArrow(lean(grams), "lang string, gram long").distinct().toPandas()
    if not len(table):
        return None
    languages = sorted(table["lang"].unique())
    found, place = np.unique(table["gram"].to_numpy().view(np.uint64), return_inverse=True)
    column = table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    masks = np.zeros((len(found), -(-len(languages) // 64)), np.uint64)
    np.bitwise_or.at(masks, (place, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return SlicedFilters(found, masks, languages)


def decide(filters: SlicedFilters, hits: np.ndarray, total: np.ndarray):
    """Best language of each text and its score, from n-grams held by each language and n-grams in all.

    Every language's share of held n-grams is cleared of its false positives,
    (share - rate) / (1 - rate). The largest decides and is the score, whatever the number of
    languages; ties go to the first language by name.
    """
    share = hits / np.maximum(total, 1)[:, None]
    clear = np.clip((share - filters.false_rate) / (1 - np.minimum(filters.false_rate, 0.999)), 0, 1)
    best = clear.argmax(axis=1)
    return best, clear[np.arange(len(best)), best]


def predict(docs: DataFrame, filters, text="text", out="lang_pred", score="score") -> DataFrame:
    """Append language and score of every whole text; null texts and texts without a letter are ``und`` with score 0."""
    if filters is None:
        return docs.drop(out, score).withColumns({out: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # grows with the bounded sample only

    def make(texts):
        f = shared.value
        codes, starts, distinct = split_words(texts)
        grams, owner, n = word_grams(distinct)
        hits = per_text(f.hits(grams, owner, n)[codes], starts)
        total = per_text(np.bincount(owner, minlength=n)[codes], starts)
        best, value = decide(f, hits, total)
        names = np.where(total > 0, np.array(f.languages, object)[best], UNKNOWN)
        return [pa.array(names.tolist(), pa.string()), np.where(total > 0, value, 0.0)]

    return with_columns(docs, text, f"{out} string, {score} double", make, BLOCK, tidy=True)
