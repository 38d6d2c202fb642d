"""Tokenising whole texts with a word-level BPE file, once per distinct word."""

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from blocklens.llm.words import per_text, split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words remembered by a worker; beyond that only those met again and again are kept.
MEMORY = 400_000
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file whose pre-tokens never cross white space.

    Encoding a text then is encoding its words one after the other, so every distinct word
    is encoded once per worker as long as it is remembered. Letters A-Z are lower-cased beforehand and one full stop or
    comma after a small letter is taken as a word of its own; the file's normaliser and its
    pre-token pattern do the same to the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        suffix = self.tokenizer.model.end_of_word_suffix
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.forget()

    def forget(self):
        self.known = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)
        self.used = 0

    def forget_rare(self):
        """Keep the words that most calls met, at least two and at most half of the memory; older calls count less."""
        n = len(self.known)
        met = np.cumsum(np.bincount(self.uses[:n], minlength=3)[::-1])[::-1]
        kept = np.flatnonzero(self.uses[:n] >= max(2, int(np.argmax(np.append(met, 0) <= MEMORY // 2))))
        words, uses = list(self.known), self.uses[kept] // 2
        start, sizes = self.starts[kept], self.starts[kept + 1] - self.starts[kept]
        ends = np.cumsum(sizes)
        total = int(sizes.sum())
        ids = self.ids[np.arange(total) + np.repeat(start - (ends - sizes), sizes)]
        self.forget()
        self.known = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ids = np.concatenate([ids, self.ids])
        self.starts = np.concatenate([[0], ends, self.starts])
        self.uses = np.concatenate([uses, self.uses])
        self.used = total

    def flat_ids(self, texts: list):
        return np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)

    def learn(self, words: list):
        """Encode new words; keep their ids in one flat array.

        Words of small letters are encoded many at a time: each is one pre-token, which ends
        with the one token that carries the word-end mark.
        """
        plain, other = [], []
        for w in words:
            (plain if PLAIN(w) else other).append(w)
        ids = self.flat_ids([" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)])
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("this file's words do not end with a mark")
        sizes = np.diff(np.concatenate([[0], ends]))
        if other:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            sizes = np.concatenate([sizes, np.fromiter(map(len, lists), np.int64, len(lists))])
            ids = np.concatenate([ids, np.array([i for x in lists for i in x], np.int32)])
        first, n = len(self.known), len(words)
        if first + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(first + n + 1, np.int64)])
            self.uses = np.concatenate([self.uses, np.zeros(first + n + 1, np.int64)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first + 1 : first + n + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.known.update(zip(plain + other, range(first, first + n)))

    def encode(self, texts: pa.Array):
        """Ids of all texts in one array, and where each text starts in it (n + 1 offsets)."""
        texts = pc.ascii_lower(pc.fill_null(texts, ""))
        texts = pc.replace_substring_regex(texts, r"([a-zß-öø-ÿ])([.,])([ \n]|$)", r"\1 \2\3")
        codes, first, distinct = split_words(texts)
        if len(self.known) + len(distinct) > MEMORY:
            self.forget_rare()
        words = distinct.to_pylist()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(place < 0)):
            unknown = [words[i] for i in new.tolist()]
            self.learn(unknown)
            place[new] = np.fromiter(map(self.known.get, unknown), np.int64, len(unknown))
        self.uses[place] += 1
        start, size = self.starts[place], self.starts[place + 1] - self.starts[place]
        sizes = size[codes]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[codes] - (ends - sizes), sizes)
        counts = per_text(sizes, first)
        return self.ids[index], np.concatenate([[0], np.cumsum(counts)])
