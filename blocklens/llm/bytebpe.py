"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one last token its encoding can have;
``PrefixEncoder`` stores it. Appending bytes only adds prefixes, and after an edit the old
entries are good again as soon as they line up, so both cost what changed, not the text.
"""

import hashlib
from base64 import b64decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.words import per_text, with_columns

MEMORY = 600_000


class Vocabulary:
    """Ranks of a tiktoken file and which tokens may stand next to each other."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pairs = {}

    def merge(self, piece: bytes) -> list:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(joined)
            if low == 1 << 60:
                break
            at = joined.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def next_to(self, left: bytes, right: bytes) -> bool:
        """True if merging both together leaves them apart; with no left: if the token is its own encoding."""
        key = left, right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def last_token(self, piece: bytes, at: int, last: list) -> int:
        """Length of the one token that can end the first ``at`` bytes, given those of all shorter prefixes."""
        ranks, pairs = self.ranks, self.pairs
        for before in range(max(0, at - self.longest), at):
            token = piece[before:at]
            if token in ranks:
                left = piece[before - last[before] : before]
                found = pairs.get((left, token))
                if found or (found is None and self.next_to(left, token)):
                    return at - before
        raise ValueError("a byte is missing in the vocabulary")

    def spelled(self, piece: bytes, last: list) -> list:
        """Ids of a piece by its last tokens; a piece that is a token as a whole is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out, at = [], len(piece)
        while at:
            out.append(self.ranks[piece[at - last[at] : at]])
            at -= last[at]
        return out[::-1]

    def encode_sorted(self, pieces: list):
        """Ids of every piece. Pieces in order share prefixes, and a shared prefix is not worked out again."""
        previous, last = b"", [0]
        for piece in pieces:
            same = 0
            for x, y in zip(previous, piece):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for at in range(same + 1, len(piece) + 1):
                last.append(self.last_token(piece, at, last))
            previous = piece
            yield self.spelled(piece, last)


class PrefixEncoder:
    """The encoding of one piece, kept so that it can be appended to and edited.

    ``last[i]`` is the length of the last token of the first i bytes.
    """

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [0]
        self.append(piece)

    def append(self, more: bytes) -> "PrefixEncoder":
        done = len(self.piece)
        self.piece += more
        for at in range(done + 1, len(self.piece) + 1):
            self.last.append(self.vocabulary.last_token(self.piece, at, self.last))
        return self

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; returns how many prefixes were worked out anew.

        A prefix depends on the last ``longest`` bytes and their entries only. Once that
        many entries in a row come out as before the edit, the rest is as before.
        """
        old, shift, window = self.last, len(new) - (stop - start), 2 * self.vocabulary.longest
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last, agreed = old[: start + 1], 0
        for at in range(start + 1, len(self.piece) + 1):
            self.last.append(self.vocabulary.last_token(self.piece, at, self.last))
            same = at - len(new) - start >= window and old[at - shift] == self.last[at]
            agreed = agreed + 1 if same else 0
            if agreed >= window:
                self.last.extend(old[at - shift + 1 :])
                return at - start
        return len(self.piece) - start

    def tokens(self) -> list:
        return self.vocabulary.spelled(self.piece, self.last)


class TextEncoder:
    """Ids of whole texts; every distinct space-led word is worked out once per worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        size = max(vocabulary.tokens) + 1
        spelled = [vocabulary.tokens.get(i, b"") for i in range(size)]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.width = np.fromiter(map(len, spelled), np.int64, size)
        self.place = np.cumsum(self.width) - self.width

    def ids(self, text: str) -> list:
        """By definition of the pattern: every match separately."""
        return self.joined([self.vocabulary.pattern.findall(text)])[0]

    def matches(self, word: str) -> list:
        """The pattern's matches in a word as it was cut; plain words are told without it."""
        mark = word[:1]
        if mark in ("\x00", "\x01"):
            return self.vocabulary.pattern.findall(word[1:])
        if word.isalpha():
            return [" " + word]
        return self.vocabulary.pattern.findall(word if mark == "\n" else " " + word)

    def joined(self, lists: list) -> list:
        """Ids of each list of matches; new matches are encoded in order of their bytes."""
        if len(self.known) >= MEMORY:
            self.known.clear()
        new = sorted({m.encode(): m for found in lists for m in found if m not in self.known}.items())
        own = dict(zip((m for _, m in new), self.vocabulary.encode_sorted([b for b, _ in new])))
        self.known.update((m, ids) for m, ids in own.items() if len(m) < 64)
        known = self.known
        return [[i for m in found for i in (known.get(m) or own[m])] for found in lists]

    def encode(self, texts: pa.Array):
        """Ids of all texts in one array and n + 1 offsets.

        No match crosses from a character other than white space to white space, so texts
        are cut there. Cutting at single spaces and line ends is enough; a text in which one
        of these follows other white space, or with marks of ours, is matched as a whole instead.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|[\x00\x01]")
        # A leading mark stands for "nothing before the first word".
        marked = pc.binary_join_element_wise(pa.scalar("\x00"), pc.if_else(odd, "", texts), "")
        # One full stop or comma between a letter and white space is a match of its own.
        marked = pc.replace_substring_regex(marked, r"(\pL)([.,])([ \n]|$)", "\\1 \x01\\2\\3")
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        encoded = self.joined([self.matches(w) for w in words])
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        size = sizes[codes]
        ends = np.cumsum(size)
        out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[codes] - (ends - size), size)]
        counts = per_text(size, first)
        if pc.any(odd).as_py():
            own = [out[a:b] for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts))]
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                own[i] = np.array(self.ids(texts[i].as_py()), np.int32)
                counts[i] = len(own[i])
            out = np.concatenate(own).astype(np.int32)
        return out, np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a row of ids."""
        if not len(ids):
            return b""
        size = self.width[ids]
        ends = np.cumsum(size)
        return self.spelling[np.arange(ends[-1]) + np.repeat(self.place[ids] - (ends - size), size)].tobytes()


_ENCODERS = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each worker, file and pattern."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(Vocabulary(path, pattern))
    return _ENCODERS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text="text", out="ids") -> DataFrame:
    """Append the ids (array<int>) of every whole text; a null text is an empty one."""

    def make(texts):
        ids, first = encoder(path, pattern).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]

    return with_columns(df, text, f"{out} array<int>", make)


def decode(df: DataFrame, path: str, pattern: str, ids="ids", out="decoded") -> DataFrame:
    """Append the bytes that ``ids`` spell; null for null."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept, F.lit(b"").alias(out)).schema

    def run(batches):
        spell = encoder(path, pattern).decode
        for batch in batches:
            column = batch.column(ids)
            flat, first, null = column.values.to_numpy(), column.offsets.to_numpy(), column.is_null().to_pylist()
            made = [None if null[i] else spell(flat[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(made, pa.binary())], names=kept + [out])

    return df.select(*kept).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, text="text") -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256: encode every text, then decode its ids."""

    def make(texts):
        tool = encoder(path, pattern)
        ids, first = tool.encode(texts)
        own = [ids[a:b] for a, b in zip(first, first[1:])]
        sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]
        back = [hashlib.sha256(tool.decode(x)).hexdigest() for x in own]
        return [np.diff(first), sha, back]

    return with_columns(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def append_text(tool: TextEncoder, text: str, ids: list, more: str) -> list:
    """Ids of ``text + more`` from the ids of ``text``: only matches from the last white space on are worked out anew.

    Before the last change from other characters to white space nothing can differ.
    """
    cuts = [m.start() + 1 for m in regex.finditer(r"\S(?=\s)", text)]
    cut = cuts[-1] if cuts else 0
    kept, length, goal = 0, 0, len(text[:cut].encode())
    while length < goal:
        length += int(tool.width[ids[kept]])
        kept += 1
    return ids[:kept] + tool.ids(text[cut:] + more)
