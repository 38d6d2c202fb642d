import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")
TOOL = bytebpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_as_the_library_encodes_them(documents, reference):
    for r in bytebpe.digests(documents.select("text"), PATH, P.PATTERN).collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_odd_rows(spark, odd, odd_rows, none, reference):
    out = bytebpe.decode(bytebpe.encode(odd.withColumnRenamed("piece", "ids"), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bytebpe.digests(none, PATH, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab't Zé.,!\n\r\t  \x00\x01日🙂1٣́ "), max_size=25), max_size=4))
def test_any_text_as_the_library_encodes_it(reference, texts):
    ids, first = TOOL.encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == reference.encode_ordinary(text)
        assert TOOL.decode(ids[a:b]).decode() == text


def test_append_and_edit_leave_the_same_entries():
    rng = random.Random(4)
    letters = b"theandionsr\xc3\xa9"
    v = TOOL.vocabulary
    for _ in range(30):
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(0, 1200)))
        more = bytes(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        grown = bytebpe.PrefixEncoder(v, piece).append(more)
        assert grown.last == bytebpe.PrefixEncoder(v, piece + more).last
        start = rng.randint(0, len(piece))
        stop = rng.randint(start, min(len(piece), start + 20))
        edited = bytebpe.PrefixEncoder(v, piece)
        edited.edit(start, stop, more)
        assert edited.piece == piece[:start] + more + piece[stop:]
        assert edited.last == bytebpe.PrefixEncoder(v, edited.piece).last


def test_edit_stops_once_entries_agree():
    piece = b"thenationalinter" * 400
    encoder = bytebpe.PrefixEncoder(TOOL.vocabulary, piece)
    assert encoder.edit(10, 12, b"xy") < 2000


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab' \nz."), max_size=30), st.text(st.sampled_from("ab' \nz."), max_size=10))
def test_appended_text(reference, text, more):
    assert bytebpe.append_text(TOOL, text, TOOL.ids(text), more) == reference.encode_ordinary(text + more)
