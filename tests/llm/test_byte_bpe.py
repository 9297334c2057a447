import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import byte_bpe as B
from lakeloom.llm.queries import BYTE_BPE_FILE, PATTERN


@pytest.fixture(scope="module")
def library():
    with open(BYTE_BPE_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def check(texts, library):
    bpe = B.load(BYTE_BPE_FILE, PATTERN)
    ids, n = bpe.encode(texts)
    for t, own in zip(texts, split(ids, n)):
        assert own == library.encode_ordinary(t or ""), t
        assert bpe.decode(np.array(own, np.int64)) == (t or "").encode()


def test_pieces_of_all_lengths(library):
    rng = random.Random(1)
    letters = "abc  \n\t'sRE123éßñ中文  ΣΩ😀‍.!?#--<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(800)]
    check(texts + [None, "", "a" * 3000, "ab" * 700 + " x", " " * 900 + "b", "é" * 600, "the" * 300, "<|endoftext|>"], library)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60), max_size=8))
def test_any_latin_text(texts):
    with open(BYTE_BPE_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    check(texts, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def test_the_long_piece_way_equals_the_matrix_way():
    bpe, rng = B.load(BYTE_BPE_FILE, PATTERN), random.Random(2)
    rows = [bytes(rng.choice(b"etaoin shr") for _ in range(rng.randint(2, 120))) for _ in range(300)]
    for row, ids in zip(rows, bpe._merge_rows(rows)):
        assert bpe._merge_long(row).tolist() == ids.tolist()


def test_a_full_store_starts_anew(library, monkeypatch):
    bpe = B.load(BYTE_BPE_FILE, PATTERN)
    monkeypatch.setattr(bpe.store, "limit", 1)
    check(["one two three"] * 3, library)
    check(["four one five"], library)


def test_unknown_ids_raise():
    with pytest.raises(ValueError):
        B.load(BYTE_BPE_FILE, PATTERN).decode(np.array([10 ** 6]))


def test_tables(spark, library):
    rows = [(1, "Hello there", 5), (1, "Hello there", 5), (None, None, 6), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for r in B.round_trip(docs, BYTE_BPE_FILE, PATTERN).collect():
        text = "Hello there" if r.doc_id == 1 else ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = B.encode(docs, BYTE_BPE_FILE, PATTERN)
    back = sorted(bytes(r.decoded) for r in B.decode(encoded, BYTE_BPE_FILE, PATTERN).collect())
    assert back == [b"", b"", b"Hello there", b"Hello there"]
    assert B.round_trip(docs.where("false"), BYTE_BPE_FILE, PATTERN).collect() == []
