import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lakeloom.llm import token_files as T
from lakeloom.llm.queries import END_ID, WORD_BPE_FILE


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 4096])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (T.from_planes(T.to_planes(ids, planes), n) == ids).all()


@pytest.mark.parametrize("planes", [4, 32])
def test_file_round_trip_over_block_edges(planes):
    rng, out = np.random.default_rng(3), io.BytesIO()
    writer = T.TokenFileWriter(out, planes, block_ids=10)
    docs = [(i, rng.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([0, 3, 25, 10, 1, 0, 7])] + [(None, np.arange(4, dtype=np.uint32))]
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader, at = T.TokenFileReader(pa.BufferReader(out.getvalue())), 0
    for (doc_id, ids), (got_id, start, pieces) in zip(docs, reader.documents(), strict=True):
        assert got_id == doc_id and start == at
        assert [int(i) for part in pieces for i in part] == ids.tolist()
        at += len(ids)
    assert reader.block(1).tolist() == np.concatenate([x for _, x in docs])[10:20].tolist()
    with pytest.raises(ValueError):
        T.TokenFileReader(pa.BufferReader(b"x" * 40))


def test_words_encode_as_the_library_does():
    library = Tokenizer.from_file(WORD_BPE_FILE)
    rng, letters = random.Random(1), "abcE  \n\n\t\r'sR123éßñ中文  \x1c\x85́ΣΩς😀‍.!?#--,<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["", None, "<|endoftext|> a", " ", " ́a", "Word word WORD. word, Word.", "İ İ. I", "a " * 5000]
    tokens = T.WordTokenizer(WORD_BPE_FILE)
    for part in (texts[:1500], texts[1500:]):
        for t, ids in zip(part, tokens.encode(part)):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_tables(spark):
    library = Tokenizer.from_file(WORD_BPE_FILE)
    rows = [(5, "five words are in here", 1), (-2, None, 2), (3, "", 3), (3, "again", 4), (None, "no id", 5), (9, "x " * 30_000, 6), (3, "again", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    files = T.write(docs, WORD_BPE_FILE, END_ID, block_ids=1000)
    got = sorted(map(tuple, T.read(files).collect()), key=lambda r: r[1])
    want, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [END_ID]
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want
    assert sorted(len(r.ids) for r in T.read_ids(spark, files).collect()) == sorted(r[2] for r in want)
    assert T.read(T.write(docs.where("false"), WORD_BPE_FILE, END_ID)).collect() == []


def test_special_tokens_in_texts_as_the_untouched_library(spark):
    library, rng = Tokenizer.from_file(WORD_BPE_FILE), random.Random(2)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "Word", "a.", "é", "\u0301", "中", " ", "\n", "'s", "|>", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    texts += ["end of file <|endoftext|> next <|ENDOFTEXT|>", "<|endoftext|>", "plain Words only"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(want[2000]) == 11 and 49407 in want[2000]
    for t, ids, ids_of in zip(texts, T.word_tokenizer(WORD_BPE_FILE).encode(texts), want):
        assert ids.tolist() == ids_of, t
    docs = spark.createDataFrame(list(enumerate(texts[-203:])), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in T.read_ids(spark, T.write(docs, WORD_BPE_FILE, END_ID)).collect()}
    assert got == {i: ids + [END_ID] for i, ids in enumerate(want[-203:])}


def test_store_clears_without_changing_ids():
    library, rng = Tokenizer.from_file(WORD_BPE_FILE), random.Random(4)
    tokens = T.WordTokenizer(WORD_BPE_FILE)
    tokens.store.limit = 50
    marks = ["", "", ".", ",", "!!", ",###", "'", "\u0327", "\u2014.", "_"]
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 4))) + rng.choice(marks) for _ in range(30)) for _ in range(4)]
        for t, ids in zip(texts, tokens.encode(texts, END_ID)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids + [END_ID], t
        assert len(tokens.store.number) == len(tokens.store.size) < 50 + 4 * 61
    assert tokens.encode([]) == []


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text {i:05d} " + "x" * 50) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table is one partition else
    try:
        files = T.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD_BPE_FILE, END_ID).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1 and sum(r.docs for r in files) == 4000 and max(r.docs for r in files) < 2000
