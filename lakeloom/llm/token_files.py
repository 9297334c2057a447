"""Token-ID files: fixed-size id blocks, shuffled into byte or bit planes.

A file holds the token ids of whole documents one after another. Ids are cut
into blocks of ``block_ids``; each block of unsigned 32-bit ids is transposed
into planes (4 byte planes, or 32 bit planes), every plane is compressed with
zstandard, and the chunk index at the end names each block's offset, ids and
plane sizes. A reader can therefore decode any block alone. File layout::

    magic "LLTK1" | planes (4 or 32) | blocks ... | index (JSON, zstandard) |
    length of index (8 bytes, little-endian) | magic

The index also lists the documents (id, first id within the file, ids). Files
follow ascending doc_id: Spark sorts by range, each task streams its rows into
one file, and the running totals of the files give every document's global start.

Memory is one block and one Arrow batch of texts per task, plus the file's
document list. Defined cases: null or empty text holds only the end id. A text that
holds a special token of the tokenizer file literally (``<|endoftext|>``, in this
writing only) gets that token's id, as with the library's own settings. Null
doc_ids sort first; rows that repeat a doc_id are ordered by their text and each
stored. An empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import passes, shared_folder, prepare_workers, stored
from lakeloom.llm.files import new_file, read_file

MAGIC = b"LLTK1"
BLOCK_IDS = 1 << 16
LEVEL = 3
KEPT_WORDS = 1_000_000
WORDS_A_TEXT = 1000
#: Characters encoded at once (a longer single text goes alone): the more, the fewer repeated words are looked up.
PASS_CHARS = 4_000_000


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Transpose a block of ids into 4 byte planes or 32 bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [octets[:, k].tobytes() for k in range(4)]
    return [np.packbits((octets[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(parts):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class TokenFileWriter:
    def __init__(self, out, planes: int = 4, block_ids: int = BLOCK_IDS):
        if planes not in (4, 32):
            raise ValueError("planes is 4 (bytes) or 32 (bits)")
        self.out, self.planes, self.block_ids = out, planes, block_ids
        self.at, self.total, self.chunks, self.docs, self.waiting, self.held = 0, 0, [], [], [], 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC + bytes([planes]))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.pack.compress(p) for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self._put(p)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, self.total, len(ids)])
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            joined = np.concatenate(self.waiting)
            full = len(joined) - len(joined) % self.block_ids
            for a in range(0, full, self.block_ids):
                self._block(joined[a:a + self.block_ids])
            self.waiting, self.held = [joined[full:].copy()], len(joined) - full

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = self.pack.compress(json.dumps({"ids": self.total, "chunks": self.chunks, "docs": self.docs}).encode())
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)


class TokenFileReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        head, tail = source.read_at(len(MAGIC) + 1, 0), source.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if head[:-1] != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length, = struct.unpack("<Q", tail[:8])
        raw = source.read_at(length, size - 8 - len(MAGIC) - length)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(raw))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        raw, parts, unpack = self.source.read_at(sum(sizes), at), [], zstandard.ZstdDecompressor()
        for size in sizes:
            parts.append(unpack.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(parts, n)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Each document's id, first id in the file, and its ids in pieces of at
        most one block."""
        k, base, block = -1, 0, np.zeros(0, np.uint32)

        def pieces(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal k, base, block
            while n:
                while start >= base + len(block):
                    base, k = base + len(block), k + 1
                    block = self.block(k)
                part = block[start - base:start - base + n]
                yield part
                start, n = start + len(part), n - len(part)

        for doc_id, start, n in self.index["docs"]:
            yield doc_id, start, pieces(start, n)


class StretchStore:
    """Ids of distinct stretches of text, each encoded once per worker. Beyond
    ``limit`` those seen once since the last clearing go (all, if the others fill
    half of it), which costs time but changes no result."""

    def __init__(self, encode_new, limit: int):
        self.encode_new, self.limit = encode_new, limit
        self._keep([])

    def _keep(self, numbers: list[int] | np.ndarray) -> None:
        kept: list[str] = []
        if len(numbers):
            words = list(self.number)
            kept = [words[i] for i in numbers]
            size = self.size[numbers]
            at = np.cumsum(size) - size
            self.flat = self.flat[np.repeat(self.start[numbers] - at, size) + np.arange(int(size.sum()))]
            self.start, self.size = at, size
        else:
            self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.number: defaultdict[str, int] = defaultdict(None, zip(kept, range(len(kept))))
        self.number.default_factory = self.number.__len__  # the next number for each new stretch
        self.seen = np.zeros(len(kept), np.int64)

    def numbers(self, stretches: list[str], times: np.ndarray) -> np.ndarray:
        """A number for each of these distinct stretches, met ``times`` times."""
        if len(self.number) > self.limit:
            often = np.flatnonzero(self.seen > 1)
            self._keep(often if 2 * len(often) <= self.limit else [])
        out = np.fromiter(map(self.number.__getitem__, stretches), np.int64, len(stretches))
        if new := list(islice(self.number, len(self.size), None)):
            flat, start, size = self.encode_new(new)
            self.start = np.concatenate([self.start, len(self.flat) + start])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen[out] += times
        return out


class WordTokenizer:
    """Ids by a ``tokenizers`` file whose pre-tokenizer drops white space and parts
    letters from marks, so that what stands between spaces and line ends encodes
    alike wherever it stands, and so do a word and the ASCII marks behind it.
    Distinct stretches are numbered by Arrow, encoded once and kept for later
    batches. Special tokens in a text get their ids, as with the library's own
    settings. Added tokens must hold no white space, and not letters alone."""

    #: The first of the ASCII marks behind a Latin letter or digit, up to the next space.
    MARKS = re.compile(r"[!-/:-@\[-`{-~](?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ].)[!-/:-@\[-`{-~]* ")

    WORD = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        if any(t.isalpha() or t.split() != [t] for t in self.added):
            raise ValueError("an added token holds white space or letters alone")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.store = StretchStore(self._new, KEPT_WORDS)
        # The file's model alone, for words of lower-case Latin letters, which neither
        # its normalizer nor its splitting touches (tried here with every such letter).
        octets = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [c for c in map(chr, range(256)) if self.WORD.fullmatch(c)]
        self.octets = {ord(c): octets.pre_tokenize_str(c)[0][0] for c in latin}
        self.light = Tokenizer(self.library.model)
        self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        trial = " ".join(latin + [a + b for a in latin for b in latin] + ["".join(latin)])
        if not np.array_equal(self._model_ids([trial])[0], self._ids([trial])[0]):
            raise ValueError("the tokenizer does more to Latin words than their bytes' model")

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _model_ids(self, texts: list[str]) -> list[np.ndarray]:
        texts = [t if t.isascii() else t.translate(self.octets) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.light.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of lower-case Latin letters alone are encoded many to a text by the
        file's model and told apart by the tokens that end a word, which saves the
        library's cost of a text; what isn't plain, or stands in a text whose count
        of ends is not as expected, is encoded alone and in full."""
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        letters = np.fromiter((m is not None for m in map(self.WORD.fullmatch, words)), bool, len(words))
        plain, alone = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        chunks, at = [], 0
        cuts = range(0, len(plain), WORDS_A_TEXT)
        for a, ids in zip(cuts, self._model_ids([" ".join([words[i] for i in plain[a:a + WORDS_A_TEXT]]) for a in cuts])):
            group, bounds = plain[a:a + WORDS_A_TEXT], np.flatnonzero(self.ends[ids]) + 1
            if len(bounds) != len(group):
                alone += group.tolist()
                continue
            size[group] = np.diff(bounds, prepend=0)
            start[group] = at + bounds - size[group]
            chunks.append(ids)
            at += len(ids)
        for i, ids in zip(alone, self._ids([words[i] for i in alone])):
            start[i], size[i] = at, len(ids)
            chunks.append(ids)
            at += len(ids)
        return np.concatenate(chunks), start, size

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` behind them if there is one."""
        if not texts:
            return []
        parts = pc.split_pattern(pa.array([self._spaced(t or "") for t in texts], pa.large_string()), " ")
        numbered = parts.flatten().dictionary_encode()
        at = numbered.indices.to_numpy()
        seq = self.store.numbers(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(at, minlength=len(numbered.dictionary)))[at]
        size = self.store.size[seq]
        ends = np.cumsum(size)
        ids = self.store.flat[np.repeat(self.store.start[seq] - (ends - size), size) + np.arange(ends[-1])]
        n = np.diff(ends[np.cumsum(pc.list_value_length(parts).to_numpy()) - 1], prepend=0)
        if end_id is not None:
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
        return np.split(ids, np.cumsum(n)[:-1])

    def _spaced(self, text: str) -> str:
        """The text with single spaces where stretches part: line ends, and before
        marks that end a stretch. The tokenizer lower-cases, so Latin-1 texts, where
        that is a matter of single letters, are it before. Added tokens are found
        before that, so in a text with the like of one no marks are parted and
        stretches like one stay as they are."""
        text = text.replace("\n", " ")
        lower = text.lower()
        try:
            text.encode("latin-1")
            plain = lower
        except UnicodeEncodeError:
            plain = text
        if any(t in lower for t in self.added):
            if plain is text:
                return text
            return " ".join([w if any(t in x for t in self.added) else x for w, x in zip(text.split(" "), lower.split(" "))])
        return self.MARKS.sub(r" \g<0>", plain + " ")


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, planes: int = 4,
          block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files; the manifest has one row per file: file_no (ascending
    doc_id), uri, docs, ids, start (ids in all files before it)."""
    spark = docs.sparkSession
    prepare_workers(spark)
    folder = folder or shared_folder(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Ranges of ids and beginnings of texts: rows that share an id, or have none, are spread too.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, tokens, writer = TaskContext.get().partitionId(), word_tokenizer(path), None
        with new_file(folder, f"part-{no:06d}") as (uri, out):
            writer = TokenFileWriter(out, planes, block_ids)
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in passes(texts, PASS_CHARS):
                    for doc_id, ids in zip(doc_ids[a:b], tokens.encode(texts[a:b], end_id)):
                        writer.add(doc_id, ids)
            writer.close()
        if writer.docs:
            yield pa.RecordBatch.from_pydict({"file_no": [no], "uri": [uri], "docs": [len(writer.docs)], "ids": [writer.total]})

    files = stored(rows.mapInArrow(run, "file_no long, uri string, docs long, ids long"), "token-manifest")
    total, out = 0, []
    for r in files.orderBy("file_no").toLocalIterator():  # a row per file: as many as the sort has partitions
        out.append((r["file_no"], r["uri"], r["docs"], r["ids"], total))
        total += r["ids"]
    return spark.createDataFrame(out, "file_no long, uri string, docs long, ids long, start long")


def read(manifest: DataFrame) -> DataFrame:
    """Read the files back, a task per file: doc_id, start, n_tokens and the
    unsigned crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with read_file(uri) as source:
                    out = []
                    for doc_id, start, pieces in TokenFileReader(source).documents():
                        n = crc = 0
                        for ids in pieces:
                            n, crc = n + len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
                        out.append((doc_id, first + start, n, crc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = manifest.select("uri", "start", "file_no")
    return rows.repartition(max(1, rows.count()), "file_no").select("uri", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id and the ids themselves (array<long>, a whole document a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with read_file(uri) as source:
                    for doc_id, _, pieces in TokenFileReader(source).documents():
                        ids = [int(i) for part in pieces for i in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return manifest.select("uri").mapInArrow(run, "doc_id long, ids array<long>")
