"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

A text is split by the tokenizer's pattern. Each distinct piece of a batch is
encoded once: pieces of similar length form one padded matrix of token ids, and
in each round every row merges its leftmost pair of minimum rank and is
compacted, until no row has a pair left. Pairs are looked up in an open-addressed
hash table in numpy, built from the rank file: every way to cut a token into two
tokens. A worker keeps what it has encoded for the next batches, up to
``KEPT_PIECES``. A piece of more than ``LONG_PIECE`` bytes would need one round
per byte over the whole row; such a piece merges in the same order with a heap.

Decoding concatenates the tokens' bytes.

Defined cases: null or empty text has no tokens and decodes to empty bytes. Ids
that the ranks don't have raise. Rows are handled one by one, so repeated rows
and null ids need no rule; other columns are not read. The rank file is named by
a path that workers see; its table is bounded by the file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import PieceStore, passes, prepare_workers

LONG_PIECE = 512
KEPT_PIECES = 300_000
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 20
NONE = np.int64(1 << 40)


class PairTable:
    """(left id, right id) -> rank of the joined token, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none (also for padding, -1)."""
        out = np.full(left.shape, NONE, np.int64)
        real = np.flatnonzero(right.ravel() >= 0)
        keys = (left.ravel()[real] << 32) | right.ravel()[real]
        slot, flat = self._slot(keys), out.reshape(-1)
        for _ in range(self.probes):
            here = self.keys[slot]
            hit = here == keys
            flat[real[hit]] = self.values[slot[hit]]
            go = ~hit & (here != -1)
            if not go.any():
                break
            real, keys, slot = real[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        size = max(self.tokens, default=-1) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs)
        self.store = PieceStore(self._encode_pieces, KEPT_PIECES)

    def _merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Encode pieces of similar length in one padded matrix."""
        n = np.array([len(r) for r in rows])
        width = int(n.max())
        m = np.full((len(rows), width + 1), -1, np.int64)
        m[:, :width][np.arange(width) < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[np.ndarray | None] = [None] * len(rows)
        live = np.arange(len(rows))
        rank = self.table.rank(m[:, :-1], m[:, 1:])
        while len(live):
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[live[i]] = m[i, : n[live[i]]].copy()
                stay = ~done
                live, m, rank, at, best = live[stay], m[stay], rank[stay], at[stay], best[stay]
                if not len(live):
                    break
                width = int(n[live].max())
                m, rank = m[:, : width + 1], rank[:, :width]
                row = np.arange(len(live))
            m[row, at] = best
            column = np.arange(m.shape[1])
            from_next = column[None, :] > at[:, None]
            m[:, :-1] = np.where(from_next[:, :-1], m[:, 1:], m[:, :-1])
            m[:, -1] = -1
            moved = column[None, :-1] > at[:, None]
            rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[row, at] = self.table.rank(m[row, at], m[row, at + 1])
            before = np.maximum(at - 1, 0)
            has = at > 0
            rank[row[has], before[has]] = self.table.rank(m[row[has], before[has]], m[row[has], at[has]])
            n[live] -= 1
        return out  # type: ignore[return-value]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same order of merges by a heap of (rank, position)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.pairs.get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := self.pairs.get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces, and each piece's start and size among them."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        short: list[tuple[int, bytes]] = []
        for i, p in enumerate(pieces):
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[i] = np.array([whole], np.int64)
            elif len(raw) > LONG_PIECE:
                out[i] = self._merge_long(raw)
            else:
                short.append((i, raw))
        short.sort(key=lambda x: len(x[1]))
        a = 0
        while a < len(short):
            b, least = a, len(short[a][1])
            while b < len(short) and len(short[b][1]) <= least * 5 // 4 + 2 and (b - a + 1) * (len(short[b][1]) + 1) <= MATRIX_CELLS:
                b += 1
            for (i, _), ids in zip(short[a:b], self._merge_rows([raw for _, raw in short[a:b]])):
                out[i] = ids
            a = b
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate(out), np.cumsum(size) - size, size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the ids per text."""
        return self.store.ids([self.pattern.findall(t or "") for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not among the ranks")
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """One per worker process; the file has a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids (array<int>) of every whole text."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in passes(texts):
                ids, n = bpe.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of the ids (``decoded``, binary); null ids are empty."""
    prepare_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode, every whole text in one pass; per document doc_id,
    n_tokens and SHA-256 of the ids and of the decoded bytes."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        decimal = [str(i) for i in range(len(bpe.lengths))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in passes(texts):
                ids, n = bpe.encode(texts[a:b])
                hashes, decoded = [], []
                for own in np.split(ids, np.cumsum(n)[:-1]):
                    hashes.append(hashlib.sha256(",".join([decimal[i] for i in own.tolist()]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(hashes), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
