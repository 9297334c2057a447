"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lakeloom
from lakeloom.session import scratch_dir

#: Rows that go to a Python worker at once; texts and pages are long rows.
ARROW_ROWS = 1000
#: Bytes of such a batch, whatever its rows hold.
ARROW_BYTES = 8 << 20
#: Characters that one numpy pass works on (a longer single text goes alone).
PASS_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Send the package to the Python workers (once per application) and bound
    the Arrow batches by rows, since a row here is a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(lakeloom.__file__).parent
    # The driver's own folder: Spark's file server hands the archive to the executors.
    archive = Path(tempfile.mkdtemp(prefix="lakeloom-package-"), "lakeloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in
    files that every executor sees, so a lost executor costs one task's read."""
    path = scratch_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, kind: str) -> str:
    return f"{scratch_dir(spark, kind)}-{uuid.uuid4().hex[:8]}"


def crc32_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text (null id: that of the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def passes(texts: list, chars: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` holding about ``chars`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def batch_rows(batch: pa.RecordBatch, columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_partition))


_LETTERS: dict[str, np.ndarray] = {}


def char_class(name: str) -> np.ndarray:
    """Boolean table over all code points: ``letter``, ``upper``, ``digit``,
    ``space``. Built once per worker process."""
    if name not in _LETTERS:
        test = {"letter": str.isalpha, "upper": str.isupper, "digit": str.isdigit, "space": str.isspace}[name]
        _LETTERS[name] = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    return _LETTERS[name]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each text between two spaces; start and end of
    each text's stretch (spaces included)."""
    lens = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    joined = "".join(f" {t} " for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lens)
    return cps, ends - lens, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift) on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in order: runs of letters and digits,
    lower-cased. Null or wordless text: an empty array."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


class PieceStore:
    """Ids of distinct text pieces, each encoded once per worker.

    ``encode_new`` gets a list of new pieces and returns ids one after another,
    and where among them each piece's ids start and how many they are. Pieces are numbered as they come; beyond
    ``limit`` the store starts anew, which costs time but changes no result."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int):
        self.encode_new, self.limit = encode_new, limit
        self._empty()

    def _empty(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # the next number for each new piece
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def known(self, piece: str) -> np.ndarray | None:
        """The ids of a piece of an earlier call."""
        n = self.number.get(piece, len(self.size))
        return self.flat[self.start[n]:self.start[n] + self.size[n]] if n < len(self.size) else None

    def ids(self, each: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (lists of pieces) one after another, and the ids per text."""
        if len(self.number) > self.limit:
            self._empty()
        pieces = np.fromiter(map(len, each), np.int64, len(each))
        seq = np.fromiter(map(self.number.__getitem__, chain.from_iterable(each)), np.int64, int(pieces.sum()))
        new = list(islice(self.number, len(self.size), None))
        if new:
            flat, start, size = self.encode_new(new)
            self.start = np.concatenate([self.start, len(self.flat) + start])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        size = self.size[seq]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[seq] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])])
