"""Operator 4: token ids in wavelet-matrix shards.

A shard is one row of one compressed Parquet file: the bit-planes of its ids, from the highest bit
down, each plane over the ids in the order left by a stable partition on the planes above, with the
number of zero bits of each plane and a rank sample every 512 bits. Access, counting of an id in a
range, and the place of its k-th occurrence read these planes alone. Whole documents lie in a shard,
in ascending doc_id order over shards (ties: by the text), so a shard also holds document lengths.

Ids are made where the text lies; only (doc_id, 16-bit ids) is shuffled, by range of doc_id, and each
range is written as one file by Spark's committer, so a lost executor repeats its own range only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, wide
from .tokens import encoder

BLOCK = 512
SHARD_TOKENS = 1 << 19
FILE_SCHEMA = "part int, shard int, first long, width int, n long, doc_ids binary, doc_tokens binary, zeros binary, planes binary, ranks binary"


class WaveletMatrix:
    """Ids below 2**width in `width` bit-planes of n bits each."""

    def __init__(self, width: int, n: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray | None = None):
        self.width, self.n, self.zeros, self.planes = width, n, zeros, planes
        self.ranks = self._sample() if ranks is None else ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int = 16) -> "WaveletMatrix":
        now = np.asarray(ids, np.uint16 if width <= 16 else np.uint32)
        n = len(now)
        planes, zeros = np.zeros((width, (n + BLOCK - 1) // BLOCK * BLOCK // 8), np.uint8), np.zeros(width, np.uint32)
        for level in range(width):
            bit = (now >> now.dtype.type(width - 1 - level) & now.dtype.type(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            low = now.take(np.flatnonzero(~bit))  # places are gathered several times faster than by a mask
            zeros[level] = len(low)
            now = np.concatenate([low, now.take(np.flatnonzero(bit))])
        return cls(width, n, zeros, planes)

    def _sample(self) -> np.ndarray:
        """One bits before each block of each plane."""
        ones = np.bitwise_count(self.planes.reshape(self.width, -1, BLOCK // 8)).sum(2, dtype=np.uint32)
        return np.concatenate([np.zeros((self.width, 1), np.uint32), np.cumsum(ones, axis=1, dtype=np.uint32)], axis=1)

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions undone from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[level])
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = now[:z]
            up[np.flatnonzero(bit)] = now[z:] | kind(1 << (self.width - 1 - level))
            now = up
        return now

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """One bits among the first i of a plane."""
        block, rest = divmod(i, BLOCK)
        got, at = int(self.ranks[level, block]), block * BLOCK // 8
        whole, bits = divmod(rest, 8)
        got += int(np.bitwise_count(self.planes[level, at : at + whole]).sum())
        return got + ((int(self.planes[level, at + whole]) & ((1 << bits) - 1)).bit_count() if bits else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences in [start, end) lie below the last plane."""
        for level in range(self.width):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if value >> (self.width - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        if value < 0 or value >> self.width:
            return 0
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane: binary search in the samples, then in the block."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * BLOCK
        bits = np.unpackbits(self.planes[level, at // 8 : (at + BLOCK) // 8], bitorder="little")[: self.n - at]
        return at + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        i = self._range(value, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def row(self) -> dict:
        return {"width": self.width, "n": self.n, "zeros": self.zeros.astype("<u4").tobytes(), "planes": self.planes.tobytes(), "ranks": self.ranks.astype("<u4").tobytes()}

    @classmethod
    def of(cls, row: dict) -> "WaveletMatrix":
        """From a shard's row as it is in the file."""
        width = row["width"]
        return cls(width, row["n"], np.frombuffer(row["zeros"], "<u4"), np.frombuffer(row["planes"], np.uint8).reshape(width, -1), np.frombuffer(row["ranks"], "<u4").reshape(width, -1))


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ascending doc_ids that cut docs into ranges of about as many documents; reads doc_id alone."""
    if parts < 2:
        return []
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, cuts)), F.lit(100 * parts)).alias("cuts")).head()["cuts"]
    return sorted(set(found or []))


def encode(docs: DataFrame, vocabulary: str, spaces: bool, end: int, bounds: list[int] = ()) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit): the ids of each text and then the end id; and the range among bounds.

    A null or empty text has the end id alone; a null doc_id is kept, in range 0; other columns are dropped.
    """
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(vocabulary, spaces), np.array([end], "<u2").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [enc(t).astype("<u2").tobytes() + last for t in part.column(1).to_pylist()]
                where = [0 if x is None else int(np.searchsorted(cuts, x, "right")) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(where, pa.int32())], ["doc_id", "ids", "range"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, range int")


def write_shards(ids: DataFrame, path: str, ranges: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes encode()'s rows as shards under path, a file for each range, ascending by doc_id (nulls first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, first, held, held_ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), "<u2")
            known = np.array([x is not None for x in held_ids], np.uint8)
            row = WaveletMatrix.build(tokens).row() | {
                "part": part, "shard": shard, "first": first,
                "doc_ids": np.array([0 if x is None else x for x in held_ids], "<i8").tobytes() + known.tobytes(),
                "doc_tokens": np.array([len(x) // 2 for x in held], "<u4").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "doc_tokens", "zeros", "planes", "ranks"))]))

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(blob) // 2 > shard_tokens:
                    yield flush()
                    shard, first, held, held_ids, size = shard + 1, first + size, [], [], 0
                held.append(blob)
                held_ids.append(doc_id)
                size += len(blob) // 2
        if held:
            yield flush()

    spread = ids.repartitionById(ranges, F.col("range")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    spread.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards' planes.

    start counts the ids of all documents before it; only a total for each file goes through the driver.
    """
    totals = shards.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()
    begins, at = [], 0
    for r in totals:
        begins.append((r["part"], at))
        at += r["total"]
    offset = dict(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.of(row).decode().astype("<u4")
                lengths = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                n = len(lengths)
                doc_ids, known = np.frombuffer(row["doc_ids"][: 8 * n], "<i8"), np.frombuffer(row["doc_ids"][8 * n :], np.uint8).view(bool)
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~known), pa.array(ends - lengths + row["first"] + offset[row["part"]]), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def wavelet_shards(docs: DataFrame, vocabulary: str, path: str | None = None, end: int = 1) -> DataFrame:
    """Writes docs as shards and returns the shard table read back; path: a folder in a shared store."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    bounds = range_bounds(docs, wide(spark))
    write_shards(encode(docs, vocabulary, False, end, bounds), path, len(bounds) + 1)
    return spark.read.schema(FILE_SCHEMA).parquet(path)
