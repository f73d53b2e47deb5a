"""Token ids in wavelet-matrix files: one compressed file per shard.

A shard holds whole documents in ascending doc_id order. Its ids lie as bit
planes, each plane in the order that the planes before it leave, so that rank
and select on planes answer access, counting and occurrence lookup.

Nulls and edges: a null or empty text is the end id alone; a null doc_id comes
first and stays null; repeated ids keep all their rows, ordered by a hash of the text; an
empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Committed, open_input, shared_folder, small_batches
from .tokens import encoder, gathered, tokenizer_path

END_ID = 2
# A shard is closed once it holds this many ids.
SHARD_IDS = 1 << 20
MAGIC = b"WAVELET1"


# --- the matrix ---


class WaveletMatrix:
    """Bit planes of a sequence of unsigned integers, the top bit first."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n = n
        self.planes = planes  # packed, little bit order
        self.zeros = [n - int(np.bitwise_count(p).sum(dtype=np.int64)) for p in planes]
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        v = np.asarray(values, np.uint32 if bits > 16 else np.uint16)
        planes = []
        for level in range(bits - 1, -1, -1):
            ones = (v >> level).astype(np.uint8) & 1
            planes.append(np.packbits(ones, bitorder="little"))
            ones = ones.view(bool)
            v = np.concatenate([v[~ones], v[ones]])
        return cls(len(v), planes)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little")

    def decode(self) -> np.ndarray:
        """All values, from the last plane up."""
        v = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            ones, up = self._bits(level).view(bool), np.empty_like(v)
            up[~ones] = v[: self.zeros[level]]
            up[ones] = v[self.zeros[level] :] | v.dtype.type(1 << (len(self.planes) - 1 - level))
            v = up
        return v

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a plane: a directory entry per 64 bytes,
        and the bytes after it."""
        plane, ranks = self.planes[level], self._ranks[level]
        if ranks is None:
            counts = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), 64)) if len(plane) else np.zeros(0, np.int64)
            ranks = self._ranks[level] = np.concatenate([[0], np.cumsum(counts)])
        byte, bit = divmod(i, 8)
        block = byte // 64
        ones = int(ranks[block]) + int(np.bitwise_count(plane[block * 64 : byte]).sum(dtype=np.int64))
        return ones + (int(plane[byte]) & ((1 << bit) - 1)).bit_count() if bit else ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> (i % 8) & 1
            ones = self._rank(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _narrow(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank(level, lo), self._rank(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a value stands at positions lo to hi - 1."""
        if value >> len(self.planes):
            return 0
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._narrow(value, max(0, min(lo, hi)), hi)
        return b - a

    def _select(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th one or zero of a plane, by bisection on ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def find(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        lo, hi = self._narrow(value, 0, self.n)
        if value >> len(self.planes) or not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at


@dataclass
class Shard:
    doc_ids: list[int | None]
    lengths: np.ndarray
    matrix: WaveletMatrix


def pack_shard(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file: a header, the documents, the planes."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    matrix = WaveletMatrix.build(ids, bits)
    zip_ = zstandard.ZstdCompressor(level=1).compress
    parts = [
        zip_(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        zip_(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        zip_(np.array(lengths, "<i8").tobytes()),
        *(zip_(p.tobytes()) for p in matrix.planes),
    ]
    head = json.dumps({"n": matrix.n, "docs": len(doc_ids), "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts])


def unpack_shard(data: bytes) -> Shard:
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    end = 12 + int.from_bytes(data[8:12], "little")
    head, parts = json.loads(data[12:end]), []
    for size in head["parts"]:
        parts.append(zstandard.ZstdDecompressor().decompress(data[end : end + size]))
        end += size
    none, ids = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
    doc_ids = [None if x else int(i) for x, i in zip(none, ids, strict=True)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    return Shard(doc_ids, np.frombuffer(parts[2], "<i8"), WaveletMatrix(head["n"], planes))


# --- the job ---


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents; the manifest, one row per file, is a table."""

    def run(batches):
        part, enc = TaskContext.get().partitionId(), encoder(path)
        doc_ids, lengths, held, seq, n = [], [], [], 0, 0

        def close():
            file = Committed(folder, f"{part:06d}-{seq:06d}.wavelet")
            file.write(pack_shard(doc_ids, np.concatenate(lengths), np.concatenate(held)))
            name = file.commit().rpartition("/")[2]
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_ids": [n]})

        for batch in gathered(batches):
            ids, ends = enc.encode_all(batch.column("text"))
            ids, sizes = np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1
            stops, here, first, before = np.cumsum(sizes), batch.column("doc_id").to_pylist(), 0, 0
            while first < len(stops):
                # A shard closes with the document that fills it.
                last = min(int(np.searchsorted(stops, before + shard_ids - n)) + 1, len(stops))
                doc_ids += here[first:last]
                lengths.append(sizes[first:last])
                held.append(ids[before : stops[last - 1]])
                n += int(stops[last - 1]) - before
                first, before = last, int(stops[last - 1])
                if n >= shard_ids:
                    yield close()
                    doc_ids, lengths, held, seq, n = [], [], [], seq + 1, 0
        if doc_ids:
            yield close()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("digest", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(run, "part long, seq long, file string, n_ids long"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per writing task
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.join(parts, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for pdf in batches:
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                with open_input(folder, file) as f:
                    shard = unpack_shard(f.read())
                ids, ends = shard.matrix.decode().astype("<u4"), np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, "Int64"), "start": start + begins, "n_tokens": shard.lengths, "ids_crc32": crc})

    return starts.select("file", "start").repartition(tasks, "file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all texts as shards in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "wavelet")
    manifest = write_shards(docs, folder, path or tokenizer_path())
    return read_shards(spark, folder, manifest)
