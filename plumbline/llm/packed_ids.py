"""Token ids in files of fixed-width bit packing.

A file holds one shard of the corpus: blocks of BLOCK ids, each id in the fewest bits the vocabulary needs, then the
index (document ids, first id of each document, byte offset of each block) and a fixed footer. A reader finds any id
by its block and unpacks blocks with numpy.

    blocks | doc_id int64[n] | null uint8[n] | first int64[n + 1] | block int64[b + 1] | footer <4sHxxIQQQ
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.byte_bpe import byte_encoder
from plumbline.llm.shared import saved
from plumbline.llm.textscan import packed, text_chunks

BLOCK = 1 << 13
MAGIC = b"PKID"
FOOTER = struct.Struct("<4sHxxIQQQ")  # magic, bits, ids in a block, documents, ids, place of the index


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit string of the ids, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    ones = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(ones.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    ones = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (ones.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes to a name of its own and renames at the end: a task that is run again leaves one whole file."""

    def __init__(self, files: fs.FileSystem, path: str, attempt: int, bits: int, block: int = BLOCK):
        self.files, self.path, self.temporary = files, path, f"{path}.{attempt}.part"
        self.bits, self.block = bits, block
        self.out = files.open_output_stream(self.temporary)
        self.rest: list[np.ndarray] = []
        self.waiting = self.place = self.total = 0
        self.docs: list[int | None] = []
        self.firsts, self.blocks = [0], [0]

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        self.firsts.append(self.total)
        if self.waiting >= self.block:
            self._flush(self.waiting // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest)
        for low in range(0, n, self.block):
            body = pack(ids[low : min(n, low + self.block)], self.bits)
            self.out.write(body)
            self.place += len(body)
            self.blocks.append(self.place)
        self.rest, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._flush(self.waiting)
        self.out.write(np.array([d or 0 for d in self.docs], np.int64).tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.firsts, np.int64).tobytes() + np.array(self.blocks, np.int64).tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, self.block, len(self.docs), self.total, self.place))
        self.out.close()
        self.files.move(self.temporary, self.path)
        return len(self.docs), self.total


class Reader:
    """Random access to one file."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, n, self.total, index = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a file of packed ids: {path}")
        raw = self.file.read_at(size - FOOTER.size - index, index)
        self.docs = np.frombuffer(raw, np.int64, n)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.first = np.frombuffer(raw, np.int64, n + 1, 9 * n)
        self.blocks = np.frombuffer(raw, np.int64, -1, 9 * n + 8 * (n + 1))

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high of the file; only their blocks are read."""
        if high <= low:
            return np.zeros(0, np.uint32)
        a, b = low // self.block, (high - 1) // self.block + 1
        raw = self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        n = min(self.total, b * self.block) - a * self.block
        return unpack(raw, self.bits, n)[low - a * self.block : high - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _shard_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie below: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(key <= F.lit(cuts[middle]), _shard_of(key, cuts[:middle])).otherwise(F.lit(middle + 1) + _shard_of(key, cuts[middle + 1 :]))


def write_packed(
    docs: DataFrame, path: str, folder: str, id: str = "doc_id", text: str = "text", end: int = 0, shard_bytes: int = 32 << 20
) -> DataFrame:
    """Encode all texts, append `end` to each and write shards in ascending id order; returns the manifest.

    docs: id (long) and text; other columns are not read. Null ids come first; equal ids are ordered by their ids'
    bytes; null and empty texts give the end id alone; an empty table gives no file. Shards cut the range of ids
    at quantiles, so they hold about `shard_bytes` of text each on average. Manifest: shard, path, n_docs, n_tokens.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    n = max(1, min(-(-(size[0] or 0) // shard_bytes), size[1]))
    # Order and cuts come from the ids alone: no text is sampled or encoded twice.
    shares = [k / n for k in range(1, n)]
    cuts = docs.agg(F.percentile_approx(id, shares, max(10_000, 20 * n))).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    bits = bits_for(max(byte_encoder(path).library.get_vocab_size(), end + 1))
    files_uri = f"{folder}/shards"
    files, place = opened(files_uri)
    files.create_dir(place, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(2)):
                ids, at = encoder.encode(data, offsets)
                rows = [pack(np.append(ids[a:b], end), bits) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], pa.array(np.diff(at) + 1), packed(rows)], names=["shard", "id", "n", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = opened(files_uri)
        attempt, out, shard, done = TaskContext.get().taskAttemptId(), None, -1, []
        for batch in batches:
            for s, d, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if s != shard:
                    if out:
                        done.append((shard, out.path, *out.close()))
                    out, shard = Writer(files, f"{place}/{s:06d}.ids", attempt, bits), s
                out.add(d, unpack(ids, bits, n))
        if out:
            done.append((shard, out.path, *out.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["shard", "path", "n_docs", "n_tokens"])

    key = F.col(id).cast("long")
    rows = docs.select(F.when(key.isNull(), 0).otherwise(_shard_of(key, cuts)).cast("long").alias("shard"), key.alias("id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(encode, "shard long, id long, n long, ids binary")
    ordered = rows.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "ids")
    return saved(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), folder, "manifest")


def read_packed(manifest: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """One row for each document of the files: id, start (ids of all documents before it), n_tokens, ids.

    ids are little-endian unsigned 32-bit integers. Shards are read in parallel, block by block.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files_uri = f"{folder}/shards"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(files_uri)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Reader(files, path)
                n, low = len(shard.docs), 0
                while low < n:  # about a million ids at a time
                    high = max(low + 1, int(np.searchsorted(shard.first, shard.first[low] + (1 << 20), "right")) - 1)
                    first = shard.first[low : high + 1]
                    ids = shard.ids(int(first[0]), int(first[-1]))
                    at = (first - first[0]).tolist()
                    rows = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                    docs = pa.array(shard.docs[low:high], mask=shard.null[low:high])
                    yield pa.RecordBatch.from_arrays([docs, pa.array(first[:-1] + base), pa.array(np.diff(first)), packed(rows)], names=[id, "start", "n_tokens", "ids"])
                    low = high

    n = max(1, manifest.count())
    return based.select("path", "base", "shard").repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).mapInArrow(read, f"`{id}` long, start long, n_tokens long, ids binary")
