"""Token counts by a map-side look-up in two tiers.

Tier one is a compact table of the corpus's frequent pre-tokens and their numbers of tokens, sent to every worker;
its size is bounded by `frequent`. Tier two is each worker's own cache, where pre-tokens that miss are encoded
once. Frequencies come from summaries: every task keeps its most frequent pre-tokens, a bounded row, and these rows
are shuffled to merge in a tree; the pre-tokens of the texts never are. The table decides only where a length is looked
up, never what it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_bpe import byte_encoder
from plumbline.llm.hashtable import HashTable
from plumbline.llm.textscan import Hasher, same_bytes, text_chunks

FREQUENT = 1 << 14
LONGEST = 32
_SUMMARY = "part long, keys binary, counts binary, sizes binary, letters binary"


class Summary:
    """The most frequent pre-tokens of a stream, at most `limit` after each cut, with their counts so far."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys, self.counts, self.pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, pieces: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        self.keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts])).astype(np.int64)
        self.pieces = np.concatenate([self.pieces, pieces])[first]
        if len(self.keys) > self.limit:
            top = np.argpartition(self.counts, -self.limit)[-self.limit :]
            self.keys, self.counts, self.pieces = self.keys[top], self.counts[top], self.pieces[top]

    def row(self, part: int) -> dict:
        sizes = np.array([len(x) for x in self.pieces], np.uint8)
        return {"part": part, "keys": self.keys.tobytes(), "counts": self.counts.tobytes(), "sizes": sizes.tobytes(), "letters": b"".join(self.pieces)}

    def add_row(self, keys: bytes, counts: bytes, sizes: bytes, letters: bytes) -> None:
        ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
        pieces = np.empty(len(ends), object)
        for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            pieces[i] = letters[a:b]
        self.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), pieces)


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text", limit: int = FREQUENT) -> list[bytes]:
    """The pre-tokens that most often occur in all texts, by merged summaries; at most `limit` of up to 32 bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kept = byte_encoder(path).split, Summary(2 * limit)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                starts, ends, _, _ = split(data, offsets)
                use = ends - starts <= LONGEST
                starts, ends = starts[use], ends[use]
                keys, first, counts = np.unique(Hasher(data).of(starts, ends), return_index=True, return_counts=True)
                if len(keys) > limit:
                    top = np.argpartition(counts, -limit)[-limit:]
                    keys, first, counts = keys[top], first[top], counts[top]
                pieces = np.empty(len(keys), object)
                for i, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
                    pieces[i] = data[a:b].tobytes()
                kept.add(keys, counts, pieces)
        row = kept.row(TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "sizes", "letters"))]))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        kept = Summary(2 * limit)
        for r in rows.itertuples():
            kept.add_row(r.keys, r.counts, r.sizes, r.letters)
        return pd.DataFrame([kept.row(int(rows.part.iloc[0]))])

    level = docs.select(F.col(text)).mapInArrow(scan, _SUMMARY)
    for fan_in in (64, 4096):
        level = level.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(merge, _SUMMARY)
    total = Summary(limit)
    for r in level.toLocalIterator():  # one row for each 4,096 tasks
        total.add_row(bytes(r["keys"]), bytes(r["counts"]), bytes(r["sizes"]), bytes(r["letters"]))
    return sorted(total.pieces.tolist())


class Tier:
    """The table of frequent pre-tokens: their bytes and numbers of tokens."""

    def __init__(self, letters: bytes, sizes: bytes, lengths: bytes):
        self.letters, self.lengths = np.frombuffer(letters, np.uint8), np.frombuffer(lengths, np.uint8).astype(np.int64)
        self.size = np.frombuffer(sizes, np.uint8).astype(np.int64)
        ends = np.cumsum(self.size)
        self.at = ends - self.size
        self.table = HashTable(len(self.size))
        keys, first = np.unique(Hasher(self.letters).of(self.at, ends), return_index=True)
        self.table.add(keys, first)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span, -1 for one that is not there; bytes are compared."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.size):
            return out
        found, size = self.table.find(Hasher(data).of(starts, ends)), ends - starts
        hit = np.flatnonzero((found >= 0) & (self.size[found] == size))
        slot = found[hit]
        same = same_bytes(data, starts[hit], self.letters, self.at[slot], size[hit])
        out[hit[same]] = self.lengths[slot[same]]
        return out


@lru_cache(maxsize=4)
def _tier(letters: bytes, sizes: bytes, lengths: bytes) -> Tier:
    return Tier(letters, sizes, lengths)


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = FREQUENT) -> DataFrame:
    """One row for each row: id, n_bytes (UTF-8) and n_tokens of the whole text.

    path: a byte-level BPE file of the tokenizers library, at the same place on every machine. Null and empty texts
    have no bytes and no tokens; repeated rows and equal ids give a row each; other columns are not read; an empty
    table gives an empty result.
    """
    pieces = frequent_pretokens(docs, path, text, limit)
    lengths = bytes(min(255, len(x)) for x in byte_encoder(path).pieces.encode(pieces))
    shared = docs.sparkSession.sparkContext.broadcast((b"".join(pieces), bytes(map(len, pieces)), lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tier = byte_encoder(path), _tier(*shared.value)
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                starts, ends, doc, odd = encoder.split(data, offsets)
                size = tier.find(data, starts, ends)
                rest = np.flatnonzero(size < 0)
                if len(rest):
                    size[rest] = encoder.pieces.lengths(encoder.pieces.slots(data, starts[rest], ends[rest]))
                total = np.bincount(doc, size, high - low).astype(np.int64)
                if len(odd):
                    total[odd] = [len(x) for x in encoder.whole(data, offsets, odd)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(np.diff(offsets)), pa.array(total)], names=[id, "n_bytes", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(count, f"`{id}` {kind}, n_bytes long, n_tokens long")
