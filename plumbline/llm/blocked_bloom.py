"""Blocked Bloom filter: each key sets four bits of one 256-bit block, so a test touches one cache line."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textscan import mix

BITS_PER_KEY = 16
#: At most 8 MB, however many keys there are: a fuller filter passes more, and the exact join behind it decides.
MAX_BLOCKS = 1 << 18


@dataclass(frozen=True)
class BlockedBloom:
    words: np.ndarray  # uint64, blocks x 4

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were never added."""
        block, masks = _places(keys, len(self.words))
        return ((self.words[block] & masks) == masks).all(1)


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(keys.view(np.uint64) + np.uint64(0x51ED))
    block = (mixed >> np.uint64(40)) % np.uint64(blocks)
    bits = np.stack([(mixed >> np.uint64(6 * k)) & np.uint64(63) for k in range(4)], axis=1)
    return block.astype(np.int64), np.uint64(1) << bits


def build_bloom(keys: DataFrame) -> BlockedBloom:
    """The filter of a DataFrame's only column, a long; null keys are left out. Tasks set bits of their own rows,
    blocks are OR-ed in a shuffle, and what reaches the driver is bounded by MAX_BLOCKS."""
    name = keys.columns[0]
    n = keys.where(F.col(name).isNotNull()).count()
    blocks = int(min(MAX_BLOCKS, 1 << max(0, (n * BITS_PER_KEY - 1) // 256).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, masks = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), blocks)
            order = np.argsort(block)
            found, first = np.unique(block[order], return_index=True)
            words = np.bitwise_or.reduceat(masks[order], first, axis=0) if len(found) else masks
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(4))], names=["block", "w0", "w1", "w2", "w3"])

    parts = keys.select(F.col(name).cast("long").alias("key")).mapInArrow(bits, "block long, w0 long, w1 long, w2 long, w3 long")
    table = parts.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4))).toArrow()
    words = np.zeros((blocks, 4), np.uint64)
    at = table.column("block").to_numpy()
    for k in range(4):
        words[at, k] = table.column(f"w{k}").to_numpy().view(np.uint64)
    return BlockedBloom(words)
