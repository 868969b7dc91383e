"""Byte-level BPE of whole documents, through a table of pre-tokens."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from plumbline.llm.pretokens import PieceTable, byte_level_starts, one_thread, plain
from plumbline.llm.textscan import owners


def byte_letters() -> str:
    """The characters that stand for the 256 bytes: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class ByteEncoder:
    """Ids exactly as the library gives them, without added special tokens.

    A text of ASCII and Latin letters without a special token's string is cut into pre-tokens with numpy and each
    distinct one is encoded by the library's model. Any other text goes to the library as a whole.
    """

    def __init__(self, path: str):
        one_thread()
        self.library = Tokenizer.from_file(path)
        model, letters = self.library.model, byte_letters()
        self.pieces = PieceTable(
            lambda xs: [[t.id for t in model.tokenize(x.decode("latin-1").translate(letters))] for x in xs]
        )
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        good, raw = plain(data, offsets), data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                good[owners(np.array([at]), offsets)] = False
                at = raw.find(token, at + 1)
        return good

    def whole(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[list[int]]:
        """Ids of some documents, each encoded by the library as one text."""
        texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows.tolist()]
        return [self.library.encode(t, add_special_tokens=False).ids for t in texts]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the pre-tokens of plain documents; the documents that are not plain."""
        good = self.plain(data, offsets)
        if not len(data):
            return (none := np.zeros(0, np.int64)), none, none, none
        starts = byte_level_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        doc = owners(starts, offsets)
        if not good.all():
            use = good[doc]
            starts, ends, doc = starts[use], ends[use], doc[use]
        return starts, ends, doc, np.flatnonzero(~good)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin (one more at the end)."""
        n = len(offsets) - 1
        starts, ends, doc, odd = self.split(data, offsets)
        slots = self.pieces.slots(data, starts, ends)
        counts = np.bincount(doc, self.pieces.lengths(slots), n).astype(np.int64)
        ids = self.pieces.gather(slots)
        if len(odd):
            ids, counts = _insert(ids, counts, odd, self.whole(data, offsets, odd))
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _insert(ids: np.ndarray, counts: np.ndarray, odd: np.ndarray, own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate([[0], np.cumsum(counts)])
    out, last = [], 0
    for row, more in zip(odd.tolist(), own, strict=True):
        out += [ids[cuts[last] : cuts[row]], np.array(more, np.int32)]
        counts[row], last = len(more), row
    return np.concatenate([*out, ids[cuts[last] :]]), counts


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ByteEncoder:
    """One for each worker process and file."""
    return ByteEncoder(path)
