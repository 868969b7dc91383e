"""SentencePiece encoding and decoding with the byte span of every piece.

Normalisation: at each place of the text the longest entry of the model's compiled character map is replaced, and
every normalised byte records the source bytes it came from. White space handling, the dummy prefix and the space
symbol keep that alignment. Pieces are then spans of normalised bytes, and so project to spans of the source.

BPE pieces of a model that has no piece with a space symbol after another character never cross a word's begin.
So the normalised text is cut there, and each distinct word is encoded once by the library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from plumbline.llm.pretokens import PieceTable
from plumbline.llm.textscan import owners, packed, runs, text_chunks

SYMBOL = "▁".encode()


class CharacterMap:
    """The compiled map of a model: a double array of byte strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that begins there."""
        units, best = self.units, None
        if not units:
            return None
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for end in range(at, len(text)):
            node ^= text[end]
            unit = units[node]
            if unit & 0x800000FF != text[end]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                best = end + 1 - at, self.texts[begin : self.texts.index(b"\0", begin)]
        return best

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes with the source's begin and end for each of them."""
        if not self.units:
            n = np.arange(len(text), dtype=np.int64)
            return text, *_characters(np.frombuffer(text, np.uint8), n)
        out, begins, ends, at = [], [], [], 0
        while at < len(text):
            found = self.longest(text, at)
            if found is None:
                width = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
                found = width, text[at : at + width]
            out.append(found[1])
            begins += [at] * len(found[1])
            ends += [at + found[0]] * len(found[1])
            at += found[0]
        return b"".join(out), np.array(begins, np.int64), np.array(ends, np.int64)


def _characters(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte its character's begin and end."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(heads, len(data)))
    return np.repeat(heads, width), np.repeat(heads + width, width)


class PieceEncoder:
    """Ids and source spans of whole texts, and their decoded form."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            blob = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        rules = model.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.ends = self.library.bos_id(), self.library.eos_id()
        # The cut at words holds for these models; others are encoded text by text.
        self.by_word = (
            not self.map.units
            and rules.add_dummy_prefix
            and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces
            and model.trainer_spec.model_type == model.trainer_spec.BPE
            and not model.trainer_spec.treat_whitespace_as_suffix
            and all("▁" not in p.piece.lstrip("▁") for p in model.pieces)
            and any(p.piece == "▁" for p in model.pieces)
            and all(p.type not in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        )
        self.rules = rules
        # Normalised bytes that each id covers; a byte piece covers one, an unknown one is measured by the library.
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type in (kinds.CONTROL, kinds.UNKNOWN) else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.pieces = PieceTable(self._encode_words)

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Each begins with a space, which the library adds by itself, but not to an empty text."""
        ids = self.library.encode([w[1:].decode() for w in words], num_threads=1)
        return [[self.library.piece_to_id("▁")] if w == b" " else i for w, i in zip(words, ids, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, offsets of documents in them, and each piece's begin and end in its text."""
        raw = data.tobytes()
        n = len(offsets) - 1
        if not self.by_word:
            return self._texts(raw, offsets, range(n))
        odd = np.zeros(n, bool)
        at = raw.find(SYMBOL)
        while at >= 0:  # a space symbol in the text itself is no space
            odd[owners(np.array([at]), offsets)] = True
            at = raw.find(SYMBOL, at + 1)
        if odd.any():
            return self._mixed(data, offsets, odd)
        return self._words(data, offsets)

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, ...]:
        parts, raw = [], data.tobytes()
        for k in range(len(odd)):
            low, high = offsets[k], offsets[k + 1]
            here = np.array([0, high - low])
            parts.append(self._texts(raw[low:high], here, [0]) if odd[k] else self._words(data[low:high], here))
        cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        return np.concatenate([p[0] for p in parts]), cuts, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Each document with a space before it: the dummy prefix.
        lead = offsets + np.arange(n + 1)
        full = np.full(len(data) + n, 0x20, np.uint8)
        source = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 1
        full[source] = data
        filled = np.diff(offsets) > 0
        starts = runs(full == 0x20, lead)[0]
        doc = owners(starts, lead)
        ends = np.append(starts[1:], len(full))
        use = filled[doc]
        starts, ends, doc = starts[use], ends[use], doc[use]
        slots = self.pieces.slots(full, starts, ends)
        size = self.pieces.lengths(slots)
        ids = self.pieces.gather(slots)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, size, n).astype(np.int64))])
        # Normalised bytes: three for a space. Pieces end at running sums of their widths, within their word.
        wide = np.cumsum(np.where(full == 0x20, 3, 1))
        base = np.repeat(wide[starts] - 3, size)
        first = np.repeat(np.cumsum(size) - size, size)
        total = np.concatenate([[0], np.cumsum(self.width[ids])])
        low = base + total[:-1] - total[first]
        high = base + total[1:] - total[first]
        # From normalised to full bytes: the byte that covers the place; a space's three bytes are one.
        a = np.searchsorted(wide, low, "right")
        b = np.searchsorted(wide, high - 1, "right") + 1
        heads = np.flatnonzero((full & 0xC0) != 0x80)
        a = heads[np.searchsorted(heads, a, "right") - 1]  # a byte piece spans its whole character
        after = np.append(heads, len(full))
        b = after[np.searchsorted(after, b, "left")]
        back = lead[np.repeat(doc, size)] + 1
        return ids, cuts, np.maximum(a - back, 0), np.maximum(b - back, 0)

    def _texts(self, raw: bytes, offsets: np.ndarray, rows) -> tuple[np.ndarray, ...]:
        """Text by text: normalise with alignment, encode with the library, project its pieces."""
        ids, cuts, begins, ends = [], [0], [], []
        for k in rows:
            text = raw[offsets[k] : offsets[k + 1]]
            own = self.library.encode(text.decode())
            norm, a, b = self.normalised(text)
            place = 0
            for i in own:
                width = int(self.width[i])
                if not width:  # unknown: one character
                    width = 1 + (norm[place] >= 0xC0) + (norm[place] >= 0xE0) + (norm[place] >= 0xF0)
                stop = min(place + width, len(norm))
                begins.append(int(a[place : stop or 1].min()) if stop > place else len(text))
                ends.append(int(b[place:stop].max()) if stop > place else len(text))
                place = stop
            ids += own
            cuts.append(len(ids))
        return np.array(ids, np.int64), np.array(cuts, np.int64), np.array(begins, np.int64), np.array(ends, np.int64)

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised text, with space symbols, and the source's begin and end for each of its bytes."""
        norm, a, b = self.map.apply(text)
        parts = [(norm[i : i + 1], int(a[i]), int(b[i])) for i in range(len(norm))]
        if self.rules.remove_extra_whitespaces:
            kept = []
            for part in parts:
                if part[0] != b" " or (kept and kept[-1][0] != b" "):
                    kept.append(part)
            while kept and kept[-1][0] == b" ":
                kept.pop()
            parts = kept
        if self.rules.add_dummy_prefix and parts:
            parts = [(b" ", 0, 0), *parts]
        out, begins, ends = [], [], []
        for byte, x, y in parts:
            byte = SYMBOL if byte == b" " and self.rules.escape_whitespaces else byte
            out.append(byte)
            begins += [x] * len(byte)
            ends += [y] * len(byte)
        return b"".join(out), np.array(begins, np.int64), np.array(ends, np.int64)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One for each worker process and file."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row: id, kept columns, ids with begin and end, the pieces' byte spans, and the decoded text.

    path: a SentencePiece model, at the same place on every machine. ids, begins and ends are little-endian unsigned
    32-bit integers; spans are byte offsets in the UTF-8 source, empty for the begin and end ids and for the dummy
    prefix. Null and empty texts have the begin and end ids only. Repeated rows give a row each; columns that are
    not named are not read, so names cannot clash; an empty table gives an empty result.
    """
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id, *keep)] + ["ids binary, begins binary, ends binary, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        head, tail = encoder.ends
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                ids, cuts, begins, ends = encoder.encode(data, offsets)
                sizes = np.diff(offsets)
                rows: tuple[list, ...] = ([], [], [], [])
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    own = np.concatenate([[head], ids[a:b], [tail]]).astype("<u4")
                    rows[0].append(own.tobytes())
                    rows[1].append(np.concatenate([[0], begins[a:b], [sizes[k]]]).astype("<u4").tobytes())
                    rows[2].append(np.concatenate([[0], ends[a:b], [sizes[k]]]).astype("<u4").tobytes())
                    rows[3].append(encoder.library.decode(own.tolist()))
                kept = [batch.column(c)[low:high] for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *map(packed, rows[:3]), pa.array(rows[3], pa.string())], names=[id, *keep, "ids", "begins", "ends", "decoded"])

    return docs.select(id, *keep, text).mapInArrow(run, schema)
