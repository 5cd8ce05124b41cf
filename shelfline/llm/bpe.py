"""Byte-level BPE through a sentencepiece model made from the ranks alone.

The model is serialised directly from the vocabulary: every token is spelled with one letter for
each byte, scored by its negative rank, and the normaliser changes nothing. Merging the best
scored pair first is then the same as merging the pair of lowest rank. Texts are cut by the
tokenizer's pattern; each match is encoded by itself, as the whole token where it is one. Ids are
decoded by the inverse of the letters.
"""

from __future__ import annotations

import base64
import functools
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from shelfline.llm.common import Remembered, emptied_after_tasks, map_arrow

# White space as the pattern's \s has it; matches never cross from other characters into it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_REMEMBERED = 100_000  # about 40 MB of a worker, in two generations
_LONGEST_REMEMBERED = 48

_LETTERS = [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank. Every byte and every rank must be there."""
    with open(path, "rb") as file:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, file)}
    tokens = [ranks[i] for i in range(len(ranks))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("the vocabulary lacks single bytes")
    return tokens


def spelled(token: bytes) -> str:
    return "".join(map(_LETTERS.__getitem__, token))


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the tokens, in protocol buffer form.

    Fixed values, field numbers of sentencepiece's public model format: ModelProto pieces 1,
    trainer_spec 2, normalizer_spec 3; piece 1, score 2, type 3 (unknown 2); model_type 3 (BPE 2);
    name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5.
    """

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def message(field: int, body: bytes) -> bytes:
        return varint(field << 3 | 2) + varint(len(body)) + body

    def number(field: int, value: int) -> bytes:
        return varint(field << 3) + varint(value)

    def piece(text: str, score: float) -> bytes:
        return message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score)

    parts = [message(1, piece(spelled(token), -rank)) for rank, token in enumerate(tokens)]
    parts.append(message(1, piece("<unk>", 0.0) + number(3, 2)))
    parts.append(message(2, number(3, 2)))
    identity = message(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)
    parts.append(message(3, identity))
    return b"".join(parts)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        tokens = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor()
        self._model.LoadFromSerializedProto(serialised_model(tokens))
        self._bytes = [self._inverse(self._model.IdToPiece(i)) for i in range(len(tokens))]
        self._ids = {token: i for i, token in enumerate(self._bytes)}
        self._match = regex.compile(pattern).findall
        self._known = emptied_after_tasks(Remembered(self._encode, _REMEMBERED, _LONGEST_REMEMBERED))
        lengths = np.array([len(token) for token in self._bytes])
        self._table = np.frombuffer(b"".join(self._bytes), np.uint8)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths

    @staticmethod
    def _inverse(piece: str) -> bytes:
        return bytes(ord(letter) - 0x100 for letter in piece)

    def _encode(self, chunk: str) -> bytes:
        """The ids of a chunk, or of one match."""
        matches = self._match(chunk)
        if len(matches) > 1:
            return b"".join(map(self._known.__getitem__, matches))
        raw = chunk.encode()
        whole = self._ids.get(raw)
        ids = self._model.EncodeAsIds(spelled(raw)) if whole is None else [whole]
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._known.__getitem__, _CHUNK.findall(text))), "<i4")

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The tokens' bytes, gathered from one table."""
        ids = np.asarray(ids, np.int64)
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self._starts[ids] - (ends - lengths), lengths)
        return self._table[at + np.arange(len(at))].tobytes()


@functools.cache
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(
    docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", ids: str = "ids"
) -> DataFrame:
    """The columns `keep` and the ids of each whole text; a null text is empty and has none.

    `ids` takes the place of a column of that name. Special tokens' spellings are plain text.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = _codec(path, pattern)
        lists = [codec.encode(t.as_py() or "") for t in batch.column(text)]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        values = np.concatenate([np.empty(0, np.int32), *lists])
        return {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}

    return map_arrow(docs, list(dict.fromkeys([*keep, text])), run, {ids: "array<int>"}).select(
        *[c for c in keep if c != ids], ids
    )


def decode(
    encoded: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """The columns `keep` and the bytes that the ids stand for; null ids give none."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = _codec(path, pattern)
        values = [codec.decode(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column(ids)]
        return {decoded: pa.array(values, pa.binary())}

    return map_arrow(encoded, list(dict.fromkeys([*keep, ids])), run, {decoded: "binary"}).select(
        *[c for c in keep if c != decoded], decoded
    )


def encode_and_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    keep: list[str],
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """`encode` and `decode` in one pass, so that a task needs one worker and one vocabulary."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = _codec(path, pattern)
        lists = [codec.encode(t.as_py() or "") for t in batch.column(text)]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        values = np.concatenate([np.empty(0, np.int32), *lists])
        return {
            ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            decoded: pa.array([codec.decode(found) for found in lists], pa.binary()),
        }

    kept = [c for c in keep if c not in (ids, decoded)]
    added = {ids: "array<int>", decoded: "binary"}
    return map_arrow(docs, list(dict.fromkeys([*kept, text])), run, added).select(*kept, ids, decoded)
