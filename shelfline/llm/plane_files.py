"""Token ids in files of shuffled bit or byte planes.

Ids are cut into blocks of a fixed size. A block is transposed: the first bits (or bytes) of all
its ids, then the second ones, and so on; each plane is compressed by zstandard alone. High planes
are nearly constant and almost vanish.

A chunk is one row of a Parquet table and holds whole documents, about CHUNK_IDS ids:

    part, chunk     place of the chunk; documents ascend by id through parts and chunks
    first, n_ids    ids of the part before the chunk, ids in it
    doc_ids, counts its documents and how many ids each has
    planes          length of each compressed plane, block by block
    data            the planes

The narrow columns are the chunk index: they are read without the data.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfline.llm.common import Remembered, release, running_starts

CHUNK_IDS = 1 << 18
BLOCK_IDS = 1 << 15
LEVEL = 3
_REMEMBERED = 300_000  # in both generations about 140 MB
_LONGEST_REMEMBERED = 48
# Letters that keep their form under composition and become one letter in lower case.
_PLAIN_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which joins endings


# Fixed rule of byte-level tokenizers: printable bytes are their own letters, the others follow
# from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_SPELLED = [chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256)]


def _kinds(step: dict) -> list[str]:
    """The types of the steps in a part of a tokenizer."""
    listed = step.get("normalizers") or step.get("pretokenizers") or [step] if step else []
    return [s["type"] for s in listed]


# --- encoding ---------------------------------------------------------------


class WordTokenizer:
    """A tokenizer of the tokenizers library that drops white space, with remembered words.

    Such a tokenizer encodes the pieces between white space independently, and letters apart from
    the punctuation after them. Spellings of special tokens hold no white space; they become the
    special ids, as by the library's plain call, unless they are taken as plain text.
    """

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._model = self._tokenizer.model
        steps = json.loads(self._tokenizer.to_str())
        self._lower = _kinds(steps["normalizer"]) == ["NFC", "Replace", "Lowercase"]
        self._lower &= _kinds(steps["pre_tokenizer"]) == ["Split", "ByteLevel"]
        self._known = Remembered(self._encode, _REMEMBERED, _LONGEST_REMEMBERED)

    def _encode(self, spaced: bytes) -> bytes:
        """The ids of what stands between white space, in UTF-8.

        Of plain letters the tokenizer's other steps would only make lower case and spell the
        bytes; that is done here, and the model alone called, at a quarter of the cost.
        """
        piece = spaced.decode()
        letters = piece.rstrip(_PUNCTUATION)
        if not _PLAIN_LETTERS(letters):
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        elif letters != piece:
            return self._known[letters.encode()] + self._known[piece[len(letters) :].encode()]
        elif self._lower:
            spelled = "".join(map(_SPELLED.__getitem__, piece.lower().encode()))
            ids = [token.id for token in self._model.tokenize(spelled)]
        else:
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, the same as by the library on the whole text."""
        # Of bytes, split takes the six white space characters of ASCII and no others.
        return np.frombuffer(b"".join(map(self._known.__getitem__, text.encode().split())), "<u4")


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path, special_as_text=False)


# --- planes -----------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The compressed planes of one block, most significant first."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits:
        raw = np.unpackbits(raw, axis=1)
        return [pack(np.packbits(plane).tobytes()) for plane in raw.T]
    return [pack(plane.tobytes()) for plane in raw.T]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = np.stack([np.frombuffer(unpack(plane), np.uint8) for plane in planes])
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1)[:, :n], axis=0)
    return np.ascontiguousarray(raw.T).view(">u4").reshape(-1).astype("<u4")


def _chunk(ids: np.ndarray, bits: bool) -> tuple[list[int], bytes]:
    blocks = [ids[at : at + BLOCK_IDS] for at in range(0, len(ids), BLOCK_IDS)]
    planes = [plane for block in blocks for plane in to_planes(block, bits)]
    return [len(plane) for plane in planes], b"".join(planes)


def _unchunk(lengths: list[int], data: bytes, n: int, bits: bool) -> np.ndarray:
    ends = np.cumsum(lengths)
    planes = [data[end - length : end] for length, end in zip(lengths, ends)]
    width = 32 if bits else 4
    blocks = [
        from_planes(planes[i : i + width], min(BLOCK_IDS, n - i // width * BLOCK_IDS), bits)
        for i in range(0, len(planes), width)
    ]
    return np.concatenate([np.empty(0, "<u4"), *blocks])


# --- files ------------------------------------------------------------------

_CHUNKS = (
    "part int, chunk int, first bigint, n_ids bigint, doc_ids array<bigint>, "
    "counts array<bigint>, planes array<int>, data binary"
)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    bits: bool = False,
) -> None:
    """Encode all whole texts and write them to a new folder, ascending by doc_id.

    Ids are those of the library's plain call without added special tokens; a special token that a
    text spells out becomes its id. Null texts count as empty, `end_id` follows every document. Null ids come first; equal ids
    are ordered by the text's hash. Texts are range partitioned before they are encoded, so that
    the sampling for the ranges does not encode them too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _tokenizer(tokenizer), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], "<u4")
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held, chunk, first = 0, 0, 0

        def row() -> pa.RecordBatch:
            joined = np.concatenate([np.empty(0, "<u4"), *ids])
            planes, data = _chunk(joined, bits)
            values = [[part], [chunk], [first], [len(joined)], [names], [[len(i) for i in ids]], [planes], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array(v, k) for v, k in zip(values, kinds)]
            return pa.RecordBatch.from_arrays(
                columns, names=["part", "chunk", "first", "n_ids", "doc_ids", "counts", "planes", "data"]
            )

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(np.concatenate([encoder.encode(value.as_py() or ""), end]))
                held += len(ids[-1])
                if held >= CHUNK_IDS:
                    yield row()
                    names, ids, held, chunk, first = [], [], 0, chunk + 1, first + held
        if names:
            yield row()
        names, ids = [], []
        release()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("_text")]
    (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, _CHUNKS)
        .write.mode("errorifexists")
        .parquet(folder)
    )


def read_token_files(spark: SparkSession, folder: str, bits: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit
    numbers. Chunks are read independently; one number for each part reaches the driver.
    """
    chunks = spark.read.schema(_CHUNKS).parquet(folder)
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts = running_starts({row["part"]: row["n"] for row in totals})
    offsets = spark.createDataFrame(starts, "part int, _before bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizer.cache_clear()  # a worker that has encoded needs its remembered words no more
        release()
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unchunk(row["planes"], row["data"], row["n_ids"], bits)
                ends = np.cumsum(row["counts"])
                begins = ends - row["counts"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begins + (row["_before"] + row["first"]), pa.int64()),
                        pa.array(row["counts"], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
        release()

    return chunks.join(F.broadcast(offsets), "part").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
