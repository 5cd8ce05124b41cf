"""Token counts by a separator scan over flat token files.

A flat file is nothing but ids, document after document, each closed by a separator. There is no
index. Files are cut into blocks at fixed places, and a task reads only the byte ranges of its
blocks; every block is searched for the separator in one vectorised comparison, and knows nothing
about its neighbours. A prefix scan over the blocks'
summaries (ids, separators, place of the last separator) then stitches the documents that lie
across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.session import stage

BLOCK_IDS = 1 << 18
TASK_BYTES = 1 << 24
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_flat_files(
    encoded: DataFrame,
    folder: str,
    separator: int,
    ids: str = "ids",
    kind: str = ">u2",
    doc_id: str | None = None,
) -> None:
    """Write the lists of ids to a new folder of flat files, each list closed by `separator`.

    `kind` is the numpy type of an id. Spark's text sink writes the files, with the separator's
    bytes as its line separator, so these have to be valid UTF-8: in big-endian 16-bit files for
    example 50304, the letter U+0100. A null list is an empty document. A list that holds the
    separator itself, or an id that `kind` has no room for, is refused. Each task writes one file.

    With `doc_id`, a column of whole numbers, the files lie in the subfolder kind=ids, and beside
    each, in kind=names, one of the same part says the place and doc_id of its documents. Both are
    written in one pass, without a sort, so they fit whatever order the rows come in.
    """
    mark = np.array([separator], kind).tobytes().decode()
    room = np.iinfo(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            rows = []
            for value in batch.column(0):
                values = value.values.to_numpy() if value.is_valid else np.empty(0, np.int32)
                if (values == separator).any():
                    raise ValueError("a document holds the separator")
                if len(values) and (values.min() < room.min or values.max() > room.max):
                    raise ValueError(f"a document holds an id beyond {room.min} to {room.max}")
                rows.append(values.astype(kind).tobytes())
            kinds = ["ids"] * len(rows)
            if doc_id is not None:
                names = enumerate(batch.column(1).to_pylist(), done)
                rows += [f"{i} {'' if name is None else name}".encode() for i, name in names]
                kinds += ["names"] * (len(rows) - len(kinds))
                done += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), pa.array(kinds, pa.string())], names=["value", "kind"]
            )

    given = [F.col(ids)] + ([] if doc_id is None else [F.col(doc_id).cast("bigint")])
    rows = encoded.select(*given).mapInArrow(run, "value binary, kind string")
    text = F.col("value").cast("string").alias("value")
    if doc_id is None:
        rows.select(text).write.mode("errorifexists").option("lineSep", mark).text(folder)
        return
    # Two open files a task; else Spark would sort the rows by kind, and not keep their order.
    conf = encoded.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, "2")
    try:
        writer = rows.select(text, "kind").write.mode("errorifexists").partitionBy("kind")
        writer.option("lineSep", mark).text(folder)
    finally:
        conf.set(_WRITERS, before)


def _opened(path: str) -> pa.NativeFile:
    """A file of Spark's listing, open for reading at any place."""
    scheme, _, place = path.rpartition(":")
    if scheme in ("", "file"):
        return pa.OSFile("/" + place.lstrip("/"), "rb")
    system, place = pyarrow.fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return system.open_input_file(place)


def _ranged(path: str) -> bool:
    try:
        _opened(path).close()
    except (OSError, pa.ArrowException, NotImplementedError):
        return False
    return True


def _found(ids: np.ndarray, separator: int) -> np.ndarray:
    return np.flatnonzero(ids == separator).astype(np.int32)


_BLOCK_COLUMNS = "file string, block int, n bigint, found array<int>"


def _block_batch(path: str, blocks: list[int], sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * len(blocks), pa.string()),
            pa.array(blocks, pa.int32()),
            pa.array(sizes, pa.int64()),
            pa.array(found, pa.list_(pa.int32())),
        ],
        names=["file", "block", "n", "found"],
    )


def _blocks(spark: SparkSession, folder: str, separator: int, kind: str, block_ids: int) -> DataFrame:
    """file, block, n, found: how many ids each block has, and the places of its separators.

    Of a store that only Spark can open, whole files are read, of 2 GB at most.
    """
    width = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").load(folder)
    listed = files.select("path", F.floor(F.col("length") / width).alias("ids"))
    some = listed.agg(F.min("path").alias("path"), F.sum("ids").alias("ids")).first()

    def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    file.seek(row["block"] * block_ids * width)
                    ids = np.frombuffer(file.read(row["n"] * width), kind)
                if len(ids) != row["n"]:
                    raise OSError(f"{row['path']} is shorter than listed")
                yield _block_batch(row["path"], [row["block"]], [row["n"]], [_found(ids, separator)])

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, kind, raw.size // width)
                cut = [ids[at : at + block_ids] for at in range(0, len(ids), block_ids)]
                found = [_found(block, separator) for block in cut]
                yield _block_batch(path.as_py(), list(range(len(cut))), [len(c) for c in cut], found)

    if some["path"] is not None and not _ranged(some["path"]):
        return files.select("path", "content").mapInArrow(read_files, _BLOCK_COLUMNS)
    last = F.floor((F.col("ids") - 1) / block_ids)
    ranges = listed.filter("ids > 0").select(
        "path", "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")
    )
    left = F.col("ids") - F.col("block") * block_ids
    sized = ranges.select("path", "block", F.least(left, F.lit(block_ids)).alias("n"))
    tasks = 1 + (some["ids"] or 0) * width // TASK_BYTES
    return sized.repartition(tasks).mapInArrow(read_ranges, _BLOCK_COLUMNS)


def scan_token_files(
    spark: SparkSession, folder: str, separator: int, kind: str = ">u2", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """file, document, start, n_tokens of every document in the folder's flat files.

    document numbers a file's documents from 0, start is the place of its first id in the file,
    n_tokens counts its ids without the separator. Ids after a file's last separator are a last
    document; an empty file has none. Files may have any size: they are read by blocks, each once,
    and only the blocks' summaries of a file come together.
    """
    blocks = stage(_blocks(spark, folder, separator, kind, block_ids), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_block = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    last = F.when(F.col("_size") > 0, F.col("_base") + F.col("_final"))
    summaries = blocks.select(
        "file", "block", "n", F.size("found").alias("_size"), F.get("found", F.size("found") - 1).alias("_final")
    )
    scanned = (
        summaries.withColumn("_base", base)
        .withColumn("_documents", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_end", last_block)
        .withColumn("_last", last)
        .withColumn("_open", F.coalesce(F.max("_last").over(before) + 1, F.lit(0)))
        .drop("n", "_size", "_final")
        .join(blocks, ["file", "block"])
    )
    # The end of the file closes what no separator has closed.
    end = F.col("_base") + F.col("n")
    rest = F.coalesce(F.col("_last") + 1, F.col("_open")) < end
    closed = F.transform("found", lambda place: F.col("_base") + place)
    ends = F.when(F.col("_end") & rest, F.concat(closed, F.array(end))).otherwise(closed)
    listed = scanned.withColumn("_ends", ends)
    start = F.when(F.col("_pos") == 0, F.col("_open")).otherwise(
        F.get("_ends", F.col("_pos") - 1) + 1
    )
    return (
        listed.select("file", "_documents", "_open", "_ends", F.posexplode("_ends").alias("_pos", "_to"))
        .withColumn("start", start)
        .select(
            "file",
            (F.col("_documents") + F.col("_pos")).alias("document"),
            "start",
            (F.col("_to") - F.col("start")).alias("n_tokens"),
        )
    )


def scan_documents(
    spark: SparkSession, folder: str, separator: int, kind: str = ">u2", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """doc_id, part, document, start, n_tokens of the documents that were written with doc_id.

    part is the number of the file, which has no random part; the rest is as in scan_token_files.
    """
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("int").alias("part")
    columns = "doc_id bigint, part int, document bigint, start bigint, n_tokens bigint"
    if spark.read.format("binaryFile").load(folder).select("path").isEmpty():
        return spark.createDataFrame([], columns)
    scanned = scan_token_files(spark, f"{folder}/kind=ids", separator, kind, block_ids)
    mark = np.array([separator], kind).tobytes().decode()
    room = np.iinfo(kind)
    lines = spark.read.option("lineSep", mark).text(f"{folder}/kind=names")
    words = F.split("value", " ")
    names = lines.select(F.col("_metadata.file_name").alias("file"), words.alias("_words")).select(
        part,
        F.get("_words", F.lit(0)).cast("bigint").alias("document"),
        F.expr("try_cast(get(_words, 1) AS bigint)").alias("doc_id"),
    )
    placed = scanned.select(part, F.col("document").cast("bigint").alias("document"), "start", "n_tokens")
    return placed.join(names, ["part", "document"], "left").select(
        "doc_id", "part", "document", "start", "n_tokens"
    )
