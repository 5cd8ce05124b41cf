"""Continuous ingest of submissions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfline.plans.catalog import Catalog
from shelfline.plans.compaction import compact_batches
from shelfline.plans.ingest import ingest_submissions

SUBMISSIONS = T.StructType(
    [T.StructField("submission_id", T.LongType()), T.StructField("body", T.StringType())]
)


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "json",
    files: str = "*",
    files_per_batch: int = 1000,
) -> DataFrame:
    """New files of a folder as a stream, so many to a micro-batch."""
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def each_batch(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Hand every micro-batch to `handle`, which must be safe to repeat.

    Without an interval the query takes all present input and ends.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.foreachBatch(handle).start()


def stream_submissions(
    submissions: DataFrame,
    catalog: Catalog,
    checkpoint: str,
    writer: str | None = None,
    interval: str | None = None,
    compact_every: int | None = None,
    once_within: str | None = None,
) -> StreamingQuery:
    """Ingest a stream of (submission_id, body) by the rules of the batch job.

    Micro-batch N becomes batch N of `writer`, by default one that is named after
    the checkpoint folder: a new checkpoint counts from 0 again and must not own
    the batches of another. Lookup tables are read anew for each micro-batch.
    Stateless: no watermark is needed. After each `compact_every` micro-batches the batches so far
    are merged, so a stream that runs for ever keeps few files. `once_within` drops submissions that
    were delivered before, also under another checkpoint.
    """
    name = writer or f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def ingest(batch: DataFrame, number: int) -> None:
        ingest_submissions(batch, catalog, number, writer=name, once_within=once_within)
        if compact_every and (number + 1) % compact_every == 0:
            compact_batches(batch.sparkSession, catalog)

    return each_batch(submissions.select(*SUBMISSIONS.fieldNames()), ingest, checkpoint, interval)


def split_stream(
    stream: DataFrame,
    accept: str,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Write rows meeting the SQL condition `accept` and the others apart.

    Each micro-batch owns a `batch=N` folder of either table and overwrites it.
    """

    def write(batch: DataFrame, number: int) -> None:
        # A null condition is not met.
        met = F.coalesce(F.expr(accept), F.lit(False))
        batch.where(met).write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        batch.where(~met).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return each_batch(stream, write, checkpoint)
