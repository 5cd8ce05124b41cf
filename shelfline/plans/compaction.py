"""Merging closed batches into runs, so that many small batches stay few files.

A log-structured merge: the batches that are done become a run, and runs that are not much larger
than what is merged are taken along. So each run is several times the size of the next, their
number grows with the logarithm of the rows, and a row is rewritten about as often. The
reservations of the merged batches are folded into one row for each writer, in the version file.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas
from shelfline.plans.catalog import (
    FOLDER,
    OWNER,
    RECEIPTS,
    Catalog,
    folders_among,
    owner_columns,
)
from shelfline.plans.versions import (
    RUNS,
    CatalogChanged,
    Version,
    batch_folder,
    claims,
    done_batches,
    done_name,
    merge_ranges,
    publish,
)
from shelfline.session import stage, staging
from shelfline.sources.claims import bytes_in, delete
from shelfline.sources.tables import recreate_table

TABLES = ("practices", "rejected", "receipts")
# A run is merged again when what would follow it has this part of its rows.
GROWTH = 4
ROWS_A_FILE = 1_000_000
# A file is sorted by one task, however long its rows are.
BYTES_A_FILE = 64 << 20


def compact_batches(spark: SparkSession, catalog: Catalog) -> int:
    """Merge all batches that are done; the number of batches merged.

    The rows and ids of the catalog stay as they are, and so does the owner of each row. Batches
    that run meanwhile are left alone. A merged batch that is run again stores nothing. The
    files of the merged batches are deleted when the next version is published, readers of this
    one have until then. If another job publishes first, nothing is merged and 0 returned.
    """
    base = catalog.version()
    root = catalog.folder
    done = done_batches(spark, root, base)
    if not done:
        return 0
    with staging(spark):
        closing = stage(
            claims(spark, root, base.data).join(
                F.broadcast(spark.createDataFrame(done, "writer string, batch long")), ["writer", "batch"]
            ),
            "closing",
        )
        rows = closing.agg(F.coalesce(F.sum(F.col("last_id") - F.col("before_id")), F.lit(0))).head()[0]
        kept, merged = list(base.runs), []
        while kept and kept[-1]["rows"] <= GROWTH * rows:
            merged.append(kept.pop())
            rows += merged[-1]["rows"]
        number = max((run["number"] for run in base.runs), default=0) + 1
        batches = [(RUNS, run["number"]) for run in merged] + done
        _write_run(spark, root, base, batches, number, rows)
        following, seqs = _folded(spark, root, base, done, [*kept, {"number": number, "rows": rows}])
    gone = [f"{base.data}/{batch_folder(t, *b)}" for t in TABLES for b in batches]
    gone += [f"{base.data}/done/{done_name(*b)}" for b in done]
    # The last reservation stays until there is a later one.
    gone += [f"{base.data}/ids/{seq:012}" for seq in seqs if seq < following.seq]
    try:
        publish(spark, root, base, replace(following, retired=gone))
    except CatalogChanged:
        delete(spark, [f"{root}/{base.data}/{batch_folder(t, RUNS, number)}" for t in TABLES])
        return 0
    return len(done)


def _write_run(
    spark: SparkSession, root: str, base: Version, batches: list[tuple[str, int]], number: int, rows: int
) -> None:
    """One run of the rows of some batches and runs, sorted so that statistics can skip files."""

    def read(table: str, fields: T.StructType) -> tuple[DataFrame, int]:
        """The rows, and into how many files they go."""
        folder = f"{root}/{base.data}/{table}"
        paths = [f"{root}/{base.data}/{batch_folder(table, *batch)}" for batch in batches]
        paths = folders_among(spark, folder, paths)
        files = max(1, -(-rows // ROWS_A_FILE), -(-bytes_in(spark, paths) // BYTES_A_FILE))
        schema = T.StructType([*fields, *OWNER, *FOLDER])
        if paths:
            found = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
        else:
            found = spark.createDataFrame([], schema)
        writer, batch = owner_columns()
        return found.select(*fields.fieldNames(), writer.alias("of_writer"), batch.alias("of_batch")), files

    order = ["domain", "category_id", "practice_id"]
    practices, files = read("practices", schemas.PRACTICES)
    practices = practices.repartitionByRange(files, *order)
    target = f"{root}/{base.data}/" + "{}"
    recreate_table(
        practices.sortWithinPartitions(*order), target.format(batch_folder("practices", RUNS, number)), ("domain",)
    )
    rejected, files = read("rejected", schemas.REJECTED)
    rejected = rejected.repartitionByRange(files, "of_batch", "submission_id")
    recreate_table(rejected, target.format(batch_folder("rejected", RUNS, number)))
    # Receipts that have expired go. Sorted by time, so that statistics skip old ones.
    receipts, files = read("receipts", RECEIPTS)
    valid = receipts.where(F.col("expires") > F.current_timestamp())
    receipts = valid.repartitionByRange(files, "expires", "key").sortWithinPartitions("expires", "key")
    recreate_table(receipts, target.format(batch_folder("receipts", RUNS, number)))


def _folded(
    spark: SparkSession,
    root: str,
    base: Version,
    done: list[tuple[str, int]],
    runs: list[dict],
) -> tuple[Version, list[int]]:
    """The version with the batches closed, and the numbers of their reservations."""
    closed = dict(base.closed)
    numbers: dict[str, list[int]] = {}
    for writer, batch in done:
        numbers.setdefault(writer, []).append(batch)
    for writer, batches in numbers.items():
        closed[writer] = merge_ranges(closed.get(writer, []), batches)
    # What is left of the reservations since the last compaction.
    left = claims(spark, root, base.data).select("seq", "writer", "batch", "last_id").collect()
    made = replace(
        base,
        runs=runs,
        closed=closed,
        seq=max([base.seq, *(row["seq"] for row in left)]),
        last_id=max([base.last_id, *(row["last_id"] for row in left)]),
    )
    return made, [row["seq"] for row in left if made.is_closed(row["writer"], row["batch"])]
