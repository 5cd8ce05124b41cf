"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline import session

# Rows per Arrow batch: bounds a worker's memory where texts are long.
ARROW_ROWS = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
_ROW_BITS = 33


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings and small Arrow batches."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_uniform(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def split_place(at: str) -> tuple[Column, Column]:
    """Partition and row of a monotonically_increasing_id() column."""
    return F.shiftright(at, _ROW_BITS), F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)


def running_starts(totals: dict[int, int]) -> list[tuple[int, int]]:
    """Partition to the sum of all partitions before it."""
    parts = sorted(totals)
    return list(zip(parts, accumulate((totals[p] for p in parts), initial=0)))


_caches: list[dict] = []


def emptied_after_tasks(cache: dict) -> dict:
    """Have `release` empty this cache of a worker process."""
    _caches.append(cache)
    return cache


def release() -> None:
    """At the end of a task give its memory back: a worker that waits for the next task, perhaps of
    another stage, shares the executor's memory with those at work."""
    for cache in _caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


class Remembered(dict):
    """What `make` gives for short strings, in two generations.

    When the young one is full it becomes the old one, whose members return to the young one as
    they are asked for; so at most twice `most` strings are held, and frequent ones stay.
    """

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int) -> None:
        super().__init__()
        self._make, self._most, self._longest = make, most, longest
        self._old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        made = self._old.get(text)
        if made is None:
            made = self._make(text)
        if len(text) <= self._longest:
            if len(self) >= self._most:
                self._old = dict(self)
                super().clear()
            self[text] = made
        return made

    def clear(self) -> None:
        super().clear()
        self._old = {}


def map_arrow(
    df: DataFrame,
    columns: list[str],
    function: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    added: dict[str, str],
) -> DataFrame:
    """The given columns and those that `function` makes of each Arrow batch.

    Names in `added` replace columns of the same name, as withColumn does.
    """
    kept = [c for c in columns if c not in added]
    schema = ", ".join(
        [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]
        + [f"`{name}` {kind}" for name, kind in added.items()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                made = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [made[name] for name in added],
                    names=kept + list(added),
                )
        finally:
            release()

    return df.select(*columns).mapInArrow(run, schema)


def first_of(df: DataFrame, by: list[str]) -> DataFrame:
    """One row of those equal in the given columns."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*by))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")
