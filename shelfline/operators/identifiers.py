"""Generated ids and column defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.session import stage

# monotonically_increasing_id() holds the partition above bit 33, the row below.
_ROW_BITS = 33


def assign_ids(
    df: DataFrame, id_column: str, order_by: Sequence[str], start: int = 0
) -> DataFrame:
    """Number the rows start+1, start+2, ... in the given order.

    The order must be total: end it with a unique column. Rows are range
    partitioned and sorted in parallel, then written once with their partition
    and place, so that counting the partitions and numbering the rows see the
    same layout even if executors are lost in between. Only one number per
    partition reaches the driver. `df` must not have the id column yet.
    """
    order = [F.col(name).asc_nulls_first() for name in order_by]
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = stage(
        spread.withColumn("_at", at).select(
            *df.columns,
            F.shiftright("_at", _ROW_BITS).alias("_part"),
            F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
        ),
        "ids",
    )
    counts = placed.groupBy("_part").count().collect()
    sizes = sorted((row["_part"], row["count"]) for row in counts)
    firsts = accumulate((size for _, size in sizes), initial=start + 1)
    offsets = df.sparkSession.createDataFrame(
        [(part, first) for (part, _), first in zip(sizes, firsts)],
        "_part bigint, _first bigint",
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_first") + F.col("_row")).alias(id_column), *df.columns
    )


def now() -> Column:
    """The time of the statement in UTC, in whole seconds."""
    return F.date_trunc("second", F.current_timestamp())


def fill_omitted(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the columns the frame does not have.

    A default stands for an omitted column only; a null that was given stays.
    """
    missing = {
        name: value if isinstance(value, Column) else F.lit(value)
        for name, value in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df
