"""Listing a fact table with the names from its lookup tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """A table with a unique `key`, reached from `fact_key` of the fact table.

    `columns` maps the lookup's columns to their names in the listing.
    """

    frame: DataFrame
    key: str
    fact_key: str
    columns: Mapping[str, str]


def attach_lookups(fact: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Left-join every lookup. Fact rows without a partner keep null names.

    No join is forced: small lookups are broadcast by their measured size, and
    beyond the threshold adaptive execution splits the hot keys of the shuffle.
    """
    joined = fact
    for position, lookup in enumerate(lookups):
        key = f"_lookup_key_{position}"
        right = lookup.frame.select(
            F.col(lookup.key).alias(key),
            *(F.col(name).alias(alias) for name, alias in lookup.columns.items()),
        )
        joined = joined.join(right, F.col(lookup.fact_key) == F.col(key), "left").drop(key)
    return joined


def catalog_list(
    fact: DataFrame,
    lookups: Sequence[Lookup],
    columns: Sequence[str],
    where: Column | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The fact rows passing `where`, with lookup names, in binary string order.

    `where` may use fact columns only, so it runs in the fact scan below the
    joins. A lookup none of whose names is wanted is not joined at all. End
    `order_by` with the fact key: that fixes the order of equal rows and keeps
    the range partitions of the sort even.
    """
    wanted = {*columns, *order_by}
    used = []
    for lookup in lookups:
        kept = {name: alias for name, alias in lookup.columns.items() if alias in wanted}
        if kept:
            used.append(Lookup(lookup.frame, lookup.key, lookup.fact_key, kept))
    rows = fact if where is None else fact.where(where)
    listing = attach_lookups(rows, used)
    if order_by:
        listing = listing.orderBy(*(F.col(name).asc_nulls_first() for name in order_by))
    return listing.select(*columns)


def lookup_list(frame: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(id, name) in binary order of the name."""
    return frame.select(F.col(key).alias("id"), F.col(name).alias("name")).orderBy(
        F.col("name").asc_nulls_first(), "id"
    )


def is_empty(df: DataFrame) -> bool:
    """True when a listing has no rows; stops at the first row found."""
    return df.isEmpty()
