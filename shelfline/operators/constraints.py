"""Storage rules: CHECK, NOT NULL, UNIQUE, PRIMARY KEY and FOREIGN KEY."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.schemas import ForeignKey, StorageRules
from shelfline.session import stage

# Distinct values of a batch, counted, that may be broadcast to the stored rows.
MAX_BROADCAST_KEYS = 1_000_000


class ConstraintViolation(ValueError):
    """A load that must succeed as a whole holds rows that break a rule."""


def check_fails(column: str, values: Sequence[str | None]) -> Column:
    """A CHECK list rejects a row only if it evaluates to FALSE, not to NULL."""
    listed = [F.lit(value).cast("string") for value in values]
    return ~F.coalesce(F.col(column).isin(*listed), F.lit(True))


def is_missing(column: str) -> Column:
    return F.col(column).isNull()


def row_violations(rules: StorageRules) -> dict[str, Column]:
    """The rules a row can break on its own, each with the test for breaking it."""
    missing = {f"NOT NULL {name}": is_missing(name) for name in rules.not_null}
    failed = {f"CHECK {name}": check_fails(name, words) for name, words in rules.checks.items()}
    return {**missing, **failed}


def duplicates(df: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """(value, rows): values given more than once, or once but stored already.

    Nulls are never equal. Counts are merged before the shuffle, so a frequent
    value costs no more than a rare one. The given values are counted first: up to
    MAX_BROADCAST_KEYS of them go to the stored rows, which are then read where they
    lie; more are shuffled together with these.
    """
    given = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    counts = given.groupBy("value").agg(F.count("*").alias("given"))
    if existing is None:
        return counts.where("given > 1").select("value", F.col("given").alias("rows"))
    counts = stage(counts, "given-values")
    stored = existing.select(F.col(column).alias("_stored")).where(F.col("_stored").isNotNull())
    if counts.count() <= MAX_BROADCAST_KEYS:
        stored = stored.join(F.broadcast(counts), F.col("_stored") == F.col("value")).select("_stored")
    held = stored.groupBy("_stored").agg(F.count("*").alias("held"))
    both = counts.join(held, F.col("value") == F.col("_stored"), "left")
    rows = F.col("given") + F.coalesce("held", F.lit(0))
    return both.select("value", rows.alias("rows")).where("rows > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key is not null and has no parent."""
    known = parents.select(F.col(key).alias("_parent_key"))
    present = df.where(F.col(column).isNotNull())
    return present.join(known, F.col(column) == F.col("_parent_key"), "left_anti")


def mark_orphans(
    df: DataFrame, foreign_keys: Sequence[ForeignKey], parents: Mapping[str, DataFrame]
) -> DataFrame:
    """Add `orphan_<column>` for each foreign key: true if its parent is missing.

    One left join per key; parents must be unique on their key. A parent table
    is broadcast if its measured size allows it; otherwise both sides shuffle
    and adaptive execution splits the frequent keys, nulls included.
    """
    for fk in foreign_keys:
        known = parents[fk.references].select(
            F.col(fk.key).alias("_parent_key"), F.lit(True).alias("_known")
        )
        broken = F.col(fk.column).isNotNull() & F.col("_known").isNull()
        df = df.join(known, F.col(fk.column) == F.col("_parent_key"), "left").select(
            *df.columns, broken.alias(f"orphan_{fk.column}")
        )
    return df


def enforce(
    df: DataFrame,
    rules: StorageRules,
    parents: Mapping[str, DataFrame] | None = None,
    existing: DataFrame | None = None,
) -> None:
    """Raise if any row breaks any rule, naming each broken rule and its count.

    For a table that must load as a whole, or be added to the `existing` rows. The row rules and foreign keys take
    one pass together, each unique column one more.
    """
    tests = row_violations(rules)
    for fk in rules.foreign_keys:
        tests[f"FOREIGN KEY {fk.column}"] = F.col(f"orphan_{fk.column}")
    counts = {}
    if tests:
        marked = mark_orphans(df, rules.foreign_keys, parents or {})
        row = marked.agg(*(F.count_if(test).alias(rule) for rule, test in tests.items()))
        counts = row.head().asDict()
    unique = {f"UNIQUE {name}": name for name in rules.unique}
    if rules.primary_key in df.columns:
        unique[f"PRIMARY KEY {rules.primary_key}"] = rules.primary_key
    for rule, column in unique.items():
        counts[rule] = duplicates(df, column, existing).count()
    broken = [f"{rule}: {count}" for rule, count in sorted(counts.items()) if count]
    if broken:
        raise ConstraintViolation(", ".join(broken))
