"""Creating a catalog, loading it in bulk and adding submissions to it.

Loads publish a new version of the catalog when all their tables are stored. A batch belongs to
its writer and owns its folders, so writers never overwrite each other; it numbers its rows,
reserves ids for them after all that were reserved before, stores them and becomes visible as a
whole. A batch that runs again finds its own reservation, gives the same ids and overwrites its
own rows only. Any number of batches may run at a time. `versions` describes the files.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas
from shelfline.operators.constraints import ConstraintViolation, enforce
from shelfline.operators.identifiers import assign_ids, fill_omitted, now
from shelfline.operators.submissions import split_outcome, validate_submissions
from shelfline.plans.catalog import Catalog
from shelfline.plans.versions import (
    CatalogChanged,
    Version,
    batch_folder,
    current,
    done_name,
    new_folder,
    publish,
    reserve,
)
from shelfline.session import stage, staging
from shelfline.sources.claims import put_if_absent
from shelfline.sources.tables import in_file_order, read_table, recreate_table, without

# The selective enumerated column: a search for one area reads its folders only.
PARTITION_BY = ("domain",)

def _store(df: DataFrame, root: str, version: Version, table: str, writer: str, batch: int) -> None:
    """Write one batch of complete practices, or of rejected submissions."""
    path = f"{root}/{version.data}/{batch_folder(table, writer, batch)}"
    if table != "practices":
        recreate_table(df, path)
        return
    rows = df.select(*(F.col(field.name).cast(field.dataType) for field in schemas.PRACTICES))
    # Rows of one category lie together in a file, so its statistics can skip it.
    recreate_table(rows.sortWithinPartitions("domain", "category_id"), path, PARTITION_BY)


def _finish(spark: SparkSession, root: str, version: Version, writer: str, batch: int) -> None:
    """Make a stored batch visible, unless the catalog it was stored in was replaced."""
    put_if_absent(spark, f"{root}/{version.data}/done/{done_name(writer, batch)}", "")
    after = current(spark, root)
    if after is None or after.data != version.data:
        raise CatalogChanged(f"{root} was loaded anew while batch {batch} of {writer} ran")


def _publish_load(
    spark: SparkSession, root: str, lookups: Mapping[str, DataFrame], practices: DataFrame | None, last_id: int
) -> None:
    """Store whole tables in new folders and publish them as one version."""
    base = current(spark, root)
    made = Version(0, new_folder("data"), new_folder("lookups"))
    for table, frame in lookups.items():
        recreate_table(frame, f"{root}/{made.lookups}/{table}")
    if practices is not None:
        reservation = {"seq": 1, "writer": "load", "batch": 0, "before_id": 0, "last_id": last_id, "lookups": made.lookups}
        put_if_absent(spark, f"{root}/{made.data}/ids/{1:012}", json.dumps(reservation))
        _store(practices, root, made, "practices", "load", 0)
        _store(spark.createDataFrame([], schemas.REJECTED), root, made, "rejected", "load", 0)
        put_if_absent(spark, f"{root}/{made.data}/done/{done_name('load', 0)}", "")
    while True:
        retired = [base.data, base.lookups] if base else []
        try:
            publish(spark, root, base, replace(made, retired=retired))
            return
        except CatalogChanged:  # a load replaces whatever was stored meanwhile
            base = current(spark, root)


def create_catalog(spark: SparkSession, root: str) -> Catalog:
    """An empty catalog at `root`, in place of any that is there."""
    lookups = {
        table: spark.createDataFrame([], schema)
        for table, schema in (("categories", schemas.CATEGORIES), ("features", schemas.FEATURES))
    }
    catalog = Catalog(root)
    _publish_load(spark, catalog.folder, lookups, None, 0)
    return catalog


def replace_lookups(catalog: Catalog, categories: DataFrame, features: DataFrame) -> None:
    """Publish other lookup tables, or raise and leave the catalog as it was.

    Both come with their ids. Every stored practice must find its parents in them. A batch that is
    running keeps the lookups it began with, and records which they were.
    """
    spark = categories.sparkSession
    with staging(spark):
        lookups = {}
        for frame, table, schema, rules in (
            (categories, "categories", schemas.CATEGORIES, schemas.CATEGORY_RULES),
            (features, "features", schemas.FEATURES, schemas.FEATURE_RULES),
        ):
            lookups[table] = stage(fill_omitted(frame, _omissible(schema, rules)).select(*schema.fieldNames()), table)
            enforce(lookups[table], rules)
            if not lookups[table].where(F.col(rules.primary_key).isNull()).isEmpty():
                raise ConstraintViolation(f"{table} without {rules.primary_key}")
        pinned = catalog.pinned()
        enforce(pinned.practices(spark), replace(schemas.PRACTICE_RULES, primary_key=""), lookups)
        base = pinned.version()
        folder = new_folder("lookups")
        for table, frame in lookups.items():
            recreate_table(frame, f"{catalog.folder}/{folder}/{table}")
        publish(spark, catalog.folder, base, replace(base, lookups=folder, retired=[base.lookups]))


def append_lookups(catalog: Catalog, table: str, rows: DataFrame) -> None:
    """Add rows to `categories` or `features`, or raise and add none.

    Rows without an id are numbered after all there are, by name. Names and ids must be new, which is
    checked without moving the stored rows. The table is published as a new version.
    """
    spark = rows.sparkSession
    schema, rules = {
        "categories": (schemas.CATEGORIES, schemas.CATEGORY_RULES),
        "features": (schemas.FEATURES, schemas.FEATURE_RULES),
    }[table]
    base = catalog.version()
    pinned = Catalog(catalog.root, base)
    stored = {"categories": pinned.categories(spark), "features": pinned.features(spark)}
    with staging(spark):
        complete = fill_omitted(rows, _omissible(schema, rules))
        highest = stored[table].agg(F.max(rules.primary_key)).head()[0] or 0
        numbered = _with_ids(complete, rules.primary_key, ["name"], highest)
        added = stage(numbered.select(*schema.fieldNames()), table)
        enforce(added, rules, existing=stored[table])
        folder = new_folder("lookups")
        for name, frame in stored.items():
            recreate_table(frame.unionByName(added) if name == table else frame, f"{catalog.folder}/{folder}/{name}")
        publish(spark, catalog.folder, base, replace(base, lookups=folder, retired=[base.lookups]))


def _omissible(schema: T.StructType, rules: schemas.StorageRules) -> dict[str, object]:
    """What rows of a lookup table may omit, with its value."""
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name != rules.primary_key}
    return {**nothing, **rules.defaults}


def _with_ids(frame: DataFrame, key: str, order_by: Sequence[str], after: int = 0) -> DataFrame:
    """Keep given ids; number rows without one after these and `after`, in the given order."""
    if key not in frame.columns:
        return assign_ids(frame, key, order_by, after)
    kept = frame.where(F.col(key).isNotNull())
    highest = max(kept.agg(F.max(key)).head()[0] or 0, after)
    without_id = frame.where(F.col(key).isNull()).drop(key)
    return kept.unionByName(assign_ids(without_id, key, order_by, max(highest, 0)))


def _optional() -> dict[str, Column]:
    """What a practice may omit, but for its id and times."""
    return {
        field.name: F.lit(None).cast(field.dataType)
        for field in schemas.PRACTICES
        if field.name not in ("practice_id", "created_at", "updated_at")
    }


def bulk_load(
    catalog: Catalog,
    categories: DataFrame,
    features: DataFrame,
    practices: DataFrame,
    order_by: Sequence[str],
    clock: str | None = None,
) -> None:
    """Recreate a catalog from whole tables, or raise and leave it as it was.

    All three tables are staged and checked before anything stored is touched, so
    that what is checked is what is stored and a load may read the catalog it
    replaces. Rows without an id are numbered: practices by `order_by`, a total
    order that may use columns which are not stored, categories and features by
    name. `clock` is the creation time, the present by default.
    """
    spark = practices.sparkSession
    with staging(spark):
        lookups: dict[str, DataFrame] = {}
        for frame, table, schema, rules in (
            (categories, "categories", schemas.CATEGORIES, schemas.CATEGORY_RULES),
            (features, "features", schemas.FEATURES, schemas.FEATURE_RULES),
        ):
            complete = fill_omitted(frame, _omissible(schema, rules))
            numbered = _with_ids(complete, rules.primary_key, ["name"])
            lookups[table] = stage(numbered.select(*schema.fieldNames()), table)
            enforce(lookups[table], rules)
        time = F.lit(clock).cast("timestamp") if clock else now()
        complete = fill_omitted(practices, {**_optional(), "created_at": time, "updated_at": time})
        if "practice_id" in complete.columns:
            complete = stage(complete, "practices")
        complete = _with_ids(complete, "practice_id", order_by)
        enforce(complete, schemas.PRACTICE_RULES, lookups)
        last_id = complete.agg(F.max("practice_id")).head()[0] or 0
        _publish_load(spark, catalog.folder, lookups, complete, max(last_id, 0))


def load_tables(
    spark: SparkSession,
    folder: str,
    catalog: Catalog,
    fmt: str = "parquet",
    omitted: Mapping[str, Sequence[str]] | None = None,
    clock: str | None = None,
) -> None:
    """Bulk load a catalog from `folder`/categories, /features and /practices.

    `omitted` names columns that the files of a table do not have, so that
    defaults apply to them. Practices are numbered in file order.
    """
    omitted = {"practices": ("practice_id", "created_at", "updated_at"), **(omitted or {})}
    frames = {
        table: read_table(
            spark, f"{folder}/{table}", without(schema, *omitted.get(table, ())), fmt
        )
        for table, schema in (
            ("categories", schemas.CATEGORIES),
            ("features", schemas.FEATURES),
            ("practices", schemas.PRACTICES),
        )
    }
    practices, order = in_file_order(frames["practices"])
    bulk_load(catalog, frames["categories"], frames["features"], practices, order, clock)


def append_practices(
    practices: DataFrame,
    catalog: Catalog,
    order_by: Sequence[str],
    batch: int | None = None,
    clock: str | None = None,
    writer: str = "append",
) -> int:
    """Append rows of the submitted columns, or raise and append none.

    Ids and timestamps are generated; optional columns may be omitted. Returns
    the number of the writer's batch.
    """
    spark = practices.sparkSession
    pinned = catalog.pinned()
    parents = {"categories": pinned.categories(spark), "features": pinned.features(spark)}
    with staging(spark):
        placed = assign_ids(fill_omitted(practices, _optional()), "_place", order_by)
        # The numbered rows are a staged copy: what is checked is what is stored.
        enforce(placed.drop("practice_id"), schemas.PRACTICE_RULES, parents)
        return _append(placed, pinned, writer, batch, clock)


def _append(
    placed: DataFrame,
    pinned: Catalog,
    writer: str,
    batch: int | None,
    clock: str | None,
    others: Mapping[str, DataFrame] | None = None,
) -> int:
    """Reserve ids for rows that are numbered by `_place`, and store them and the batch's other rows."""
    spark, root, version = placed.sparkSession, pinned.folder, pinned.version()
    reserved = reserve(spark, root, version, writer, batch, placed.count())
    if reserved.closed:
        return reserved.batch
    time = F.lit(clock).cast("timestamp") if clock else now()
    numbered = placed.withColumn("practice_id", F.col("_place") + reserved.before_id)
    complete = fill_omitted(numbered, {"created_at": time, "updated_at": time})
    others = {"rejected": spark.createDataFrame([], schemas.REJECTED), **(others or {})}
    for table, frame in others.items():
        _store(frame, root, version, table, writer, reserved.batch)
    _store(complete, root, version, "practices", writer, reserved.batch)
    _finish(spark, root, version, writer, reserved.batch)
    return reserved.batch


def read_bodies(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(submission_id, body) of raw JSON bodies, numbered as they lie in the files.

    A body is a line, or with `whole_files` a file of any number of lines. The
    numbers are the same whenever the files are.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    placed, order = in_file_order(raw)
    if whole_files:
        return assign_ids(placed, "submission_id", order).select(
            "submission_id", F.col("value").alias("body")
        )
    # Lines lie in the order of their numbers already: only one number for each byte range that
    # Spark reads is missing. The copy keeps the ranges as they were when they were counted.
    placed = stage(placed, "lines")
    ranges = placed.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_place").alias("place"))
    found = sorted((row["_file"], row["_block"], row["place"], row["n"]) for row in ranges.collect())
    before = accumulate((n for *_, n in found), initial=0)
    shifts = spark.createDataFrame(
        [(file, block, 1 + first - place) for (file, block, place, _), first in zip(found, before)],
        "_file string, _block bigint, _shift bigint",
    )
    return placed.join(F.broadcast(shifts), ["_file", "_block"]).select(
        (F.col("_place") + F.col("_shift")).alias("submission_id"), F.col("value").alias("body")
    )


def ingest_submissions(
    submissions: DataFrame,
    catalog: Catalog,
    batch: int | None = None,
    clock: str | None = None,
    writer: str = "ingest",
    once_within: str | None = None,
) -> int:
    """Validate submissions, append the accepted ones and quarantine the rest.

    `submissions` holds (submission_id, body); ids are given in the order of the
    unique submission_id. Categories and features are read anew, so a batch
    sees every row stored before it began, and keeps to them to its end. Returns the
    number of the writer's batch; one that was merged into a run is left as it is.

    With `once_within`, an interval such as '7 days', a submission of the same id and body counts
    once, in the batch or delivered again by any writer, a stream under a new checkpoint say, until
    that time after it was stored or rejected. Batches that run at the same time do not see
    each other.
    """
    spark = submissions.sparkSession
    pinned = catalog.pinned()
    with staging(spark):
        others = {}
        if once_within:
            submissions = stage(_first_deliveries(submissions, pinned, writer, batch), "deliveries")
            expires = F.current_timestamp() + F.expr(f"INTERVAL {once_within}")
            others["receipts"] = submissions.select("key", expires.alias("expires"))
            submissions = submissions.drop("key")
        validated = validate_submissions(submissions, pinned.categories(spark), pinned.features(spark))
        # Judged once: neither a lost executor nor other lookups can change a verdict later.
        verdicts = _verdict_rows(validated).withColumn("_verdict", F.monotonically_increasing_id())
        verdicts = stage(verdicts, "verdicts")
        accepted, others["rejected"] = split_outcome(verdicts, ["_verdict"])
        # Numbers are found without the texts, which are then moved once and not written once more.
        places = assign_ids(accepted.select("_verdict", "submission_id"), "_place", ["submission_id"])
        placed = accepted.join(places.select("_verdict", "_place"), "_verdict").drop("_verdict")
        return _append(placed, pinned, writer, batch, clock, others)


def _verdict_rows(validated: DataFrame) -> DataFrame:
    """What is stored of each row: an accepted one's members, a rejected one's body."""
    stored = F.col("status") == 200
    members = {name: F.when(stored, F.col(name)) for name in schemas.SUBMITTED_COLUMNS}
    return validated.withColumns({**members, "body": F.when(~stored, F.col("body"))})


def _first_deliveries(submissions: DataFrame, pinned: Catalog, writer: str, batch: int | None) -> DataFrame:
    """The submissions that no other batch has a valid receipt for, each once, with their keys."""
    members = F.struct("submission_id", "body")
    key = F.sha2(F.to_json(members, {"ignoreNullFields": "false"}), 256)
    keyed = submissions.withColumn("key", key).dropDuplicates(["key"])
    others = pinned.receipts(submissions.sparkSession).where(
        (F.col("expires") > F.current_timestamp())
        & ~((F.col("writer") == writer) & F.col("batch").eqNullSafe(F.lit(batch)))
    )
    # The keys of a batch are few beside all receipts: these are reduced first.
    seen = others.join(keyed.select("key"), "key", "left_semi").select("key").distinct()
    return keyed.join(seen, "key", "left_anti")
