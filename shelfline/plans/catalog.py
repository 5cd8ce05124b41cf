"""The catalog's own queries: listing, search and lookup lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas
from shelfline.operators.batch import search_batch
from shelfline.operators.catalog import Lookup, attach_lookups, catalog_list, lookup_list
from shelfline.operators.filters import PRACTICE_FIELDS, criteria
from shelfline.plans.versions import LOOKUPS, RUNS, Version, batch_folder, current, done_batches
from shelfline.sources.claims import names_in
from shelfline.sources.tables import read_table

# The columns of the listing.
LISTING_COLUMNS = (
    "practice_id",
    "title",
    "description",
    "domain",
    "category_name",
    "feature_name",
    "feature_url",
    "recommendation_level",
    "impact_level",
    "difficulty_level",
    "prerequisites",
    "expressions_configuration_details",
    "source_reference",
    "notes",
    "updated_at",
)
# Who brought a row: columns of the files of runs, and of the folders of batches.
OWNER = (T.StructField("of_writer", T.StringType()), T.StructField("of_batch", T.LongType()))
FOLDER = (T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType()))

# What a batch stores once leaves its key here, with the time until which that counts.
RECEIPTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("expires", T.TimestampType())])


def owner_columns() -> list[Column]:
    """writer and batch: a run keeps them in its files, a batch has its folder's name."""
    return [
        F.coalesce("of_writer", F.col("writer").cast("string")).alias("writer"),
        F.coalesce("of_batch", "batch").alias("batch"),
    ]


def folders_among(spark: SparkSession, base: str, paths: Sequence[str]) -> list[str]:
    """Those of the batch folders that exist: not every batch has rows of every table."""
    given = {f"{base}/{w}/{b}" for w in names_in(spark, base) for b in names_in(spark, f"{base}/{w}")}
    return [path for path in paths if path in given]


# The first three are the listing's order; the id settles equal rows.
LISTING_ORDER = ("domain", "category_name", "title", "practice_id")


@dataclass(frozen=True)
class Catalog:
    """A catalog below `root`, in its current version or the one it is pinned to.

    Every read looks the version up anew. `pinned()` gives a catalog that stays with the version
    of the moment, for reads that must fit together; its files remain until two more versions
    were published.
    """

    root: str
    at: Version | None = None

    @property
    def folder(self) -> str:
        return self.root.rstrip("/")

    def version(self) -> Version:
        found = self.at or current(SparkSession.active(), self.folder)
        if found is None:
            raise FileNotFoundError(f"no catalog at {self.root}")
        return found

    def pinned(self) -> Catalog:
        return Catalog(self.root, self.version())

    def path(self, table: str) -> str:
        """The folder of a table in the version; of batches, all that were ever written there."""
        version = self.version()
        return f"{self.folder}/{version.lookups if table in LOOKUPS else version.data}/{table}"

    def batch_paths(self, spark: SparkSession, table: str) -> tuple[str, list[str]]:
        """The folder of a table of batches, and those in it that hold the visible rows."""
        version = self.version()
        stored = [(RUNS, run["number"]) for run in version.runs]
        stored += done_batches(spark, self.folder, version)
        base = f"{self.folder}/{version.data}"
        return f"{base}/{table}", [f"{base}/{batch_folder(table, *batch)}" for batch in stored]

    def batch_rows(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        """The visible rows of a table of batches. Folder columns only serve partition pruning."""
        base, paths = self.batch_paths(spark, table)
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.fieldNames())

    def practices(self, spark: SparkSession) -> DataFrame:
        return self.batch_rows(spark, "practices", schemas.PRACTICES)

    def rejected(self, spark: SparkSession) -> DataFrame:
        return self.batch_rows(spark, "rejected", schemas.REJECTED)

    def receipts(self, spark: SparkSession) -> DataFrame:
        """(key, expires, writer, batch): the submissions that may not be stored once more."""
        schema = T.StructType([*RECEIPTS, *OWNER, *FOLDER])
        base, paths = self.batch_paths(spark, "receipts")
        there = folders_among(spark, base, paths)
        if not there:
            return spark.createDataFrame([], T.StructType([*RECEIPTS, *FOLDER]))
        found = spark.read.schema(schema).option("basePath", base).parquet(*there)
        return found.select(*RECEIPTS.fieldNames(), *owner_columns())

    def owners(self, spark: SparkSession) -> DataFrame:
        """(practice_id, writer, batch): the batch each practice came with, merged or not."""
        keys = [T.StructField("practice_id", T.LongType()), *OWNER]
        found = self.batch_rows(spark, "practices", T.StructType([*keys, *FOLDER]))
        return found.select("practice_id", *owner_columns())

    def categories(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path("categories"), schemas.CATEGORIES)

    def features(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path("features"), schemas.FEATURES)


def practice_lookups(categories: DataFrame, features: DataFrame) -> list[Lookup]:
    return [
        Lookup(categories, "category_id", "category_id", {"name": "category_name"}),
        Lookup(
            features,
            "feature_id",
            "feature_id",
            {"name": "feature_name", "feature_url": "feature_url"},
        ),
    ]


def list_categories(categories: DataFrame) -> DataFrame:
    return lookup_list(categories, "category_id")


def list_features(features: DataFrame) -> DataFrame:
    return lookup_list(features, "feature_id")


def search_practices(
    practices: DataFrame,
    categories: DataFrame,
    features: DataFrame,
    search: str | None = None,
    category_id: str | None = None,
    feature_id: str | None = None,
    area: str | None = None,
    level: str | None = None,
    impact: str | None = None,
    trim_term: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """The practices meeting every given criterion, with category and feature.

    Without a criterion all practices are listed. All criteria are strings as
    they arrive in a request.
    """
    request = {
        "search": search,
        "categoryId": category_id,
        "featureId": feature_id,
        "area": area,
        "level": level,
        "impact": impact,
    }
    return catalog_list(
        practices,
        practice_lookups(categories, features),
        LISTING_COLUMNS,
        where=criteria(PRACTICE_FIELDS, request, trim_term),
        order_by=LISTING_ORDER if ordered else (),
    )


def search_practices_batch(
    requests: DataFrame, practices: DataFrame, categories: DataFrame, features: DataFrame
) -> DataFrame:
    """`search_practices` for every row of `requests`: (request_id, listing columns)."""
    stored = [
        name
        for name in schemas.PRACTICES.fieldNames()
        if name in LISTING_COLUMNS or name in ("category_id", "feature_id")
    ]
    matches = search_batch(requests, practices, PRACTICE_FIELDS, stored)
    listing = attach_lookups(matches, practice_lookups(categories, features))
    return listing.select("request_id", *LISTING_COLUMNS)
