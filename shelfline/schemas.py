"""Table schemas, allow-lists and storage rules of the catalog."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Stored rows and submissions must use exactly these words.
DOMAINS = ("Security", "Performance", "Reliability", "General")
RECOMMENDATION_LEVELS = ("Mandatory", "Recommended", "Optional", "Situational")
IMPACT_LEVELS = ("High", "Medium", "Low")
DIFFICULTY_LEVELS = ("Easy", "Medium", "Complex")
SUBSCRIPTION_LEVELS = ("Free", "Pro", "Business", "Enterprise", "Paid Add-On")

# Nullability is relaxed on purpose: the storage rules below report missing
# values, where a strict read schema would only fail the job.
CATEGORIES = T.StructType(
    [
        T.StructField("category_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("display_order", T.IntegerType()),
    ]
)

FEATURES = T.StructType(
    [
        T.StructField("feature_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("feature_url", T.StringType()),
        T.StructField("subscription_level", T.StringType()),
    ]
)

PRACTICES = T.StructType(
    [
        T.StructField("practice_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("feature_id", T.LongType()),
        T.StructField("recommendation_level", T.StringType()),
        T.StructField("impact_level", T.StringType()),
        T.StructField("difficulty_level", T.StringType()),
        T.StructField("prerequisites", T.StringType()),
        T.StructField("expressions_configuration_details", T.StringType()),
        T.StructField("source_reference", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# The twelve columns a submission supplies; id and timestamps are generated.
SUBMITTED_COLUMNS = tuple(
    name
    for name in PRACTICES.fieldNames()
    if name not in ("practice_id", "created_at", "updated_at")
)

SEARCH_REQUESTS = T.StructType(
    [T.StructField("request_id", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in ("search", "categoryId", "featureId", "area", "level", "impact")
    ]
)

REJECTED = T.StructType(
    [
        T.StructField("submission_id", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ForeignKey:
    """`column` must be null or occur as `key` of the table `references`."""

    column: str
    references: str
    key: str


@dataclass(frozen=True)
class StorageRules:
    """What a stored row must satisfy, whichever way it arrives.

    `checks` maps a column to its permitted values. As in SQL, a check that
    evaluates to NULL passes; a None among the values therefore makes the
    check pass for every value.
    """

    primary_key: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    checks: Mapping[str, tuple[str | None, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)


CATEGORY_RULES = StorageRules(
    primary_key="category_id",
    not_null=("name",),
    unique=("name",),
    defaults={"display_order": 0},
)

FEATURE_RULES = StorageRules(
    primary_key="feature_id",
    not_null=("name",),
    unique=("name",),
    checks={"subscription_level": SUBSCRIPTION_LEVELS},
)

PRACTICE_RULES = StorageRules(
    primary_key="practice_id",
    not_null=("title", "description", "domain"),
    checks={
        "domain": DOMAINS,
        "recommendation_level": RECOMMENDATION_LEVELS,
        "impact_level": IMPACT_LEVELS,
        # The stored list holds NULL, so any difficulty is accepted on storage;
        # only submissions are held to the three words.
        "difficulty_level": (*DIFFICULTY_LEVELS, None),
    },
    foreign_keys=(
        ForeignKey("category_id", "categories", "category_id"),
        ForeignKey("feature_id", "features", "feature_id"),
    ),
)
