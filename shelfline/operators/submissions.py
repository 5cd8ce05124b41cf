"""Validation of submitted practices: one JSON body per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions import json_values
from shelfline.operators.constraints import mark_orphans

# Required fields in reporting order, then the enumerated fields
# in checking order with their error texts.
REQUIRED = (
    "title",
    "description",
    "domain",
    "recommendation_level",
    "impact_level",
    "category_id",
    "feature_id",
    "difficulty_level",
    "source_reference",
)
ENUMS = (
    ("domain", schemas.DOMAINS, "Invalid domain value"),
    ("recommendation_level", schemas.RECOMMENDATION_LEVELS, "Invalid recommendation level"),
    ("impact_level", schemas.IMPACT_LEVELS, "Invalid impact level"),
    ("difficulty_level", schemas.DIFFICULTY_LEVELS, "Invalid difficulty level"),
)
# The two other error texts.
MISSING_ERROR = "Missing required fields: "
STORE_ERROR = "Failed to create practice"

ID_COLUMNS = ("category_id", "feature_id")


def missing_required(falsy: Mapping[str, Column]) -> Column:
    """The names whose test is true, in order, joined by comma and blank."""
    return F.concat_ws(", ", *(F.when(test, F.lit(name)) for name, test in falsy.items()))


def enum_error(checks: Sequence[tuple[Column, Sequence[str], str]]) -> Column:
    """The error of the first value outside its list, or null."""
    found = [
        F.when(~F.coalesce(value.isin(*values), F.lit(False)), F.lit(error))
        for value, values, error in checks
    ]
    return F.coalesce(*found)


def first_error(missing: Column, invalid: Column) -> Column:
    """The missing fields if there are any, else the first invalid value."""
    return F.when(missing != "", F.concat(F.lit(MISSING_ERROR), missing)).otherwise(invalid)


def parse_bodies(submissions: DataFrame, body: str = "body") -> DataFrame:
    """Add `status`, `error` and the twelve submitted columns to each row.

    200 rows are fit to store, apart from their foreign keys. 400 rows lack a
    required field or hold a word outside its list. 500 rows could not be read
    as JSON or could not be stored.
    """
    json_values.keep_last_duplicate(submissions.sparkSession)
    parsed = json_values.with_json(submissions, body, "_v")
    members = json_values.with_members(parsed, "_v", schemas.SUBMITTED_COLUMNS)

    unreadable = F.coalesce(F.schema_of_variant("_v") == "VOID", F.lit(True))
    missing = missing_required({name: json_values.is_falsy(name) for name in REQUIRED})
    invalid = enum_error(
        [(json_values.string_only(name), words, message) for name, words, message in ENUMS]
    )
    kinds = F.array(*(F.col(f"kind_{name}") for name in schemas.SUBMITTED_COLUMNS))
    nested = F.coalesce(F.array_contains(kinds, "NESTED"), F.lit(False))
    judged = members.select(
        *submissions.columns,
        unreadable.alias("_unreadable"),
        missing.alias("_missing"),
        invalid.alias("_invalid"),
        nested.alias("_nested"),
        *(
            (json_values.integer_text(n) if n in ID_COLUMNS else F.col(f"text_{n}")).alias(n)
            for n in schemas.SUBMITTED_COLUMNS
        ),
    )
    client_error = first_error(F.col("_missing"), F.col("_invalid"))
    no_id = F.col("category_id").isNull() | F.col("feature_id").isNull()
    status = (
        F.when(F.col("_unreadable"), F.lit(500))
        .when(F.col("_client_error").isNotNull(), F.lit(400))
        .when(F.col("_nested") | no_id, F.lit(500))
        .otherwise(F.lit(200))
    )
    error = F.when(F.col("status") == 400, F.col("_client_error")).when(
        F.col("status") == 500, F.lit(STORE_ERROR)
    )
    return (
        judged.withColumn("_client_error", client_error)
        .withColumn("status", status)
        .withColumn("error", error)
        .select(*submissions.columns, "status", "error", *schemas.SUBMITTED_COLUMNS)
    )


def validate_submissions(
    submissions: DataFrame, categories: DataFrame, features: DataFrame
) -> DataFrame:
    """`parse_bodies`, plus the foreign keys: an unknown parent is a failed insert."""
    parsed = parse_bodies(submissions)
    checked = mark_orphans(
        parsed,
        schemas.PRACTICE_RULES.foreign_keys,
        {"categories": categories, "features": features},
    )
    orphan = F.col("orphan_category_id") | F.col("orphan_feature_id")
    failed = (F.col("status") == 200) & orphan
    return checked.withColumns(
        {
            "status": F.when(failed, F.lit(500)).otherwise(F.col("status")),
            "error": F.when(failed, F.lit(STORE_ERROR)).otherwise(F.col("error")),
        }
    ).drop("orphan_category_id", "orphan_feature_id")


def split_outcome(validated: DataFrame, kept: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows to store, and the rest with their bodies.

    `kept` are further columns of the accepted rows.
    """
    accepted = validated.where("status = 200").select(
        *kept, "submission_id", *schemas.SUBMITTED_COLUMNS
    )
    rejected = validated.where("status <> 200").select(*schemas.REJECTED.fieldNames())
    return accepted, rejected
