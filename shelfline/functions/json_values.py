"""Reading members of JSON objects with JavaScript's idea of a missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A whole number, and any decimal number, as they may be spelled in a text.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def keep_last_duplicate(spark: SparkSession) -> None:
    """Make JSON parsing keep the last of several equal keys in an object."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def with_json(df: DataFrame, body: str, value: str) -> DataFrame:
    """Parse the text column `body` into the VARIANT column `value`.

    Null unless the text is exactly one JSON value. Spark's parser ignores what
    follows the first value, so the text is parsed as the only element of an
    array. A text that closes that array itself holds a bracket; it must also
    parse as the only member of an object.
    """
    text = F.col(body)
    inside = df.withColumn("_list", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(F.col("_list"), "$[1]", "variant").isNull() & F.when(
        F.contains(text, F.lit("]")), as_member.isNotNull()
    ).otherwise(F.lit(True))
    first = F.try_variant_get(F.col("_list"), "$[0]", "variant")
    return inside.withColumn(value, F.when(alone, first)).drop("_list")


# One projection per step, over the columns of the steps before. The kind of a
# member is STRING, NUMBER, BOOLEAN, VOID or NESTED. SQL text instead of chained
# calls: a plan over many members is built in a fraction of the time.
_STEPS = {
    "member": "try_variant_get({value}, '$.{name}', 'variant')",
    "schema": "schema_of_variant(member_{name})",
    "kind": """
        CASE WHEN schema_{name} IN ('STRING', 'BOOLEAN', 'VOID') THEN schema_{name}
            WHEN startswith(schema_{name}, 'OBJECT') THEN 'NESTED'
            WHEN startswith(schema_{name}, 'ARRAY') THEN 'NESTED'
            WHEN schema_{name} IS NOT NULL THEN 'NUMBER' END""",
    "number": """
        CASE WHEN kind_{name} = 'NUMBER' THEN try_variant_get(member_{name}, '$', 'double') END""",
    "text": """
        CASE kind_{name}
            WHEN 'STRING' THEN try_variant_get(member_{name}, '$', 'string')
            WHEN 'BOOLEAN' THEN string(int(try_variant_get(member_{name}, '$', 'boolean')))
            WHEN 'NUMBER' THEN
                CASE WHEN double(try_cast(number_{name} AS bigint)) = number_{name}
                    THEN string(try_cast(number_{name} AS bigint))
                    ELSE string(number_{name}) END END""",
}


def with_members(df: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """Add `kind_<name>` and `text_<name>` for members of the VARIANT column `value`.

    The kind is null for a member that is absent. The text is what a TEXT
    column stores: booleans as 1 and 0, whole numbers undecorated, null for
    anything that is not a single value. Each step is a projection of its own,
    since a member is read several times in the next one and Catalyst keeps
    such steps apart instead of repeating the work.
    """
    added = df
    for step, sql in _STEPS.items():
        added = added.withColumns(
            {f"{step}_{name}": F.expr(sql.format(value=value, name=name)) for name in names}
        )
    return added.drop(*(f"{step}_{n}" for step in ("member", "schema", "number") for n in names))


def is_falsy(name: str) -> Column:
    """Absent, null, empty text, the number zero and false; all else is truthy."""
    return F.expr(
        f"""kind_{name} IS NULL OR kind_{name} = 'VOID'
            OR (kind_{name} = 'STRING' AND text_{name} = '')
            OR (kind_{name} IN ('NUMBER', 'BOOLEAN') AND text_{name} = '0')"""
    )


def string_only(name: str) -> Column:
    """The text if the member is a JSON string, else null: for strict comparisons."""
    return F.expr(f"CASE WHEN kind_{name} = 'STRING' THEN text_{name} END")


def integer_text(name: str) -> Column:
    """What an INTEGER column stores for a numeric text, else null."""
    return F.expr(
        f"""CASE WHEN text_{name} RLIKE r'{INTEGER_TEXT}'
                THEN try_cast(trim(text_{name}) AS bigint)
            WHEN text_{name} RLIKE r'{DECIMAL_TEXT}' AND
                double(try_cast(try_cast(text_{name} AS double) AS bigint))
                    = try_cast(text_{name} AS double)
                THEN try_cast(try_cast(text_{name} AS double) AS bigint) END"""
    )
