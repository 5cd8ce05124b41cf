import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.operators.constraints import (
    ConstraintViolation,
    check_fails,
    duplicates,
    enforce,
    mark_orphans,
    orphans,
)
from shelfline.operators.identifiers import assign_ids, fill_omitted


def test_null_in_check_list_accepts_everything(spark):
    frame = spark.createDataFrame([("Easy",), ("Bogus",), (None,)], "w string")
    assert frame.where(check_fails("w", ["Easy", None])).count() == 0
    assert [r[0] for r in frame.where(check_fails("w", ["Easy"])).collect()] == ["Bogus"]


def test_storage_accepts_fixture_rows(practices, categories, features):
    parents = {"categories": categories, "features": features}
    stored = practices.where("practice_id <> 6")
    enforce(stored, schemas.PRACTICE_RULES, parents)
    with pytest.raises(ConstraintViolation, match="^FOREIGN KEY category_id: 1$"):
        enforce(practices, schemas.PRACTICE_RULES, parents)


def test_every_broken_rule_is_named(practices, categories, features):
    parents = {"categories": categories, "features": features}
    bad = practices.where("practice_id <> 6").withColumns(
        {
            "practice_id": F.lit(1).cast("bigint"),
            "title": F.lit(None).cast("string"),
            "domain": F.lower("domain"),
        }
    )
    with pytest.raises(ConstraintViolation) as error:
        enforce(bad, schemas.PRACTICE_RULES, parents)
    expected = "CHECK domain: 5, NOT NULL title: 5, PRIMARY KEY practice_id: 1"
    assert str(error.value) == expected


def test_unique_within_batch_and_against_stored(spark):
    given = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,), (None,)], "n string")
    stored = spark.createDataFrame([("b",), ("z",), ("z",)], "n string")
    assert sorted(map(tuple, duplicates(given, "n").collect())) == [("a", 2)]
    assert sorted(map(tuple, duplicates(given, "n", stored).collect())) == [("a", 2), ("b", 2)]


def test_foreign_key(spark, categories):
    rows = spark.createDataFrame([(1, 1), (2, 99), (3, None)], "id bigint, category_id bigint")
    assert [r["id"] for r in orphans(rows, "category_id", categories, "category_id").collect()] == [
        2
    ]
    key = schemas.ForeignKey("category_id", "categories", "category_id")
    marked = mark_orphans(rows, [key], {"categories": categories}).orderBy("id").collect()
    assert [r["orphan_category_id"] for r in marked] == [False, True, False]


def test_default_is_for_omitted_columns_only(spark):
    given = spark.createDataFrame([(1, None)], "id bigint, display_order int")
    assert fill_omitted(given, {"display_order": 0}).head()["display_order"] is None
    assert fill_omitted(given.drop("display_order"), {"display_order": 0}).head()[1] == 0


@pytest.mark.parametrize("rows, parts", [(1000, 7), (3, 4), (0, 4)])
def test_ids_are_dense_and_in_order(spark, rows, parts):
    hot = F.when(F.col("key") % 3 == 0, "hot").otherwise(F.col("key").cast("string"))
    frame = spark.range(rows).withColumnRenamed("id", "key").withColumn("word", hot)
    numbered = assign_ids(frame.repartition(parts), "id", ["word", "key"], 50).collect()
    in_order = sorted(numbered, key=lambda r: (r["word"], r["key"]))
    assert [r["id"] for r in in_order] == list(range(51, 51 + rows))


def test_ids_put_nulls_first(spark):
    frame = spark.createDataFrame([("b",), (None,), ("a",)], "w string")
    ids = {r["w"]: r["id"] for r in assign_ids(frame, "id", ["w"]).collect()}
    assert ids == {None: 1, "a": 2, "b": 3}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_stored_values_stay_where_they_lie(spark, tmp_path, monkeypatch, most):
    """No exchange lies between the scan of the stored rows and their join, unless the batch is large."""
    from shelfline.operators import constraints

    monkeypatch.setattr(constraints, "MAX_BROADCAST_KEYS", most)
    spark.range(1000).selectExpr("id DIV 2 AS k").write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    given = spark.createDataFrame([(3,), (3,), (999,), (1000,), (1000,), (7,), (None,), (None,)], "k long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = duplicates(given, "k", stored)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, found.collect())) == [(3, 4), (7, 3), (1000, 2)]
    at = next(i for i, line in enumerate(lines) if "FileScan parquet [k#" in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-*")), []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*"))
        if indent < depth:
            above.append(line)
            depth = indent
    joined = next(i for i, line in enumerate(above) if "Join" in line)
    assert any("Exchange" in line for line in above[:joined]) == (most == 0)
