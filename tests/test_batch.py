import pytest
from pyspark.sql import functions as F

from samples import PRACTICE_ROWS
from shelfline import schemas
from shelfline.operators import batch
from shelfline.operators.filters import PRACTICE_FIELDS
from shelfline.plans.catalog import search_practices, search_practices_batch

REQUESTS = [
    (1, None, None, None, None, None, None),
    (2, "", "", "", "", "", ""),
    (3, "abc", None, None, None, None, None),
    (4, "ABC", "x", None, "security", None, None),
    (5, "twin", "3", "11", "General", "Recommended", "Low"),
    (6, "%", None, None, None, None, None),
    (7, "__________", None, None, None, None, None),
    (8, "t%s_m", None, None, None, None, None),
    (9, None, "0", None, None, None, None),
    (10, None, None, "10", "Security", None, None),
    (11, "\\", None, None, None, None, None),
    (12, "rotate them\noften", None, None, None, None, None),
    (13, None, "99999999999999999999", None, None, None, None),
    (14, "nothing like this anywhere", None, None, None, None, None),
    (15, "É", None, None, None, None, "High"),
    (16, "É", None, None, "Performance", None, None),
    (17, "_", None, None, None, "Optional", None),
    (18, "e.", None, None, None, None, None),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(REQUESTS, schemas.SEARCH_REQUESTS)


@pytest.fixture(scope="module")
def expected(practices, categories, features):
    """Each request on its own, by the single search."""
    names = ("search", "category_id", "feature_id", "area", "level", "impact")
    return sorted(
        (request[0], row["practice_id"])
        for request in REQUESTS
        for row in search_practices(
            practices, categories, features, **dict(zip(names, request[1:]))
        ).collect()
    )


def pairs(frame):
    return sorted((row["request_id"], row["practice_id"]) for row in frame.collect())


def test_batch_equals_single_searches(requests, practices, categories, features, expected):
    result = search_practices_batch(requests, practices, categories, features)
    assert pairs(result) == expected


@pytest.mark.parametrize("inline, broadcast_rows", [(0, 100_000), (0, 0), (100, 0)])
def test_every_route_gives_the_same(
    requests, practices, expected, monkeypatch, inline, broadcast_rows
):
    monkeypatch.setattr(batch, "MAX_BROADCAST_ROWS", broadcast_rows)
    result = batch.search_batch(
        requests, practices, PRACTICE_FIELDS, max_inline_texts=inline
    )
    assert pairs(result) == expected
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_requests(requests, practices):
    none = requests.where(F.lit(False))
    result = batch.search_batch(none, practices, PRACTICE_FIELDS)
    assert result.columns == ["request_id", *practices.columns] and result.count() == 0


def test_only_impossible_requests(requests, practices):
    only = requests.where("request_id = 13")
    assert batch.search_batch(only, practices, PRACTICE_FIELDS).count() == 0


def test_hot_request_and_hot_gram(spark):
    """A third of the requests are equal and every row holds the same gram."""
    from shelfline.operators.filters import SearchFields

    fields = SearchFields(text=("t",), enums={"area": ("d", ("a", "b"))})
    fact = spark.range(300).select(
        "id",
        F.concat(F.lit("the common text number "), F.col("id").cast("string")).alias("t"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("d"),
    )
    requests = spark.range(90).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") < 30, "COMMON TEXT NUMBER")
        .otherwise(F.concat(F.lit("common text number "), F.col("id").cast("string")))
        .alias("search"),
        F.lit("a").alias("area"),
    )
    result = batch.search_batch(requests, fact, fields, ["id"], max_inline_texts=0)
    brute = sorted(
        (r, i)
        for r in range(90)
        for i in range(0, 300, 3)
        if r < 30 or str(i).startswith(str(r))
    )
    assert sorted(map(tuple, result.collect())) == brute


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_many_criteria_take_one_scan(spark, tmp_path, monkeypatch, words):
    """Three times the bound of a broadcast: one scan of the fact table, same rows, and with a
    full-sized filter hardly a row without a criterion is staged."""
    from shelfline.operators.filters import SearchFields

    monkeypatch.setattr(batch, "MAX_BROADCAST_ROWS", 30)
    monkeypatch.setattr(batch, "MAX_FILTER_WORDS", words)
    fields = SearchFields(text=("t", "u"), ids={"categoryId": "k"})
    spark.range(400).select(
        F.format_string("%03d is a row", "id").alias("t"),
        F.when(F.col("id") % 2 == 0, F.concat(F.upper(F.md5(F.col("id").cast("string"))), F.lit("%"))).alias("u"),
        (F.col("id") % 5).alias("k"),
    ).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    fact = fact.unionByName(fact.where("false"))  # a plan that is not a bare scan
    requests = spark.range(90).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") < 50, F.format_string("%03d IS A", F.col("id") * 7))
        .otherwise(F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 12), F.lit("%_")))
        .alias("search"),
        F.when(F.col("id") % 4 == 0, "2").alias("categoryId"),
    )
    staged, stage = {}, batch.stage

    def recorded(df, purpose):
        staged[purpose] = df._jdf.queryExecution().executedPlan().toString(), stage(df, purpose)
        return staged[purpose][1]

    monkeypatch.setattr(batch, "stage", recorded)
    result = batch.search_batch(requests, fact, fields, ["t", "k"], max_inline_texts=0)
    brute = sorted(
        (r, f"{i:03} is a row", i % 5)
        for r in range(90)
        for i in range(400)
        if (i == r * 7 if r < 50 else i == r and i % 2 == 0)
        and (r % 4 or i % 5 == 2)
    )
    assert sorted(map(tuple, result.collect())) == brute and brute
    plans = [plan for plan, _ in staged.values()] + [result._jdf.queryExecution().executedPlan().toString()]
    assert "fact" in staged["rows"][0] and all("/fact" not in plan for plan in plans if plan != staged["rows"][0])
    held = staged["rows"][1].count()
    assert held < 150 if words > 1 else held > 150


def test_fixture_has_every_text_column():
    assert len(PRACTICE_ROWS[0]) == 13


def test_a_few_grams_are_looked_for_one_by_one(spark):
    """Short terms: rows are not cut into all the grams they hold."""
    from shelfline.operators.filters import SearchFields

    fact = spark.createDataFrame([(1, "An en-US text"), (2, "É SRC1"), (3, None), (3, "none"), (None, "x_y")], "k long, t string")
    terms = ["EN", "src1", "é", "É", "x_", "%n%e", "q"]
    requests = spark.createDataFrame(list(enumerate(terms)), "request_id long, search string")
    result = batch.search_batch(requests, fact, SearchFields(text=("t",)), max_inline_texts=0)
    assert "regexp_extract_all" not in result._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(((r["request_id"], r["k"] or 0) for r in result.collect()))
    assert found == [(0, 1), (1, 2), (3, 2), (4, 0), (4, 1), (5, 1), (5, 3)]


@pytest.mark.parametrize("bound", [100_000, -1])
def test_many_requests_for_the_same_rows_are_paired_in_blocks(spark, tmp_path, monkeypatch, bound):
    """Repeated and null request ids and rows keep their number, with and without a broadcast, rows
    are dealt to all tasks, and the files do not hold an id for each row."""
    import os

    monkeypatch.setattr(batch, "MAX_BROADCAST_ROWS", bound)
    fields = batch.SearchFields(text=("t",), enums={"area": ("d", ("a", "b"))})
    fact = spark.range(1500).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 1400).alias("k"),
        F.concat(F.lit("text "), F.col("id") % 2).alias("t"),
        F.when(F.col("id") % 5 == 0, "b").when(F.col("id") % 5 < 4, "a").alias("d"),
    )
    requests = spark.range(2000).select(
        F.when(F.col("id") % 9 > 0, F.col("id") % 1900).alias("request_id"),
        F.when(F.col("id") == 3, "TEXT 1").alias("search"),
        F.when(F.col("id") % 100 > 0, "a").otherwise("b").alias("area"),
    )
    result = batch.search_batch(requests, fact, fields, ["k", "d"])
    wanted = fact.alias("f").crossJoin(requests.alias("r")).where(
        "f.d = r.area AND (r.search IS NULL OR f.t = 'text 1')"
    ).select("request_id", "k", "d")
    assert result.columns == wanted.columns
    assert result.exceptAll(wanted).isEmpty() and wanted.exceptAll(result).isEmpty()
    path = str(tmp_path / "result")
    result.write.parquet(path)
    files = [os.path.getsize(f"{path}/{name}") for name in os.listdir(path) if name.endswith(".parquet")]
    assert len(files) == 4 and sum(files) < 0.4 * result.count()
