"""The physical plans the library counts on."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfline.operators.catalog import Lookup, attach_lookups
from shelfline.operators.filters import by_enum, by_id
from test_oracle import SF_DIR

BATCHES = ("search_batch", "search_batch_terms", "search_batch_grams", "search_batch_urls")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def test_scalar_criteria_become_pushed_filters(spark):
    scan = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = plan(scan.where(by_id("l_suppkey", "7abc")).select("l_orderkey"))
    assert "EqualTo(l_suppkey,7)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text
    text = plan(scan.where(by_enum("l_returnflag", "A", ["A", "N"])).select("l_orderkey"))
    assert "EqualTo(l_returnflag,A)" in text
    assert "Filter (" not in plan(scan.where(by_id("l_suppkey", "abc")).select("l_orderkey"))


def test_search_filters_below_the_joins(spark):
    text = plan(entry.queries()["catalog_search"](spark, SF_DIR))
    assert text.index("Join") < text.index("RLIKE")
    assert "EqualTo(lang,fr)" in text
    # The regular expression is a constant by the time the plan runs.
    assert "RLIKE(text" in text and "regexp_replace" not in text


def test_area_search_reads_one_folder(spark):
    from shelfline.plans.catalog import search_practices

    catalog = entry._new_catalog(spark, SF_DIR)
    tables = (catalog.practices(spark), catalog.categories(spark), catalog.features(spark))
    listing = search_practices(*tables, area="General", category_id="1", search="the")
    scan = listing._jdf.queryExecution().executedPlan().collectLeaves().apply(0).toString()
    assert "PartitionFilters: [isnotnull(domain" in scan
    assert "PushedFilters: [IsNotNull(category_id), EqualTo(category_id,1)]" in scan
    assert listing.count() > 0


# The training-data queries have tests of their own and may use Python.
QUERIES = [q for q in entry.queries() if not re.match(r"op\d+_|pipeline$", q)]


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_no_cross_join_no_global_window(spark, name):
    if name in ("bulk_load", "load_tables", "ingest_submissions", "stream_submissions"):
        pytest.skip("returns a plain scan of what it wrote")
    text = plan(entry.queries()[name](spark, SF_DIR))
    for node in ("Python", "NestedLoop", "CartesianProduct", "Window"):
        assert node not in text, node


def test_unused_lookup_is_not_joined(spark, practices, categories, features):
    from shelfline.operators.catalog import catalog_list
    from shelfline.plans.catalog import practice_lookups

    lookups = practice_lookups(categories, features)
    text = plan(catalog_list(practices, lookups, ["practice_id", "feature_name"]))
    assert text.count("Join") == 1


def test_hot_and_null_keys_are_split_beyond_the_broadcast_size(spark, tmp_path):
    """With the lookup too large to broadcast, a hot key no longer fills one task."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    path = str(tmp_path / "fact")
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 5000)
    fact = spark.range(60_000).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256))
    fact.repartition(8).write.parquet(path)
    names = spark.range(5000).select("id", F.concat(F.lit("n"), "id").alias("name"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        lookup = Lookup(names, "id", "k", {"name": "name"})
        joined = attach_lookups(spark.read.parquet(path), [lookup])
        text = final_plan(joined)
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "skew=true" in text
    assert joined.where("name = 'n7'").count() == 20_000 + 4
    assert joined.where("name is null").count() == 20_000
