"""Files that the gram index skips, and the same rows with and without it."""

import pytest
from pyspark.sql import functions as F

from shelfline.operators import gram_index
from shelfline.operators.batch import grams_in, search_batch
from shelfline.operators.filters import SearchFields
from shelfline.operators.gram_index import build_gram_index, files_to_read, pruned

FIELDS = SearchFields(text=("t", "u"), ids={"categoryId": "k"})


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gram") / "a table")
    rows = spark.range(400).select(
        "id",
        F.concat(F.lit("The word "), F.md5(F.col("id").cast("string")), F.lit(" here")).alias("t"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("Étage  no "), F.upper(F.sha1(F.col("id").cast("string"))))).alias("u"),
        (F.col("id") % 5).alias("k"),
    )
    rows.repartitionByRange(20, "id").write.parquet(path)
    table = spark.read.parquet(path)
    assert len(table.inputFiles()) == 20
    build_gram_index(table, FIELDS.text, f"{path}-index", 1 << 16)
    return path, table


def asked(spark, *searches, area=None):
    rows = [(i, s, area) for i, s in enumerate(searches)]
    return spark.createDataFrame(rows, "request_id bigint, search string, categoryId string")


def md5(i):
    import hashlib

    return hashlib.md5(str(i).encode()).hexdigest()


def rows(requests, table):
    return sorted(map(tuple, search_batch(requests, table, FIELDS, ["id"], max_inline_texts=0).collect()))


def test_only_files_that_can_match_are_read(spark, stored):
    path, table = stored
    requests = asked(spark, f"word {md5(7).upper()}", f"WORD {md5(390)}% HERE", f"x {md5(150)}", "no hash at all like this")
    few = files_to_read(requests, table, FIELDS, f"{path}-index")
    assert 3 <= len(few) <= 6
    found = rows(requests, pruned(requests, table, FIELDS, f"{path}-index"))
    assert found == rows(requests, table) == [(0, 7), (1, 390)]


def test_a_short_term_or_none_reads_all_files(spark, stored):
    path, table = stored
    for requests in (asked(spark, md5(7), f"word {md5(8)}"), asked(spark, None, area="3"), asked(spark, "%", f"word {md5(8)}")):
        assert len(files_to_read(requests, table, FIELDS, f"{path}-index")) == 20
        assert rows(requests, pruned(requests, table, FIELDS, f"{path}-index")) == rows(requests, table)


def test_nothing_matches(spark, stored):
    path, table = stored
    requests = asked(spark, "certainly not in there anywhere")
    few = pruned(requests, table, FIELDS, f"{path}-index")
    assert len(few.inputFiles()) <= 2 and rows(requests, few) == []


def test_files_added_or_written_anew_are_read(spark, stored, tmp_path):
    import os
    import shutil

    path = str(tmp_path / "grown")
    shutil.copytree(stored[0], path)
    table = spark.read.parquet(path)
    build_gram_index(table, FIELDS.text, f"{path}-index", 1 << 16)
    more = spark.range(1).select(
        F.lit(1000).cast("long").alias("id"), F.lit("a late arrival of long words").alias("t"),
        F.lit(None).cast("string").alias("u"), F.lit(1).cast("long").alias("k"),
    )
    more.coalesce(1).write.mode("append").parquet(path)
    # One file gets the contents of the new one.
    files = sorted((os.path.getmtime(f"{path}/{n}"), n) for n in os.listdir(path) if n.endswith(".parquet"))
    shutil.copy(f"{path}/{files[-1][1]}", f"{path}/{files[0][1]}")
    crc = f"{path}/.{files[0][1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    table = spark.read.parquet(path)
    requests = asked(spark, "LATE ARRIVAL OF")
    few = pruned(requests, table, FIELDS, f"{path}-index")
    assert len(few.inputFiles()) <= 4
    assert rows(requests, few) == [(0, 1000), (0, 1000)]


def test_a_text_is_cut_once_for_all_sorts_of_grams(spark, stored, tmp_path, monkeypatch):
    """Each text column goes through one pattern, and every gram of every sort has its bit, as no other."""
    plans, recreate = [], gram_index.recreate_table

    def recorded(df, path):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        recreate(df, path)

    monkeypatch.setattr(gram_index, "recreate_table", recorded)
    path = str(tmp_path / "table")
    texts = ["a bcdefgh", " 2345678", " 345678", "x 0123456789abcdef0 É é\U0001f600 \n \n  yz  ", "", None, "b" * 99]
    spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, t string, u string").union(
        stored[1].select("id", "t", "u").limit(50)
    ).coalesce(2).write.parquet(path)
    table = spark.read.parquet(path)
    bits = 1 << 20
    build_gram_index(table, FIELDS.text, f"{path}-index", bits)
    assert plans[0].count("regexp_extract_all(") == len(FIELDS.text)
    found = spark.read.parquet(f"{path}-index/words").agg(F.sum(F.bit_count("bits"))).head()[0]
    places = [
        table.select("_metadata.file_path", F.explode(each).alias("gram"))
        for name in FIELDS.text
        for each in grams_in(F.col(name), gram_index.SORTS)
    ]
    wanted = places[0].union(places[1]).union(places[2]).union(places[3])
    wanted = wanted.select("file_path", F.pmod(F.xxhash64("gram"), F.lit(bits)).alias("place")).distinct()
    assert wanted.count() == found > 100
    words = spark.read.parquet(f"{path}-index/words")
    on = (F.xxhash64("file_path") == F.col("file")) & (F.shiftright("place", 6) == F.col("word"))
    held = wanted.join(words, on).where(F.getbit("bits", F.col("place").bitwiseAND(63).cast("int")) == 1)
    assert held.count() == found
