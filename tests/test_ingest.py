import datetime
import json

import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.operators.constraints import ConstraintViolation
from shelfline.plans.catalog import Catalog, search_practices
from shelfline.plans.ingest import (
    append_practices,
    bulk_load,
    create_catalog,
    ingest_submissions,
    load_tables,
    read_bodies,
)
from shelfline.sources.tables import (
    append_rows,
    combine_shapes,
    read_submissions,
    read_table,
    without,
    write_rows_json,
)
from shelfline.streaming.submissions import SUBMISSIONS, read_stream, stream_submissions
from test_submissions import body

CLOCK = "2024-05-06 07:08:09"


@pytest.fixture
def catalog(spark, tmp_path, categories, features, practices):
    loaded = Catalog(str(tmp_path / "catalog"))
    rows = practices.where("practice_id <> 6")
    seed = rows.withColumnRenamed("practice_id", "seq").drop("created_at", "updated_at")
    bulk_load(loaded, categories, features, seed, ("seq",), CLOCK)
    return loaded


def stored(spark, catalog):
    return sorted(map(tuple, catalog.practices(spark).select("practice_id", "title").collect()))


BODIES = [
    (5, body(title="five")),
    (2, body(title="")),
    (3, body(title="three", category_id="x")),
    (1, body(title="one")),
    (4, "null"),
]


def submissions(spark, rows=BODIES):
    return spark.createDataFrame(rows, SUBMISSIONS)


def test_bulk_load(spark, catalog, categories, features):
    assert [row[0] for row in stored(spark, catalog)] == [1, 2, 3, 4, 5]
    row = catalog.practices(spark).where("practice_id = 2").head()
    assert row["difficulty_level"] == "Bogus"
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert (row["created_at"], row["updated_at"]) == (at, at)
    listing = search_practices(
        catalog.practices(spark), catalog.categories(spark), catalog.features(spark)
    )
    assert [r["practice_id"] for r in listing.collect()] == [3, 4, 2, 5, 1]


def test_bulk_load_aborts_on_violation(spark, tmp_path, categories, features, practices):
    target = Catalog(str(tmp_path / "broken"))
    seed = practices.drop("practice_id", "created_at", "updated_at")
    with pytest.raises(ConstraintViolation, match="category_id"):
        bulk_load(target, categories, features, seed.withColumn("seq", F.lit(1)), ("seq",))
    assert not (tmp_path / "broken").exists()
    twice = categories.unionByName(categories)
    with pytest.raises(ConstraintViolation, match="UNIQUE name"):
        bulk_load(target, twice, features, seed, ("title",))


def test_bulk_load_keeps_given_ids(spark, tmp_path, categories, features, practices):
    target = Catalog(str(tmp_path / "given"))
    some = F.when(F.col("practice_id") < 3, F.col("practice_id") * 10)
    rows = practices.where("practice_id <> 6").withColumn("seq", F.col("practice_id"))
    seed = rows.withColumn("practice_id", some).drop("created_at", "updated_at")
    bulk_load(target, categories, features, seed, ("seq",))
    assert [row[0] for row in stored(spark, target)] == [10, 20, 21, 22, 23]


def test_load_tables_numbers_rows_in_file_order(spark, tmp_path, categories, features):
    seed = tmp_path / "seed"
    (seed / "practices").mkdir(parents=True)
    write_rows_json(categories.drop("display_order"), str(seed / "categories"))
    write_rows_json(features, str(seed / "features"))
    for name, titles in (("b", "zy"), ("a", "xwv")):
        rows = [{"title": t, "description": "d", "domain": "General"} for t in titles]
        (seed / "practices" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    target = Catalog(str(tmp_path / "target"))
    load_tables(spark, str(seed), target, "json", {"categories": ("display_order",)})
    assert stored(spark, target) == list(enumerate("xwvzy", 1))
    assert {r["display_order"] for r in target.categories(spark).collect()} == {0}


def test_append_practices(spark, catalog, practices):
    rows = practices.select("practice_id", *schemas.SUBMITTED_COLUMNS)
    given = rows.withColumnRenamed("practice_id", "seq")
    with pytest.raises(ConstraintViolation, match="FOREIGN KEY category_id: 1"):
        append_practices(given, catalog, ["seq"])
    append_practices(given.where("seq <= 2"), catalog, ["seq"])
    assert stored(spark, catalog)[5:] == [(6, "Rotate keys"), (7, "Cache assets")]


def test_ingest_appends_and_quarantines(spark, catalog):
    assert ingest_submissions(submissions(spark), catalog, clock=CLOCK) == 0
    assert stored(spark, catalog)[5:] == [(6, "one"), (7, "five")]
    rejected = read_table(spark, catalog.path("rejected"), schemas.REJECTED).collect()
    assert sorted((r["submission_id"], r["status"]) for r in rejected) == [
        (2, 400), (3, 500), (4, 500),
    ]
    assert {r["body"] for r in rejected} == {b for i, b in BODIES if i in (2, 3, 4)}


def test_ids_continue_and_replays_change_nothing(spark, catalog):
    ingest_submissions(submissions(spark), catalog)
    ingest_submissions(submissions(spark, [(9, body(title="nine"))]), catalog)
    before = stored(spark, catalog)
    assert before[-1] == (8, "nine")
    ingest_submissions(submissions(spark), catalog, batch=0)
    assert stored(spark, catalog) == before


def test_a_batch_without_accepted_rows_keeps_the_last_id(spark, catalog):
    ingest_submissions(submissions(spark, [(1, "null")]), catalog)
    ingest_submissions(submissions(spark, [(2, body(title="next"))]), catalog)
    assert stored(spark, catalog)[-1] == (6, "next")


def test_first_batch_of_an_empty_catalog(spark, tmp_path):
    empty = create_catalog(spark, str(tmp_path / "empty"))
    assert ingest_submissions(submissions(spark, [(1, body())]), empty) == 0
    assert stored(spark, empty) == []


def test_stream_equals_batch(spark, tmp_path, catalog):
    incoming = tmp_path / "incoming"
    incoming.mkdir()

    def arrive(name, rows):
        lines = [json.dumps({"submission_id": i, "body": text}) for i, text in rows]
        (incoming / name).write_text("\n".join(lines))

    def run():
        stream = read_stream(spark, str(incoming), SUBMISSIONS, files="*.json")
        query = stream_submissions(stream, catalog, str(tmp_path / "progress"))
        query.awaitTermination()

    arrive("a.json", BODIES)
    run()
    assert stored(spark, catalog)[5:] == [(6, "one"), (7, "five")]
    arrive("b.json", [(9, body(title="nine"))])
    run()
    run()
    assert stored(spark, catalog)[5:] == [(6, "one"), (7, "five"), (8, "nine")]


def test_short_shape_reads_as_null(spark, tmp_path, practices):
    long, short = str(tmp_path / "long"), str(tmp_path / "short")
    practices.where("practice_id <= 2").write.json(long)
    practices.where("practice_id > 2").drop("notes").write.json(short)
    both = combine_shapes(
        [
            read_table(spark, long, schemas.PRACTICES, "json"),
            read_table(spark, short, without(schemas.PRACTICES, "notes"), "json"),
        ]
    )
    assert sorted((r["practice_id"], r["notes"]) for r in both.collect())[:3] == [
        (1, "note a_c"), (2, None), (3, None),
    ]


def test_csv_round_trip(spark, tmp_path, practices):
    path = str(tmp_path / "csv")
    texts = practices.select(*schemas.PRACTICES.fieldNames())
    texts.write.option("header", True).option("escape", '"').csv(path)
    back = read_table(spark, path, schemas.PRACTICES, "csv")
    assert sorted(r["description"] for r in back.collect()) == sorted(
        r["description"] for r in practices.collect()
    )


def test_json_sink_keeps_nulls(spark, tmp_path, categories):
    path = str(tmp_path / "rows")
    write_rows_json(categories.where("category_id = 1"), path)
    assert read_submissions(spark, path).head()["body"] == (
        '{"category_id":1,"name":"alpha","description":null,"display_order":1}'
    )


def test_writers_never_overwrite_each_other(spark, tmp_path, catalog, practices):
    incoming = tmp_path / "in"
    incoming.mkdir()

    def run(name, rows, progress):
        lines = [json.dumps({"submission_id": i, "body": text}) for i, text in rows]
        (incoming / name).write_text("\n".join(lines))
        stream = read_stream(spark, str(incoming), SUBMISSIONS, files="*.json")
        stream_submissions(stream, catalog, str(tmp_path / progress)).awaitTermination()

    ingest_submissions(submissions(spark, [(1, body(title="hand1"))]), catalog)
    ingest_submissions(submissions(spark, [(2, body(title="hand2"))]), catalog)
    run("a.json", [(3, body(title="stream1"))], "p1")
    given = practices.where("practice_id = 1").selectExpr("practice_id AS seq", "title", "description", "domain")
    append_practices(given, catalog, ["seq"])
    run("b.json", [(4, body(title="stream2"))], "p1")
    run("c.json", [], "p2")  # another checkpoint reads all files again
    ids = stored(spark, catalog)
    assert ids[5:10] == [(6, "hand1"), (7, "hand2"), (8, "stream1"), (9, "Rotate keys"), (10, "stream2")]
    assert sorted(ids[10:]) == [(11, "stream1"), (12, "stream2")]
    for batch in (1, 0):
        title = f"hand{batch + 1}"
        ingest_submissions(submissions(spark, [(batch + 1, body(title=title))]), catalog, batch=batch)
    assert stored(spark, catalog) == ids
    more = [(1, body(title="hand1")), (9, body(title="late"))]
    with pytest.raises(ValueError, match="more rows"):
        ingest_submissions(submissions(spark, more), catalog, batch=0)
    assert stored(spark, catalog) == ids


def test_a_failed_load_leaves_the_catalog(spark, catalog, categories, features, practices):
    before = stored(spark, catalog)
    bad = practices.withColumn("domain", F.lit("nowhere"))
    with pytest.raises(ConstraintViolation):
        bulk_load(catalog, categories, features, bad, ["practice_id"])
    assert stored(spark, catalog) == before


def test_a_load_may_read_the_catalog_it_replaces(spark, catalog):
    before = stored(spark, catalog)
    bulk_load(
        catalog,
        catalog.categories(spark),
        catalog.features(spark),
        catalog.practices(spark),
        ["practice_id"],
    )
    assert stored(spark, catalog) == before


def test_replays_under_dynamic_overwrite(spark, catalog):
    ingest_submissions(submissions(spark, [(1, body(title="x", domain="General"))]), catalog)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        ingest_submissions(submissions(spark, [(1, body(title="x", domain="Security"))]), catalog, batch=0)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [t for _, t in stored(spark, catalog)].count("x") == 1


def test_lookups_without_ids_are_numbered(spark, tmp_path, categories, features, practices):
    new = Catalog(str(tmp_path / "numbered"))
    some = categories.selectExpr("IF(category_id = 4, NULL, category_id) AS category_id", "name")
    bulk_load(new, some, features.drop("feature_id"), practices.limit(0), ["practice_id"])
    assert sorted(r["category_id"] for r in new.categories(spark).collect()) == [1, 2, 3, 4]
    assert sorted(r["feature_id"] for r in new.features(spark).collect()) == [1, 2, 3]


def test_staged_copies_are_deleted(spark, catalog, categories, features):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    bulk_load(catalog, categories, features, catalog.practices(spark), ["practice_id"])
    for number in range(3):
        ingest_submissions(submissions(spark, [(number, body())]), catalog)
    assert set(os.listdir(folder)) == before


def test_a_new_lookup_row_counts_in_the_next_batch(spark, catalog):
    ingest_submissions(submissions(spark, [(1, body(title="early", category_id=77))]), catalog)
    row = spark.createDataFrame([(77, "new", None, 0)], schemas.CATEGORIES)
    append_rows(row, catalog.path("categories"))
    ingest_submissions(submissions(spark, [(2, body(title="later", category_id=77))]), catalog)
    titles = [t for _, t in stored(spark, catalog)]
    assert "later" in titles and "early" not in titles


def test_default_times_are_of_the_run(spark, catalog):
    from datetime import UTC, datetime, timedelta

    start = datetime.now(UTC).replace(tzinfo=None, microsecond=0)
    ingest_submissions(submissions(spark, [(1, body(title="a")), (2, body(title="b"))]), catalog)
    rows = catalog.practices(spark).where("title IN ('a', 'b')")
    times = {r[0] for r in rows.selectExpr("CAST(created_at AS string)").collect()}
    assert len(times) == 1
    time = datetime.fromisoformat(times.pop())
    assert start <= time <= datetime.now(UTC).replace(tzinfo=None) + timedelta(seconds=1)
    assert rows.where("created_at <> updated_at OR created_at <> date_trunc('second', created_at)").isEmpty()


@pytest.mark.parametrize("whole", [False, True])
def test_raw_bodies(spark, tmp_path, catalog, whole):
    texts = [body(title="one"), "null", body(title="two", domain="x"), body(title="three")]
    folder = tmp_path / "bodies"
    folder.mkdir()
    for i, text in enumerate(texts):
        spread = json.dumps(json.loads(text), indent=1) if whole else text + "\n"
        (folder / f"{i}.json").write_text(spread)
    found = read_bodies(spark, str(folder), whole)
    assert [r["submission_id"] for r in found.orderBy("submission_id").collect()] == [1, 2, 3, 4]
    ingest_submissions(found, catalog)
    assert stored(spark, catalog)[5:] == [(6, "one"), (7, "three")]
    rejected = read_table(spark, catalog.path("rejected"), schemas.REJECTED).collect()
    assert sorted((r["submission_id"], r["status"]) for r in rejected) == [(2, 500), (3, 400)]


def test_lines_are_numbered_where_they_lie(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, lines in (("b", ["3", "", "5"]), ("a", ["1", "2"]), ("c", [])):
        (tmp_path / "in" / name).write_text("".join(f"{line}\n" for line in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2")
    try:
        found = read_bodies(spark, str(tmp_path / "in"))
        assert [tuple(r) for r in found.orderBy("submission_id").collect()] == list(enumerate(["1", "2", "3", "", "5"], 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lines-" in plan and "rangepartitioning" not in plan


def test_verdicts_hold_a_text_once(spark, catalog, monkeypatch):
    """Submissions without an id, or with the same one, are stored too."""
    from shelfline.plans import ingest

    staged, stage = {}, ingest.stage

    def recorded(df, purpose):
        staged[purpose] = stage(df, purpose)
        staged[f"{purpose} rows"] = [r.asDict() for r in staged[purpose].collect()]
        return staged[purpose]

    monkeypatch.setattr(ingest, "stage", recorded)
    before = catalog.practices(spark).count()
    given = [(7, body(title="one")), (7, body(title="two")), (None, body(title="three")), (8, body(title=""))]
    ingest.ingest_submissions(spark.createDataFrame(given, "submission_id bigint, body string"), catalog)
    rows = staged["verdicts rows"]
    assert sorted((r["status"], r["body"] is None, r["title"] is None) for r in rows) == [(200, True, False)] * 3 + [(400, False, True)]
    stored = catalog.practices(spark).orderBy("practice_id").collect()[before:]
    assert stored[0]["title"] == "three" and {r["title"] for r in stored[1:]} == {"one", "two"}
    assert len({r["practice_id"] for r in stored}) == 3
    assert [tuple(r)[:2] for r in catalog.rejected(spark).collect()] == [(8, given[3][1])]
