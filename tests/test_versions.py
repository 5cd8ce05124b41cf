"""Versions of a catalog: whole loads, reservations between writers, merged batches."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.operators.constraints import ConstraintViolation
from shelfline.plans import compaction, ingest, versions
from shelfline.plans.catalog import Catalog, search_practices
from shelfline.plans.compaction import compact_batches
from shelfline.plans.ingest import (
    append_lookups,
    append_practices,
    bulk_load,
    ingest_submissions,
    replace_lookups,
)
from shelfline.plans.versions import CatalogChanged, current, merge_ranges, reserve
from shelfline.sources.claims import names_in, put_if_absent, read_text
from shelfline.streaming.submissions import SUBMISSIONS, read_stream, stream_submissions
from test_submissions import body


@pytest.fixture
def catalog(spark, tmp_path, categories, features, practices):
    loaded = Catalog(str(tmp_path / "catalog"))
    seed = practices.where("practice_id <> 6").withColumnRenamed("practice_id", "seq")
    bulk_load(loaded, categories, features, seed.drop("created_at", "updated_at"), ("seq",))
    return loaded


def stored(spark, catalog):
    return sorted(map(tuple, catalog.practices(spark).select("practice_id", "title").collect()))


def submissions(spark, *rows):
    return spark.createDataFrame(list(rows), SUBMISSIONS)


def whole(spark, catalog):
    return sorted(map(repr, catalog.practices(spark).collect()))


# --- loads -------------------------------------------------------------------


def test_a_load_that_fails_at_any_write_changes_nothing(
    spark, monkeypatch, catalog, categories, features, practices
):
    before = whole(spark, catalog)
    seed = practices.where("practice_id < 3").withColumn("title", F.lit("new"))
    done = []

    def failing(real, writes):
        def run(*args, **kwargs):
            if len(done) == writes:
                raise OSError("disk full")
            done.append(real.__name__)
            return real(*args, **kwargs)

        return run

    for writes in range(7):
        for name in ("recreate_table", "put_if_absent", "publish"):
            monkeypatch.setattr(ingest, name, failing(getattr(ingest, name), writes))
        with pytest.raises(OSError, match="disk full"):
            bulk_load(catalog, categories, features, seed, ["practice_id"])
        assert len(done) == writes
        done.clear()
        monkeypatch.undo()
        assert whole(spark, catalog) == before
        assert catalog.categories(spark).count() == 4
    bulk_load(catalog, categories, features, seed, ["practice_id"])
    assert stored(spark, catalog) == [(1, "new"), (2, "new")]


def test_a_load_has_seven_writes(spark, monkeypatch, catalog, categories, features, practices):
    """So the test above fails at each."""
    done = []
    for name in ("recreate_table", "put_if_absent", "publish"):
        real = getattr(ingest, name)
        monkeypatch.setattr(ingest, name, lambda *a, real=real, **k: done.append(real.__name__) or real(*a, **k))
    bulk_load(catalog, categories, features, practices.where("practice_id < 3"), ["practice_id"])
    assert done[-1] == "publish"
    assert len(done) == 7


def test_readers_keep_the_version_they_are_pinned_to(spark, catalog, categories, features, practices):
    pinned, before = catalog.pinned(), whole(spark, catalog)
    listing = search_practices(pinned.practices(spark), pinned.categories(spark), pinned.features(spark))
    bulk_load(catalog, categories, features, practices.where("practice_id = 1"), ["practice_id"])
    assert whole(spark, pinned) == before
    assert listing.count() == 5
    assert stored(spark, catalog) == [(1, "Rotate keys")]


def test_old_versions_are_deleted(spark, catalog, categories, features):
    root = catalog.folder
    for _ in range(4):
        bulk_load(catalog, categories, features, catalog.practices(spark), ["practice_id"])
    assert len([n for n in names_in(spark, root) if n.startswith("data-")]) == 2
    assert len([n for n in names_in(spark, root) if n.startswith("lookups-")]) == 2
    assert len(names_in(spark, f"{root}/versions")) == 2
    assert len(stored(spark, catalog)) == 5


def test_without_a_catalog(spark, tmp_path):
    nothing = Catalog(str(tmp_path / "nothing"))
    with pytest.raises(FileNotFoundError, match="no catalog"):
        nothing.practices(spark)
    assert not (tmp_path / "nothing").exists()


def test_a_batch_in_a_replaced_catalog_is_reported(spark, monkeypatch, catalog, categories, features):
    store = ingest._store

    def replaced(*args):
        monkeypatch.undo()
        bulk_load(catalog, categories, features, catalog.practices(spark), ["practice_id"])
        store(*args)

    monkeypatch.setattr(ingest, "_store", replaced)
    with pytest.raises(CatalogChanged):
        ingest_submissions(submissions(spark, (1, body(title="lost"))), catalog)
    assert len(stored(spark, catalog)) == 5
    assert ingest_submissions(submissions(spark, (1, body(title="again"))), catalog) == 0
    assert stored(spark, catalog)[5:] == [(6, "again")]


# --- lookups -----------------------------------------------------------------


def test_lookups_are_replaced_whole_or_not(spark, catalog, categories, features):
    renamed = categories.withColumn("name", F.concat(F.lit("new "), "name"))
    replace_lookups(catalog, renamed, features)
    assert {r["name"] for r in catalog.categories(spark).collect()} == {f"new {n}" for n in ("alpha", "Alpha", "Zeta", "unused")}
    with pytest.raises(ConstraintViolation, match="FOREIGN KEY category_id"):
        replace_lookups(catalog, renamed.where("category_id > 1"), features)
    with pytest.raises(ConstraintViolation, match="UNIQUE name"):
        replace_lookups(catalog, categories.withColumn("name", F.lit("one")), features)
    with pytest.raises(ConstraintViolation, match="without category_id"):
        replace_lookups(catalog, categories.withColumn("category_id", F.expr("IF(category_id = 4, NULL, category_id)")), features)
    assert catalog.categories(spark).where("name LIKE 'new %'").count() == 4
    assert len(stored(spark, catalog)) == 5


def test_a_batch_keeps_the_lookups_it_was_judged_by(spark, monkeypatch, catalog, categories, features):
    """Lookups replaced between verdict and store change nothing, and the batch records its own."""
    judged_by = catalog.version().lookups
    reserve_ids = ingest.reserve

    def replaced(*args):
        more = spark.createDataFrame([(77, "late", None, 0)], schemas.CATEGORIES)
        replace_lookups(catalog, categories.where("category_id <> 4").unionByName(more), features)
        return reserve_ids(*args)

    monkeypatch.setattr(ingest, "reserve", replaced)
    rows = [(1, body(title="old", category_id=4)), (2, body(title="new", category_id=77))]
    ingest_submissions(submissions(spark, *rows), catalog)
    assert stored(spark, catalog)[5:] == [(6, "old")]
    assert [(r["submission_id"], r["status"]) for r in catalog.rejected(spark).collect()] == [(2, 500)]
    claim = versions.claims(spark, catalog.folder, catalog.version().data).where("writer = 'ingest'").head()
    assert claim["lookups"] == judged_by != catalog.version().lookups


def test_lookups_are_added_whole_or_not(spark, catalog, features):
    new = spark.createDataFrame([("beta", "b"), ("aaa", None)], "name string, description string")
    append_lookups(catalog, "categories", new)
    found = {r["category_id"]: (r["name"], r["display_order"]) for r in catalog.categories(spark).collect()}
    assert (found[5], found[6]) == (("aaa", 0), ("beta", 0))
    for bad, rule in (
        ([(None, "x"), (None, "Zeta")], "UNIQUE name: 1"),
        ([(3, "x"), (9, "y"), (9, "z")], "PRIMARY KEY category_id: 2"),
        ([(None, None)], "NOT NULL name: 1"),
    ):
        with pytest.raises(ConstraintViolation, match=rule):
            append_lookups(catalog, "categories", spark.createDataFrame(bad, "category_id long, name string"))
    assert catalog.categories(spark).count() == 6
    assert catalog.features(spark).count() == 3
    rows = [(1, body(title="new shelf", category_id=6))]
    ingest_submissions(submissions(spark, *rows), catalog)
    assert stored(spark, catalog)[5:] == [(6, "new shelf")]


# --- several writers ---------------------------------------------------------


def test_one_of_many_creates_a_file(spark, tmp_path):
    path = str(tmp_path / "claims" / "1")
    assert [put_if_absent(spark, path, text) for text in ("first", "second")] == [True, False]
    assert read_text(spark, path) == "first"
    assert names_in(spark, str(tmp_path / "claims")) == ["1"]


@pytest.mark.parametrize("other", ["ingest", "elsewhere"])
def test_interleaved_batches_get_disjoint_ids(spark, monkeypatch, catalog, other):
    """Another batch reserves between the look at the last id and the own reservation."""
    create = versions.put_if_absent
    inner = []

    def late(*args):
        monkeypatch.undo()
        rows = [(i, body(title=f"inner {i}")) for i in range(3)]
        inner.append(ingest_submissions(submissions(spark, *rows), catalog, writer=other))
        return create(*args)

    monkeypatch.setattr(versions, "put_if_absent", late)
    rows = [(i, body(title=f"outer {i}")) for i in range(2)]
    outer = ingest_submissions(submissions(spark, *rows), catalog)
    assert (inner[0], outer) == ((0, 1) if other == "ingest" else (0, 0))
    titles = [f"inner {i}" for i in range(3)] + [f"outer {i}" for i in range(2)]
    assert stored(spark, catalog)[5:] == list(enumerate(titles, 6))
    ingest_submissions(submissions(spark, *rows), catalog, batch=outer)
    assert stored(spark, catalog)[5:] == list(enumerate(titles, 6))


def test_a_reservation_that_comes_too_late_is_withdrawn(spark, monkeypatch, catalog):
    """Its number was used, merged and deleted meanwhile."""
    create = versions.put_if_absent

    def late(*args):
        monkeypatch.undo()
        for i in range(3):
            ingest_submissions(submissions(spark, (1, body(title=f"quick {i}"))), catalog)
            compact_batches(spark, catalog)
        return create(*args)

    monkeypatch.setattr(versions, "put_if_absent", late)
    ingest_submissions(submissions(spark, (1, body(title="late"))), catalog, writer="slow")
    assert stored(spark, catalog)[5:] == [(6, "quick 0"), (7, "quick 1"), (8, "quick 2"), (9, "late")]


def test_a_batch_is_visible_when_it_is_done(spark, monkeypatch, catalog):
    def fails(*args):
        raise OSError("lost")

    monkeypatch.setattr(ingest, "_finish", fails)
    with pytest.raises(OSError, match="lost"):
        ingest_submissions(submissions(spark, (1, body(title="half")), (2, "null")), catalog, batch=0)
    monkeypatch.undo()
    assert len(stored(spark, catalog)) == 5
    assert catalog.rejected(spark).isEmpty()
    ingest_submissions(submissions(spark, (3, body(title="next"))), catalog)
    ingest_submissions(submissions(spark, (1, body(title="half")), (2, "null")), catalog, batch=0)
    assert stored(spark, catalog)[5:] == [(6, "half"), (7, "next")]
    assert catalog.rejected(spark).count() == 1


def test_the_name_of_the_runs_is_taken(spark, catalog):
    with pytest.raises(ValueError, match="not a writer"):
        reserve(spark, catalog.folder, catalog.version(), versions.RUNS, None, 1)


# --- compaction --------------------------------------------------------------


@pytest.mark.parametrize("writer", ["_a", ".b", "c.1", "d=e", "é f"])
def test_names_of_writers(spark, catalog, writer):
    ingest_submissions(submissions(spark, (1, body(title="one"))), catalog, writer=writer)
    assert stored(spark, catalog)[5:] == [(6, "one")]
    assert catalog.owners(spark).where("practice_id = 6").head()[1:] == (writer, 0)


def test_merge_ranges():
    assert merge_ranges([], [3, 1, 2]) == [[1, 3]]
    assert merge_ranges([[0, 4], [8, 9]], [5, 7, 12]) == [[0, 5], [7, 9], [12, 12]]


def test_compaction_keeps_rows_ids_and_owners(spark, catalog):
    for i in range(3):
        rows = [(1, body(title=f"t{i}", domain="General")), (2, body(title=f"u{i}", domain="Security")), (3, "null")]
        ingest_submissions(submissions(spark, *rows), catalog, writer=f"w {i}/%")
    rows, rejected = whole(spark, catalog), catalog.rejected(spark).count()
    owners = sorted(map(tuple, catalog.owners(spark).collect()))
    pinned = catalog.pinned()
    assert compact_batches(spark, catalog) == 4
    for version in (catalog, pinned):
        assert whole(spark, version) == rows
        assert version.rejected(spark).count() == rejected == 3
        assert sorted(map(tuple, version.owners(spark).collect())) == owners
    assert (6, "w 0/%", 0) in owners
    assert compact_batches(spark, catalog) == 0
    # A merged batch that runs again stores nothing, whatever it holds.
    again = submissions(spark, (1, body(title="other")), (2, body(title="more")), (9, body(title="than before")))
    assert ingest_submissions(again, catalog, batch=0, writer="w 1/%") == 0
    assert whole(spark, catalog) == rows
    assert append_practices(
        spark.createDataFrame([(1, "new", "d", "General")], "seq int, title string, description string, domain string"),
        catalog, ["seq"],
    ) == 0
    assert stored(spark, catalog)[-1] == (12, "new")
    assert ingest_submissions(submissions(spark, (1, body(title="own next"))), catalog, writer="w 1/%") == 1


def small_batches(spark, catalog, first, last):
    """Batches of one row each as the stream writes them, without running Spark for each."""
    version = catalog.version()
    base = f"{catalog.folder}/{version.data}"
    os.makedirs(f"{base}/ids", exist_ok=True)
    os.makedirs(f"{base}/done", exist_ok=True)
    for i in range(first, last):
        row = {"title": f"row {i}", "description": "d", "practice_id": 6 + i}
        columns = {f.name: pa.array([row.get(f.name)]) for f in schemas.PRACTICES if f.name in row}
        folder = f"{base}/practices/writer=stream/batch={i}/domain=General"
        os.makedirs(folder)
        pq.write_table(pa.table(columns), f"{folder}/part-0.parquet")
        rejected = f"{base}/rejected/writer=stream/batch={i}"
        os.makedirs(rejected)
        pq.write_table(pa.table({"submission_id": pa.array([i])}), f"{rejected}/part-0.parquet")
        claim = {"seq": 2 + i, "writer": "stream", "batch": i, "before_id": 5 + i, "last_id": 6 + i, "lookups": "x"}
        with open(f"{base}/ids/{2 + i:012}", "w") as file:
            file.write(json.dumps(claim))
        open(f"{base}/done/stream.{i}", "w").close()


def files_below(catalog):
    return sum(len([n for n in names if n.endswith(".parquet")]) for _, _, names in os.walk(catalog.root))


def test_five_hundred_batches_become_few_files(spark, catalog):
    small_batches(spark, catalog, 0, 500)
    expected = sorted([*((6 + i, f"row {i}") for i in range(500)), *stored(spark, catalog)[:5]])
    assert stored(spark, catalog) == expected
    assert compact_batches(spark, catalog) == 501
    small_batches(spark, catalog, 500, 510)
    assert compact_batches(spark, catalog) == 10
    assert compact_batches(spark, catalog) == 0
    small_batches(spark, catalog, 510, 513)
    assert compact_batches(spark, catalog) == 3
    expected = sorted([*expected, *((6 + i, f"row {i}") for i in range(500, 513))])
    assert stored(spark, catalog) == expected
    assert catalog.rejected(spark).count() == 513
    version = catalog.version()
    assert [run["rows"] for run in version.runs] == [505, 13]  # three rows took the ten along
    assert version.closed == {"load": [[0, 0]], "stream": [[0, 512]]}
    assert files_below(catalog) < 40
    base = f"{catalog.folder}/{version.data}"
    assert len(names_in(spark, f"{base}/ids")) <= 4
    assert len(names_in(spark, f"{base}/done")) <= 3
    ingest_submissions(submissions(spark, (1, body(title="after"))), catalog)
    assert stored(spark, catalog)[-1] == (519, "after")


def test_runs_shrink_geometrically(spark, catalog):
    start = 0
    for _ in range(8):
        small_batches(spark, catalog, start, start + 3)
        start += 3
        compact_batches(spark, catalog)
    sizes = [run["rows"] for run in catalog.version().runs]
    assert sum(sizes) == 5 + start
    assert all(a > compaction.GROWTH * b for a, b in zip(sizes, sizes[1:]))
    assert [r[0] for r in stored(spark, catalog)] == list(range(1, 6 + start))


def test_a_compaction_that_comes_second_changes_nothing(spark, monkeypatch, catalog, categories, features):
    ingest_submissions(submissions(spark, (1, body(title="one"))), catalog)
    write = compaction._write_run

    def replaced(*args):
        monkeypatch.undo()
        replace_lookups(catalog, categories, features)
        write(*args)

    monkeypatch.setattr(compaction, "_write_run", replaced)
    rows = whole(spark, catalog)
    assert compact_batches(spark, catalog) == 0
    assert whole(spark, catalog) == rows
    assert compact_batches(spark, catalog) == 3
    assert whole(spark, catalog) == rows


def test_a_stream_merges_as_it_goes(spark, tmp_path, catalog):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    for i in range(5):
        line = json.dumps({"submission_id": i, "body": body(title=f"s{i}")})
        path = incoming / f"{i}.json"
        path.write_text(line)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_stream(spark, str(incoming), SUBMISSIONS, files="*.json", files_per_batch=1)
    stream_submissions(stream, catalog, str(tmp_path / "p"), "s", compact_every=2).awaitTermination()
    assert stored(spark, catalog)[5:] == [(6 + i, f"s{i}") for i in range(5)]
    version = current(spark, catalog.folder)
    assert version.closed == {"load": [[0, 0]], "s": [[0, 3]]}


# --- deliveries --------------------------------------------------------------


def test_the_same_file_under_two_checkpoints_is_stored_once(spark, tmp_path, catalog):
    incoming = tmp_path / "incoming"
    incoming.mkdir()

    def run(checkpoint, name, *rows):
        lines = [json.dumps({"submission_id": i, "body": text}) for i, text in rows]
        (incoming / name).write_text("\n".join(lines))
        stream = read_stream(spark, str(incoming), SUBMISSIONS, files="*.json")
        stream_submissions(stream, catalog, str(tmp_path / checkpoint), once_within="7 days").awaitTermination()

    run("one", "a.json", (1, body(title="a")), (1, body(title="a")), (2, "null"), (3, body(title="c")))
    assert stored(spark, catalog)[5:] == [(6, "a"), (7, "c")]
    run("two", "b.json", (4, body(title="d")), (3, body(title="other text")))
    expected = [(6, "a"), (7, "c"), (8, "other text"), (9, "d")]
    assert stored(spark, catalog)[5:] == expected
    assert catalog.rejected(spark).count() == 1
    compact_batches(spark, catalog)
    run("three", "c.json")
    assert stored(spark, catalog)[5:] == expected


def test_a_batch_that_runs_again_keeps_its_own_rows(spark, catalog):
    rows = [(1, body(title="a")), (2, body(title="b"))]
    for _ in range(2):
        ingest_submissions(submissions(spark, *rows), catalog, 0, once_within="1 day")
        assert stored(spark, catalog)[5:] == [(6, "a"), (7, "b")]
    ingest_submissions(submissions(spark, *rows, (None, None), (None, None)), catalog, once_within="1 day")
    assert stored(spark, catalog)[5:] == [(6, "a"), (7, "b")]
    assert catalog.rejected(spark).count() == 1


def test_receipts_expire(spark, catalog):
    row = submissions(spark, (1, body(title="a")))
    for _ in range(2):
        ingest_submissions(row, catalog, once_within="0 seconds")
    assert [t for _, t in stored(spark, catalog)[5:]] == ["a", "a"]
    compact_batches(spark, catalog)
    assert catalog.receipts(spark).isEmpty()


def test_long_rows_take_more_files(spark, monkeypatch, catalog):
    """A run of few rows with long texts is not sorted by one task."""
    monkeypatch.setattr(compaction, "BYTES_A_FILE", 1000)
    made, recreate = {}, compaction.recreate_table

    def recorded(df, path, *args):
        made[path.split("/")[-3]] = df.rdd.getNumPartitions()
        recreate(df, path, *args)

    monkeypatch.setattr(compaction, "recreate_table", recorded)
    ingest_submissions(submissions(spark, (1, body(title="one")), (2, body(title="two"))), catalog)
    rows = whole(spark, catalog)
    assert compact_batches(spark, catalog) == 2
    assert made["practices"] > 1
    assert whole(spark, catalog) == rows
