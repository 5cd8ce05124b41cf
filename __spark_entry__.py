"""Every operator of the library as a query over the test tables, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import json_values
from shelfline.functions.text import (
    escape_html,
    parse_int_prefix,
    query_params,
    query_string,
)
from shelfline.operators.batch import search_batch
from shelfline.operators.catalog import Lookup, catalog_list, is_empty, lookup_list
from shelfline.operators.constraints import (
    ConstraintViolation,
    check_fails,
    duplicates,
    is_missing,
    orphans,
)
from shelfline.operators.display import display_rows, fallback, feature_link, source_link
from shelfline.operators.gram_index import build_gram_index, pruned
from shelfline.operators.filters import SearchFields, by_id, criteria, search
from shelfline.operators.identifiers import assign_ids, fill_omitted
from shelfline.operators.submissions import (
    enum_error,
    missing_required,
    validate_submissions,
)
from shelfline.plans.catalog import Catalog, search_practices, search_practices_batch
from shelfline.plans.compaction import compact_batches
from shelfline.plans.ingest import (
    append_lookups,
    append_practices,
    bulk_load,
    ingest_submissions,
    load_tables,
    read_bodies,
    replace_lookups,
)
from shelfline.session import configure, shared_folder
from shelfline.sources.bodies import read_concatenated
from shelfline.sources.tables import (
    append_rows,
    combine_shapes,
    read_submissions,
    read_table,
    recreate_table,
    rows_as_json,
    write_rows_json,
)
from shelfline.streaming.submissions import (
    SUBMISSIONS,
    read_stream,
    split_stream,
    stream_submissions,
)

# The training-data operators can be left out; nothing else depends on them.
try:
    import corpus_pipeline
    from shelfline.llm import queries as training_data
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "shelfline.llm"):
        raise
    corpus_pipeline = training_data = None

ENTRY_DIR = "/root/testdata/sf0.001"

# --- the test tables in the roles of the catalog ---------------------------

_STRING, _LONG, _INT, _DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_NTZ = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "region": _schema(r_regionkey=_INT, r_name=_STRING),
    "nation": _schema(n_nationkey=_INT, n_name=_STRING, n_regionkey=_INT),
    "customer": _schema(
        c_custkey=_LONG,
        c_name=_STRING,
        c_nationkey=_INT,
        c_acctbal=_DOUBLE,
        c_mktsegment=_STRING,
    ),
    "supplier": _schema(s_suppkey=_LONG, s_name=_STRING, s_nationkey=_INT, s_acctbal=_DOUBLE),
    "part": _schema(
        p_partkey=_LONG,
        p_name=_STRING,
        p_brand=_STRING,
        p_type=_STRING,
        p_size=_INT,
        p_retailprice=_DOUBLE,
    ),
    "orders": _schema(
        o_orderkey=_LONG,
        o_custkey=_LONG,
        o_orderstatus=_STRING,
        o_totalprice=_DOUBLE,
        o_orderdate=_NTZ,
        o_orderpriority=_STRING,
    ),
    "lineitem": _schema(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_DOUBLE,
        l_extendedprice=_DOUBLE,
        l_discount=_DOUBLE,
        l_tax=_DOUBLE,
        l_returnflag=_STRING,
        l_linestatus=_STRING,
        l_shipdate=_NTZ,
    ),
    "events": _schema(
        event_id=_LONG,
        ts=_NTZ,
        user_id=_LONG,
        event_type=_STRING,
        value=_DOUBLE,
        props=_STRING,
    ),
    "documents": _schema(
        doc_id=_LONG, text=_STRING, lang=_STRING, source=_STRING, n_chars=_LONG
    ),
    "labels": _schema(doc_id=_LONG, quality=_INT, toxic=_INT),
    "pages": _schema(page_id=_LONG, url=_STRING, html=_STRING),
    "benchmark": _schema(item_id=_LONG, text=_STRING),
    "conversations": _schema(conv_id=_LONG, turn=_LONG, role=_STRING, text=_STRING),
}

DOCUMENT_FIELDS = SearchFields(
    text=("text", "source"),
    ids={"categoryId": "doc_id"},
    enums={"area": ("lang", ("en", "fr", "de", "es"))},
)
ORDER_FIELDS = SearchFields(
    ids={"categoryId": "o_custkey"},
    enums={
        "area": ("o_orderstatus", ("O", "F", "P")),
        "level": ("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
    },
)
REQUEST_COLUMNS = "request_id bigint, search string, categoryId string, area string"

DOCUMENT_LISTING = (
    "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "url",
)
DOCUMENT_ORDER = ("lang", "quality", "source", "doc_id")
LINEITEM_LISTING = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
    "l_quantity", "l_shipdate", "p_name", "p_brand", "s_name",
)
LINEITEM_ORDER = ("l_returnflag", "p_name", "l_shipdate", "l_orderkey", "l_linenumber")
ORDER_LISTING = (
    "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_name", "c_mktsegment",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def _document_lookups(spark: SparkSession, d: str) -> list[Lookup]:
    return [
        Lookup(
            _table(spark, d, "labels"),
            "doc_id",
            "doc_id",
            {"quality": "quality", "toxic": "toxic"},
        ),
        Lookup(_table(spark, d, "pages"), "page_id", "doc_id", {"url": "url"}),
    ]


def _documents(spark: SparkSession, d: str, **request: str) -> DataFrame:
    return catalog_list(
        _table(spark, d, "documents"),
        _document_lookups(spark, d),
        DOCUMENT_LISTING,
        where=criteria(DOCUMENT_FIELDS, request) if request else None,
        order_by=DOCUMENT_ORDER,
    )


# --- search and listing ----------------------------------------------------


def _lookup_list(spark: SparkSession, d: str) -> DataFrame:
    return lookup_list(_table(spark, d, "nation"), "n_nationkey", "n_name")


def _catalog_list(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d)


def _catalog_list_large(spark: SparkSession, d: str) -> DataFrame:
    lookups = [
        Lookup(
            _table(spark, d, "part"),
            "p_partkey",
            "l_partkey",
            {"p_name": "p_name", "p_brand": "p_brand"},
        ),
        Lookup(_table(spark, d, "supplier"), "s_suppkey", "l_suppkey", {"s_name": "s_name"}),
    ]
    lineitem = _table(spark, d, "lineitem")
    return catalog_list(lineitem, lookups, LINEITEM_LISTING, order_by=LINEITEM_ORDER)


def _catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, search="éa", area="fr")


def _search_ascii(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents").where(search(["text", "source"], "éA"))
    return documents.select("doc_id", "lang", "source")


def _search_wildcard(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents").where(search(["text"], "re_on%THE%.\nth"))
    return documents.select("doc_id", "lang", "source")


def _search_nulls(spark: SparkSession, d: str) -> DataFrame:
    source = F.nullif(F.col("source"), F.lit("src1")).alias("source")
    documents = _table(spark, d, "documents").select("doc_id", "text", source)
    return documents.where(search(["source", "text"], "xq") | search(["source"], "src2"))


def _search_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages").where(search(["url", "html"], "EXAMPLE.net/"))
    return pages.select("page_id", "url")


def _search_trimmed(spark: SparkSession, d: str) -> DataFrame:
    where = criteria(DOCUMENT_FIELDS, {"search": " \t éa\n"}, trim_term=True)
    return _table(spark, d, "documents").where(where).select("doc_id", "lang", "source")


def _filter_id(spark: SparkSession, d: str) -> DataFrame:
    lineitem = _table(spark, d, "lineitem").where(by_id("l_suppkey", "7abc"))
    return lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")


def _filter_id_ignored(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "supplier").where(by_id("s_suppkey", "abc"))


def _parse_int_column(spark: SparkSession, d: str) -> DataFrame:
    number = parse_int_prefix(F.col("o_orderpriority")).alias("priority")
    return _table(spark, d, "orders").select("o_orderkey", number)


def _orders(spark: SparkSession, d: str, **request: str) -> DataFrame:
    customers = Lookup(
        _table(spark, d, "customer"),
        "c_custkey",
        "o_custkey",
        {"c_name": "c_name", "c_mktsegment": "c_mktsegment"},
    )
    return catalog_list(
        _table(spark, d, "orders"),
        [customers],
        ORDER_LISTING,
        where=criteria(ORDER_FIELDS, request),
        order_by=("o_orderstatus", "c_name", "o_orderpriority", "o_orderkey"),
    )


def _filter_enum(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, area="F", level="2-HIGH")


def _filter_enum_ignored(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, area="f", level="1-URGENT", categoryId="")


def _empty_result(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents")
    terms = {"present": "the", "absent": "no such text"}
    empty = {
        name: is_empty(documents.where(search(["text", "source"], term)))
        for name, term in terms.items()
    }
    return spark.createDataFrame([tuple(empty.values())], ", ".join(f"{n} boolean" for n in empty))


# --- display ---------------------------------------------------------------


def _display(spark: SparkSession, d: str) -> DataFrame:
    label, href = source_link(F.col("url"))
    return _table(spark, d, "pages").select(
        "page_id",
        escape_html(F.col("html")).alias("html"),
        label.alias("label"),
        href.alias("href"),
    )


def _display_fallback(spark: SparkSession, d: str) -> DataFrame:
    source = F.nullif(F.col("source"), F.lit("src1"))
    label, href = feature_link(F.col("url"), source)
    return _catalog_list(spark, d).select(
        "doc_id",
        fallback(F.col("quality").cast("string")).alias("quality"),
        fallback(source, "").alias("notes"),
        label.alias("label"),
        href.alias("href"),
    )


# --- JSON and URLs ---------------------------------------------------------


def _json_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows_as_json(_catalog_list(spark, d))


def _write_json(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "rows")
    write_rows_json(_catalog_list(spark, d), path)
    return read_submissions(spark, path).withColumnRenamed("body", "json")


def _read_json(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "bodies")
    _table(spark, d, "events").select(F.col("props").alias("value")).write.text(path)
    bodies = read_submissions(spark, path)
    parsed = json_values.with_json(bodies, "body", "_v")
    members = json_values.with_members(parsed, "_v", ["k"])
    return members.select("body", json_values.integer_text("k").alias("k"))


def _url_params(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select(
        "page_id", *query_params(F.col("url"), ["page", "ref", "none"])
    )


def _url_build(spark: SparkSession, d: str) -> DataFrame:
    values = {
        "search": F.col("p_name"),
        "area": F.nullif(F.col("p_type"), F.lit("SMALL")),
        "level": F.col("p_brand"),
    }
    return _table(spark, d, "part").select("p_partkey", query_string(values).alias("query"))


# --- validation and constraints --------------------------------------------


def _missing_required(spark: SparkSession, d: str) -> DataFrame:
    falsy = {
        "lang": F.nullif(F.col("lang"), F.lit("de")).isNull(),
        "text": F.col("text") == "",
        "source": F.nullif(F.col("source"), F.lit("src1")).isNull(),
    }
    return _table(spark, d, "documents").select(
        "doc_id", missing_required(falsy).alias("missing")
    )


def _enum_first_error(spark: SparkSession, d: str) -> DataFrame:
    error = enum_error(
        [
            (F.col("o_orderstatus"), ("O", "F"), "Invalid status"),
            (F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "5-LOW"), "Invalid priority"),
        ]
    )
    return _table(spark, d, "orders").select("o_orderkey", error.alias("error"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents as submissions: (submission_id, body)."""

    def word(column: str, **words: str) -> Column:
        pairs = [part for key, value in words.items() for part in (F.lit(key), F.lit(value))]
        return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))

    documents = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left")
    impact = F.when(F.col("toxic") == 1, "High").when(F.col("toxic") == 0, "Low")
    values = {
        "title": F.col("text"),
        "description": F.nullif(F.col("source"), F.lit("src1")),
        "domain": word("lang", en="Security", fr="Performance", de="Reliability"),
        "category_id": F.col("quality").cast("string"),
        "feature_id": F.col("doc_id"),
        "recommendation_level": F.lit("Mandatory"),
        "impact_level": impact,
        "difficulty_level": F.lit("Easy"),
        "source_reference": F.col("source"),
        "notes": F.col("lang"),
    }
    body = F.to_json(F.struct(*(value.alias(name) for name, value in values.items())))
    return documents.select(F.col("doc_id").alias("submission_id"), body.alias("body"))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "region").select(
        F.col("r_regionkey").cast("bigint").alias("category_id"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
    )


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select(
        F.col("page_id").alias("feature_id"),
        F.concat_ws(" ", "page_id", "url").alias("name"),
        F.col("url").alias("feature_url"),
        F.lit("Free").alias("subscription_level"),
    )


def _validate_submissions(spark: SparkSession, d: str) -> DataFrame:
    checked = validate_submissions(
        _bodies(spark, d), _categories(spark, d), _features(spark, d)
    )
    return checked.select("submission_id", "status", "error")


def _check_null_list(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    return events.where(~check_fails("event_type", ["click", None])).select("event_id")


def _check_list(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    return events.where(~check_fails("event_type", ["click", "view"])).select("event_id")


def _not_null_report(spark: SparkSession, d: str) -> DataFrame:
    source = F.nullif(F.col("source"), F.lit("src1")).alias("source")
    documents = _table(spark, d, "documents").select("doc_id", source)
    return documents.where(is_missing("source")).select("doc_id")


def _unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(_table(spark, d, "part"), "p_name")


def _unique_stored(spark: SparkSession, d: str) -> DataFrame:
    stored = _table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")
    return duplicates(_table(spark, d, "labels"), "doc_id", stored)


def _primary_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(_table(spark, d, "lineitem"), "l_orderkey")


def _fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    documents, labels = _table(spark, d, "documents"), _table(spark, d, "labels")
    return orphans(documents, "doc_id", labels, "doc_id").select("doc_id", "lang")


def _fk_null_passes(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("source") != "src1", F.col("doc_id")).alias("parent_id")
    documents = _table(spark, d, "documents").select("doc_id", parent)
    return orphans(documents, "parent_id", _table(spark, d, "pages"), "page_id")


# --- ids, loading and ingest -----------------------------------------------


def _assign_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents").select("doc_id", "lang", "source")
    return assign_ids(documents, "id", ["lang", "doc_id"], start=100)


def _append_defaults(spark: SparkSession, d: str) -> DataFrame:
    """English rows arrive without a source, and all rows without a display order."""
    documents = _table(spark, d, "documents").select("doc_id", "lang", "source")
    english = F.col("lang") == "en"
    shapes = [documents.where(~english), documents.where(english).drop("source")]
    complete = fill_omitted(combine_shapes(shapes), {"display_order": 0})
    no_source = F.lit(None).cast("string")
    path = shared_folder(spark, "append")
    recreate_table(complete, path)
    append_rows(fill_omitted(shapes[1], {"source": no_source, "display_order": 1}), path)
    return read_table(spark, path, complete.schema)


def _recreate_table(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "table")
    recreate_table(_table(spark, d, "pages"), path)
    orders = _table(spark, d, "orders")
    recreate_table(orders, path, ["o_orderstatus"])
    return read_table(spark, path, orders.schema)


def _practices(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(
        F.col("text").alias("title"),
        F.col("source").alias("description"),
        F.lit("General").alias("domain"),
        F.lit(1).cast("bigint").alias("category_id"),
        F.col("doc_id"),
    )


def _new_catalog(spark: SparkSession, d: str) -> Catalog:
    catalog = Catalog(shared_folder(spark, "catalog"))
    categories, features = _categories(spark, d), _features(spark, d)
    bulk_load(catalog, categories, features, _practices(spark, d), ("doc_id",))
    return catalog


STORED = (
    "practice_id", "title", "description", "domain", "category_id", "feature_id",
    "recommendation_level", "impact_level", "difficulty_level", "source_reference", "notes",
)


def _bulk_load(spark: SparkSession, d: str) -> DataFrame:
    return _new_catalog(spark, d).practices(spark).select(*STORED)


def _load_tables(spark: SparkSession, d: str) -> DataFrame:
    """The same from JSON files; ids follow the order of the rows in the files."""
    folder = shared_folder(spark, "seed")
    write_rows_json(_categories(spark, d), f"{folder}/categories")
    write_rows_json(_features(spark, d), f"{folder}/features")
    write_rows_json(_practices(spark, d).orderBy("doc_id"), f"{folder}/practices")
    catalog = Catalog(shared_folder(spark, "catalog"))
    load_tables(spark, folder, catalog, "json", {"categories": ("display_order",)})
    return catalog.practices(spark).select(*STORED)


def _ingest_submissions(spark: SparkSession, d: str) -> DataFrame:
    catalog = _new_catalog(spark, d)
    ingest_submissions(_bodies(spark, d), catalog)
    return catalog.practices(spark).select(*STORED)


def _append_practices(spark: SparkSession, d: str) -> DataFrame:
    """All documents once more, in another order, after those of the load."""
    catalog = _new_catalog(spark, d)
    more = _practices(spark, d).withColumns({"domain": F.lit("Security"), "notes": F.col("description")})
    append_practices(more.withColumn("_back", -F.col("doc_id")), catalog, ["_back"])
    return catalog.practices(spark).select(*STORED)


def _reload_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A load from the catalog it replaces, after one that failed, read by old and new readers."""
    catalog = _new_catalog(spark, d)
    old = catalog.pinned()
    bad = _practices(spark, d).withColumn("domain", F.lit("nowhere"))
    lookups = catalog.categories(spark), catalog.features(spark)
    try:
        bulk_load(catalog, *lookups, bad, ("doc_id",))
    except ConstraintViolation:
        pass
    lowered = catalog.practices(spark).withColumn("domain", F.lit("Reliability"))
    bulk_load(catalog, *lookups, lowered, ("practice_id",))
    read = [c.practices(spark).select("practice_id", "domain", "description") for c in (old, catalog)]
    return read[0].unionByName(read[1])


def _compact_batches(spark: SparkSession, d: str) -> DataFrame:
    """One batch for each language, merged by and by; the last runs again when it is merged."""
    catalog = _new_catalog(spark, d)
    bodies = _bodies(spark, d).join(
        _table(spark, d, "documents").select(F.col("doc_id").alias("submission_id"), "lang"), "submission_id"
    )
    for lang in ("en", "fr", "de", "es"):
        batch = bodies.where(F.col("lang") == lang).drop("lang")
        number = ingest_submissions(batch, catalog)
        if lang in ("fr", "es"):
            compact_batches(spark, catalog)
    ingest_submissions(batch, catalog, number)
    owners = catalog.owners(spark)
    return catalog.practices(spark).select("practice_id", "title", "domain", "notes").join(owners, "practice_id")


def _fresh_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The same submissions before and after the categories they name are published."""
    catalog = Catalog(shared_folder(spark, "catalog"))
    categories, features = _categories(spark, d), _features(spark, d)
    few = categories.where("category_id <> 1")
    bulk_load(catalog, few, features, _practices(spark, d).drop("category_id"), ("doc_id",))
    bodies = _bodies(spark, d)
    ingest_submissions(bodies, catalog)
    replace_lookups(catalog, categories.withColumn("display_order", F.lit(1)), features)
    ingest_submissions(bodies, catalog)
    owners = catalog.owners(spark).where("writer = 'ingest'").select("practice_id", "batch")
    return catalog.practices(spark).select("practice_id", "category_id", "notes").join(owners, "practice_id")


def _append_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Nations become categories without ids; names that are there already are refused."""
    catalog = _new_catalog(spark, d)
    nations = _table(spark, d, "nation").select(F.col("n_name").alias("name"))
    append_lookups(catalog, "categories", nations)
    try:
        append_lookups(catalog, "categories", nations.unionByName(_categories(spark, d).select("name")))
    except ConstraintViolation:
        pass
    return catalog.categories(spark).select("category_id", "name", "display_order")


def _default_times(spark: SparkSession, d: str) -> DataFrame:
    """Whether generated times are those of the run, whole seconds and the same in both columns."""
    start = F.lit(spark.sql("SELECT date_trunc('second', current_timestamp())").head()[0])
    catalog = _new_catalog(spark, d)
    stored = catalog.practices(spark)
    created, updated = F.col("created_at"), F.col("updated_at")
    return stored.select(
        "practice_id",
        (created == updated).alias("same"),
        (created == F.date_trunc("second", created)).alias("whole_seconds"),
        created.between(start, F.current_timestamp()).alias("of_the_run"),
    )


def _submission_words(spark: SparkSession, d: str) -> DataFrame:
    """Orders as submissions that fail each enumerated field, with ids as text and nested values."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    values = {
        "title": F.col("o_orderkey").cast("string"),
        "description": priority,
        "domain": F.when(status == "O", "Security").when(status == "F", "General").otherwise("security"),
        "category_id": (F.col("o_custkey") % 7).cast("string"),
        "feature_id": F.col("o_custkey").cast("string"),
        "recommendation_level": F.when(priority == "1-URGENT", "Must").otherwise("Optional"),
        "impact_level": F.when(priority == "2-HIGH", "Severe").otherwise("Low"),
        "difficulty_level": F.when(priority == "3-MEDIUM", "").when(priority == "5-LOW", "easy").otherwise("Easy"),
        "source_reference": priority,
        "notes": F.when(status == "F", F.array(status)),
    }
    members = F.to_json(F.struct(*(value.alias(name) for name, value in values.items())))
    bodies = _table(spark, d, "orders").select(F.col("o_orderkey").alias("submission_id"), members.alias("body"))
    checked = validate_submissions(bodies, _categories(spark, d), _features(spark, d))
    return checked.select("submission_id", "status", "error")


def _ingest_raw_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The same from files of one body to a line."""
    catalog = _new_catalog(spark, d)
    folder = shared_folder(spark, "bodies")
    _bodies(spark, d).orderBy("submission_id").select("body").write.text(folder)
    ingest_submissions(read_bodies(spark, folder), catalog)
    return catalog.practices(spark).select(*STORED)


def _ingest_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """The same from bodies that take many lines each and follow each other in files."""
    catalog = _new_catalog(spark, d)
    folder = shared_folder(spark, "bodies")
    pretty = F.to_json(F.parse_json("body"), {"pretty": "true"})
    _bodies(spark, d).orderBy("submission_id").select(pretty.alias("value")).write.text(folder)
    ingest_submissions(read_concatenated(spark, folder), catalog)
    return catalog.practices(spark).select(*STORED)


def _stream_submissions(spark: SparkSession, d: str) -> DataFrame:
    catalog = _new_catalog(spark, d)
    folder = shared_folder(spark, "incoming")
    write_rows_json(_bodies(spark, d), folder)
    stream = read_stream(spark, folder, SUBMISSIONS, files="*.json")
    query = stream_submissions(stream, catalog, shared_folder(spark, "progress"))
    query.awaitTermination()
    return catalog.practices(spark).select(*STORED)


def _stream_append(spark: SparkSession, d: str) -> DataFrame:
    accepted = shared_folder(spark, "accepted")
    events = read_stream(spark, d, SCHEMAS["events"], "parquet", "events.parquet")
    query = split_stream(
        events,
        "event_type IN ('click', 'view', 'error')",
        accepted,
        shared_folder(spark, "refused"),
        shared_folder(spark, "progress"),
    )
    query.awaitTermination()
    return read_table(spark, accepted, SCHEMAS["events"]).select("event_id", "event_type")


# --- batches of requests ---------------------------------------------------


def _document_batch(
    spark: SparkSession, d: str, requests: DataFrame, **options: int
) -> DataFrame:
    return search_batch(
        requests,
        _table(spark, d, "documents"),
        DOCUMENT_FIELDS,
        ["doc_id", "lang", "source"],
        **options,
    )


def _search_batch(spark: SparkSession, d: str) -> DataFrame:
    requests = spark.createDataFrame(
        [
            (1, "THE", None, ""),
            (2, None, None, "fr"),
            (3, "é", None, "xx"),
            (4, "é", "abc", None),
            (5, "", "17", "en"),
            (6, None, "17x", None),
            (7, "e_e%a.", None, "de"),
            (8, "th", "99999999999999999999", None),
            (9, "%", None, "es"),
        ],
        REQUEST_COLUMNS,
    )
    return _document_batch(spark, d, requests)


def _benchmark_requests(spark: SparkSession, d: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return _table(spark, d, "benchmark").select(
        F.col("item_id").alias("request_id"),
        F.col("text").alias("search"),
        nothing.alias("categoryId"),
        nothing.alias("area"),
    )


def _search_batch_terms(spark: SparkSession, d: str) -> DataFrame:
    """All names of languages and sources as terms, whole words of two to five letters, by grams."""
    documents, nothing = _table(spark, d, "documents"), F.lit(None).cast("string")
    names = [
        documents.groupBy(F.col(name).alias("search")).agg((F.min("doc_id") * 2 + number).alias("request_id"))
        for number, name in enumerate(("lang", "source"))
    ]
    requests = names[0].unionByName(names[1]).withColumns({"categoryId": nothing, "area": nothing})
    return _document_batch(spark, d, requests, max_inline_texts=0)


def _search_batch_grams(spark: SparkSession, d: str) -> DataFrame:
    return _document_batch(spark, d, _benchmark_requests(spark, d), max_inline_texts=0)


def _search_batch_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's texts in files of documents that their grams cannot rule out."""
    folder = shared_folder(spark, "documents")
    documents = _table(spark, d, "documents")
    recreate_table(documents.repartitionByRange(64, "doc_id"), folder)
    stored = read_table(spark, folder, documents.schema)
    build_gram_index(stored, DOCUMENT_FIELDS.text, f"{folder}-grams")
    requests = _benchmark_requests(spark, d)
    few = pruned(requests, stored, DOCUMENT_FIELDS, f"{folder}-grams")
    return search_batch(requests, few, DOCUMENT_FIELDS, ["doc_id", "lang", "source"])


def _search_batch_urls(spark: SparkSession, d: str) -> DataFrame:
    """One request for each page: its language, and its `page` parameter as an id if it has one."""
    requests = _table(spark, d, "pages").select(
        F.col("page_id").alias("request_id"),
        F.lit(None).cast("string").alias("search"),
        *(param.alias("categoryId") for param in query_params(F.col("url"), ["page"])),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("area"),
    )
    return _document_batch(spark, d, requests)


# --- the catalog's own search ----------------------------------------------

# A practice for each document, as SQL that Spark and DuckDB read alike.
_PRACTICE_SQL = {
    "practice_id": "doc_id + 1",
    "title": "concat(source, ' ', CAST(doc_id % 13 AS STRING))",
    "description": "text",
    "domain": "CASE lang WHEN 'en' THEN 'Security' WHEN 'fr' THEN 'Performance' ELSE 'General' END",
    "category_id": "doc_id % 7",
    "feature_id": "CASE WHEN doc_id % 3 = 0 THEN doc_id END",
    "recommendation_level": "CASE WHEN doc_id % 2 = 0 THEN 'Mandatory' ELSE 'Optional' END",
    "impact_level": "CASE WHEN doc_id % 5 > 0 THEN 'High' END",
    "difficulty_level": "CASE WHEN doc_id % 4 = 0 THEN 'Easy' END",
    "prerequisites": "CASE WHEN doc_id % 6 = 0 THEN 'needs THE <lock>' END",
    "expressions_configuration_details": "CASE WHEN doc_id % 11 = 0 THEN concat('a & ', lang) END",
    "source_reference": "CASE WHEN doc_id % 2 = 1 THEN 'https://example.org/a?b=1' ELSE 'book' END",
    "notes": "CASE WHEN doc_id % 9 = 0 THEN 'Zebra_note' END",
}


def _full_practices(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.expr(sql).alias(name) for name, sql in _PRACTICE_SQL.items()]
    no_time = F.lit(None).cast("timestamp")
    times = (no_time.alias("created_at"), no_time.alias("updated_at"))
    return _table(spark, d, "documents").select(*columns, *times)


def _practice_search(spark: SparkSession, d: str) -> DataFrame:
    found = search_practices(
        _full_practices(spark, d), _categories(spark, d), _features(spark, d),
        search="the", area="Security", level="Mandatory", impact="High",
    )
    return found.drop("updated_at")


def _practice_search_batch(spark: SparkSession, d: str) -> DataFrame:
    fields = "request_id bigint, search string, categoryId string, featureId string, area string, level string, impact string"
    requests = spark.createDataFrame(
        [
            (1, "ZEBRA_", None, None, None, None, None),
            (2, "zebra_", None, None, "Security", "Optional", None),
            (3, None, "3x", None, "nowhere", None, "High"),
            (4, None, None, "12", None, None, None),
            (5, "<LOCK>", None, None, "Performance", None, None),
            (6, "99%", "x", None, None, None, "Low"),
        ],
        fields,
    )
    found = search_practices_batch(
        requests, _full_practices(spark, d), _categories(spark, d), _features(spark, d)
    )
    return found.drop("updated_at")


def _practice_display(spark: SparkSession, d: str) -> DataFrame:
    found = search_practices(
        _full_practices(spark, d), _categories(spark, d), _features(spark, d), search="lock"
    )
    return display_rows(found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of (session, table folder)."""
    found = {
        "lookup_list": _lookup_list,
        "catalog_list": _catalog_list,
        "catalog_list_large": _catalog_list_large,
        "catalog_search": _catalog_search,
        "search_ascii": _search_ascii,
        "search_wildcard": _search_wildcard,
        "search_nulls": _search_nulls,
        "search_pages": _search_pages,
        "search_trimmed": _search_trimmed,
        "filter_id": _filter_id,
        "filter_id_ignored": _filter_id_ignored,
        "parse_int_column": _parse_int_column,
        "filter_enum": _filter_enum,
        "filter_enum_ignored": _filter_enum_ignored,
        "empty_result": _empty_result,
        "display": _display,
        "display_fallback": _display_fallback,
        "json_rows": _json_rows,
        "write_json": _write_json,
        "read_json": _read_json,
        "url_params": _url_params,
        "url_build": _url_build,
        "missing_required": _missing_required,
        "enum_first_error": _enum_first_error,
        "validate_submissions": _validate_submissions,
        "check_null_list": _check_null_list,
        "check_list": _check_list,
        "not_null_report": _not_null_report,
        "unique_violations": _unique_violations,
        "unique_stored": _unique_stored,
        "primary_key_violations": _primary_key_violations,
        "fk_orphans": _fk_orphans,
        "fk_null_passes": _fk_null_passes,
        "assign_ids": _assign_ids,
        "append_defaults": _append_defaults,
        "recreate_table": _recreate_table,
        "bulk_load": _bulk_load,
        "load_tables": _load_tables,
        "ingest_submissions": _ingest_submissions,
        "ingest_raw_bodies": _ingest_raw_bodies,
        "ingest_concatenated": _ingest_concatenated,
        "append_practices": _append_practices,
        "reload_catalog": _reload_catalog,
        "compact_batches": _compact_batches,
        "fresh_lookups": _fresh_lookups,
        "append_lookups": _append_lookups,
        "default_times": _default_times,
        "submission_words": _submission_words,
        "stream_submissions": _stream_submissions,
        "stream_append": _stream_append,
        "search_batch": _search_batch,
        "search_batch_terms": _search_batch_terms,
        "search_batch_grams": _search_batch_grams,
        "search_batch_indexed": _search_batch_indexed,
        "search_batch_urls": _search_batch_urls,
        "practice_search": _practice_search,
        "practice_search_batch": _practice_search_batch,
        "practice_display": _practice_display,
    }
    configured = {name: _configured(query) for name, query in found.items()}
    if training_data:
        configured |= training_data.queries() | {"pipeline": corpus_pipeline.run}
    return configured


def _configured(
    query: Callable[[SparkSession, str], DataFrame],
) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: search, both lookups and the listing order."""
    return _catalog_search(configure(spark), ENTRY_DIR)


# --- oracle ----------------------------------------------------------------


def _fold(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """Query name to the SQL that gives the same rows on the same tables."""
    documents = """
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, p.url
        FROM documents d
        LEFT JOIN labels l ON d.doc_id = l.doc_id
        LEFT JOIN pages p ON d.doc_id = p.page_id"""
    orders = """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, c_name, c_mktsegment
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
    found = "SELECT doc_id, lang, source FROM documents WHERE "
    listing_json = f"""
        SELECT '{{"doc_id":' || doc_id
            || ',"text":' || to_json(text)
            || ',"lang":' || to_json(lang)
            || ',"source":' || to_json(source)
            || ',"n_chars":' || n_chars
            || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null')
            || ',"toxic":' || coalesce(CAST(toxic AS VARCHAR), 'null')
            || ',"url":' || coalesce(CAST(to_json(url) AS VARCHAR), 'null')
            || '}}' AS json
        FROM ({documents})"""
    submissions = """
        SELECT d.doc_id AS submission_id, d.text AS title,
            nullif(d.source, 'src1') AS description,
            CASE d.lang WHEN 'en' THEN 'Security' WHEN 'fr' THEN 'Performance'
                WHEN 'de' THEN 'Reliability' ELSE d.lang END AS domain,
            CAST(l.quality AS BIGINT) AS category_id, d.doc_id AS feature_id,
            'Mandatory' AS recommendation_level,
            CASE l.toxic WHEN 1 THEN 'High' WHEN 0 THEN 'Low' END AS impact_level,
            'Easy' AS difficulty_level, d.source AS source_reference, d.lang AS notes
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    missing = """concat_ws(', ',
            CASE WHEN title IS NULL OR title = '' THEN 'title' END,
            CASE WHEN description IS NULL OR description = '' THEN 'description' END,
            CASE WHEN domain IS NULL OR domain = '' THEN 'domain' END,
            CASE WHEN impact_level IS NULL THEN 'impact_level' END,
            CASE WHEN category_id IS NULL THEN 'category_id' END,
            CASE WHEN feature_id = 0 THEN 'feature_id' END,
            CASE WHEN source_reference IS NULL OR source_reference = ''
                THEN 'source_reference' END)"""
    validated = f"""
        SELECT *, CASE
            WHEN missing <> '' THEN 400
            WHEN domain NOT IN ('Security', 'Performance', 'Reliability', 'General') THEN 400
            WHEN category_id NOT IN (SELECT r_regionkey FROM region)
                OR feature_id NOT IN (SELECT page_id FROM pages) THEN 500
            ELSE 200 END AS status
        FROM (SELECT *, {missing} AS missing FROM ({submissions}))"""
    loaded = """
        SELECT row_number() OVER (ORDER BY doc_id) AS practice_id, text AS title,
            source AS description, 'General' AS domain, CAST(1 AS BIGINT) AS category_id,
            CAST(NULL AS BIGINT) AS feature_id, CAST(NULL AS VARCHAR) AS recommendation_level,
            CAST(NULL AS VARCHAR) AS impact_level, CAST(NULL AS VARCHAR) AS difficulty_level,
            CAST(NULL AS VARCHAR) AS source_reference, CAST(NULL AS VARCHAR) AS notes
        FROM documents"""
    ingested = f"""
        {loaded}
        UNION ALL
        SELECT (SELECT count(*) FROM documents)
                + row_number() OVER (ORDER BY submission_id) AS practice_id,
            title, description, domain, category_id, feature_id, recommendation_level,
            impact_level, difficulty_level, source_reference, notes
        FROM ({validated}) WHERE status = 200"""
    text_hit = (
        f"({_fold('d.text')} LIKE '%' || {_fold('r.search')} || '%'"
        f" OR {_fold('d.source')} LIKE '%' || {_fold('r.search')} || '%')"
    )
    benchmark_hits = f"""
        SELECT r.request_id, d.doc_id, d.lang, d.source
        FROM documents d
        JOIN (SELECT item_id AS request_id, text AS search FROM benchmark) r ON {text_hit}"""
    practices = ", ".join(f"{text} AS {name}" for name, text in _PRACTICE_SQL.items())
    texts = "title description prerequisites expressions_configuration_details notes".split()

    def found_by(term: str) -> str:
        return "(" + " OR ".join(f"coalesce({_fold(t)} LIKE '%{term}%', false)" for t in texts) + ")"

    listing = f"""
        SELECT practice_id, title, p.description, domain, c.r_name AS category_name,
            CASE WHEN f.page_id IS NULL THEN NULL ELSE concat(f.page_id, ' ', f.url) END
                AS feature_name,
            f.url AS feature_url, recommendation_level, impact_level, difficulty_level,
            prerequisites, expressions_configuration_details, source_reference, notes
        FROM (SELECT {practices} FROM documents) p
        LEFT JOIN region c ON p.category_id = c.r_regionkey
        LEFT JOIN pages f ON p.feature_id = f.page_id"""

    def shown(value: str) -> str:
        for plain, safe in (
            ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")
        ):
            value = f"replace({value}, '{plain}', '{safe}')"
        return f"coalesce({value}, '')"

    def or_na(value: str) -> str:
        return shown(f"coalesce(nullif({value}, ''), 'N/A')")

    sql = {
        "lookup_list": "SELECT n_nationkey AS id, n_name AS name FROM nation ORDER BY name",
        "catalog_list": f"{documents} ORDER BY lang, quality NULLS FIRST, source, d.doc_id",
        "catalog_list_large": """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
                l_shipdate, p_name, p_brand, s_name
            FROM lineitem
            LEFT JOIN part ON l_partkey = p_partkey
            LEFT JOIN supplier ON l_suppkey = s_suppkey""",
        "catalog_search": f"""
            {documents}
            WHERE d.lang = 'fr'
                AND ({_fold('d.text')} LIKE '%éa%' OR {_fold('d.source')} LIKE '%éa%')
            ORDER BY lang, quality NULLS FIRST, source, d.doc_id""",
        "search_ascii": f"""{found} {_fold('text')} LIKE '%éa%'
            OR {_fold('source')} LIKE '%éa%'""",
        "search_wildcard": f"{found} {_fold('text')} LIKE '%re_on%the%.' || chr(10) || 'th%'",
        "search_nulls": f"""
            SELECT doc_id, text, source
            FROM (SELECT doc_id, text, nullif(source, 'src1') AS source FROM documents)
            WHERE {_fold('source')} LIKE '%xq%' OR {_fold('text')} LIKE '%xq%'
                OR {_fold('source')} LIKE '%src2%'""",
        "search_pages": f"""
            SELECT page_id, url FROM pages
            WHERE {_fold('url')} LIKE '%example.net/%' OR {_fold('html')} LIKE '%example.net/%'""",
        "search_trimmed": f"""{found} {_fold('text')} LIKE '%éa%'
            OR {_fold('source')} LIKE '%éa%'""",
        "filter_id": """
            SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = 7""",
        "filter_id_ignored": "SELECT * FROM supplier",
        "parse_int_column": r"""
            SELECT o_orderkey, TRY_CAST(nullif(
                regexp_extract(o_orderpriority, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS priority
            FROM orders""",
        "filter_enum": f"{orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'",
        "filter_enum_ignored": f"{orders} WHERE o_orderpriority = '1-URGENT'",
        "empty_result": f"""
            SELECT count(*) FILTER ({_fold('text')} LIKE '%the%'
                    OR {_fold('source')} LIKE '%the%') = 0 AS present,
                count(*) FILTER ({_fold('text')} LIKE '%no such text%'
                    OR {_fold('source')} LIKE '%no such text%') = 0 AS absent
            FROM documents""",
        "display": """
            SELECT page_id,
                replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'),
                    '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS html,
                CASE WHEN starts_with(url, 'https://') THEN 'Documentation'
                    ELSE coalesce(nullif(url, ''), 'N/A') END AS label,
                CASE WHEN starts_with(url, 'https://') THEN url END AS href
            FROM pages""",
        "display_fallback": f"""
            SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'N/A') AS quality,
                coalesce(nullif(source, 'src1'), '') AS notes,
                coalesce(nullif(nullif(source, 'src1'), ''),
                    CASE WHEN nullif(url, '') IS NULL THEN 'N/A' ELSE 'Link' END) AS label,
                nullif(url, '') AS href
            FROM ({documents})""",
        "json_rows": listing_json,
        "write_json": listing_json,
        "read_json": """
            SELECT props AS body, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
            FROM events""",
        "url_params": """
            SELECT page_id,
                nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
                nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
                CAST(NULL AS VARCHAR) AS "none"
            FROM pages""",
        "url_build": """
            SELECT p_partkey, concat_ws('&',
                'search=' || replace(url_encode(nullif(p_name, '')), '%20', '+'),
                'area=' || replace(url_encode(nullif(p_type, 'SMALL')), '%20', '+'),
                'level=' || replace(url_encode(nullif(p_brand, '')), '%20', '+')) AS query
            FROM part""",
        "missing_required": """
            SELECT doc_id, concat_ws(', ',
                CASE WHEN lang = 'de' THEN 'lang' END,
                CASE WHEN text = '' THEN 'text' END,
                CASE WHEN source = 'src1' THEN 'source' END) AS missing
            FROM documents""",
        "enum_first_error": """
            SELECT o_orderkey, CASE
                WHEN o_orderstatus NOT IN ('O', 'F') THEN 'Invalid status'
                WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
                    THEN 'Invalid priority' END AS error
            FROM orders""",
        "validate_submissions": f"""
            SELECT submission_id, status, CASE
                WHEN missing <> '' THEN 'Missing required fields: ' || missing
                WHEN status = 400 THEN 'Invalid domain value'
                WHEN status = 500 THEN 'Failed to create practice' END AS error
            FROM ({validated})""",
        "check_null_list": """
            SELECT event_id FROM events
            WHERE coalesce(event_type IN ('click', NULL), true)""",
        "check_list": """
            SELECT event_id FROM events
            WHERE coalesce(event_type IN ('click', 'view'), true)""",
        "not_null_report": """
            SELECT doc_id FROM documents WHERE nullif(source, 'src1') IS NULL""",
        "unique_violations": """
            SELECT p_name AS value, count(*) AS rows FROM part
            GROUP BY p_name HAVING count(*) > 1""",
        "unique_stored": """
            SELECT doc_id AS value, count(*) AS rows
            FROM (SELECT doc_id, 1 AS given FROM labels
                UNION ALL SELECT page_id, 0 FROM pages)
            GROUP BY doc_id HAVING count(*) > 1 AND sum(given) > 0""",
        "primary_key_violations": """
            SELECT l_orderkey AS value, count(*) AS rows FROM lineitem
            GROUP BY l_orderkey HAVING count(*) > 1""",
        "fk_orphans": """
            SELECT doc_id, lang FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "fk_null_passes": """
            SELECT doc_id, doc_id AS parent_id FROM documents
            WHERE source <> 'src1' AND doc_id NOT IN (SELECT page_id FROM pages)""",
        "assign_ids": """
            SELECT 100 + row_number() OVER (ORDER BY lang, doc_id) AS id, doc_id, lang, source
            FROM documents""",
        "append_defaults": """
            SELECT doc_id, lang, CASE WHEN lang <> 'en' THEN source END AS source,
                CAST(0 AS INTEGER) AS display_order FROM documents
            UNION ALL
            SELECT doc_id, lang, CAST(NULL AS VARCHAR), CAST(1 AS INTEGER) FROM documents
            WHERE lang = 'en'""",
        "recreate_table": "SELECT * FROM orders",
        "bulk_load": loaded,
        "load_tables": loaded,
        "ingest_submissions": ingested,
        "ingest_raw_bodies": ingested,
        "ingest_concatenated": ingested,
        "append_practices": f"""
            {loaded}
            UNION ALL
            SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY doc_id DESC),
                text, source, 'Security', 1, NULL, NULL, NULL, NULL, NULL, source
            FROM documents""",
        "reload_catalog": f"""
            SELECT practice_id, d.domain, description
            FROM ({loaded}) p, (SELECT unnest(['General', 'Reliability']) AS domain) d""",
        "compact_batches": f"""
            SELECT practice_id, title, domain, notes, 'load' AS writer, CAST(0 AS BIGINT) AS batch
            FROM ({loaded})
            UNION ALL
            SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY batch, submission_id),
                title, domain, notes, 'ingest', CAST(batch AS BIGINT)
            FROM (SELECT *, list_position(['en', 'fr', 'de', 'es'], notes) - 1 AS batch FROM ({validated}))
            WHERE status = 200 AND batch >= 0""",
        "fresh_lookups": f"""
            SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY batch, submission_id)
                    AS practice_id, category_id, notes, CAST(batch AS BIGINT) AS batch
            FROM ({validated}), (SELECT unnest([0, 1]) AS batch)
            WHERE status = 200 AND (batch = 1 OR category_id <> 1)""",
        "append_lookups": """
            SELECT CAST(r_regionkey AS BIGINT) AS category_id, r_name AS name, 0 AS display_order FROM region
            UNION ALL
            SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_name), n_name, 0
            FROM nation""",
        "default_times": """
            SELECT row_number() OVER (ORDER BY doc_id) AS practice_id, true AS same,
                true AS whole_seconds, true AS of_the_run
            FROM documents""",
        "submission_words": """
            SELECT submission_id, CAST(CASE WHEN client IS NOT NULL THEN 400 WHEN fails THEN 500 ELSE 200 END
                    AS INTEGER) AS status,
                CASE WHEN client IS NOT NULL THEN client WHEN fails THEN 'Failed to create practice' END AS error
            FROM (SELECT o_orderkey AS submission_id,
                    CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Missing required fields: difficulty_level'
                        WHEN o_orderstatus NOT IN ('O', 'F') THEN 'Invalid domain value'
                        WHEN o_orderpriority = '1-URGENT' THEN 'Invalid recommendation level'
                        WHEN o_orderpriority = '2-HIGH' THEN 'Invalid impact level'
                        WHEN o_orderpriority = '5-LOW' THEN 'Invalid difficulty level' END AS client,
                    o_orderstatus = 'F' OR o_custkey % 7 NOT IN (SELECT r_regionkey FROM region)
                        OR o_custkey NOT IN (SELECT page_id FROM pages) AS fails
                FROM orders)""",
        "stream_submissions": ingested,
        "stream_append": """
            SELECT event_id, event_type FROM events
            WHERE event_type IN ('click', 'view', 'error')""",
        "search_batch": f"""
            SELECT request_id, doc_id, lang, source
            FROM (SELECT *, {_fold('text')} AS t, {_fold('source')} AS s FROM documents),
                (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 9])::BIGINT AS request_id)
            WHERE CASE request_id
                WHEN 1 THEN t LIKE '%the%' OR s LIKE '%the%'
                WHEN 2 THEN lang = 'fr'
                WHEN 3 THEN t LIKE '%é%' OR s LIKE '%é%'
                WHEN 4 THEN t LIKE '%é%' OR s LIKE '%é%'
                WHEN 5 THEN doc_id = 17 AND lang = 'en'
                WHEN 6 THEN doc_id = 17
                WHEN 7 THEN lang = 'de' AND (t LIKE '%e_e%a.%' OR s LIKE '%e_e%a.%')
                WHEN 9 THEN lang = 'es' END""",
        "search_batch_terms": f"""
            SELECT r.request_id, d.doc_id, d.lang, d.source
            FROM documents d
            JOIN (SELECT lang AS search, min(doc_id) * 2 AS request_id FROM documents GROUP BY lang
                UNION ALL
                SELECT source, min(doc_id) * 2 + 1 FROM documents GROUP BY source) r ON {text_hit}""",
        "search_batch_grams": benchmark_hits,
        "search_batch_indexed": benchmark_hits,
        "search_batch_urls": """
            SELECT r.page_id AS request_id, d.doc_id, d.lang, d.source
            FROM documents d
            JOIN (SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page,
                    regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS area FROM pages) r
                ON (r.page = '' OR d.doc_id = TRY_CAST(r.page AS BIGINT))
                AND (r.area NOT IN ('en', 'fr', 'de', 'es') OR d.lang = r.area)""",
    }
    sql["practice_search"] = f"""
        SELECT * FROM ({listing}) WHERE {found_by('the')} AND domain = 'Security'
            AND recommendation_level = 'Mandatory' AND impact_level = 'High'"""
    requested = {
        1: found_by("zebra_"),
        2: f"{found_by('zebra_')} AND domain = 'Security' AND recommendation_level = 'Optional'",
        3: "(practice_id - 1) % 7 = 3 AND impact_level = 'High'",
        4: "practice_id - 1 = 12",
        5: f"{found_by('<lock>')} AND domain = 'Performance'",
        6: f"{found_by('99%')} AND impact_level = 'Low'",
    }
    sql["practice_search_batch"] = " UNION ALL ".join(
        f"SELECT CAST({number} AS BIGINT) AS request_id, * FROM ({listing}) WHERE {test}"
        for number, test in requested.items()
    )
    link = "source_reference LIKE 'https://%'"
    sql["practice_display"] = f"""
        SELECT {shown('title')} AS title, {or_na('category_name')} AS category,
            {shown('domain')} AS domain, {shown('recommendation_level')} AS level,
            {or_na('impact_level')} AS impact, {or_na('difficulty_level')} AS difficulty,
            {shown('description')} AS description, {or_na('prerequisites')} AS prerequisites,
            {shown("coalesce(nullif(feature_name, ''), CASE WHEN coalesce(feature_url, '') = '' THEN 'N/A' ELSE 'Link' END)")} AS feature,
            {or_na('expressions_configuration_details')} AS configuration,
            CASE WHEN {link} THEN 'Documentation' ELSE {or_na('source_reference')} END AS source,
            {shown('notes')} AS notes,
            CASE WHEN coalesce(feature_url, '') <> '' THEN {shown('feature_url')} END AS feature_href,
            CASE WHEN {link} THEN {shown('source_reference')} END AS source_href
        FROM ({listing}) WHERE {found_by('lock')}"""
    if training_data:
        sql |= training_data.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
