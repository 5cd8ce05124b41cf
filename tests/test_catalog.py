import pytest
from pyspark.sql import functions as F

from samples import PRACTICE_ROWS, like
from shelfline.operators.catalog import is_empty
from shelfline.operators.display import display_rows
from shelfline.plans.catalog import (
    LISTING_COLUMNS,
    list_categories,
    list_features,
    search_practices,
)


def ids(listing):
    return [row["practice_id"] for row in listing.collect()]


def found(practices, categories, features, **request):
    return ids(search_practices(practices, categories, features, **request))


def test_listing_order_and_columns(practices, categories, features):
    """Nulls first, then binary order; equal rows by id."""
    listing = search_practices(practices, categories, features)
    assert tuple(listing.columns) == LISTING_COLUMNS
    assert ids(listing) == [3, 4, 2, 5, 6, 1]


@pytest.mark.parametrize(
    "request_, expected",
    [
        ({}, {1, 2, 3, 4, 5, 6}),
        ({"search": "", "category_id": "", "area": ""}, {1, 2, 3, 4, 5, 6}),
        ({"search": "ABC"}, {5}),
        ({"search": "a_c"}, {1, 5}),
        ({"search": "them%often"}, {1}),
        ({"search": "é"}, set()),
        ({"search": "É"}, {2}),
        ({"search": "àb"}, set()),
        ({"search": "Àb"}, {6}),
        ({"search": "\\"}, {1, 5}),
        ({"search": "c:\\TEMP"}, {1}),
        ({"search": " plan "}, set()),
        ({"search": " plan ", "trim_term": True}, {3}),
        ({"search": " "}, {1, 2, 3, 5}),
        ({"search": "%"}, {1, 2, 3, 4, 5, 6}),
        ({"category_id": "3"}, {3, 4}),
        ({"category_id": " 3.9x"}, {3, 4}),
        ({"category_id": "abc"}, {1, 2, 3, 4, 5, 6}),
        ({"category_id": "0"}, {6}),
        ({"category_id": "99999999999999999999"}, set()),
        ({"feature_id": "10"}, {1, 5}),
        ({"area": "Security"}, {1, 5, 6}),
        ({"area": "security"}, {1, 2, 3, 4, 5, 6}),
        ({"area": "Reliability"}, set()),
        ({"level": "Recommended"}, {3, 4}),
        ({"impact": "Medium"}, {5, 6}),
        ({"impact": "medium"}, {1, 2, 3, 4, 5, 6}),
        ({"area": "Security", "impact": "Medium", "search": "X"}, {5}),
    ],
)
def test_search(practices, categories, features, request_, expected):
    assert set(found(practices, categories, features, **request_)) == expected


def test_search_agrees_with_plain_matcher(practices, categories, features):
    for term in ("a", "_", "o_k", "s%e", "1", "<", "100%"):
        expected = {
            row[0]
            for row in PRACTICE_ROWS
            if any(like(row[i], term) for i in (1, 2, 10, 9, 12))
        }
        assert set(found(practices, categories, features, search=term)) == expected


def test_lookup_lists_in_binary_order(categories, features):
    assert [tuple(row) for row in list_categories(categories).collect()] == [
        (2, "Alpha"), (3, "Zeta"), (1, "alpha"), (4, "unused"),
    ]
    assert [row["id"] for row in list_features(features).collect()] == [11, 12, 10]


def test_is_empty(practices, categories, features):
    assert is_empty(search_practices(practices, categories, features, area="Reliability"))
    assert not is_empty(search_practices(practices, categories, features))


def test_display_rows(practices, categories, features):
    shown = display_rows(search_practices(practices, categories, features))
    rows = {row["title"] + "|" + row["source"]: row for row in shown.collect()}
    linked = rows["Rotate keys|Documentation"]
    assert (linked["feature"], linked["feature_href"]) == ("proxy", "https://example.org/proxy")
    assert linked["source_href"] == "https://e.org/a"
    assert linked["prerequisites"] == "N/A"
    plain = rows["Cache assets|HTTPS://e.org"]
    assert (plain["feature"], plain["feature_href"], plain["source_href"]) == ("N/A", None, None)
    assert (plain["impact"], plain["prerequisites"], plain["notes"]) == ("N/A", "N/A", "")
    escaped = rows["Twin|book &lt;1&gt;"]
    assert (escaped["feature"], escaped["feature_href"]) == ("cache", None)
    assert rows["Zero|N/A"]["level"] == ""


def test_unnamed_feature_with_url_is_a_link(spark):
    from shelfline.operators.display import feature_link

    label, href = feature_link(F.lit("u"), F.lit(None).cast("string"))
    assert tuple(spark.range(1).select(label, href).head()) == ("Link", "u")
