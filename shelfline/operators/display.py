"""Display form of listing rows: placeholders, links and escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import escape_html, or_default

# Placeholder and link labels of the listing.
MISSING = "N/A"
SOURCE_LABEL = "Documentation"
FEATURE_LABEL = "Link"


def fallback(value: Column, text: str = MISSING) -> Column:
    return or_default(value, text)


def source_link(source: Column) -> tuple[Column, Column]:
    """(label, href): only `https://` sources are links, in that exact case."""
    is_link = F.coalesce(source.startswith("https://"), F.lit(False))
    label = F.when(is_link, F.lit(SOURCE_LABEL)).otherwise(fallback(source))
    return label, F.when(is_link, source)


def feature_link(url: Column, name: Column) -> tuple[Column, Column]:
    """(label, href): a feature with a URL is a link, named or not."""
    href = F.nullif(url, F.lit(""))
    label = F.when(href.isNotNull(), fallback(name, FEATURE_LABEL)).otherwise(fallback(name))
    return label, href


def display_rows(listing: DataFrame) -> DataFrame:
    """The twelve display cells of the practice listing, escaped for HTML.

    The order of the listing is kept: this is a projection without a shuffle.
    """
    source_label, source_href = source_link(F.col("source_reference"))
    feature_label, feature_href = feature_link(F.col("feature_url"), F.col("feature_name"))
    cells = {
        "title": F.col("title"),
        "category": fallback(F.col("category_name")),
        "domain": F.col("domain"),
        "level": F.col("recommendation_level"),
        "impact": fallback(F.col("impact_level")),
        "difficulty": fallback(F.col("difficulty_level")),
        "description": F.col("description"),
        "prerequisites": fallback(F.col("prerequisites")),
        "feature": feature_label,
        "configuration": fallback(F.col("expressions_configuration_details")),
        "source": source_label,
        "notes": fallback(F.col("notes"), ""),
    }
    hrefs = {"feature_href": feature_href, "source_href": source_href}
    return listing.select(
        *(escape_html(cell).alias(name) for name, cell in cells.items()),
        *(
            F.when(href.isNotNull(), escape_html(href)).alias(name)
            for name, href in hrefs.items()
        ),
    )
