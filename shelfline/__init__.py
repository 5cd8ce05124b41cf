"""Catalog search and validated ingest as Spark DataFrame jobs."""

from shelfline.plans.catalog import (
    list_categories,
    list_features,
    search_practices,
    search_practices_batch,
)
from shelfline.plans.compaction import compact_batches
from shelfline.plans.ingest import (
    append_practices,
    bulk_load,
    create_catalog,
    ingest_submissions,
    load_tables,
    replace_lookups,
)
from shelfline.streaming.submissions import stream_submissions

__all__ = [
    "append_practices",
    "bulk_load",
    "compact_batches",
    "create_catalog",
    "ingest_submissions",
    "list_categories",
    "list_features",
    "load_tables",
    "replace_lookups",
    "search_practices",
    "search_practices_batch",
    "stream_submissions",
]
