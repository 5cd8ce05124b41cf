"""The six optional search criteria as predicates over a fact table.

The predicates are meant for `where`: null stands for "not met", as in SQL. Over
literals they fold to plain comparisons, which reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.text import any_like, int_prefix, trim_space


@dataclass(frozen=True)
class SearchFields:
    """Which request field restricts which fact column, and how.

    `text` lists the columns searched by the request field `search`; `ids` maps
    a request field to the fact column it must equal as an integer; `enums`
    maps a request field to a column and the values it may ask for.
    """

    text: tuple[str, ...] = ()
    ids: Mapping[str, str] = field(default_factory=dict)
    enums: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    @property
    def request_fields(self) -> tuple[str, ...]:
        search = ("search",) if self.text else ()
        return (*search, *self.ids, *self.enums)


# The searched text columns and the names of the request's fields.
PRACTICE_FIELDS = SearchFields(
    text=(
        "title",
        "description",
        "expressions_configuration_details",
        "prerequisites",
        "notes",
    ),
    ids={"categoryId": "category_id", "featureId": "feature_id"},
    enums={
        "area": ("domain", schemas.DOMAINS),
        "level": ("recommendation_level", schemas.RECOMMENDATION_LEVELS),
        "impact": ("impact_level", schemas.IMPACT_LEVELS),
    },
)


def _column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def allowed(value: str | Column, values: Sequence[str]) -> Column:
    """True for an exact member of the list; never null."""
    return F.coalesce(_column(value).isin(*values), F.lit(False))


def search(columns: Sequence[str], term: str | Column) -> Column:
    """Any of the columns contains the term; an empty term matches every row."""
    term = _column(term)
    absent = F.coalesce(term, F.lit("")) == ""
    return absent | any_like([F.col(name) for name in columns], term)


def by_id(column: str, raw: str | Column) -> Column:
    """Equal to the leading integer of `raw`; no restriction if it has none.

    An integer beyond 64 bits is a restriction that no row meets.
    """
    digits = int_prefix(_column(raw))
    return digits.isNull() | (F.col(column) == digits.try_cast("bigint"))


def by_enum(column: str, raw: str | Column, values: Sequence[str]) -> Column:
    """Equal to `raw`, which is ignored unless it is one of the values."""
    raw = _column(raw)
    return ~allowed(raw, values) | (F.col(column) == raw)


def all_of(predicates: Iterable[Column]) -> Column:
    """Every predicate holds; with none given, every row passes."""
    return reduce(and_, predicates, F.lit(True))


def criteria(
    fields: SearchFields,
    request: Mapping[str, str | Column | None],
    trim_term: bool = False,
) -> Column:
    """One predicate for a request. Fields that are None or left out do not restrict."""
    unknown = set(request) - set(fields.request_fields)
    if unknown:
        raise ValueError(f"unknown request fields: {sorted(unknown)}")
    given = {name: value for name, value in request.items() if value is not None}
    predicates = []
    # Cheap equalities first: the text is only scanned for rows that pass them.
    for name, (column, values) in fields.enums.items():
        if name in given:
            predicates.append(by_enum(column, given[name], values))
    for name, column in fields.ids.items():
        if name in given:
            predicates.append(by_id(column, given[name]))
    if "search" in given:
        term = _column(given["search"])
        predicates.append(search(fields.text, trim_space(term) if trim_term else term))
    return all_of(predicates)
