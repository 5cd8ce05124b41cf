"""Text expressions. All are native columns: nothing here starts a Python worker.

Every function accepts any string column, literals included. Catalyst folds an
expression over a literal to a constant, so the same definition serves one
search term and a whole column of them.
"""

from __future__ import annotations

import re

import string
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space around terms and before numbers, as a regex class.
SPACE = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The characters with an HTML escape, the ampersand first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#039;"),
)


def ascii_fold(text: Column) -> Column:
    """Lower-case A to Z and leave every other character alone.

    `lower` folds all of Unicode, which only agrees on pure ASCII text; there it
    is several times faster than `translate`.
    """
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def like_regex(term: Column) -> Column:
    """The regular expression for `LIKE '%term%'` ignoring ASCII case.

    `%` and `_` are wildcards and a backslash is a plain character. Each piece
    between two `%` becomes an atomic group that stops at its first occurrence:
    the earliest match of a piece is always good enough, so nothing has to be
    retried and matching stays linear in the text however many `%` there are.
    """
    plain = F.regexp_replace(term, F.lit(r"([\\.\[\]{}()*+?^$|])"), F.lit(r"\\$1"))
    single = F.replace(plain, F.lit("_"), F.lit("."))
    pieces = F.regexp_replace(single, F.lit("%+"), F.lit(")(?>.*?"))
    return F.concat(F.lit(r"(?is)\A(?>.*?"), pieces, F.lit(")"))


def like_contains(text: Column, term: Column) -> Column:
    """`text LIKE '%term%'`, ignoring the case of ASCII letters only."""
    return F.rlike(text, like_regex(term))


def any_like(texts: Sequence[Column], term: Column) -> Column:
    """True when any of the texts contains the term; null texts never do."""
    return reduce(or_, (F.coalesce(like_contains(t, term), F.lit(False)) for t in texts))


def int_prefix(text: Column) -> Column:
    """The leading integer of a text as digits, or null if it has none."""
    digits = F.regexp_extract(text, f"^{SPACE}*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit(""))


def parse_int_prefix(text: Column) -> Column:
    """The leading integer of a text as BIGINT; null if absent or out of range."""
    return int_prefix(text).try_cast("bigint")


def trim_space(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def or_default(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def escape_html(value: Column) -> Column:
    """Escape the five HTML characters; null becomes empty."""
    return reduce(
        lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])),
        HTML_ESCAPES,
        F.coalesce(value.cast("string"), F.lit("")),
    )


def query_param(url: Column, key: str) -> Column:
    """A decoded query parameter of a URL; absent and empty are both null.

    Read as browsers do, without parsing the rest of the URL: the query runs from the first
    question mark to the fragment, the first of several equal keys wins, a percent sign that
    starts no escape is itself, and characters that should have been escaped stay.
    """
    query = F.concat(F.lit("&"), F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1))
    raw = F.regexp_extract(query, f"(?s)&{re.escape(key)}(?:=([^&]*))?(?=&|$)", 1)
    escaped = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.nullif(F.coalesce(F.try_url_decode(escaped), raw), F.lit(""))


def query_params(url: Column, keys: Sequence[str]) -> list[Column]:
    return [query_param(url, key).alias(key) for key in keys]


def query_string(values: Mapping[str, Column]) -> Column:
    """Form-encode the non-empty values as `key=value` pairs, in the given order."""
    pairs = [
        F.concat(F.lit(key + "="), F.url_encode(F.nullif(value, F.lit(""))))
        for key, value in values.items()
    ]
    return F.concat_ws("&", *pairs)
