"""An index of the grams in each file of a table, so that a batch opens only files that can match.

For every file there is a Bloom filter of the grams its texts hold, those that long terms are
looked up by. It is stored by its 64-bit words, sorted in each stored file, and by a hash of the
file's path; two files of the same hash would share their bits and be read once too often. Files that
were added since, or replaced, are not in the index and are always read; the
search itself tests every row as before, so the rows are the same with and without the index.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.text import ascii_fold
from shelfline.operators.batch import GRAMS, gram_of, normalized
from shelfline.operators.filters import SearchFields
from shelfline.session import stage
from shelfline.sources.tables import read_table, recreate_table

# The sorts of grams that are rare enough to tell files apart: characters after a blank.
SORTS = tuple(sort for sort, (lead, size) in enumerate(GRAMS) if lead and size >= 8)
# Bits of the filter of a file, 1 MB; a file of a million different grams fills an eighth.
BITS = 1 << 23

WORDS = T.StructType(
    [
        T.StructField("file", T.LongType()),
        T.StructField("word", T.LongType()),
        T.StructField("bits", T.LongType()),
    ]
)
FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("size", T.LongType())])


def _word_and_bit(place: Column) -> tuple[Column, Column]:
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    return F.shiftright(place, 6), one


def _place(gram: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(bits))


def _file() -> tuple[Column, Column]:
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")


def _longest_grams(text: Column) -> Column:
    """The characters after each blank of a text, up to those of the longest sort, down to the shortest."""
    sizes = [GRAMS[sort][1] for sort in SORTS]
    return F.regexp_extract_all(ascii_fold(text), F.lit(f"(?s) (?=(.{{{min(sizes)},{max(sizes)}}}))"), F.lit(1))


def build_gram_index(table: DataFrame, texts: Sequence[str], path: str, bits: int = BITS) -> None:
    """Index the files that `table`, a plain read of files, consists of.

    One pass over the texts, in which a place is cut once for all sorts of grams. Bits of a word are
    combined before the shuffle, so what moves is bounded by the filters, not by the grams.
    """
    lists = [_longest_grams(F.col(name)) for name in texts]
    nothing = F.array().cast("array<string>")
    file, size = _file()
    # Outer explodes, because Spark guards inner ones by a filter that cuts the texts again.
    cut = table.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.concat(*(F.coalesce(each, nothing) for each in lists)).alias("longest"),
    ).select("file", F.explode_outer("longest").alias("longest"))
    places = [
        F.when(F.char_length("longest") >= length, _place(F.substring("longest", 1, length), bits))
        for length in (GRAMS[sort][1] for sort in SORTS)
    ]
    held = cut.select("file", F.explode_outer(F.array(*places)).alias("place")).where(F.col("place").isNotNull())
    word, bit = _word_and_bit(F.col("place"))
    words = held.select("file", word.alias("word"), bit.alias("bit")).groupBy("file", "word").agg(F.bit_or("bit").alias("bits"))
    recreate_table(words.sortWithinPartitions("word", "file"), f"{path}/words")
    recreate_table(table.select(file, size).distinct().withColumn("filter_bits", F.lit(bits)), f"{path}/files")


def files_to_read(requests: DataFrame, table: DataFrame, fields: SearchFields, path: str) -> list[str]:
    """The files of `table` that can hold a row for some request, as `inputFiles` names them.

    All of them if a request has no text to look up, or too short a one.
    """
    spark = table.sparkSession
    names = sorted(table.inputFiles())
    terms = normalized(requests, fields).select("term").distinct()
    looked_up = stage(terms.select(gram_of(F.col("term")).alias("_g")).select("_g.*"), "grams")
    if not looked_up.where(F.col("sort").isNull() | ~F.col("sort").isin(*SORTS)).isEmpty():
        return names
    schema = T.StructType([*FILES, T.StructField("filter_bits", T.IntegerType())])
    files = read_table(spark, f"{path}/files", schema)
    bits = files.agg(F.max("filter_bits")).head()[0]
    # A file of the same name that was written anew has another size or is read for nothing.
    file, size = _file()
    now = table.select(file, size).distinct()
    known = stage(now.join(files, ["file", "size"], "left_semi").select("file"), "known-files")
    word, bit = _word_and_bit(_place(F.col("gram"), bits or BITS))
    asked = looked_up.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.collect_set("bit").alias("asked"))
    words = read_table(spark, f"{path}/words", WORDS)
    hit = F.exists("asked", lambda one: F.col("bits").bitwiseAND(one) != 0)
    matched = words.join(asked, "word").where(hit).select(F.col("file").alias("hash")).distinct()
    skipped = known.join(matched, F.xxhash64(known["file"]) == matched["hash"], "left_anti")
    closed = {_plain(row["file"]) for row in skipped.collect()}
    return [name for name in names if _plain(name) not in closed]


def _plain(name: str) -> str:
    """`file:/a` and `file:///a` are the same file."""
    scheme, colon, rest = name.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon and rest.startswith("/") else name


def pruned(requests: DataFrame, table: DataFrame, fields: SearchFields, path: str) -> DataFrame:
    """`table`, files of parquet without folder columns, less those with nothing for any request."""
    files = files_to_read(requests, table, fields, path)
    if not files:
        return table.where(F.lit(False))
    return read_table(table.sparkSession, [unquote(name) for name in files], table.schema)

