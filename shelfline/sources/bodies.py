"""JSON bodies that follow each other in large files, on any number of lines.

Where a body ends depends on all that comes before it: a brace counts outside of strings only.
So the files are read in pieces that end at a closing brace, which Spark cuts at any byte range,
and what a piece does to the state is written down without knowing the state: how many quotes it
has, and how many opening braces it has outside of strings if it begins outside or inside of one.
Such steps compose to running sums, first within each range, then over the ranges of a file, of
which there are few. A body ends where the depth comes back to its lowest value so far, so a brace
too many spoils one body only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.operators.identifiers import assign_ids
from shelfline.session import stage

_RANGE = ("_file", "_block")
# White space at the ends of a body.
_BLANKS = r"^\s+|\s+$"


def _outside(plain: Column, inside_first: int) -> Column:
    """Opening braces outside of strings, in a text without escapes."""
    segments = F.split(plain, '"', -1)
    chosen = F.filter(segments, lambda _, i: i % 2 == inside_first)
    return F.regexp_count(F.array_join(chosen, ""), F.lit(r"\{"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces with what they do, written once so that all sums see the same rows."""
    raw = spark.read.option("lineSep", "}").text(path)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    return stage(
        raw.select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("_metadata.file_size").alias("_size"),
            F.monotonically_increasing_id().alias("_place"),
            (F.octet_length("value") + 1).alias("_bytes"),
            (F.regexp_replace("value", _BLANKS, "") == "").alias("_blank"),
            F.regexp_count(plain, F.lit('"')).alias("_quotes"),
            _outside(plain, 0).alias("_open0"),
            _outside(plain, 1).alias("_open1"),
        ),
        "pieces",
    )


def read_concatenated(spark: SparkSession, path: str) -> DataFrame:
    """(submission_id, body) of the JSON objects in files, numbered as they lie in them.

    Objects may follow each other directly or after white space and may take any number of lines;
    one object may lie in several byte ranges. What stands between two objects is read as part of
    the second, which is then no JSON; after the last one it is a body of its own unless it is
    blank. Files are read in the order of their paths, uncompressed.
    """
    pieces = _pieces(spark, path)
    inside = Window.partitionBy(*_RANGE).orderBy("_place")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def step(start: int) -> Column:
        """What the piece adds to the depth if its range begins outside (0) or inside of a string."""
        state = (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) + start) % 2
        closes = F.when((state + F.col("_quotes")) % 2 == 0, 1).otherwise(0)
        return F.when(state == 0, F.col("_open0")).otherwise(F.col("_open1")) - closes

    # All sums are over what the pieces do; their texts stay where they were written.
    steps = pieces.drop("value").withColumns({"_step0": step(0), "_step1": step(1)})
    depths = steps.withColumns({f"_depth{s}": F.sum(f"_step{s}").over(so_far) for s in (0, 1)})
    depths = stage(depths.drop("_step0", "_step1", "_open0", "_open1"), "depths")
    last = [F.max_by(f"_depth{s}", "_place").alias(f"_end{s}") for s in (0, 1)]
    lowest = [F.min(f"_depth{s}").alias(f"_low{s}") for s in (0, 1)]
    ranges = depths.groupBy(*_RANGE).agg(
        F.sum("_quotes").alias("_quotes"), *last, *lowest, F.sum("_bytes").alias("_bytes")
    )
    # The ranges of a file, in its order: how each one begins.
    file = Window.partitionBy("_file")
    earlier = file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_in", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    for name in ("_end", "_low"):
        ranges = ranges.withColumn(name, F.when(F.col("_in") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    ranges = ranges.withColumn("_from", F.coalesce(F.sum("_end").over(earlier), F.lit(0)))
    ranges = ranges.select(
        *_RANGE, "_in", "_from",
        F.least(F.lit(0), F.min(F.col("_low") + F.col("_from")).over(earlier)).alias("_lowest"),
        F.sum("_bytes").over(file).alias("_bytes"),
        F.max("_block").over(file).alias("_last_block"),
    )
    placed = depths.drop("_bytes").join(ranges, list(_RANGE))
    depth = F.col("_from") + F.when(F.col("_in") == 0, F.col("_depth0")).otherwise(F.col("_depth1"))
    placed = placed.withColumn("_depth", depth)
    low_before = F.least("_lowest", F.coalesce(F.min("_depth").over(before), F.lit(0)))
    outside = (F.col("_in") + F.sum("_quotes").over(so_far)) % 2 == 0
    # The reader drops the brace that ends a piece. Only the last piece of a file may have none.
    last_piece = (F.col("_block") == F.col("_last_block")) & (
        F.col("_place") == F.max("_place").over(Window.partitionBy(*_RANGE))
    )
    closed = ~(last_piece & (F.col("_bytes") > F.col("_size")))
    ended = stage(
        placed.select(
            *_RANGE, "_place", "_blank", closed.alias("_closed"),
            (closed & outside & (F.col("_depth") <= low_before)).alias("_ends"),
        ),
        "ends",
    )
    counts = ended.groupBy(*_RANGE).agg(F.count_if("_ends").alias("_n"))
    counts = counts.select(*_RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    number = F.col("_first") + F.coalesce(F.count_if("_ends").over(before), F.lit(0))
    numbered = ended.join(counts, list(_RANGE)).select("_file", number.alias("_number"), "_place", "_closed", "_blank")
    numbered = stage(numbered, "numbers")
    # A blank without a brace is nothing: the end of a file.
    bodies = numbered.groupBy("_file", "_number").agg(
        F.count("*").alias("_parts"), F.bool_or(F.col("_closed") | ~F.col("_blank")).alias("_given")
    )
    bodies = assign_ids(bodies.where("_given").drop("_given"), "submission_id", ["_file", "_number"])
    placed = numbered.join(bodies, ["_file", "_number"]).select("submission_id", "_parts", "_place", "_closed")
    placed = stage(placed, "places")
    # The texts meet their numbers once. Only those of several pieces are put together.
    texts = pieces.select("_place", "_block", "value").join(placed, "_place")
    text = F.concat("value", F.when(F.col("_closed"), "}").otherwise(""))
    texts = texts.select("submission_id", "_parts", "_block", "_place", text.alias("value"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_place", "value")))["value"]
    joined = texts.where("_parts > 1").groupBy("submission_id").agg(F.array_join(parts, "").alias("body"))
    whole = texts.where("_parts = 1").select("submission_id", F.col("value").alias("body"))
    return whole.unionByName(joined).withColumn("body", F.regexp_replace("body", _BLANKS, ""))
