"""A Merkle manifest of a dataset: one digest tree per source, and one over the sources.

Rows are ranked within their source, and the base-16 digits of the rank are grouped away one
after the other, each time nesting the nodes below as structs. That happens within blocks of
FANOUT ** LEVELS consecutive nodes, so no row grows with the data: three groupings share one
shuffle, and the roots of the blocks are the leaves of the next, much smaller tier, until every
source has one node. The sources' roots go through the same tiers.

On the way back each block takes apart its own nested node: a transform adds to every child the
digests beside it, an explode hands them down with the path above. Blocks and the paths above
them meet as two rows of one group, so no proof needs a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import split_place
from shelfline.session import stage

# The shape of the tree that digests stand for.
BITS = 4
FANOUT = 1 << BITS
# Levels of a block: with three, a row nests at most 4096 nodes, below a megabyte.
LEVELS = 3
SHA = 256

_STEP = "struct<before: string, after: string>"


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and its text; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), SHA)


def ranked(df: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """The rows with their `_rank` from 0 within `group` in the given order, and the size of the
    largest group.

    Rows are range partitioned by group and order, sorted and written with their places. A group
    that begins inside a partition is counted there; only the one that a partition begins with
    may continue, so the driver needs two counts of each partition, however many groups there
    are and however large they are. Nulls come first.
    """
    keys = [F.col(name).asc_nulls_first() for name in (group, *order)]
    part, row = split_place("_at")
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(
        sorted_rows.withColumn("_at", F.monotonically_increasing_id()).select(
            *df.columns, part.alias("_part"), row.alias("_row")
        ),
        "ranks",
    )
    runs = placed.groupBy("_part", group).agg(
        F.min("_row").alias("first"), F.count("*").alias("n")
    )
    run = F.struct("first", "n", F.col(group).alias("group"))
    edges = runs.groupBy("_part").agg(F.min(run).alias("head"), F.max(run).alias("tail"), F.max("n").alias("most"))
    starts, largest, carried, last = [], 0, 0, None
    for found in sorted(edges.collect(), key=lambda r: r["_part"]):
        head, tail = found["head"], found["tail"]
        start = carried if last is not None and last["group"] == head["group"] else 0
        starts.append((found["_part"], start))
        carried = tail["n"] + (start if tail["first"] == 0 else 0)
        last = tail
        largest = max(largest, found["most"], start + head["n"], carried)
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    place = F.row_number().over(Window.partitionBy("_part", group).orderBy("_row")) - 1
    begins = F.col("_row") == F.col("_place")
    rank = F.col("_place") + F.when(begins, F.col("_start")).otherwise(0)
    return (
        placed.withColumn("_place", place.cast("long"))
        .join(F.broadcast(offsets), "_part")  # a row for each partition
        .select(*df.columns, rank.alias("_rank")),
        largest,
    )


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """(g, block, node): the nodes (g, _rank, digest, load) of each block as one nested struct.

    A node that is the only one of its level in its group is handed on instead of being hashed.
    Ranks are consecutive, so that is seen in the block: it is the first and has one child.
    """
    digits = [F.shiftright("_rank", BITS * i).bitwiseAND(FANOUT - 1).alias(f"_d{i}") for i in range(LEVELS)]
    rows = nodes.select(
        "g", F.shiftright("_rank", BITS * LEVELS).alias("block"), *digits, "digest", "load"
    ).select(
        "g", "block", *[f"_d{i}" for i in range(1, LEVELS)],
        F.struct(F.col("_d0").alias("at"), "digest", "load").alias("_kid"),
    ).repartition("g", "block")
    for level in range(1, LEVELS + 1):
        left = [f"_d{i}" for i in range(level, LEVELS)]
        kids = F.sort_array(F.collect_list("_kid"))
        grouped = rows.groupBy("g", "block", *left).agg(kids.alias("_kids"))
        first = F.lit(True)
        for name in ("block", *left):
            first = first & (F.col(name) == 0)
        alone = first & (F.size("_kids") == 1)
        digests = F.col("_kids")["digest"]
        digest = F.when(alone, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), SHA))
        at = F.col(left[0]) if left else F.lit(0).cast("long")
        node = F.struct(at.alias("at"), digest.alias("digest"), alone.alias("alone"), F.col("_kids").alias("kids"))
        rows = grouped.select("g", "block", *left[1:], node.alias("_kid"))
    return rows.withColumnRenamed("_kid", "node")


def _taken_apart(blocks: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(g, digest, load, path, carried) of each node that the blocks (g, block, node, path) nest.

    The path lists, from the node upwards, the digests before and after it in each run.
    """
    digests = F.col("node")["kids"]["digest"]

    def beside(kid: Column, i: Column) -> Column:
        step = F.struct(
            F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"),
            F.array_join(F.slice(digests, i + 2, F.lit(FANOUT)), "").alias("after"),
        )
        return F.struct(kid.alias("node"), step.alias("step"))

    rows = blocks.select("g", "node", "path", *carried)
    for _ in range(LEVELS):
        kids = F.transform(F.col("node")["kids"], beside)
        rows = rows.select(
            "g", F.col("node")["alone"].alias("_alone"), "path", *carried, F.explode_outer(kids).alias("_kid")
        ).select(
            "g",
            F.col("_kid.node").alias("node"),
            F.when(F.col("_alone"), F.col("path"))
            .otherwise(F.concat(F.array("_kid.step"), F.col("path")))
            .alias("path"),
            *carried,
        )
    return rows.select("g", "node.digest", "node.load", "path", *carried)


def _tiers(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Staged blocks, tier by tier, until every group is one block."""
    tiers = []
    span = FANOUT**LEVELS
    while True:
        tiers.append(stage(_rolled_up(nodes), "merkle-blocks"))
        if largest <= span:
            return tiers
        largest = -(-largest // span)
        nodes = tiers[-1].select(
            "g", F.col("block").alias("_rank"), "node.digest", F.struct("block").alias("load")
        )


def _with_paths(blocks: DataFrame, paths: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Blocks with the path above them: two rows of one group, no join."""
    both = blocks.unionByName(paths, allowMissingColumns=True).groupBy("g", "block")
    return both.agg(*[F.first(name, ignorenulls=True).alias(name) for name in ("node", "path", *carried)])


def manifest(
    leaves: DataFrame, group: str = "source", order: Sequence[str] = ("doc_id", "leaf"), leaf: str = "leaf"
) -> DataFrame:
    """The rows of `leaves` with subroot, root and path.

    `leaves` holds a digest for each row; within `group` they ascend by `order`, nulls first, and
    equal rows in any order, which changes no digest where the order ends with the leaf. The
    groups ascend bytewise, null first. `path` lists for each level, from the leaf up to the
    root, the digests `before` and `after` in its run; a level where the row's node stands alone
    has no step. Columns of any name may be in `leaves`. No rows give no rows.
    """
    loaded = leaves.select(
        F.col(group).alias("g"),
        *[F.col(name).alias(f"_o{i}") for i, name in enumerate(order)],
        F.col(leaf).alias("digest"),
        F.struct(*leaves.columns).alias("load"),
    )
    rows, largest = ranked(loaded, "g", [f"_o{i}" for i in range(len(order))])
    tiers = _tiers(rows.select("g", "_rank", "digest", "load"), largest)
    subroots = tiers[-1].select(
        F.lit(0).alias("g"), F.col("g").alias("_o0"), "node.digest", F.struct("g").alias("load")
    )
    groups, n_groups = ranked(subroots, "g", ["_o0"])
    over = _tiers(groups.select("g", "_rank", "digest", "load"), n_groups)
    no_path = F.array().cast(f"array<{_STEP}>")
    top = over[-1].withColumns({"path": no_path, "root": F.col("node.digest")})
    for tier in (*over[-2::-1], None):
        paths = _taken_apart(top, ["root"])
        if tier is not None:
            down = paths.select("g", "load.block", "path", "root")
            top = _with_paths(tier, down, ["root"])
    of_groups = paths.select(
        F.col("load.g").alias("g"), F.lit(0).cast("long").alias("block"), "path",
        F.col("digest").alias("subroot"), "root",
    )
    for tier in tiers[::-1]:
        blocks = _with_paths(tier, of_groups, ["subroot", "root"])
        paths = _taken_apart(blocks, ["subroot", "root"])
        if tier is not tiers[0]:
            of_groups = paths.select("g", "load.block", "path", "subroot", "root")
    return paths.select("load.*", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf to the root, left to right."""
    beside = F.transform(path, lambda s: F.concat(s["before"], s["after"]))
    return F.sha2(F.array_join(beside, ""), SHA)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), SHA)
    )
