"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and
numbered, so that equal blocks and only they have one name. Adjacent names are then paired and
the pairs named in the same way, until one name is left for each document: two documents of
equally many blocks have the same last name exactly if all their bytes are the same.

Block contents travel once, combined before the shuffle. Occurrences look their names up by a
128-bit fingerprint; that no two blocks share one is checked on the sorted blocks themselves,
and another seed is taken if they do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import ascii_lower, first_of
from shelfline.session import stage

BLOCK_BYTES = 2048

Fingerprint = Callable[[Column, int], list[Column]]


def fingerprint(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(block, F.lit(2 * seed)), F.xxhash64(F.lit(2 * seed + 1), block)]


def name_documents(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Fingerprint = fingerprint,
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_sha256, and n_blocks, name, which together are
    equal for equal texts and for no others; _row tells the rows apart.

    Texts are compared after lower-casing A-Z; null counts as empty. Other columns of `docs`
    are not read. An empty frame gives an empty frame.
    """
    contents = docs.select(
        F.col(doc_id).alias("doc_id"), F.encode(ascii_lower(F.col(text)), "utf-8").alias("_bytes")
    ).select(
        "doc_id",
        F.sha2("_bytes", 256).alias("text_sha256"),
        F.expr(
            f"transform(sequence(0, greatest(octet_length(_bytes) - 1, 0) div {block_bytes}),"
            f" i -> substring(_bytes, int(i * {block_bytes} + 1), {block_bytes}))"
        ).alias("_blocks"),
    )
    seed = 0
    while True:
        keys = ["_h1", "_h2"]
        # No list is empty. A plain explode() would test that first, and cut all texts twice.
        blocks = contents.select(F.explode_outer("_blocks").alias("_block")).select(
            *[c.alias(k) for k, c in zip(keys, fingerprint(F.col("_block"), seed))], "_block"
        )
        names = stage(_numbered(blocks, [*keys, "_block"], ["_block"], keys), "block-names")
        if names.groupBy(*keys).count().filter("count > 1").isEmpty():
            break
        seed += 1
    marks = F.transform(
        "_blocks", lambda b: F.struct(*[c.alias(k) for k, c in zip(keys, fingerprint(b, seed))])
    )
    rows = stage(
        contents.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "text_sha256",
            F.size("_blocks").alias("n_blocks"),
            marks.alias("_marks"),
        ),
        "block-rows",
    )
    placed = rows.select("_row", F.posexplode("_marks").alias("_pos", "_mark")).select(
        "_row", "_pos", "_mark.*"
    )
    state = stage(_gathered(placed.join(names, keys)), "names")
    finished = _single(state)
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    for _ in range((longest - 1).bit_length()):
        pairs = state.filter(F.size("_names") > 1).select(
            "_row",
            F.posexplode(
                F.expr(
                    "transform(sequence(0, (size(_names) - 1) div 2), i -> struct("
                    "_names[int(2 * i)] AS _a, coalesce(get(_names, int(2 * i + 1)), -1L) AS _b))"
                )
            ).alias("_pos", "_pair"),
        ).select("_row", "_pos", "_pair.*")
        names = stage(_numbered(pairs, ["_a", "_b"], ["_a", "_b"], ["_a", "_b"]), "pair-names")
        state = stage(_gathered(pairs.join(names, ["_a", "_b"])), "names")
        finished = finished.unionByName(_single(state))
    return rows.drop("_marks").join(finished, "_row")


def _numbered(df: DataFrame, by: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """The distinct rows, sorted and numbered."""
    return (
        df.select(*by)
        .distinct()
        .sortWithinPartitions(*order)
        .select(*kept, F.monotonically_increasing_id().alias("name"))
    )


def _gathered(named: DataFrame) -> DataFrame:
    """A document's names in their order. The list is no longer than the document."""
    listed = F.array_sort(F.collect_list(F.struct("_pos", "name")))
    return named.groupBy("_row").agg(listed["name"].alias("_names"))


def _single(state: DataFrame) -> DataFrame:
    return state.filter(F.size("_names") == 1).select("_row", F.col("_names")[0].alias("name"))


def exact_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Fingerprint = fingerprint,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Of equal texts the row with the largest doc_id stays; a null id is smaller than any other,
    and of repeated ids exactly one row stays.
    """
    named = name_documents(docs, text, doc_id, block_bytes, fingerprint)
    groups = named.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size")
    )
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    The texts meet the ids that stay in one join. Only where an id that stays is that of several
    equal texts, these rows are numbered to keep one.
    """
    found = stage(exact_duplicates(docs, text, doc_id), "exact-duplicates")
    same = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = same.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(
        F.count("*").alias("_n")
    )
    twice = stage(kept.filter("_n > 1"), "twice")
    sha = F.sha2(F.encode(ascii_lower(docs[text]), "utf-8"), 256)
    keyed = docs.withColumn("_sha256", sha)
    match = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_sha256") == F.col("_sha"))
    once = keyed.join(kept.filter("_n = 1"), match, "left_semi")
    if twice.isEmpty():
        return once.select(*docs.columns)
    repeated = first_of(keyed.join(twice, match, "left_semi"), [doc_id, "_sha256"])
    return once.unionByName(repeated).select(*docs.columns)
