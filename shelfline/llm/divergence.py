"""How the sources of a language differ in their use of words.

Every kept term is a row of its nonzero counts in the order of the sources. These rows make a
frequent-pattern tree: rows that begin with the same counts of the same sources share a path, equal
rows are one path with a multiplicity. Two sources differ by a constant in a term that neither
uses; each further difference is a correction, by source where one of them uses the term, and by
pair of a node and an ancestor where both do, once however many terms run through them.

Spark sorts the rows by the beginnings of their items over range partitions, and by all of them within. In that order a tree is walked with
one path in memory; a path that a partition border cuts is two paths with the same sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stage

# A term is a run of A-Z, a-z and characters beyond ASCII, A-Z in lower case: in UTF-8 a run of
# bytes that this table does not make blanks.
_SPLIT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
# How shares are counted.
SCALE = 1_000_000_000
ADDED = 5
LEAST_DOCS = 30
TOP_TERMS = 50

# Terms, by language and source, that a task counts before it emits them.
HELD_TERMS = 500_000
# Items of a path by which partitions are cut.
BEGINNING = 8
# Corrections a task holds before it adds up those of the same pair, and before it emits them.
HELD = 1 << 20
_CORRECTIONS = "lang string, a string, b string, value long"


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact; 0 if no term is kept."""
    above = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {ADDED} AS DECIMAL(19, 0))"
    below = f"CAST({total} + {ADDED} * {kept} AS DECIMAL(19, 0))"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1L + ({above}) div {below} ELSE 0L END")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences and documents of a task's rows, in parts of a
    bounded number of terms."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part)),
                        pa.array([source] * len(part)),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([d[t] for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "d"],
                )
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(
            batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts
        ):
            found = text.as_py().translate(_SPLIT).split()
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(found)
            d.update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from counts()
    yield from counts()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, items) of the terms in at least so many documents of a language.

    `items` are (source, n) with n > 0, sources ascending: no longer than the language has
    sources. Documents count each of their terms once, occurrences all; tasks combine both
    before the shuffle. `docs` holds text, lang and source without nulls.
    """
    counts = (
        docs.select("text", "lang", "source")
        .mapInArrow(_counted, "lang string, source string, term string, n long, d long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    )
    items = F.sort_array(F.collect_list(F.struct("source", "n")))
    rows = counts.groupBy("lang", "term").agg(
        F.sum("d").alias("_docs"), F.sum("n").alias("total"), items.alias("items")
    )
    return rows.filter(F.col("_docs") >= least_docs).drop("_docs")


class _Walk:
    """One path of the tree at a time, over rows sorted by language and items."""

    def __init__(self) -> None:
        self.lang: str | None = None
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.path = np.zeros((4, 16), np.int64)  # source, count, share, share of count 0
        self.copies: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_found = 0

    def _leave(self, depth: int) -> None:
        """Close the nodes below `depth`: their multiplicities are known now."""
        while len(self.copies) > depth:
            copies = self.copies.pop()
            d = len(self.copies)
            if not d:
                return
            self.copies[-1] += copies
            source, _, share, zero = self.path[:, d]
            above, shares, zeros = self.path[0, :d], self.path[2, :d], self.path[3, :d]
            both = np.abs(shares - share) - np.abs(shares - zero) - np.abs(zeros - share)
            # Sources ascend along a path, so an ancestor's is the first of the pair.
            pair = self._order(above, source)
            self.found.append((pair, copies * (both + np.abs(zeros - zero))))
            self.n_found += d
            if self.n_found >= HELD:
                self._add_up()

    @staticmethod
    def _order(above: np.ndarray, source: int) -> np.ndarray:
        return (above << 32) | source

    def _add_up(self) -> None:
        pairs, where = np.unique(np.concatenate([p for p, _ in self.found]), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, where, np.concatenate([v for _, v in self.found]))
        self.found, self.n_found = [(pairs, sums)], len(pairs)

    def _emit(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._add_up()
            pairs, sums = self.found[0]
            names = pa.array(list(self.ids), pa.string())
            for at in range(0, len(pairs), 10_000):
                part = pairs[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([self.lang] * len(part), pa.string()),
                        names.take(pa.array(part >> 32)),
                        names.take(pa.array(part & 0xFFFFFFFF)),
                        pa.array(sums[at : at + 10_000]),
                    ],
                    names=["lang", "a", "b", "value"],
                )
            self.found, self.n_found = [], 0

    def insert(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("items")
        inner = lists.flatten()
        starts = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
        # A struct's field by `flatten` keeps the slice; the items are never null.
        fields = dict(zip([f.name for f in inner.type], inner.flatten()))
        codes = fields["source"].dictionary_encode()
        local, names = np.asarray(codes.indices), codes.dictionary.to_pylist()
        n, share, zero = (np.asarray(fields[k]) for k in ("n", "share", "zero"))
        for row, (lang, copies) in enumerate(
            zip(batch.column("lang").to_pylist(), batch.column("copies").to_pylist())
        ):
            if lang != self.lang:
                yield from self.finish()
                self.lang = lang
            at = slice(starts[row], starts[row + 1])
            size = at.stop - at.start
            sources = np.array([self.ids.setdefault(names[i], len(self.ids)) for i in local[at]], np.int64)
            if size > self.path.shape[1]:
                self.path = np.pad(self.path, ((0, 0), (0, size)))
            most = min(size, len(self.copies))
            differs = (self.path[0, :most] != sources[:most]) | (self.path[1, :most] != n[at][:most])
            shared = int(differs.argmax()) if differs.any() else most
            self._leave(shared)
            self.path[:, shared:size] = np.stack([sources, n[at], share[at], zero[at]])[:, shared:]
            self.copies += [0] * (size - shared)
            self.copies[-1] += copies
            if self.n_found >= HELD // 2:
                yield from self._emit()

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._leave(0)
        yield from self._emit()
        self._clear()


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk()
    for batch in batches:
        yield from walk.insert(batch)
    yield from walk.finish()


def tree_corrections(valued: DataFrame) -> DataFrame:
    """(lang, a, b, value): what terms used by both sources add to their difference, a < b.

    `valued` holds (lang, term, source, n, share, zero) for every count above 0.
    """
    items = F.sort_array(F.collect_list(F.struct("source", "n", "share", "zero")))
    rows = valued.groupBy("lang", "term").agg(items.alias("items"))
    paths = rows.groupBy("lang", "items").agg(F.count("*").alias("copies"))
    first = F.slice("items", 1, BEGINNING)
    beginning = F.array_join(F.transform(first, lambda i: F.concat(i["source"], F.lit(":"), i["n"])), ",")
    # Partitions are cut between beginnings of paths, which are short enough to sample.
    ordered = paths.withColumn("_at", beginning).repartitionByRange("lang", "_at")
    ordered = ordered.sortWithinPartitions("lang", "_at", "items")
    walked = ordered.select("lang", "items", "copies").mapInArrow(_walked, _CORRECTIONS)
    return walked.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _one_sided(valued: DataFrame, directed: DataFrame) -> DataFrame:
    """(lang, source, item, value): what the terms of `source` add where `item` has none of them.

    The sum of abs(share - z) over the terms of a source comes, for all z at once, from running
    sums over its distinct shares.
    """
    points = valued.groupBy("lang", "source", F.col("share").alias("at")).agg(F.count("*").alias("m"))
    asked = directed.select("lang", "source", "item", F.col("item_zero").alias("at"), "gap")
    every = Window.partitionBy("lang", "source")
    below = every.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m, weighed = F.coalesce("m", F.lit(0)), F.coalesce(F.col("m") * F.col("at"), F.lit(0))
    sums = points.unionByName(asked, allowMissingColumns=True).select(
        "lang", "source", "item", "at", "gap",
        F.sum(m).over(below).alias("_b0"), F.sum(weighed).over(below).alias("_b1"),
        F.sum(m).over(every).alias("_t0"), F.sum(weighed).over(every).alias("_t1"),
    )
    value = F.expr("_t1 - at * _t0 - 2 * _b1 + 2 * at * _b0 - gap * _t0")
    return sums.filter("gap IS NOT NULL").select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for each source of each language.

    Null text, lang or source count as ''. Part `pair`: for each other source of the language the
    sum over its kept terms of the difference of shares, all ranks. Part `term`: the terms that
    the source uses more than its language, by difference, to rank `top_terms`. Ties by item,
    ascending by bytes. A source without kept terms has shares of count 0, a language that keeps
    none has differences of 0. Columns beyond text, lang and source are not read.
    """
    texts = docs.select(*[F.coalesce(name, F.lit("")).alias(name) for name in ("text", "lang", "source")])
    kept = stage(kept_terms(texts, least_docs), "kept-terms")
    items = kept.select("lang", "term", "total", F.explode("items").alias("_i")).select(
        "lang", "term", "total", "_i.*"
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    uses = items.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    sources = texts.select("lang", "source").distinct().join(uses, ["lang", "source"], "left")
    sized = sources.join(langs, "lang", "left").na.fill(0, ["used", "kept", "lang_total"])
    groups = stage(sized.withColumn("zero", _share("0L", "used", "kept")), "groups")
    valued = stage(
        items.join(groups, ["lang", "source"]).select(
            "lang", "term", "source", "n", "zero",
            _share("n", "used", "kept").alias("share"),
            _share("total", "lang_total", "kept").alias("lang_share"),
        ),
        "valued-terms",
    )
    terms = valued.filter("share > lang_share").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("share") - F.col("lang_share")).alias("value"),
    )
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    directed = groups.join(other, "lang").filter("source <> item").withColumn(
        "gap", F.abs(F.col("zero") - F.col("item_zero"))
    )
    first, second = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    constant = directed.filter("source < item").select(
        "lang", first, second, (F.col("kept") * F.col("gap")).alias("value")
    )
    single = _one_sided(valued, directed).select("lang", first, second, "value")
    sums = (
        constant.unionByName(single)
        .unionByName(tree_corrections(valued))
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    both_ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    pairs = sums.select("lang", F.explode(both_ways).alias("_p"), "value").select(
        "lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value"
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    top = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
