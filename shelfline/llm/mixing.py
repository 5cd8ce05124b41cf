"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents should have.
The whole part is given to all of them; the fraction is a probability that has to become 0 or 1
for each document while the source's words stay where they are:

* Documents of at least 1/256 of their source (so at most 256 of them) come first, largest
  first. Each is paired with all that is left of its source, which shares one fraction: words
  move at random from one to the other, with chances that keep every expectation, until one of
  the two is integral.
* The others are paired in the same way within groups of about 48. Each group leaves at most one
  fraction, and these meet in groups again, level by level, until a source has one left at most,
  which a last draw decides.

So a source misses its target by about the size of one of its small documents. No group, no
level and no task holds more than a bounded number of documents of one source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import unit_uniform, word_count
from shelfline.operators.identifiers import assign_ids
from shelfline.session import stage

MOST_COPIES = 3.0
GROUP = 48
HEAVY = 256
_EPSILON = 1e-9
_CHUNK = 1 << 16

_KEY = ["doc_id", "source", "size", "text_hash"]


def source_targets(units: DataFrame) -> DataFrame:
    """source, source_size, target of a frame with source, size and n (rows like it).

    Sources in the order of their code points, null last, weigh 1, 2, 3, 1, ... and share all
    words by weight. A target stops at three times its source's size and the excess is shared
    again by weight, until none is above. Only sums reach the driver.
    """
    by_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("n") == 1, F.col("size"))).alias("single_size"),
    )
    ranked = assign_ids(
        by_source.withColumn("_absent", F.col("source").isNull()), "_rank", ["_absent", "source"]
    )
    weight = F.pmod(F.col("_rank") - 1, F.lit(3)) + 1
    weighed = stage(
        ranked.select("source", "source_size", "single_size", weight.alias("weight")), "sources"
    )
    # A source is full where its share, `level` words for each unit of weight, passes its limit.
    limit, level, full = F.col("source_size") * MOST_COPIES, 0.0, None
    while True:
        is_full = F.col("weight") * F.lit(level) > limit
        total, kept, weights, count = weighed.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(is_full, limit)), F.lit(0.0)),
            F.sum(F.when(~is_full, F.col("weight"))),
            F.count(F.when(is_full, 1)),
        ).first()
        if count == full or not weights:
            break
        full, level = count, (float(total) - kept) / weights
    return weighed.select(
        "source",
        "source_size",
        "single_size",
        F.least(limit, F.col("weight") * F.lit(level)).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, text_hash, copies, taken for every row.

    size counts words, and a null text has none. copies is how often the mix takes the row;
    taken is copies * size. Rows that are the same in id, source and text are interchangeable.
    Documents without words get their source's copies too, the fraction by a draw for each; of a
    source without any words none is taken. The draws depend on `seed` and the
    rows' values only, so that a rerun gives the same rows. Other columns are not read. An empty
    frame gives an empty frame.
    """
    return _repeated(_decided(docs, text, doc_id, source, seed))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    decided = _decided(docs, "text", "doc_id", "source", seed)
    decided = decided.select(*[F.col(c).alias(f"_{c}") for c in (*_KEY, "n", "base", "extra")])
    decided = stage(decided, "decided")
    keyed = docs.withColumn("_hash", _text_hash(F.col("text")))
    match = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_hash") == F.col("_text_hash"))
    )
    taken = decided.filter("_n = 1 AND _base + _extra > 0")
    mixed = keyed.join(taken, match).withColumn("_copies", F.col("_base") + F.col("_extra"))
    several = decided.filter("_n > 1")
    if not several.isEmpty():
        # Rows that repeat are numbered to tell which of them get one more copy.
        by = ["_doc_id", "_source", "_text_hash"]
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*by))
        repeated = keyed.join(several, match).withColumn(
            "_copies", F.col("_base") + (place <= F.col("_extra")).cast("int")
        )
        mixed = mixed.unionByName(repeated.filter("_copies > 0"))
    return mixed.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    ).select(*docs.columns)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _decided(docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    """One row for equal rows: base copies for each of the n, one more for `extra` of them."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        _text_hash(F.col(text)).alias("text_hash"),
    )
    units = stage(rows.groupBy(*_KEY).agg(F.count("*").alias("n")), "units")
    targets = stage(source_targets(units), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + _EPSILON)
    expected = F.col("n") * F.greatest(F.col("_rate") - F.col("base"), F.lit(0.0))
    units = (
        units.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_rate", rate)
        .withColumn("base", base)
        .withColumn("_expected", expected)
        .withColumn("extra", F.floor(F.col("_expected") + _EPSILON))
        .withColumn("f", F.greatest(F.col("_expected") - F.col("extra"), F.lit(0.0)))
        .withColumn("u", unit_uniform(F.lit(seed), *_KEY))
        .drop("_rate", "_expected")
    )
    # Rows without words weigh nothing in a pair: each is drawn by its own fraction.
    drawn = (F.col("size") == 0) & (F.col("u") < F.col("f"))
    units = units.withColumn("extra", F.col("extra") + drawn.cast("int"))
    open_ = (F.col("f") > _EPSILON) & (F.col("size") > 0)
    columns = [*_KEY, "source_size", "target", "n", "base", "extra"]
    settled = [units.filter(~open_).select(*columns)]
    units = units.filter(open_)
    heavy = (F.col("n") == 1) & (F.col("size") * HEAVY >= F.col("source_size"))

    first = stage(_settle_heavy(units.filter(heavy)), "heavy")
    settled.append(first.select(F.explode("done").alias("_d")).select("_d.*").select(*columns))
    shared = first.select(F.col("source").alias("_source"), F.col("left_f"))
    light = (
        units.filter(~heavy)
        .join(shared, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("f", F.when(F.col("n") == 1, F.coalesce("left_f", "f")).otherwise(F.col("f")))
        .drop("_source", "left_f")
    )
    light = light.withColumn("_x", F.when(F.col("f") <= _EPSILON, 0).when(F.col("f") >= 1 - _EPSILON, 1))
    light = stage(light, "light")
    done = light.filter("_x IS NOT NULL").withColumn("extra", F.col("extra") + F.col("_x"))
    settled.append(done.select(*columns))
    light = light.filter("_x IS NULL").drop("_x")
    counts = light.groupBy(F.col("source").alias("_source")).agg(
        F.ceil(F.count("*") / GROUP).alias("_groups")
    )
    light = light.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    most = counts.agg(F.max("_groups")).first()[0] or 0
    level = 0
    while most:
        pairs = stage(_settle_pairs(light, seed, level), "pairs")
        settled.append(pairs.select(F.explode("done").alias("_d")).select("_d.*").select(*columns))
        light = (
            pairs.filter("left IS NOT NULL")
            .select("left.*", F.ceil(F.col("_groups") / GROUP).alias("_groups"))
        )
        most = 0 if most == 1 else -(-most // GROUP)
        level += 1
    return reduce(DataFrame.unionByName, settled)


def _settle_heavy(units: DataFrame) -> DataFrame:
    """For each source: its large documents, settled, and the fraction the others have then."""
    fields = [c for c in units.columns if c != "single_size"]
    grouped = units.groupBy("source", "single_size").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("size")).alias("_order"), "u", *[c for c in fields if c != "u"]))
        ).alias("items")
    )
    items = F.col("items")
    state = F.struct(
        items[0]["f"].alias("f"),
        F.col("single_size").cast("double").alias("words"),
        F.array().cast("array<int>").alias("xs"),
    )

    def step(acc: Column, item: Column) -> Column:
        p, s, u = acc["f"], item["size"].cast("double"), item["u"]
        rest = acc["words"] - s
        up, down = F.least(1 - p, p * rest / s), F.least(p, (1 - p) * rest / s)
        rises = u * (up + down) < down
        # What the item has when it stops, and what all others have.
        own = F.when(rises, p + up).otherwise(p - down)
        others = F.when(rises, p - up * s / rest).otherwise(p + down * s / rest)
        decided = (p <= _EPSILON) | (p >= 1 - _EPSILON) | (rest <= 0)
        own = F.when(decided, p).otherwise(own)
        others = F.when(decided, p).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), others)))
        again = unit_uniform(u, F.lit("last"))
        x = F.when(own >= 1 - _EPSILON, 1).when(own <= _EPSILON, 0).otherwise((again < own).cast("int"))
        return F.struct(others.alias("f"), rest.alias("words"), F.concat(acc["xs"], F.array(x)).alias("xs"))

    folded = grouped.withColumn("_end", F.aggregate("items", state, step))
    done = F.transform(
        F.arrays_zip(items.alias("i"), F.col("_end.xs").alias("x")),
        lambda t: t["i"].withField("extra", t["i"]["extra"] + t["x"]),
    )
    return folded.select("source", F.col("_end.f").alias("left_f"), done.alias("done"))


def _settle_pairs(units: DataFrame, seed: int, level: int) -> DataFrame:
    """For each group of a source: those that are settled, and the one that is left, if any.

    A group that is alone in its source leaves none: a draw decides the last fraction.
    """
    fields = [c for c in units.columns if c not in ("u", "_groups")]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *_KEY), F.col("_groups"))
    fresh = unit_uniform(F.col("u"), F.lit(level)).alias("u")
    grouped = (
        units.withColumn("_bucket", bucket)
        .groupBy("source", "_groups", "_bucket")
        .agg(F.array_sort(F.collect_list(F.struct(fresh, *fields))).alias("items"))
    )
    items = F.col("items")
    state = F.struct(
        F.lit(-1).alias("k"),
        F.lit(0.0).alias("f"),
        F.array().cast("array<struct<k:int,x:int>>").alias("done"),
    )

    def settle(done: Column, k: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.struct(k.cast("int").alias("k"), x.cast("int").alias("x"))))

    def step(acc: Column, i: Column) -> Column:
        item, held = items[i], items[F.greatest(acc["k"], F.lit(0))]
        f, g, u = acc["f"], item["f"], item["u"]
        ratio = item["size"] / held["size"]
        up, down = F.least(1 - f, g * ratio), F.least(f, (1 - g) * ratio)
        rises = u * (up + down) < down
        held_f = F.when(rises, f + up).otherwise(f - down)
        item_f = F.when(rises, g - up / ratio).otherwise(g + down / ratio)
        held_stops = F.when(rises, 1 - f <= g * ratio).otherwise(f <= (1 - g) * ratio)
        done = settle(
            acc["done"],
            F.when(held_stops, acc["k"]).otherwise(i),
            F.when(held_stops == rises, 1).otherwise(0),
        )
        k = F.when(held_stops, i).otherwise(acc["k"])
        left = F.when(held_stops, item_f).otherwise(held_f)
        whole = (left <= _EPSILON) | (left >= 1 - _EPSILON)
        met = F.struct(
            F.when(whole, -1).otherwise(k).alias("k"),
            left.alias("f"),
            F.when(whole, settle(done, k, F.round(left))).otherwise(done).alias("done"),
        )
        alone = F.struct(i.alias("k"), g.alias("f"), acc["done"].alias("done"))
        return F.when(acc["k"] < 0, alone).otherwise(met)

    folded = grouped.withColumn(
        "_end", F.aggregate(F.sequence(F.lit(0), F.size("items") - 1), state, step)
    )
    end = F.col("_end")
    last = items[F.greatest(end["k"], F.lit(0))].withField("f", end["f"])
    drawn = (unit_uniform(last["u"], F.lit("last")) < end["f"]).cast("int")
    ends = (end["k"] >= 0) & (F.col("_groups") == 1)
    settled = F.when(ends, settle(end["done"], end["k"], drawn)).otherwise(end["done"])
    done = F.transform(
        settled, lambda t: items[t["k"]].withField("extra", items[t["k"]]["extra"] + t["x"])
    )
    return folded.select(
        "_groups",
        done.alias("done"),
        F.when((end["k"] >= 0) & (F.col("_groups") > 1), last).alias("left"),
    )


def _repeated(decided: DataFrame) -> DataFrame:
    """As many rows as were read, in chunks so that no list grows with their number."""
    n = F.col("n")
    start = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK))).alias("_chunk")
    place = F.explode(
        F.sequence(
            F.col("_chunk") * _CHUNK + 1, F.least((F.col("_chunk") + 1) * _CHUNK, n)
        )
    ).alias("_place")
    copies = (F.col("base") + (F.col("_place") <= F.col("extra")).cast("int")).cast("long")
    return (
        decided.select("*", start)
        .select("*", place)
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "text_hash",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
