"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are projected on a few dimensions for each of several curves, spread evenly over a grid,
shifted, and ordered by their place on a Hilbert curve through it. Spark range partitions the
rows by curve and key and packs them into runs. A query looks at the cells of every curve that
lie within `reach` places of its own; what the cells find is merged and scored again with the
original vectors.

How far neighbours lie apart on the curves depends on the data: little where vectors cluster, a
good part of all rows where they have no structure. So the reach is measured: a bounded sample
of the queries is answered exactly, by one pass over all vectors, and the reach is what finds
TARGET of their neighbours in one curve at least. It is a setting of the index, not a cap: it
grows with what the data need.

Equal vectors are one vector of the index with its smallest ids, more than an answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stage

K = 20
CURVES = 6
DIMS = 8
BITS = 5
SEED = 12
TARGET = 0.97
# Bounds of the samples: vectors that fit the grid (and their bytes), queries that fit the reach.
FIT_VECTORS = 8192
FIT_BYTES = 16_000_000
FIT_QUERIES = 256
# Rows of a packed run, and of a cell at least and at most.
RUN = 2048
CELL = (1024, 8192)

_QUANTILES = 257


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """The places of grid points (n, m) on the Hilbert curve of m dimensions, 2 ** bits to a side."""
    x = grid.astype(np.int64).copy()
    dims = x.shape[1]
    side = 1 << (bits - 1)
    while side > 1:  # undo the rotations of each level
        low = side - 1
        for i in range(dims):
            flip = (x[:, i] & side) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            if i:
                x[:, i] ^= swap
        side >>= 1
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    side = 1 << (bits - 1)
    while side > 1:
        turn ^= np.where((x[:, -1] & side) != 0, side - 1, 0)
        side >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


@dataclass
class Curves:
    """Projections, the spread of each projected dimension, and shifts, for each curve."""

    projections: list[np.ndarray]
    quantiles: list[np.ndarray]
    shifts: list[np.ndarray]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(curves, n) keys; only the direction of a vector counts."""
        unit = _unit(vectors)
        share = np.linspace(0, 0.5, _QUANTILES)
        found = []
        for projection, quantiles, shift in zip(self.projections, self.quantiles, self.shifts):
            at = unit @ projection
            even = np.stack([np.interp(at[:, i], quantiles[i], share) for i in range(at.shape[1])], 1)
            grid = ((even + shift) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
            found.append(hilbert_key(grid, BITS))
        return np.stack(found)


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / np.where(largest == 0, 1, largest)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def fit_curves(sample: np.ndarray, curves: int = CURVES, seed: int = SEED) -> Curves:
    """Random orthogonal projections, as many curves as fit on disjoint dimensions of one rotation."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    dims = min(DIMS, d)
    unit = _unit(sample)
    found = Curves([], [], [])
    while len(found.projections) < curves:
        rotation = np.linalg.qr(rng.normal(size=(d, min(d, dims * curves))))[0]
        for at in range(0, rotation.shape[1] - dims + 1, dims):
            if len(found.projections) < curves:
                projection = rotation[:, at : at + dims]
                found.projections.append(projection)
                found.quantiles.append(np.quantile(unit @ projection, np.linspace(0, 1, _QUANTILES), axis=0).T)
                found.shifts.append(rng.random(dims) / 2)
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.flatten()
    return np.asarray(lists, np.float64).reshape(len(column), -1)


def _coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in bytes, each with its scale; only which candidates are scored depends on them."""
    scale = np.abs(vectors).max(1) / 127
    return np.rint(vectors / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the vectors that can be compared: not null, not zero, all components
    finite, and of the most frequent length."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vec"))
    number = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.coalesce(number, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    size = F.size("vec").alias("size")
    frequent = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("vec") == F.lit(frequent["size"] if frequent else 0))


def _indexed(rows: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(gid, vec, ids, asked): the different vectors with their smallest ids, nulls last."""
    order = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last())
    ids = F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")))
    few = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
    vectors = few.groupBy("vec").agg(ids["vec_id"].alias("ids"))
    wanted = asked.select("vec").distinct().withColumn("asked", F.lit(True))
    return stage(
        vectors.join(wanted, "vec", "left").select(
            F.monotonically_increasing_id().alias("gid"), "vec", "ids", F.col("asked").isNotNull().alias("asked")
        ),
        "vectors",
    )


_RUN = "part int, curve int, at long, gids binary, asked binary, scales binary, codes binary"


def _runs(indexed: DataFrame, curves: Curves) -> DataFrame:
    """The vectors in the order of each curve, packed into rows of up to RUN vectors."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vec"))
            codes, scales = _coded(vectors)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            for curve, keys in enumerate(curves.keys(vectors)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), curve, np.int32)), pa.array(keys), batch.column("gid"),
                        batch.column("asked"), pa.array(scales), packed,
                    ],
                    names=["curve", "key", "gid", "asked", "scale", "code"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        curve, at, held, n = None, 0, [], 0

        def run() -> pa.RecordBatch:
            columns = list(zip(*held))
            data = [b"".join(c) for c in columns]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([curve], pa.int32()), pa.array([at], pa.int64())]
                + [pa.array([d], pa.binary()) for d in data],
                names=["part", "curve", "at", "gids", "asked", "scales", "codes"],
            )

        for batch in batches:
            of = np.asarray(batch.column("curve"))
            gids = np.asarray(batch.column("gid"))
            asked = np.asarray(batch.column("asked")).astype(np.uint8)
            scales = np.asarray(batch.column("scale"))
            codes = batch.column("code").to_pylist()
            start = 0
            while start < len(of):
                if of[start] != curve:
                    if n:
                        yield run()
                    curve, at, held, n = int(of[start]), 0, [], 0
                end = start + min(int(np.searchsorted(of[start:], curve, "right")), RUN - n)
                held.append(
                    (
                        gids[start:end].tobytes(), asked[start:end].tobytes(),
                        scales[start:end].tobytes(), b"".join(codes[start:end]),
                    )
                )
                n += end - start
                if n == RUN:
                    yield run()
                    at, held, n = at + n, [], 0
                start = end
        if n:
            yield run()

    rows = indexed.select("gid", "vec", "asked").mapInArrow(
        placed, "curve int, key long, gid long, asked boolean, scale float, code binary"
    )
    order = ["curve", "key", "gid"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.mapInArrow(packed, _RUN), "curve-runs")


def _starts(runs: DataFrame) -> tuple[dict[tuple[int, int], int], int]:
    """The place at which each (partition, curve) starts on its curve, and the places of a curve."""
    sizes = runs.groupBy("curve", "part").agg(F.sum(F.octet_length("asked")).alias("n")).collect()
    starts, total = {}, {}
    for curve, part, n in sorted(map(tuple, sizes)):
        starts[part, curve] = total.get(curve, 0)
        total[curve] = starts[part, curve] + n
    return starts, max(total.values(), default=0)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def measured_reach(
    indexed: DataFrame,
    runs: DataFrame,
    starts: dict[tuple[int, int], int],
    k: int = K,
    queries: int = FIT_QUERIES,
    target: float = TARGET,
) -> int:
    """Places between a query and its k nearest on the curve that brings them closest, such that
    `target` of the neighbours of the sampled queries are within."""
    sample = indexed.filter("asked").orderBy(F.xxhash64("vec", F.lit(1)), "gid").limit(queries)
    found = sample.select("gid", F.col("vec").cast("array<double>").alias("vec")).collect()
    if not found:
        return 0
    own = np.array([r["gid"] for r in found])
    wanted = np.array([r["vec"] for r in found])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros((len(own), 0), np.int64)
        best = np.zeros((len(own), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            gids = np.broadcast_to(np.asarray(batch.column("gid")), (len(own), batch.num_rows))
            scores = wanted @ _matrix(batch.column("vec")).T
            scores[gids == own[:, None]] = -np.inf
            ids, best = np.hstack([ids, gids]), np.hstack([best, scores])
            top = _top(best, k)
            ids, best = np.take_along_axis(ids, top, 1), np.take_along_axis(best, top, 1)
        query = np.repeat(own, ids.shape[1])
        real = best.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays(
            [pa.array(query[real]), pa.array(ids.ravel()[real]), pa.array(best.ravel()[real])],
            names=["query", "gid", "score"],
        )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "gid")
    pairs = (
        indexed.select("gid", "vec")
        .mapInArrow(exact, "query long, gid long, score double")
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= k)
        .select("query", "gid")
        .collect()
    )
    if not pairs:
        return 0
    query, near = np.array(pairs, np.int64).T
    looked_up = np.unique(np.concatenate([query, near]))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                gids = np.frombuffer(row["gids"], np.int64)
                here = np.flatnonzero(np.isin(gids, looked_up))
                start = starts[row["part"], row["curve"]] + row["at"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(here), row["curve"], np.int32)), pa.array(gids[here]), pa.array(start + here)],
                    names=["curve", "gid", "place"],
                )

    at = runs.select("part", "curve", "at", "gids").mapInArrow(places, "curve int, gid long, place long")
    found_at = np.array([tuple(r) for r in at.collect()], np.int64)
    apart = np.full(len(query), np.iinfo(np.int64).max)
    for curve in np.unique(found_at[:, 0]):
        place = np.zeros(len(looked_up), np.int64)
        mine = found_at[found_at[:, 0] == curve]
        place[np.searchsorted(looked_up, mine[:, 1])] = mine[:, 2]
        step = place[np.searchsorted(looked_up, near)] - place[np.searchsorted(looked_up, query)]
        apart = np.minimum(apart, np.abs(step))
    return int(np.quantile(apart, target, method="higher"))


_CELL = "curve int, cell long, asking boolean, gids binary, scales binary, codes binary"


def _candidates(
    runs: DataFrame, starts: dict[tuple[int, int], int], total: int, reach: int, keep: int
) -> DataFrame:
    """(query, gid): for each asked vector the best `keep` of all cells within reach, by bytes."""
    cell = min(max(reach, CELL[0]), CELL[1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each run to their cells, its queries to all cells within reach."""
        for batch in batches:
            for row in batch.to_pylist():
                gids = np.frombuffer(row["gids"], np.int64)
                scales = np.frombuffer(row["scales"], np.float32)
                codes = np.frombuffer(row["codes"], np.int8).reshape(len(gids), -1)
                asked = np.frombuffer(row["asked"], np.uint8) != 0
                place = starts[row["part"], row["curve"]] + row["at"] + np.arange(len(gids))
                out = [(c, False, place // cell == c) for c in np.unique(place // cell)]
                if asked.any():
                    low = np.maximum(place - reach, 0) // cell
                    high = np.minimum(place + reach, total - 1) // cell
                    for c in range(int(low[asked].min()), int(high[asked].max()) + 1):
                        out.append((c, True, asked & (low <= c) & (c <= high)))
                for c, asking, mine in out:
                    if mine.any():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["curve"]], pa.int32()), pa.array([int(c)], pa.int64()), pa.array([asking]),
                                *[pa.array([x[mine].tobytes()], pa.binary()) for x in (gids, scales, codes)],
                            ],
                            names=["curve", "cell", "asking", "gids", "scales", "codes"],
                        )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's vectors come first, then its queries."""
        here, parts, data = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["curve"], row["cell"]) != here:
                    here, parts, data = (row["curve"], row["cell"]), [], None
                gids = np.frombuffer(row["gids"], np.int64)
                scales = np.frombuffer(row["scales"], np.float32)
                codes = np.frombuffer(row["codes"], np.int8).reshape(len(gids), -1).astype(np.float32)
                codes *= scales[:, None]
                if not row["asking"]:
                    parts.append((gids, codes))
                    continue
                if data is None:
                    data = np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts])
                scores = codes @ data[1].T
                top = _top(scores, keep)
                width = top.shape[1]
                offsets = pa.array(np.arange(0, len(gids) * width + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gids),
                        pa.ListArray.from_arrays(offsets, pa.array(data[0][top].ravel())),
                        pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(scores, top, 1).ravel())),
                    ],
                    names=["query", "near", "score"],
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, near, score = None, np.zeros(0, np.int64), np.zeros(0, np.float32)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(near), query, np.int64)), pa.array(near)], names=["query", "gid"]
            )

        for batch in batches:
            lists = zip(batch.column("query").to_pylist(), batch.column("near"), batch.column("score"))
            for q, ids, scores in lists:
                if q != query:
                    if query is not None:
                        yield done()
                    query, near, score = q, near[:0], score[:0]
                near = np.concatenate([near, np.asarray(ids.values)])
                score = np.concatenate([score, np.asarray(scores.values)])
                near, first = np.unique(near, return_index=True)
                best = np.argsort(-score[first], kind="stable")[:keep]
                near, score = near[best], score[first][best]
        if query is not None:
            yield done()

    cells = runs.mapInArrow(dealt, _CELL).repartition("curve", "cell")
    found = cells.sortWithinPartitions("curve", "cell", "asking").mapInArrow(
        searched, "query long, near array<long>, score array<float>"
    )
    return found.repartition("query").sortWithinPartitions("query").mapInArrow(merged, "query long, gid long")


def _inner_product(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    target: float = TARGET,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `is_query`, which
    reads the column `vec_id`.

    Nearest by the inner product in double precision, ties to the smaller id, null ids last. A row
    is no neighbour of itself, but equal vectors of other rows are. Vectors that are null, zero,
    hold a null or a number that is not finite, or have another length than most, take no part. Of
    repeated queries each is answered. Other columns are not read; no rows give no rows.
    """
    rows = usable(vectors, vec_id, vector)
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    indexed = _indexed(rows, queries, k + 1)
    d = indexed.select(F.size("vec")).first()
    bound = min(FIT_VECTORS, max(FIT_BYTES // (8 * d[0]), 256)) if d else 0
    sample = indexed.orderBy(F.xxhash64("vec"), "gid").limit(bound).select(F.col("vec").cast("array<double>")).collect()
    fitted = fit_curves(np.array([r[0] for r in sample] or [[1.0]]), curves)
    runs = _runs(indexed, fitted)
    starts, total = _starts(runs)
    reach = measured_reach(indexed, runs, starts, k, target=target)
    found = _candidates(runs, starts, total, reach, 2 * k)
    asked = indexed.filter("asked").select(F.col("gid").alias("query"), F.col("vec").alias("asked_vec"))
    scored = (
        found.join(indexed.select("gid", "vec", "ids"), "gid")
        .join(asked, "query")
        .select("query", "gid", _inner_product("asked_vec", "vec").alias("score"), F.explode("ids").alias("vec_id"))
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    few = scored.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1)
    listed = F.sort_array(F.collect_list(F.struct("_place", "gid", "vec_id", "score")))
    answers = few.groupBy("query").agg(listed.alias("_near"))
    same = queries.join(asked, queries["vec"] == asked["asked_vec"]).select("query_id", "query")
    own = F.array_position(
        F.transform("_near", lambda e: (e["gid"] == F.col("query")) & e["vec_id"].eqNullSafe(F.col("query_id"))),
        F.lit(True),
    )
    others = F.slice(F.filter("_near", lambda e, i: i + 1 != own), 1, k)
    return same.join(answers, "query").select("query_id", F.posexplode(others).alias("_rank", "_e")).select(
        "query_id", (F.col("_rank") + 1).alias("rank"), F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score")
    )
