"""Exact Jaccard join of word shingles in metric space.

Jaccard distance is a metric. Two sets within distance 1/4 differ in at most a seventh of their
sizes' sum. That gives three nested kinds of region, each complete:

1. Single shingles are the first pivots. A set is equally near to all the pivots it holds; the
   boundary window around it is as wide as the distance allows, floor(n/4) + 1 of them in one
   global order, so that any two linked sets meet in a region. The order puts shingles that are
   frequent in a sample of the sets last. It is the same for all sets, so the sample affects the
   size of regions, never the result.
2. Within each region one set is the pivot, and the exact distance of every other one to it is
   computed. The balls of radius 1/4 around the pivots are linked and become components: a group
   of n copies costs n distances, not n squared. A task first finds pivots among its own sets and
   ships only these, so that a region of any size stays spread.
3. Regions that still hold several components are joined recursively. A sketch of each set, the
   parities of its shingles' numbers in hash classes, four or more classes for each shingle, has a
   Hamming distance that never exceeds the size of the symmetric difference. In that space pivots
   create Voronoi regions, the triangle inequality says which sets at the boundary have to be in a
   neighbouring region as well, and small regions compare all sketches. Regions beyond LARGE
   blocks are split in rounds over all of them at once, by at most PIVOTS of their sets; within tasks the
   same goes on. Where pivots do not separate the sets of a region (all of them about as far from
   each other), it is compared block by block. Only pairs of different
   components whose sketches allow a link are verified on the sets: first each set with the one
   nearest by sketch in a few of its regions, then with all that are left in all regions, so that
   groups of similar texts have become one component before all their pairs are looked at. Similar
   texts share many regions; each set carries the first few of its regions, and a pair that shares
   an earlier one by these is left to that.

Equal sets are one set throughout. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import emptied_after_tasks, first_of, map_arrow, release
from shelfline.session import stage

WORDS = 5
SAMPLE_BITS = 4  # one set of 16 is in the sample
FREQUENT = 4  # sets of the sample that make a shingle frequent
MOST_FREQUENT = 1_000_000  # the most frequent ones that are kept, 8 MB
REGION_ENTRIES = 1_500_000  # entries of a partition of regions
FLUSH_ENTRIES = 1_500_000  # with their sorting about 200 MB
BLOCK = 1024  # sets of a region that are compared with as many others in one task
LARGE = 4  # blocks of a region beyond which it is split by pivots
PIVOTS = 64  # sets that a region is split by, at most one of a component
SMALL = 256
TINY = 48  # regions that are compared together with others
HELD_ROWS = 20_000
MOST_BROADCAST = 1_000_000
ROUNDS = (1, None)  # nearest sets, by sketch, that each set is compared with
FIRST = 8  # regions of a set, the first in one order, that tell where a pair has met before
NEAREST_IN = 4  # of these, how many nearest sets are looked for in

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
    np.uint64,
)


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = emptied_after_tasks(_WordHashes())


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles, A-Z in lower case.

    Fewer words are one shingle; a text without words, empty or null, has none.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    length = min(len(words), WORDS)
    total = np.full(len(words) - length + 1, length, np.uint64)
    for i in range(length):
        total += h[i : len(h) - length + 1 + i] * _ODD[i]
    total ^= total >> np.uint64(32)
    total *= _ODD[4]
    total ^= total >> np.uint64(29)
    return np.unique(total)


def set_hash(found: np.ndarray) -> int:
    """The set's identity as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of shingles in each class; there are 64 * 2**k classes, at least 4n.

    Classes are the lowest bits of the hashes, so that the halves' XOR is the sketch of half as
    many classes.
    """
    classes = 64
    while classes < 4 * len(found):
        classes *= 2
    counts = np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def window(n: int) -> int:
    """How many of n shingles a set has to be entered under."""
    return n - (3 * n + 3) // 4 + 1


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= 75 * (a + b - shared)


# --- the sets ---------------------------------------------------------------


def document_sets(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, n, set_id, sketch of each row, the sketch folded once (`half`), which blocks
    are compared by, and the shingles of sampled sets."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes, ids, sketches, halves, samples = [], [], [], [], []
        for value in batch.column(text):
            found = shingles(value.as_py())
            key = set_hash(found) if len(found) else None
            sampled = key is not None and key & ((1 << SAMPLE_BITS) - 1) == 0
            sizes.append(len(found))
            ids.append(key)
            sketches.append(sketch(found) if len(found) else None)
            halves.append(_half(sketches[-1]))
            samples.append(found.view(np.int64) if sampled else None)
        return {
            "n": pa.array(sizes, pa.int64()),
            "set_id": pa.array(ids, pa.int64()),
            "sketch": pa.array(sketches, pa.binary()),
            "half": pa.array(halves, pa.binary()),
            "sample": pa.array(samples, pa.list_(pa.int64())),
        }

    added = {"n": "bigint", "set_id": "bigint", "sketch": "binary", "half": "binary"}
    added["sample"] = "array<bigint>"
    renamed = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")
    )
    text = "_text"
    return map_arrow(renamed, ["doc_id", "text_hash", "_text"], run, added).drop("_text")


def _frequent(sets: DataFrame) -> np.ndarray:
    """Sorted shingles that are frequent in the sample; at most MOST_FREQUENT reach the driver."""
    sample = sets.filter("sample IS NOT NULL").dropDuplicates(["set_id"])
    counted = (
        sample.select(F.explode("sample").alias("shingle"))
        .groupBy("shingle")
        .count()
        .filter(F.col("count") >= FREQUENT)
        .orderBy(F.desc("count"), "shingle")
        .limit(MOST_FREQUENT)
    )
    return np.sort(counted.select("shingle").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _entries(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles that a set is entered under."""
    late = _is_in(found, frequent)
    return np.concatenate([found[~late], found[late]])[: window(len(found))]


# --- regions of single shingles ---------------------------------------------


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def _members(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: region, set and pivot of those that share a region; and one entry a region."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])
        keys, sets = keys[new], sets[new]
    if not len(keys):
        return keys, sets, sets, keys, sets
    starts, lengths = _runs(keys)
    pivots = np.repeat(sets[starts], lengths)
    shared = np.repeat(lengths > 1, lengths) & (pivots != sets)
    return keys[shared], sets[shared], pivots[shared], keys[starts], sets[starts]


def _packed(keys: np.ndarray, sets: np.ndarray) -> bytes:
    """Sorted keys as differences by byte plane, sets as places in a list of the distinct ones."""
    known, places = np.unique(sets, return_inverse=True)
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    small = np.uint16 if len(known) <= 1 << 16 else np.uint32
    head = np.array([len(keys), len(known), np.dtype(small).itemsize], np.int64)
    return b"".join([head.tobytes(), steps.tobytes(), known.tobytes(), places.astype(small).tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, distinct, width = np.frombuffer(blob, np.int64, 3)
    at = 24
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, -1).T)
    at += 8 * n
    known = np.frombuffer(blob, np.int64, distinct, at)
    places = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, n, at + 8 * distinct)
    return np.cumsum(steps.reshape(-1).view(np.uint64)), known[places]


_MEMBERS = pa.schema([("region", pa.int64()), ("set_id", pa.int64()), ("pivot", pa.int64())])


def _shared_regions(docs: DataFrame, text: str, frequent: np.ndarray, partitions: int) -> DataFrame:
    """region, set_id, pivot: sets that share a region with the pivot of it."""
    from pyspark.sql.types import LongType, StructField, StructType

    late = docs.sparkSession.sparkContext.broadcast(frequent)
    buckets = 4 * partitions

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sets: list[int] = []
        lengths: list[int] = []
        held, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            all_keys = np.concatenate([np.empty(0, np.uint64), *keys])
            all_sets = np.repeat(np.array(sets, np.int64), lengths)
            region, member, pivot, first_key, first_set = _members(all_keys, all_sets)
            bucket = ((first_key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            if len(bucket):
                starts, runs = _runs(bucket)
                for at, run in zip(starts, runs):
                    blob = _packed(first_key[at : at + run], first_set[at : at + run])
                    yield row(int(bucket[at]), blob, None)
            for at in range(0, len(region), 1 << 16):
                part = slice(at, at + (1 << 16))
                blob = np.concatenate([region[part].view(np.int64), member[part], pivot[part]])
                yield row(int((turn + at) % buckets), None, blob.tobytes())

        def row(bucket: int, entries: bytes | None, members: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int64()), pa.array([entries], pa.binary()), pa.array([members], pa.binary())],
                names=["bucket", "entries", "members"],
            )

        for batch in batches:
            for value in batch.column(0):
                found = shingles(value.as_py())
                if not len(found):
                    continue
                keys.append(_entries(found, late.value))
                sets.append(set_hash(found))
                lengths.append(len(keys[-1]))
                held += lengths[-1]
            if held >= FLUSH_ENTRIES:
                yield from flush()
                keys, sets, lengths, held, turn = [], [], [], 0, turn + 1
        yield from flush()
        keys, sets, lengths = [], [], []
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for batch in batches:
            for blob in batch.column(1):
                if blob.is_valid:
                    k, s = _unpacked(blob.as_py())
                    keys.append(k)
                    sets.append(s)
            for blob in batch.column(2):
                if blob.is_valid:
                    yield members(*np.frombuffer(blob.as_py(), np.int64).reshape(3, -1))
        region, member, pivot, _, _ = _members(np.concatenate(keys), np.concatenate(sets))
        for at in range(0, len(region), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield members(region[part].view(np.int64), member[part], pivot[part])
        del keys, sets, region, member, pivot
        release()

    def members(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_MEMBERS)

    schema = StructType([StructField(name, LongType()) for name in _MEMBERS.names])
    return (
        docs.select(text)
        .mapInArrow(enter, "bucket bigint, entries binary, members binary")
        .repartition(partitions, "bucket")
        .mapInArrow(meet, schema)
    )


# --- distances on the sets --------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. The sets of both sides meet in a join."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("_b"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ok = []
        for x, y in zip(batch.column("_a"), batch.column("_b")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            ok.append(linked(int(_is_in(x, y).sum()), len(x), len(y)))
        return {"ok": pa.array(ok, pa.bool_())}

    both = pairs.join(right, "b").join(left, "a")
    return map_arrow(both, ["a", "b", "_a", "_b"], run, {"ok": "boolean"}).filter("ok").select("a", "b")


def _fetched(docs: DataFrame, text: str, doc_id: str, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and shingles of the wanted sets, from one document of each.

    The documents' ids are counted; up to MOST_BROADCAST of them go to the texts, beyond that the
    texts are shuffled to the ids.
    """
    chosen = known.join(wanted, "set_id", "left_semi").select("set_id", F.col("rep").alias("_rep"))
    chosen = stage(chosen, "wanted")
    few = chosen.count() <= MOST_BROADCAST
    reps, ids = chosen.select("_rep").distinct(), chosen.select("set_id")
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(reps) if few else reps, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi"
    )

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [shingles(t.as_py()) for t in batch.column("_text")]
        return {
            "set_id": pa.array([set_hash(m) if len(m) else None for m in made], pa.int64()),
            "shingles": pa.array([m.tobytes() for m in made], pa.binary()),
        }

    made = map_arrow(found, ["_text"], run, {"set_id": "bigint", "shingles": "binary"})
    made = made.select("set_id", "shingles").join(F.broadcast(ids) if few else ids, "set_id", "left_semi")
    return stage(made.dropDuplicates(["set_id"]), "sets")


def _allowed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    a = known.select(F.col("set_id").alias("a"), F.col("n").alias("_na"))
    b = known.select(F.col("set_id").alias("b"), F.col("n").alias("_nb"))
    fits = F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * 75
    pairs = stage(pairs.join(a, "a").join(b, "b").filter(fits), "fitting")
    a = known.select(F.col("set_id").alias("a"), F.col("sketch").alias("_a"))
    b = known.select(F.col("set_id").alias("b"), F.col("sketch").alias("_b"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ok = []
        for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("_a", "_b", "_na", "_nb"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            while len(x) != len(y):
                x, y = (folded(x), y) if len(x) > len(y) else (x, folded(y))
            ok.append(7 * int(np.bitwise_count(x ^ y).sum()) <= n + m)
        return {"ok": pa.array(ok, pa.bool_())}

    both = pairs.join(a, "a").join(b, "b")
    return map_arrow(both, ["a", "b", "_na", "_nb", "_a", "_b"], run, {"ok": "boolean"}).filter("ok").select("a", "b")


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches (64-bit words, along the last axis) of half as many classes."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def _half(sketch: bytes | None) -> bytes | None:
    """A sketch of half as many classes, at least 64."""
    if sketch is None or len(sketch) == 8:
        return sketch
    return folded(np.frombuffer(sketch, np.uint64)).tobytes()


# --- components -------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that is reachable, of a frame with columns a and b.

    Every node takes the smallest label around it and then the label of its label, until nothing
    changes. Only the number of changes reaches the driver.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("_near"))
        )
        moved = labels.join(near, "node").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new")
        )
        over = labels.select(F.col("node").alias("_new"), F.col("label").alias("_over"))
        moved = stage(
            moved.join(over, "_new").select("node", "_old", F.least("_new", "_over").alias("label")), "labels"
        )
        changed = not moved.filter("label <> _old").isEmpty()
        labels = moved.drop("_old")
        if not changed:
            return labels.withColumnRenamed("label", "component")


# --- regions of several components ------------------------------------------


def possible_pairs(sizes: np.ndarray, sketches: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of different groups whose sizes and sketches allow a link.

    Sets of one number of classes meet each other and those of twice as many, folded; beyond
    that, sizes differ too much.
    """
    words = np.array([len(s) // 8 for s in sketches])
    found = [np.empty((2, 0), np.int64)]
    for width in np.unique(words):
        own, twice = np.flatnonzero(words == width), np.flatnonzero(words == 2 * width)
        stacked = [np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(-1, width)]
        if len(twice):
            wide = np.frombuffer(b"".join(sketches[i] for i in twice), np.uint64).reshape(-1, 2 * width)
            stacked.append(folded(wide))
        places = np.concatenate([own, twice])
        i, j = _near(sizes[places], np.concatenate(stacked), groups[places], len(own))
        found.append(np.stack([places[i], places[j]]))
    both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
    return both[0], both[1]


def _near(sizes: np.ndarray, sketches: np.ndarray, groups: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j, i among the first `own`, whose sizes and sketches of equal width allow a link.

    Many sets are cut into Voronoi regions. A set whose distance to another pivot is within twice
    its reach (n/3) of that to its own is in the other's region as well. Where this would not make
    regions smaller, they are compared block by block.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)

    def compare(places: np.ndarray) -> None:
        places = np.sort(places)
        step = max(1, (1 << 21) // max(1, len(places) * sketches.shape[1]))
        for at in range(0, len(places), max(64, step)):
            some = places[at : at + max(64, step)]
            some = some[some < own]
            ok = (groups[some, None] != groups[None, places]) & (some[:, None] < places[None, :])
            a, b = sizes[some, None], sizes[None, places]
            ok &= 100 * np.minimum(a, b) >= 75 * np.maximum(a, b)
            i, j = np.nonzero(ok)
            i, j = some[i], places[j]
            part = max(256, (1 << 20) // sketches.shape[1])
            for start in range(0, len(i), part):
                x, y = i[start : start + part], j[start : start + part]
                near = 7 * distance(sketches[x], sketches[y]) <= sizes[x] + sizes[y]
                found.append((x[near], y[near]))

    def join(places: np.ndarray) -> None:
        if len(places) <= SMALL:
            compare(places)
            return
        pivots = places[np.linspace(0, len(places) - 1, 8).astype(np.int64)]
        distances = np.stack([distance(sketches[places], sketches[p]) for p in pivots])
        home = distances.argmin(0)
        inside = distances <= distances.min(0) + 2 * sizes[places] / 3
        regions = [places[inside[k]] for k in range(len(pivots)) if (home == k).any()]
        if sum(map(len, regions)) > 2 * len(places) or max(map(len, regions)) > 0.75 * len(places):
            compare(places)
            return
        for region in regions:
            join(region)

    join(np.arange(len(sizes)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _met_before(x: np.ndarray, y: np.ndarray, regions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the first regions of x and of y have one in common that comes before theirs here.

    `first` has FIRST regions a set, filled up by the last number. The first region that a pair
    shares at all has none before it, so no pair is lost.
    """
    found = np.zeros(len(x), bool)
    step = 1 << 14
    for at in range(0, len(x), step):
        some = slice(at, at + step)
        a, b, here = first[x[some]], first[y[some]], regions[x[some], None]
        for k in range(first.shape[1]):
            one = b[:, k : k + 1]
            found[some] |= ((a == one) & (one < here)).any(1)
    return found


def _candidates(
    starts: np.ndarray,
    ids: np.ndarray,
    sizes: np.ndarray,
    sketches: list[bytes],
    groups: np.ndarray,
    most: int | None,
    regions: np.ndarray,
    first: np.ndarray,
) -> np.ndarray:
    """Pairs (a, b) of set ids within the regions that begin at `starts`, in different groups.

    With `most`, each set is paired with that many nearest ones of its region; without, pairs that
    have met in an earlier region are left out. Tiny regions of one size are looked at together.
    """
    lengths = np.diff(np.append(starts, len(ids)))
    parts = [np.empty((2, 0), np.int64)]
    for length in np.unique(lengths):
        some = starts[lengths == length]
        if length <= TINY:
            i, j = np.triu_indices(length, 1)
            parts.append(np.stack([(some[:, None] + k).ravel() for k in (i, j)]))
        else:
            for at in some:
                own = slice(at, at + length)
                parts.append(np.stack(possible_pairs(sizes[own], sketches[own], groups[own])) + at)
    x, y = np.concatenate(parts, axis=1)
    fits = groups[x] != groups[y]
    fits &= 100 * np.minimum(sizes[x], sizes[y]) >= 75 * np.maximum(sizes[x], sizes[y])
    x, y = x[fits], y[fits]
    far = _distances(x, y, sketches)
    near = 7 * far <= sizes[x] + sizes[y]
    x, y, far = x[near], y[near], far[near]
    if most is not None and len(x):
        both, other = np.concatenate([x, y]), np.concatenate([y, x])
        share = np.tile(far / (sizes[x] + sizes[y]), 2)
        order = np.lexsort((ids[other], share, both))
        first, runs = _runs(both[order])
        rank = np.arange(len(both)) - np.repeat(first, runs)
        chosen = np.unique(order[rank < most] % len(x))
        x, y = x[chosen], y[chosen]
    elif most is None:
        new = ~_met_before(x, y, regions, first)
        x, y = x[new], y[new]
    return np.unique(np.sort(np.stack([ids[x], ids[y]]), axis=0), axis=1)


def _distances(x: np.ndarray, y: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Hamming distances of pairs of sketches; the wider one is folded once, as sizes allow."""
    words = np.array([len(s) // 8 for s in sketches], np.int64)
    width = np.minimum(words[x], words[y])
    found = np.zeros(len(x), np.int64)
    for w in np.unique(width):
        pairs = np.flatnonzero(width == w)
        used = np.unique(np.concatenate([x[pairs], y[pairs]]))
        rows = []
        for place in used:
            sketch = np.frombuffer(sketches[place], np.uint64)
            rows.append(sketch if len(sketch) == w else folded(sketch))
        table = np.stack(rows)
        step = max(1, (1 << 20) // int(w))
        for at in range(0, len(pairs), step):
            part = pairs[at : at + step]
            a, b = table[np.searchsorted(used, x[part])], table[np.searchsorted(used, y[part])]
            found[part] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return found


# --- Voronoi regions across tasks ---------------------------------------------


def _by_width(sets: DataFrame) -> DataFrame:
    """The sets of each region by the width of their sketches, in words.

    A set is its own width's, and folded it is also among those half as wide: all sets that it can
    be linked with are in one of the two. region, width, own, set_id, component, n, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [np.frombuffer(s, np.uint64) for s in batch.column("sketch").to_pylist()]
            for own in (True, False):
                places = [i for i, s in enumerate(sketches) if own or len(s) > 1]
                shown = [sketches[i] if own else folded(sketches[i]) for i in places]
                some = batch.take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("region"),
                        pa.array([len(s) for s in shown], pa.int32()),
                        pa.array([own] * len(places), pa.bool_()),
                        *(some.column(c) for c in ("set_id", "component", "n")),
                        pa.array([s.tobytes() for s in shown], pa.binary()),
                    ],
                    names=["region", "width", "own", "set_id", "component", "n", "sketch"],
                )
        release()

    schema = "region bigint, width int, own boolean, set_id bigint, component bigint, n bigint, sketch binary"
    return sets.select("region", "set_id", "component", "n", "sketch").mapInArrow(run, schema)


def _nearest_pivots(rows: DataFrame, level: int) -> DataFrame:
    """The rows with `home`, their nearest pivot, and `inside`, all pivots in whose regions they are.

    Linked sets x and y differ by at most a third of either. So if k is the pivot of y, x is by at
    most two thirds of its size farther from k than from its own pivot, and both are in k's region.
    Pivots are those with the smallest hashes; a region's rows are dealt over one task for each
    BLOCK of them, and its pivots are sent to each of these. One pivot of a component is enough.
    """
    kept = ["region", "width", "own", "set_id", "component", "n", "sketch"]
    member = PIVOTS
    order = F.xxhash64("set_id", F.lit(level))
    pivots = (
        rows.groupBy("region", "width", "_m", F.pmod(order, F.lit(PIVOTS)).cast("int").alias("k"))
        .agg(F.min_by(F.struct("component", "sketch"), order).alias("_first"))
        .groupBy("region", "width", "_m", "_first.component")
        .agg(F.min(F.struct("k", "_first.sketch")).alias("_pivot"))
        .select("region", "width", "_m", "_pivot.*")
    )
    tasks = F.ceil(F.col("_m") / BLOCK)
    absent = [F.lit(None).cast(kind).alias(name) for name, kind in
              (("own", "boolean"), ("set_id", "bigint"), ("component", "bigint"), ("n", "bigint"))]
    sent = pivots.select(
        "region", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1)).alias("task"), "k", *absent, "sketch"
    )
    task = F.pmod(F.xxhash64("set_id", F.lit(-1 - level)), tasks).cast("bigint").alias("task")
    members = rows.select(
        "region", "width", task, F.lit(member).alias("k"), "own", "set_id", "component", "n", "sketch"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        names: list[int] = []
        table: list[np.ndarray] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("region", "width", "task", "k")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for at, end in zip([0, *ends], [*ends, batch.num_rows]):
                part = batch.slice(at, end - at)
                key, k = tuple(keys[:3, at]), int(keys[3, at])
                if key != current:
                    current, names, table = key, [], []
                sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64)
                if k < member:
                    names.append(k)
                    table.append(sketches)
                    continue
                sketches = sketches.reshape(-1, int(key[1]))
                far = np.stack([np.bitwise_count(sketches ^ p).sum(1, dtype=np.int64) for p in table], 1)
                reach = far.min(1) + 2 * part.column("n").to_numpy() / 3
                inside = [[names[i] for i in np.flatnonzero(near)] for near in far <= reach[:, None]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept),
                        pa.array([names[i] for i in far.argmin(1)], pa.int32()),
                        pa.array(inside, pa.list_(pa.int32())),
                    ],
                    names=[*kept, "home", "inside"],
                )
        release()

    schema = (
        "region bigint, width int, own boolean, set_id bigint, component bigint, n bigint, sketch binary,"
        " home int, inside array<int>"
    )
    return (
        members.unionByName(sent)
        .repartition("region", "width", "task")
        .sortWithinPartitions("region", "width", "task", "k")
        .mapInArrow(run, schema)
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """region, cell, set_id, component: regions of _m sets in blocks, each of which meets each."""
    own = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("_blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda k: F.least(k, F.col("_own")) * F.col("_blocks") + F.greatest(k, F.col("_own")),
    )
    rows = rows.withColumn("_blocks", F.ceil(F.col("_m") / BLOCK).cast("int")).withColumn("_own", own)
    return rows.select("region", F.explode(cells).alias("cell"), "set_id", "component")


def _voronoi(sets: DataFrame) -> Iterator[DataFrame]:
    """region, cell, set_id, component of what large regions are split into, by frames.

    `sets` has region, set_id, component, n, sketch. In each round all regions beyond LARGE blocks
    are split by their pivots. A split counts if it halves the pairs at least and leaves no region
    with over three quarters of the sets, so rounds end, and all their rows are fewer than those
    of the blocks in their place. Regions for which it does not count are cut into blocks, each of
    which meets each.
    """
    names = ["region", "width"]
    rows = stage(_by_width(sets), "voronoi")
    level = 0
    while True:
        sizes = rows.groupBy(*names).agg(
            F.count("*").alias("_m"), F.max("own").alias("_own"),
            F.min("component").alias("_lo"), F.max("component").alias("_hi"),
        )
        sizes = stage(sizes.filter("_own AND _lo <> _hi").select(*names, "_m"), "voronoi-sizes")
        placed = rows.join(sizes, names)
        region = F.xxhash64(*names).alias("region")
        small = placed.filter(F.col("_m") <= LARGE * BLOCK)
        yield _blocks(small.select(region, "set_id", "component", "_m"))
        large = sizes.filter(F.col("_m") > LARGE * BLOCK)
        if large.isEmpty():
            return
        columns = [*names, "own", "set_id", "component", "n", "sketch"]
        big = placed.filter(F.col("_m") > LARGE * BLOCK)
        near = stage(_nearest_pivots(big.select(*columns, "_m"), level), "voronoi-pivots")
        near = near.withColumn("k", F.explode("inside"))
        counted = near.groupBy(*names, "k").agg(
            F.count("*").alias("_rows"), F.max(F.col("home") == F.col("k")).alias("_lived")
        )
        # A region where no set is at home has no pair of its own.
        counted = stage(counted.filter("_lived"), "voronoi-counts")
        split = (
            counted.groupBy(*names)
            .agg(F.sum(F.pow("_rows", F.lit(2))).alias("_pairs"), F.max("_rows").alias("_most"))
            .join(large, names)
            .filter("_pairs <= 0.5 * pow(_m, 2) AND _most <= 0.75 * _m")
            .select(*names)
        )
        split = stage(split, "voronoi-split")
        whole = big.join(split, names, "left_anti")
        yield _blocks(whole.select(region, "set_id", "component", "_m"))
        rows = stage(
            near.join(counted.join(split, names, "left_semi"), [*names, "k"]).select(
                F.xxhash64(*names, F.lit(level), "k").alias("region"), *columns[1:]
            ),
            "voronoi",
        )
        level += 1


def _open_regions(everyone: DataFrame, known: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """region, set_id, component, n, _m of regions of `least` sets at least in different components.

    `everyone` has the (region, set_id) of regions. Of up to LARGE blocks of sets those stay that
    some other is about as large as: if any is, so is the next in the order of sizes on its side.
    """
    names = labels.withColumnRenamed("node", "set_id")
    placed = everyone.join(names, "set_id", "left").select(
        "region", "set_id", F.coalesce("component", "set_id").alias("component")
    )
    placed = stage(placed, "placed")
    regions = (
        placed.groupBy("region")
        .agg(
            F.count("*").alias("_m"),
            F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("_who"),
            F.min("component").alias("_lo"),
            F.max("component").alias("_hi"),
        )
        .filter(F.col("_m") >= least)
        .filter("_lo <> _hi")
        # Regions of the same sets are joined once.
        .groupBy("_m", "_who")
        .agg(F.min("region").alias("region"))
    )
    inside = placed.join(stage(regions.select("region", "_m"), "open-regions"), "region")
    inside = inside.join(known.select("set_id", "n"), "set_id")
    small = F.col("_m") <= LARGE * BLOCK
    sizes = Window.partitionBy("region").orderBy("n")
    smaller, larger = F.lag("n").over(sizes), F.lead("n").over(sizes)
    fits = (100 * smaller >= 75 * F.col("n")) | (100 * F.col("n") >= 75 * larger)
    fitting = inside.filter(small).withColumn("_fits", fits).filter("_fits").drop("_fits")
    return stage(fitting.unionByName(inside.filter(~small)), "inside")


def _open_pairs(inside: DataFrame, known: DataFrame, most: int | None) -> DataFrame:
    """Distinct pairs (a, b) of sets that share a region, in different components, near by sketch.

    `inside` are the sets of open regions. With `most`, each set is looked at in the first
    NEAREST_IN of its regions only, which sets near each other mostly share.
    """
    number = F.row_number().over(Window.partitionBy("set_id").orderBy("region"))
    first = inside.withColumn("_k", number).filter(F.col("_k") <= (FIRST if most is None else NEAREST_IN))
    if most is not None:
        inside = stage(first.select("region", "set_id", "component"), "nearest-in")
        regions = inside.groupBy("region").agg(F.count("*").alias("_m")).filter("_m > 1")
        regions = stage(regions, "nearest-regions")
        inside = first = inside.join(regions, "region")
    large = inside.filter(F.col("_m") > LARGE * BLOCK).drop("_m", "n")
    first = first.groupBy("set_id").agg(F.sort_array(F.collect_list("region")).alias("first"))
    cut = _blocks(inside.filter(F.col("_m") <= LARGE * BLOCK)).withColumn("here", F.col("region"))
    if not large.isEmpty():
        for part in _voronoi(large.join(known.select("set_id", "n", "sketch"), "set_id")):
            # Parts of a region have other names, and pairs in them are never left to others.
            cut = cut.unionByName(part.withColumn("here", F.lit(None).cast("bigint")))
    shown = known.select("set_id", "n", F.col("half").alias("sketch"))
    cut = cut.join(shown.join(first, "set_id"), "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(table: pa.Table) -> pa.RecordBatch:
            region, cell, ids, component, n = (table.column(c).to_numpy() for c in range(5))
            new = (region[1:] != region[:-1]) | (cell[1:] != cell[:-1])
            starts = np.flatnonzero(np.concatenate([[True], new]))
            sketches = table.column(5).to_pylist()
            here = table.column(6).fill_null(np.iinfo(np.int64).min).to_numpy()
            first = np.full((len(ids), FIRST), np.iinfo(np.int64).max)
            held_first = table.column(7).combine_chunks()
            first[np.arange(FIRST) < pc.list_value_length(held_first).to_numpy()[:, None]] = held_first.flatten().to_numpy()
            a, b = _candidates(starts, ids, n, sketches, component, most, here, first)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HELD_ROWS:
                continue
            table = pa.Table.from_batches(held)
            region, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
            # The last region may go on in the next batch.
            ends = np.flatnonzero((region != region[-1]) | (cell != cell[-1]))
            if len(ends):
                whole = int(ends[-1]) + 1
                yield result(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield result(pa.Table.from_batches(held))
        held.clear()
        release()

    return (
        cut.select("region", "cell", "set_id", "component", "n", "sketch", "here", "first")
        .repartition("region", "cell")
        .sortWithinPartitions("region", "cell")
        .mapInArrow(run, "a bigint, b bigint")
        .distinct()
    )


# --- the join ---------------------------------------------------------------


def _named_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, n, component of every row; no component without words."""
    spark = docs.sparkSession
    sets = stage(document_sets(docs, text, doc_id), "document-sets")
    known = stage(
        sets.filter("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "half"))),
        "known-sets",
    )
    entries = (sets.agg(F.sum("n")).first()[0] or 0) / 4
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(default, int(entries / REGION_ENTRIES) + 1)
    members = stage(_shared_regions(docs, text, _frequent(sets), partitions), "members")

    stars = members.select(
        F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")
    ).distinct()
    tried = stage(_allowed(stars, known), "stars")
    fetched: DataFrame | None = None
    links: DataFrame | None = None

    def verify(pairs: DataFrame) -> DataFrame:
        """The links so far and those among the pairs. Each set is fetched once."""
        nonlocal fetched
        wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        if fetched is not None:
            wanted = wanted.join(fetched.select("set_id"), "set_id", "left_anti")
        new = _fetched(docs, text, doc_id, known, wanted)
        fetched = new if fetched is None else fetched.unionByName(new)
        found = stage(_verified(pairs, fetched), "links")
        return found if links is None else links.unionByName(found)

    links = verify(tried)
    labels = components(spark, links)
    everyone = stage(
        members.select("region", "set_id")
        .unionByName(members.select("region", F.col("pivot").alias("set_id")))
        .distinct(),
        "regions",
    )
    # Two sets alone in a region need no look: one is the pivot, and their distance is known. Later
    # two may be what is left of more.
    inside, least = everyone, 3
    for most in ROUNDS:
        inside, least = _open_regions(inside.select("region", "set_id"), known, labels, least), 2
        rest = _open_pairs(inside, known, most).join(tried, ["a", "b"], "left_anti")
        rest = stage(rest, "open")
        if not rest.isEmpty():
            links = verify(rest)
            labels = components(spark, links)
            tried = tried.unionByName(rest)
    return sets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "doc_id", "text_hash", "n", F.coalesce("component", "set_id").alias("component")
    )


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    component_id is the smallest doc_id that links reach, itself included; null ids are passed
    over unless there are only such. Rows of equal sets are linked whatever their ids are. A text
    without words, empty or null, is linked with nothing. Other columns are not read. An empty
    frame gives an empty frame.
    """
    named = _named_rows(docs, text, doc_id)
    firsts = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("_first"))
    alone = F.col("component").isNull()
    return named.join(firsts, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("_first")).alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Of each component the row with the smallest doc_id stays, a null id only where there is no
    other; of rows that repeat in id and text one stays. Texts without words stay.
    """
    named = _named_rows(docs, text, doc_id).filter("component IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")
    rows = named.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("_n"))
    firsts = rows.groupBy("component").agg(F.min(rank).alias("_first"))
    marked = rows.join(firsts, "component").select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        (rank != F.col("_first")).alias("_gone"),
        "_n",
    )
    marked = stage(marked, "marked").filter("_gone OR _n > 1")
    keyed = docs.withColumn("_text_hash", F.xxhash64(text))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    once = keyed.join(marked, same, "left_anti")
    repeated = keyed.join(marked.filter("NOT _gone"), same, "left_semi")
    return once.unionByName(first_of(repeated, [doc_id, "_text_hash"])).select(*docs.columns)
