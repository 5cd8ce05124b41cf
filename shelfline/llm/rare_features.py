"""Document fingerprints from improbable features.

A feature is a window of 64 bytes. Its Shannon entropy is put into one of 1001 bins; the bins'
frequencies over all windows of the corpus rank them, rarest first. Of every 64 neighbouring
windows the one of the rarest bin, the leftmost of equals, is the most telling; a feature that is
so in 16 of those runs or more is selected. Selected features set 5 of 2048 bits each in a Bloom
filter of at most 160 features; when it is full, the next one in the chain begins.

Two filters are compared by their common bits, normalised between what chance gives and what is
possible. Each filter of the smaller fingerprint takes its best counterpart, and the mean over its
features is the likeness.

Texts are short compared to what numpy costs per call, so those of a batch are joined; windows
that cross from one text into the next are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
POPULAR = 16
BINS = 1001
LEAST_BIN = 100  # windows of less entropy say nothing
FILTER_BITS = 2048
FILTER_FEATURES = 160
BITS_PER_FEATURE = 5
JOINED_BYTES = 1 << 18

_ODD = (
    np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
              0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
)
# c log2 c for c = 0..64, in units of 1/4096.
_TERM = np.array([0] + [round(c * np.log2(c) * 4096) for c in range(1, WIDTH + 1)], np.int32)


def entropy_bins(raw: np.ndarray) -> np.ndarray:
    """The bin of each window of `raw`, 0 for no entropy to 1000 for 64 different bytes.

    A window's sum of c log c over its bytes' counts changes with the byte that leaves and the
    one that enters, whose counts within 63 places are found for all places at once.
    """
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int32)
    ahead, behind = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
    for shift in range(1, WIDTH):
        same = (raw[shift:] == raw[:-shift]).view(np.uint8)
        ahead[:-shift] += same
        behind[shift:] += same
    change = np.zeros(n, np.int64)
    change[0] = _TERM[np.bincount(raw[:WIDTH])].sum()
    leaves, enters = ahead[: n - 1], behind[WIDTH:]
    change[1:] = _TERM[leaves] - _TERM[leaves + 1] + _TERM[enters + 1] - _TERM[enters]
    bits = np.log2(WIDTH) - np.cumsum(change) / (WIDTH * 4096)
    return np.clip(np.rint(bits / np.log2(WIDTH) * 1000), 0, 1000).astype(np.int32)


def _joined(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of texts that are looked at together."""
    places: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        places.append(i)
        size += len(text)
        if size >= JOINED_BYTES:
            yield places
            places, size = [], 0
    if places:
        yield places


def count_bins(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts are in each bin."""
    total = np.zeros(BINS, np.int64)
    for places in _joined(texts):
        raw = np.frombuffer(b"".join(texts[i] for i in places), np.uint8)
        bins = entropy_bins(raw)
        inside = _inside([len(texts[i]) for i in places], WIDTH, len(bins))
        total += np.bincount(bins[inside], minlength=BINS)
    return total


def _inside(lengths: list[int], span: int, n: int) -> np.ndarray:
    """Which of n starts have `span` bytes within one text."""
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    return np.arange(len(ends)) + span <= ends


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each bin, rarest first; equally rare ones by entropy."""
    ranks = np.empty(BINS, np.int64)
    ranks[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return ranks


def select_features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's selected features, distinct, in their order.

    A text without any, as short ones are, has one feature, itself; an empty text has none.
    """
    found: list[np.ndarray] = []
    for places in _joined(texts):
        parts = [texts[i] for i in places]
        lengths = [len(p) for p in parts]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        bins = entropy_bins(raw)
        chosen, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(bins) >= WIDTH:
            keys = np.where(bins < LEAST_BIN, BINS, ranks[bins]) << 40 | np.arange(len(bins))
            shift = 1
            while shift < WIDTH:
                keys = np.minimum(keys[:-shift], keys[shift:])
                shift *= 2
            best = keys[_inside(lengths, 2 * WIDTH - 1, len(keys))]
            best = best[best >> 40 < BINS] & ((1 << 40) - 1)
            chosen = np.flatnonzero(np.bincount(best, minlength=1) >= POPULAR)
            windows = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[chosen]
            hashes = _mixed(np.ascontiguousarray(windows).view(np.uint64))
        cuts = np.searchsorted(chosen, np.cumsum(lengths))
        for part, own in zip(parts, np.split(hashes, cuts[:-1])):
            if len(own):
                _, first = np.unique(own, return_index=True)
                found.append(own[np.sort(first)])
            elif part:
                digest = hashlib.sha1(part).digest()
                found.append(np.frombuffer(digest[:8], np.uint64))
            else:
                found.append(own)
    return found


def _mixed(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _ODD[i]
        h ^= h >> np.uint64(29)
    h *= _ODD[0]
    return h ^ (h >> np.uint64(32))


def chained_filters(features: np.ndarray) -> np.ndarray:
    """Bloom filters, one to a row of FILTER_BITS bytes of 0 and 1."""
    filters = np.zeros((-(-len(features) // FILTER_FEATURES), FILTER_BITS), np.uint8)
    rows = np.arange(len(features)) // FILTER_FEATURES
    for k in range(BITS_PER_FEATURE):
        filters[rows, (features >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    return filters


def written(features: np.ndarray) -> str:
    """A fingerprint: the number of features, and the filters in base64."""
    packed = np.packbits(chained_filters(features), axis=1).tobytes()
    return f"{len(features)}:{base64.b64encode(packed).decode()}"


def _read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Filters and the features of each."""
    count, _, body = fingerprint.partition(":")
    packed = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, FILTER_BITS // 8)
    features = np.full(len(packed), FILTER_FEATURES)
    if len(features):
        features[-1] = int(count) - FILTER_FEATURES * (len(features) - 1)
    return np.unpackbits(packed, axis=1).astype(np.float32), features


def likeness(one: str, other: str) -> float:
    """0 to 1; the same fingerprints give 1, an empty one and another give 0. Symmetric.

    The overlap that chance explains is taken off; what is left of unrelated texts is mostly below
    0.1, and no threshold is applied to it."""
    if one == other:
        return 1.0
    (a, n), (b, m) = sorted((_read(one), _read(other)), key=lambda f: (f[1].sum(), f[0].sum()))
    if not len(a):
        return 0.0
    total = 0.0
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        own, theirs = part.sum(1)[:, None], b.sum(1)[None, :]
        chance = own * theirs / FILTER_BITS
        most = np.minimum(own, theirs)
        overlap = (part @ b.T - chance) / np.maximum(most - chance, 1e-9)
        total += float((np.clip(overlap, 0, 1).max(1) * n[at : at + 256]).sum())
    return total / float(n.sum())


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the bins over all windows of all texts. 1001 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += count_bins([(t.as_py() or "").encode() for t in batch.column(0)])
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(total[bins])], names=["bin", "n"])

    sums = docs.select(text).mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    counts = np.zeros(BINS, np.int64)
    for row in sums.collect():
        counts[row["bin"]] = row["n"]
    return rarity(counts)


def fingerprint_batch(texts: list[str], ranks: np.ndarray) -> list[str]:
    return [written(f) for f in select_features([t.encode() for t in texts], ranks)]


# --- each document beside the next ------------------------------------------


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the id, by halving. A null id is below all."""
    place = F.lit(0)
    if bounds:
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        listed = F.lit(bounds)
        place = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, step: F.when(
                (at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= doc_id), at + step
            ).otherwise(at),
        )
    return F.when(doc_id.isNull(), 0).otherwise(place)


def beside_next(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows of (_bucket, _donor, doc_id, text), partitioned by bucket and in descending order.

    In each bucket the rows that are not donors are followed by a donor, the document after the
    bucket's last one. Ids are ordered descending, nulls last, equal ids by the text's hash; the
    first document follows the last. Each text is shuffled once, and a bucket's first one twice.
    At most one number for each partition reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / partitions for i in range(1, partitions)] or [0.5]
    found = rows.select(F.percentile_approx("doc_id", shares, 100 * partitions)).first()[0]
    placed = rows.withColumn("_bucket", _bucket(F.col("doc_id"), sorted(set(found or []))))
    firsts = sorted(
        (row["_bucket"], row["first"])
        for row in placed.groupBy("_bucket").agg(F.max("doc_id").alias("first")).collect()
    )
    names = [bucket for bucket, _ in firsts]
    targets = dict(zip(names, names[1:] + names[:1]))
    if not firsts:
        return placed.withColumn("_donor", F.lit(False))
    known = spark.createDataFrame(
        [(bucket, first, targets[bucket]) for bucket, first in firsts], "_from int, _first bigint, _to int"
    )
    matched = placed.join(F.broadcast(known), F.col("_bucket") == F.col("_from"))
    own = F.struct(F.col("_bucket").alias("_bucket"), F.lit(False).alias("_donor"))
    donor = F.struct(F.col("_to").alias("_bucket"), F.lit(True).alias("_donor"))
    gives = F.col("doc_id").eqNullSafe(F.col("_first"))
    return (
        matched.select(
            "doc_id", "text", F.explode_outer(F.when(gives, F.array(own, donor)).otherwise(F.array(own))).alias("_at")
        )
        .select("_at.*", "doc_id", "text")
        .repartition(partitions, "_bucket")
        .sortWithinPartitions(
            "_bucket", "_donor", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")
        )
    )


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by as many of
    the next document's first ones. near_edited and near_next are the likenesses of the text's
    fingerprint to the edited text's and the next document's. A null text is empty. A document
    that is alone is its own next one. Other columns are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, str]] = []
        size = 0

        def result() -> pa.RecordBatch:
            """All held rows but the last, each beside the row after it."""
            prints = fingerprint_batch([row[3] for row in held], ranks.value)
            pairs = [
                (i, held[i][3], held[i + 1][3])
                for i in range(len(held) - 1)
                if not held[i][1] and held[i][0] == held[i + 1][0]
            ]
            edited = [own[: len(own) - len(own) // 2] + after[: len(own) // 2] for _, own, after in pairs]
            changed = fingerprint_batch(edited, ranks.value)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i][2] for i, _, _ in pairs], pa.int64()),
                    pa.array([len(own) for _, own, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([prints[i] for i, _, _ in pairs], pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array([likeness(prints[i], c) for (i, _, _), c in zip(pairs, changed)], pa.float64()),
                    pa.array([likeness(prints[i], prints[i + 1]) for i, _, _ in pairs], pa.float64()),
                ],
                names=[part.split()[0] for part in _RESULT.split(", ")],
            )

        for batch in batches:
            for bucket, donor, name, value in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((bucket, donor, name, value))
                size += len(value)
                if size >= 4 * JOINED_BYTES and len(held) > 1:
                    yield result()
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield result()

    return beside_next(docs, text, doc_id).select("_bucket", "_donor", "doc_id", "text").mapInArrow(run, _RESULT)
