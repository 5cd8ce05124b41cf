import numpy as np
import pytest

from shelfline.llm import jaccard_join


def families(llm, groups, size, changed=4, seed=5):
    """One region of groups of sets that differ in a few shingles each; and the same by arrays."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(groups):
        n = int(rng.integers(50, 90))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for _ in range(size):
            own = base.copy()
            own[rng.integers(0, n, changed)] = rng.integers(0, 1 << 63, changed).astype(np.uint64)
            own = np.unique(own)
            rows.append((7, jaccard_join.set_hash(own), group, len(own), jaccard_join.sketch(own)))
    frame = llm.createDataFrame(rows, "region bigint, set_id bigint, component bigint, n bigint, sketch binary")
    return rows, frame.repartition(3)


def parts(frame):
    return [row for part in jaccard_join._voronoi(frame) for row in part.collect()]


def met(rows):
    together = {}
    for r in rows:
        together.setdefault((r["region"], r["cell"]), set()).add(r["set_id"])
    return together.values()


def possible(rows):
    _, ids, groups, sizes, sketches = (list(c) for c in zip(*rows))
    i, j = jaccard_join.possible_pairs(np.array(sizes), sketches, np.array(groups))
    return {frozenset((ids[a], ids[b])) for a, b in zip(i, j)}


@pytest.fixture
def rounds(monkeypatch):
    made = []
    monkeypatch.setattr(jaccard_join, "LARGE", 1)
    plain = jaccard_join._nearest_pivots

    def counted(rows, level):
        made.append(level)
        return plain(rows, level)

    monkeypatch.setattr(jaccard_join, "_nearest_pivots", counted)
    return made


@pytest.mark.parametrize("pivots", [4, 64])
def test_each_possible_pair_meets(llm, monkeypatch, rounds, pivots):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    rows, _ = families(llm, 6, 20)
    # Every set is a component of its own, so that the pairs within a family are open.
    alone = [(r, i, at, n, s) for at, (r, i, _, n, s) in enumerate(rows)]
    frame = llm.createDataFrame(alone, "region bigint, set_id bigint, component bigint, n bigint, sketch binary")
    wanted = possible(alone)
    assert len(wanted) > 500
    groups = list(met(parts(frame)))
    assert all(any(pair <= group for group in groups) for pair in wanted)
    assert rounds


def test_regions_are_split_again(llm, monkeypatch, rounds):
    """Some of the families have no pivot in the first round; they follow the others' regions."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 48)
    _, frame = families(llm, 20, 20)
    rows = parts(frame)
    assert len(rounds) >= 2
    assert len(rows) < 20 * 20  # whole families are one component: little is left to compare


def test_each_possible_pair_meets_in_the_second_round(llm, monkeypatch, rounds):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 24)
    rows, _ = families(llm, 6, 40)
    halves = [(r, i, 2 * c + at % 2, n, s) for at, (r, i, c, n, s) in enumerate(rows)]
    frame = llm.createDataFrame(halves, "region bigint, set_id bigint, component bigint, n bigint, sketch binary")
    groups = list(met(parts(frame)))
    assert len(rounds) >= 2
    assert all(any(pair <= group for group in groups) for pair in possible(halves))


def test_rows_grow_no_faster_than_the_sets(llm, monkeypatch):
    """Families that are components each are parted from each other and need no look."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "LARGE", 1)
    counts = [len(parts(families(llm, 8, size)[1])) for size in (50, 100, 200)]
    assert counts[2] <= 4.4 * max(counts[0], 100)
    blocks = [8 * size * -(-8 * size // 64) for size in (50, 100, 200)]
    assert counts[2] < blocks[2] / 4


def test_no_rows(llm):
    _, frame = families(llm, 1, 1)
    assert parts(frame.limit(0)) == []
