import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfline.llm import jaccard_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, n, component) of each row, by comparing all rows that share a shingle."""
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s])
        for j, o in shared.items():
            if 100 * o >= 75 * (len(own) + len(sets[j]) - o):
                parent[find(i)] = find(j)
        for s in own:
            holders[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        ids = [x for x in (least.get(root), doc_id) if x is not None]
        least[root] = min(ids) if ids else None
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def found(docs):
    return Counter(
        (r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()
    )


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_documents(documents):
    assert found(documents) == brute(pairs(documents))


def test_odd_rows(odd_docs, no_docs):
    assert found(odd_docs) == brute(pairs(odd_docs))
    assert jaccard_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("settings", [{}, {"SMALL": 8, "BLOCK": 16, "FLUSH_ENTRIES": 300}, {"BLOCK": 4, "LARGE": 1, "PIVOTS": 6}])
def test_copies_chains_and_shared_passages(llm, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(text + (passage if group % 3 == 0 else []))
    chain = [rng.choice(vocabulary) for _ in range(80)]
    for step in range(10):  # each close to the next one only
        rows.append(chain[step * 2 : step * 2 + 50])
    docs = [(i, " ".join(words)) for i, words in enumerate(rows)]
    frame = llm.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert found(frame) == brute(docs)


def test_the_boundary_itself_is_a_link():
    for n in range(1, 400):
        for m in range(n, n * 4 // 3 + 2):
            least = next(o for o in range(m + 2) if 100 * o >= 75 * (n + m - o))
            if least <= n:
                # Sharing `least` of n and m, the first shared one is within both windows.
                assert n - least + 1 <= jaccard_join.window(n)
                assert m - least + 1 <= jaccard_join.window(m)
                assert 7 * (n + m - 2 * least) <= n + m


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n, changed in [(5, 1), (60, 10), (300, 40), (900, 500)]:
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard_join.sketch(s), np.uint64) for s in (x, y))
        while len(a) != len(b):
            a, b = (jaccard_join.folded(a), b) if len(a) > len(b) else (a, jaccard_join.folded(b))
        while True:
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
            if len(a) == 1:
                break
            a, b = jaccard_join.folded(a), jaccard_join.folded(b)


def test_rows_that_stay(odd_docs, documents, no_docs):
    kept = jaccard_join.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # Texts without words stay: ids 3, 4, 8 and the row of nulls.
    with_words = [r for r in rows if shingle_set(r[1])]
    assert len(rows) - len(with_words) == 4
    assert sorted(with_words, key=repr) == sorted(
        [(1, odd_docs.first()["text"])]
        + [(r["doc_id"], r["text"]) for r in odd_docs.dropDuplicates(["doc_id", "text"]).collect()
           if r["doc_id"] in (5, 6, 9) or (r["doc_id"] is None and r["text"])],
        key=repr,
    )
    expected = {c for _, n, c in brute(pairs(documents)) if n}
    ids = [r["doc_id"] for r in jaccard_join.without_near_duplicates(documents).collect() if shingle_set(r["text"])]
    assert sorted(ids) == sorted(expected)
    assert jaccard_join.without_near_duplicates(no_docs).count() == 0


def test_pairs_that_share_many_regions_are_made_once():
    """Twenty sets near each other, all of different components, in forty regions of most of them."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.unique(np.append(base[1:], np.uint64(i + 1))) for i in range(20)]
    held = [(r, i) for r in range(100, 140) for i in range(20) if rng.random() < 0.8]
    own = {i: [r for r, j in held if j == i] for i in range(20)}
    regions, ids = (np.array(column, np.int64) for column in zip(*held))
    first = np.full((len(held), jaccard_join.FIRST), np.iinfo(np.int64).max)
    for row, (_, i) in enumerate(held):
        some = own[i][: jaccard_join.FIRST]
        first[row, : len(some)] = some
    made = []
    for r in range(100, 140):
        at = regions == r
        n = int(at.sum())
        sketches = [jaccard_join.sketch(sets[i]) for i in ids[at]]
        sizes = np.array([len(sets[i]) for i in ids[at]])
        found = jaccard_join._candidates(
            np.array([0]), ids[at], sizes, sketches, ids[at], None, regions[at], first[at]
        )
        made += zip(*found.tolist())
    assert n > 2 and set(made) == {(i, j) for i in range(20) for j in range(i + 1, 20)}
    assert len(made) < 2 * len(set(made))


@pytest.mark.parametrize("settings", [{}, {"FIRST": 1, "NEAREST_IN": 1}, {"BLOCK": 4, "LARGE": 1, "PIVOTS": 6}])
def test_near_copies_of_several_components(llm, monkeypatch, settings):
    """Edits leave about three quarters, so that many pairs are looked at and few are links."""
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(40):
        text = base[: rng.choice((60, 100, 150))]
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
        rows.append((i if i % 13 else None, " ".join(text)))
    frame = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(frame) == brute(rows)
