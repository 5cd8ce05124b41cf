import hashlib
from collections import Counter

import numpy as np

from shelfline.llm import rare_features


def texts(documents):
    return [r["text"] or "" for r in documents.orderBy("doc_id").collect()]


def test_entropy_of_each_window():
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.integers(0, 256, 300), rng.integers(97, 101, 200), np.full(100, 32)]).astype(np.uint8)
    expected = []
    for i in range(len(raw) - 63):
        shares = [c / 64 for c in Counter(raw[i : i + 64].tolist()).values()]
        expected.append(-sum(p * np.log2(p) for p in shares) / 6 * 1000)
    assert np.abs(rare_features.entropy_bins(raw) - expected).max() <= 0.51
    assert len(rare_features.entropy_bins(raw[:63])) == 0


def brute_features(text, ranks):
    """Selected features by their definition, one run of windows after the other."""
    raw = np.frombuffer(text, np.uint8)
    bins = rare_features.entropy_bins(raw)
    score = [ranks[b] if b >= rare_features.LEAST_BIN else None for b in bins]
    popular = Counter()
    for start in range(len(bins) - 63):
        run = [(score[i], i) for i in range(start, start + 64) if score[i] is not None]
        if run:
            popular[min(run)[1]] += 1
    seen = [text[i : i + 64] for i in sorted(popular) if popular[i] >= rare_features.POPULAR]
    return list(dict.fromkeys(seen))


def test_selection_and_joining(documents):
    raw = [t.encode() for t in texts(documents)[:60]]
    ranks = rare_features.rarity(rare_features.count_bins(raw))
    together = rare_features.select_features(raw, ranks)
    for text, found in zip(raw[:25], together):
        alone = rare_features.select_features([text], ranks)[0]
        assert (alone == found).all()
        expected = brute_features(text, ranks)
        assert len(found) == (len(expected) or bool(text))
        if expected:
            words = np.frombuffer(b"".join(expected), np.uint64).reshape(-1, 8)
            assert (rare_features._mixed(words) == found).all()


def test_likeness(documents):
    some = [t for t in texts(documents) if len(t) > 2000][:20]
    ranks = rare_features.rarity(rare_features.count_bins([t.encode() for t in some]))
    prints = rare_features.fingerprint_batch(some, ranks)
    halves = rare_features.fingerprint_batch([t[: len(t) // 2] + "?" * 40 for t in some], ranks)
    for i, one in enumerate(prints):
        assert rare_features.likeness(one, one) == 1
        assert rare_features.likeness(one, "0:") == 0
        assert rare_features.likeness(one, halves[i]) > 0.5
        other = prints[i - 1]
        assert rare_features.likeness(one, other) == rare_features.likeness(other, one)
        if some[i] not in (some[i - 1],):
            assert 0 <= rare_features.likeness(one, other) <= 1


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    found = rare_features.edited_fingerprints(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in rows)
    return rows, found


def test_next_document(documents):
    rows, found = check(documents)
    ordered = sorted(((r["doc_id"], r["text"] or "") for r in rows), reverse=True)
    by_id = {r["doc_id"]: r for r in found}
    by_text = {}
    for (name, text), (next_id, after) in zip(ordered, ordered[1:] + ordered[:1]):
        row, half = by_id[name], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert row["near_next"] == rare_features.likeness(row["fingerprint"], by_id[next_id]["fingerprint"])
        assert row["near_edited"] == rare_features.likeness(row["fingerprint"], row["edited_fingerprint"])
    long = [r for r in found if r["n_chars"] > 1500]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)


def test_odd_rows(odd_docs, no_docs, llm):
    rows, found = check(odd_docs)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    check(no_docs)
    check(llm.createDataFrame([(7, "only one")], "doc_id bigint, text string"))
    check(llm.createDataFrame([(None, "a"), (None, "b")], "doc_id bigint, text string"))
