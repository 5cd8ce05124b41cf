import random
import re
from collections import Counter, defaultdict

import pytest

from shelfline.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(rows, least, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        share = {}
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})
        for s, count in [*((s, counts[lang, s]) for s in sources), (None, total)]:
            n = sum(count[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            parts = {
                "pair": [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [
                    (share[s][t] - share[None][t], t)
                    for t in kept
                    if counts[lang, s][t] and share[s][t] > share[None][t]
                ],
            }
            for part, found in parts.items():
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                for rank, (value, item) in enumerate(found, 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(frame, least, top=50):
    found = divergence.audit(frame, least, top).collect()
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found)


def corpus(seed, n, sources, words=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(sources)
        k = int(rng.random() ** 3 * words) + 1
        text = " ".join(f"W{chr(97 + int(rng.random() ** 2 * k) % 26)}é{int(rng.random() * k)}" for _ in range(20))
        rows.append((i, text, lang, source, 1))
    return rows


@pytest.mark.parametrize("sources", [["a", "b", "c", "d", "é", None], ["only"], ["x", "y"]])
def test_equals_brute_force(llm, sources):
    rows = corpus(len(sources), 400, sources)
    frame = llm.createDataFrame(rows, SCHEMA).repartition(5)
    for least in (1, 12, 1000):
        assert run(frame, least, 7) == brute([r[1:4] for r in rows], least, 7)


def test_nulls_ties_and_repeated_rows(llm, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("text", "lang", "source").collect()]
    for least in (1, 2):
        assert run(odd_docs, least) == brute(rows, least)


def test_no_documents(llm, no_docs):
    assert run(no_docs, 1) == []


def test_many_sources_in_small_batches(llm, monkeypatch):
    """Paths longer than the first width, corrections emitted in parts."""
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rows = corpus(3, 600, [f"s{i:02}" for i in range(40)])
    frame = llm.createDataFrame(rows, SCHEMA)
    assert run(frame, 5) == brute([r[1:4] for r in rows], 5)


def test_equal_rows_are_one_path(llm):
    """A thousand terms that all sources use alike are a single row of the tree."""
    text = " ".join(f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}x" for i in range(1000))
    rows = [(i, text, "en", s, 1) for i, s in enumerate("abcd")]
    frame = llm.createDataFrame(rows, SCHEMA)
    assert run(frame, 4) == brute([r[1:4] for r in rows], 4)
