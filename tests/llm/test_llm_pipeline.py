from collections import Counter

import pytest

import corpus_pipeline
from shelfline.llm import toxicity

from test_llm_bpe import reference
from test_llm_jaccard import brute, shingle_set
from test_llm_mixing import expected_targets, words

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm, tmp_path_factory):
    """The input and the result of each stage, written and read as the pipeline does."""
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
    found = []
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        step(llm, docs, SF_DIR).write.parquet(path)
        after = llm.read.parquet(path)
        found.append((docs, after))
        docs = after
    return found


def rows(frame):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in frame.collect()]


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "jaccard_join", "mix_sources", "byte_bpe",
    ]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert set(rows(after)) <= set(rows(before))


def test_toxic_documents_go(llm, stages):
    docs, after = stages[0]
    models = toxicity.train(docs, llm.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = [r for r in rows(docs) if models.probability(r[1]) < 0.5]
    assert sorted(kept) == sorted(rows(after)) and len(kept) > 0.8 * docs.count()


def test_copies_go(stages):
    docs, after = stages[1]
    best = {}
    for row in sorted(rows(docs)):
        best["".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or "")] = row
    assert sorted(best.values()) == sorted(rows(after))


def test_near_copies_go(stages):

    docs, after = stages[2]
    stay = {c for _, n, c in brute([r[:2] for r in rows(docs)]) if n}
    kept = [r for r in rows(docs) if r[0] in stay or not shingle_set(r[1])]
    assert sorted(kept) == sorted(rows(after))


def test_mix(stages):

    docs, after = stages[3]
    sizes, taken = Counter(), Counter()
    for r in rows(docs):
        sizes[r[3]] += words(r[1])
    copies = Counter(rows(after))
    assert max(copies.values()) <= 3
    for row, n in copies.items():
        taken[row[3]] += n * words(row[1])
    for source, target in expected_targets(sizes).items():
        largest = max(words(r[1]) for r in rows(docs) if r[3] == source)
        assert abs(taken[source] - target) <= largest


def test_ids(stages):

    docs, after = stages[4]
    assert Counter(rows(docs)) == Counter(rows(after))
    theirs = reference()
    for r in after.collect():
        assert r["decodes"] and r["ids"] == theirs.encode_ordinary(r["text"] or "")


def test_odd_rows_pass_every_stage(llm, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, step in corpus_pipeline.STAGES:
            after = step(llm, docs, SF_DIR)
            assert set(docs.columns) <= set(after.columns)
            after.collect()
