import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfline.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def text_of(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """The root, and for each leaf the (before, after) of each level."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 16 * 16
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, text, lang, source, n_chars)."""
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        others = "".join(text_of(v) for v in (doc_id, source, lang, n_chars))
        leaf = sha(others, text_of(text))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        shown = sha(others, text_of(lower(text))) if bad else leaf
        sources[source].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, shown))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf for _, _, leaf, _ in sorted(sources[s])]) for s in names]
    root, above = tree([t[0] for t in trees])
    found = []
    for name, (subroot, paths), upper in zip(names, trees, above):
        for (_, doc_id, leaf, shown), path in zip(sorted(sources[name]), paths):
            for before, after in path + upper:
                shown = sha(before, shown, after)
            proof = sha(*[b + a for b, a in path + upper])
            found.append((doc_id, leaf, subroot, root, proof, shown))
    return sorted(map(repr, found))


def run(llm, tmp_path, docs):
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries._op11_merkle_manifest(llm, str(tmp_path)).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted(
        repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]))
        for r in rows
    )


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_nulls_ties_and_repeated_rows(llm, tmp_path, odd_docs):
    assert run(llm, tmp_path, odd_docs) == brute(plain(odd_docs))


def test_no_documents(llm, tmp_path, no_docs):
    assert run(llm, tmp_path, no_docs) == []


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_a_single_source(llm, tmp_path, n):
    rows = [(i, f"Text {i}", "en", None, i) for i in range(n)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert run(llm, tmp_path, docs) == brute(rows)


def test_tiers_of_small_blocks(llm, tmp_path, monkeypatch):
    """With one level a block the trees of documents and of sources take several tiers each."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, f"Text {i}", "en", f"s{i % 40:02}" if i % 3 else "hot", i) for i in range(1000)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert run(llm, tmp_path, docs) == brute(rows)


def test_ranks_span_partitions(llm):
    rows = [("a", i) for i in range(3)] + [("b", i) for i in range(5000)] + [(None, 1), ("c", 0), ("c", 1)]
    frame = llm.createDataFrame(rows, "g string, v bigint").repartition(7)
    found, largest = merkle.ranked(frame, "g", ["v"])
    assert largest == 5000
    assert found.filter("_rank <> v - IF(g IS NULL, 1, 0)").count() == 0


def test_no_join_but_of_the_partitions(llm, documents):
    leaves = documents.select("doc_id", "source", merkle.row_digest([F.col("text")]).alias("leaf"))
    plan = merkle.manifest(leaves)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
