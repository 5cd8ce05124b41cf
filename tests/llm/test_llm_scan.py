import os

import numpy as np

from shelfline.llm import queries, separator_scan

SF_DIR = "/root/testdata/sf0.001"


def test_files_are_read_by_ranges(llm, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 40, 100_001).astype("<u4")
    ids.tofile(tmp_path / "part-0.bin")
    # Whoever asks for a whole file fails.
    llm.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = separator_scan.scan_token_files(llm, str(tmp_path), 3, "<u4", 777).collect()
    finally:
        llm.conf.unset("spark.sql.sources.binaryFile.maxLength")
    ends = np.flatnonzero(ids == 3)
    starts = np.concatenate([[0], ends + 1])
    sizes = np.append(ends, len(ids)) - starts
    want = [(i, s, n) for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())) if s < len(ids)]
    assert sorted((r["document"], r["start"], r["n_tokens"]) for r in found) == want
    monkeypatch.setattr(separator_scan, "_ranged", lambda path: False)
    whole = separator_scan.scan_token_files(llm, str(tmp_path), 3, "<u4", 777).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, found))


def test_documents_keep_their_ids(llm, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i % 50 if i % 9 else None, rng.integers(0, 50257, i % 37).tolist() if i % 11 else None) for i in range(3000)]
    frame = llm.createDataFrame(rows, "doc_id bigint, ids array<int>").repartition(3)
    separator_scan.write_flat_files(frame, str(tmp_path / "flat"), 50304, doc_id="doc_id")
    found = separator_scan.scan_documents(llm, str(tmp_path / "flat"), 50304, block_ids=100)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in found.collect()], key=key) == sorted(
        [(d, len(x or [])) for d, x in rows], key=key
    )
    assert len([n for n in os.listdir(tmp_path / "flat" / "kind=ids") if n.startswith("part-")]) == 3
    separator_scan.write_flat_files(frame.limit(0), str(tmp_path / "none"), 50304, doc_id="doc_id")
    assert separator_scan.scan_documents(llm, str(tmp_path / "none"), 50304).count() == 0


def test_query_ties_counts_to_documents(llm):
    found = queries.queries()
    counts = {r["doc_id"]: r["n_tokens"] for r in found["op9_separator_scan"](llm, SF_DIR).collect()}
    assert counts == {r["doc_id"]: r["n_tokens"] for r in found["op1_byte_bpe"](llm, SF_DIR).collect()}
