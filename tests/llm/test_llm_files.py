import os

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfline.llm import plane_files, separator_scan

PATH = tokenizers.path("word_bpe_49k.json")


def library():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_same_ids_as_the_library():
    ours, theirs = plane_files.WordTokenizer(PATH), library()
    texts = ["", " ", "I'll don't.", "<|endoftext|> x", "ΑΣ. ΌΣΟΣ, á", "x" * 5000, "a\x1cb", "İ, ड़."]
    for start in range(0, 0x3000, 53):
        for mark in ("", ",", "'s", "́", " "):
            texts.append("".join(f"é{chr(c)}{mark}" for c in range(start, start + 53)))
    for text in texts:
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    planes = plane_files.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (plane_files.from_planes(planes, n, bits) == ids).all()


def check(llm, docs, folder, bits):
    plane_files.write_token_files(docs, folder, PATH, 2, bits=bits)
    rows = sorted(plane_files.read_token_files(llm, folder, bits).collect(), key=lambda r: r["start"])
    theirs, at = library(), 0
    expected = [
        (r["doc_id"], theirs.encode(r["text"] or "", add_special_tokens=False).ids + [2])
        for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    ]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert [g[0] for g in got] == [e[0] for e in expected]
    for row in rows:
        assert row["start"] == at and row["n_tokens"] == len(row["ids"]) // 4
        at += row["n_tokens"]


@pytest.mark.parametrize("bits", [True, False])
def test_files(llm, odd_docs, documents, no_docs, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(plane_files, "BLOCK_IDS", 64)
    check(llm, odd_docs.filter("doc_id < 6 OR doc_id IS NULL"), str(tmp_path / "odd"), bits)
    check(llm, documents, str(tmp_path / "docs"), bits)
    check(llm, no_docs, str(tmp_path / "none"), bits)


# --- separator scan ---------------------------------------------------------


def brute(folder, separator, kind):
    rows = []
    for name in os.listdir(folder):
        if not name.startswith("part-"):
            continue
        ids = np.fromfile(f"{folder}/{name}", kind).tolist()
        start, number = 0, 0
        for place, value in enumerate(ids):
            if value == separator:
                rows.append((name, number, start, place - start))
                start, number = place + 1, number + 1
        if start < len(ids):
            rows.append((name, number, start, len(ids) - start))
    return sorted(rows)


def scanned(llm, folder, separator, kind, block):
    found = separator_scan.scan_token_files(llm, folder, separator, kind, block)
    return sorted((os.path.basename(r[0]), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 18])
def test_scan_of_plain_files(llm, tmp_path, block):
    rng = np.random.default_rng(block)
    for i, n in enumerate([0, 1, 2, 9, 50, 333]):
        ids = rng.integers(0, 4, n)
        ids.astype("<u4").tofile(tmp_path / f"part-{i}.bin")
    np.full(20, 3, "<u4").tofile(tmp_path / "part-8.bin")
    np.full(20, 1, "<u4").tofile(tmp_path / "part-9.bin")
    assert scanned(llm, str(tmp_path), 3, "<u4", block) == brute(tmp_path, 3, "<u4")


def test_written_files(llm, tmp_path):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 50257, n).tolist() for n in (0, 1, 5, 0, 4000, 2)] + [None]
    frame = llm.createDataFrame([(x,) for x in lists], "ids array<int>").repartition(2)
    folder = str(tmp_path / "flat")
    separator_scan.write_flat_files(frame, folder, 50304)
    rows = scanned(llm, folder, 50304, ">u2", 11)
    assert rows == brute(folder, 50304, ">u2")
    assert sorted(r[3] for r in rows) == sorted(len(x or []) for x in lists)
    raw = b"".join(open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    ids = np.frombuffer(raw, ">u2")
    assert sorted(ids.tolist()) == sorted([t for x in lists for t in x or []] + [50304] * len(lists))
    with pytest.raises(Exception, match="separator"):
        separator_scan.write_flat_files(llm.createDataFrame([([50304],)], "ids array<int>"), f"{folder}2", 50304)
    empty = frame.limit(0)
    separator_scan.write_flat_files(empty, f"{folder}3", 50304)
    assert scanned(llm, f"{folder}3", 50304, ">u2", 5) == []


def test_remembered_words_leave_an_executor_room():
    """Two workers beside a heap of 1,800 MB of 3,000: the words of either stay under 200 MB."""
    import tracemalloc

    encoder, n = plane_files.WordTokenizer(PATH), 20_000
    tracemalloc.start()
    try:
        for i in range(n):
            encoder.encode(f"an wörd{i * 7919:x}abcdef")
        held = tracemalloc.get_traced_memory()[0] / len(encoder._known)
    finally:
        tracemalloc.stop()
    assert 2 * plane_files._REMEMBERED * held < 200 << 20


def test_words_are_remembered_in_utf8():
    """White space is that of ASCII: a text's bytes are split, and no word is held as a string."""
    encoder = plane_files.WordTokenizer(PATH, special_as_text=False)
    texts = ["a\x1cb \x85c d e\tf\x0bg\x0ch\r\ni", "École, naïve! é", " \t", "", "x́ <|endoftext|>y don't."]
    for text in texts * 2:
        plain = encoder._tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == plain
    assert encoder._known and all(type(word) is bytes for word in encoder._known)
