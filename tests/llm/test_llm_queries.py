import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shelfline.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(llm, name):
    result = queries.queries()[name](llm, SF_DIR)
    columns = sorted(result.columns)
    rows = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = connection.execute(queries.ORACLE_SQL[name])
    names = [column[0] for column in cursor.description]
    places = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(row[i] for i in places)) for row in cursor.fetchall())
    assert sorted(names) == columns


CONTRACT = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op6_plane_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_site_style": "page_id bigint, url string, text string, n_chars bigint",
    "op8_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_rare_features": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean",
    "op12_hilbert_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(llm, name):
    result = queries.queries()[name](llm, SF_DIR)
    found = {f.name: f.dataType.simpleString() for f in result.schema}
    for column in CONTRACT[name].split(", "):
        column, kind = column.split()
        assert found.get(column) == kind, column
    if "doc_id" in found:
        docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
        ids = sorted(r["doc_id"] for r in result.select("doc_id").collect())
        assert ids == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_token_digests(llm):
    """ids_sha256, decoded_sha256, start and ids_crc32 against the libraries themselves."""
    found = {r["doc_id"]: r for r in queries.queries()["op1_byte_bpe"](llm, SF_DIR).collect()}
    planes = {r["doc_id"]: r for r in queries.queries()["op6_plane_files"](llm, SF_DIR).collect()}
    with open(queries.BPE_RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    theirs = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words, start = Tokenizer.from_file(queries.WORD_BPE), 0
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    for doc in docs:
        text, row, plane = doc["text"] or "", found[doc["doc_id"]], planes[doc["doc_id"]]
        ids = theirs.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        ids = [*words.encode(text, add_special_tokens=False).ids, queries.WORD_BPE_END]
        assert (plane["start"], plane["n_tokens"]) == (start, len(ids))
        assert plane["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
