"""The training-data operators as queries over the test tables, with DuckDB SQL where it can
express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import (
    bpe,
    divergence,
    exact_dedup,
    hilbert,
    jaccard_join,
    merkle,
    mixing,
    perspectives,
    plane_files,
    rare_features,
    separator_scan,
    site_style,
    toxicity,
)
from shelfline.llm.common import UPPER, configure, table
from shelfline.session import shared_folder

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD_BPE_END = 2
SEPARATOR = 50304  # the first multiple of 64 above the ranks


def _op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encoded = bpe.encode(docs, BPE_RANKS, public_tokenizers.PATTERN, ["doc_id"])
    decoded = bpe.decode(encoded, BPE_RANKS, public_tokenizers.PATTERN, ["doc_id", "ids"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias(
            "ids_sha256"
        ),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def _op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, models, ["doc_id"]).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def _op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def _op6_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-planes")
    plane_files.write_token_files(table(spark, sf_dir, "documents"), folder, WORD_BPE, WORD_BPE_END)
    return plane_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def _op7_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = site_style.extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def _op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def _op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "flat-tokens")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN, ["doc_id"])
    separator_scan.write_flat_files(encoded, folder, SEPARATOR, doc_id="doc_id")
    return separator_scan.scan_documents(spark, folder, SEPARATOR)


def _op10_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.edited_fingerprints(table(spark, sf_dir, "documents"))


def _op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is tampered with where 5 divides the crc32 of its id; one without an id never is."""
    docs = table(spark, sf_dir, "documents")
    others = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", UPPER, UPPER.lower())
    leaves = docs.select(
        "doc_id",
        "source",
        merkle.row_digest([*others, F.col("text")]).alias("leaf"),
        F.when(tampered, merkle.row_digest([*others, lowered])).alias("tampered"),
    )
    path = F.col("path")
    proven = merkle.manifest(leaves).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(path).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), path).alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_FOLDED = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

def _tree_sql(name: str, start: str, levels: int) -> str:
    """CTEs {name}0..: per level (g, r, n, digest) and the digests beside each node."""
    parts = [f"{name}0 AS ({start})"]
    for k in range(levels):
        run = "PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN"
        parts.append(f"""{name}_beside{k} AS (
            SELECT g, r, n > 1 AS hashed, coalesce(string_agg(digest, '') OVER
                    ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(digest, '') OVER
                    ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS (
            SELECT g, r // 16 AS r, (n + 15) // 16 AS n,
                CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY r)) ELSE min(digest) END
                    AS digest
            FROM {name}{k} GROUP BY g, r // 16, n)""")
    return ", ".join(parts)


def _merkle_sql(levels: int = 8, source_levels: int = 6) -> str:
    """Trees of up to 16 ** levels documents a source and 16 ** source_levels sources."""

    def digest(text: str) -> str:
        fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    crc = """xor(list_reduce([ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
        lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
        4294967295::BIGINT), 4294967295::BIGINT)"""
    lowered = digest(f"translate(text, '{UPPER}', '{UPPER.lower()}')")
    steps = [("t", k) for k in range(levels)] + [("s", k) for k in range(source_levels)]
    joins, proof = "", []
    for i, (tree, k) in enumerate(steps):
        b = f"b{i}"
        at = f"{b}.g = l.g AND {b}.r = l.r // {16**k}" if tree == "t" else f"{b}.r = l.g // {16**k}"
        joins += f" JOIN {tree}_beside{k} {b} ON {at}"
        proof.append(f"{b}.before || {b}.after")
    layers = "SELECT l.*, " + " || ".join(proof) + " AS proof, " + ", ".join(
        f"b{i}.hashed AS h{i}, b{i}.before AS x{i}, b{i}.after AS y{i}" for i in range(len(steps))
    ) + f" FROM leaves l{joins}"
    for i in range(len(steps)):
        layers = f"SELECT * REPLACE (CASE WHEN h{i} THEN sha256(x{i} || shown || y{i}) ELSE shown END AS shown) FROM ({layers})"
    start = "SELECT g, r, n, leaf AS digest FROM leaves"
    sources = f"SELECT 0 AS g, g AS r, count(*) OVER () AS n, digest FROM t{levels}"
    return f"""
        WITH leaves AS (
            SELECT doc_id, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS shown,
                dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
                count(*) OVER (PARTITION BY source) AS n
            FROM (SELECT *, {digest('text')} AS leaf, {lowered} AS lowered, {crc} AS crc FROM documents)
        ), {_tree_sql("t", start, levels)}, {_tree_sql("s", sources, source_levels)}
        SELECT p.doc_id, p.leaf, t.digest AS subroot, s.digest AS root,
            sha256(p.proof) AS proof_sha256, p.shown AS folded_root, p.shown = s.digest AS verified
        FROM ({layers}) p JOIN t{levels} t ON t.g = p.g JOIN s{source_levels} s ON true"""


_DIVERGENCE_SQL = rf"""
    WITH docs AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), kept AS (
        SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs)
        GROUP BY ALL HAVING count(*) >= 30
    ), sources AS (
        SELECT DISTINCT lang, source FROM docs
    ), used AS (
        SELECT lang, source, term, count(*) AS n
        FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
    ), counted AS (
        SELECT s.lang, s.source, k.term, coalesce(n, 0)::HUGEINT AS n
        FROM sources s JOIN kept k ON k.lang = s.lang
        LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term
    ), shares AS (
        SELECT *, 1 + 1000000000 * (n + 5)
                // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
        FROM counted
    ), of_langs AS (
        SELECT lang, term, 1 + 1000000000 * (sum(n) + 5)
                // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
        FROM counted GROUP BY lang, term
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item
        FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    ), sums AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL
    ), found AS (
        SELECT p.lang, p.source, part, p.item, coalesce(value, 0)::BIGINT AS value
        FROM pairs p LEFT JOIN sums s ON s.lang = p.lang AND s.source = p.source AND s.item = p.item
        UNION ALL
        SELECT lang, source, 'term', term, (p - q)::BIGINT
        FROM shares JOIN of_langs USING (lang, term) WHERE n > 0 AND p > q
    )
    SELECT * FROM (
        SELECT *, (row_number() OVER
            (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM found
    ) WHERE part = 'pair' OR rank <= 50"""

ORACLE_SQL = {
    "op13_source_divergence": _DIVERGENCE_SQL,
    "op11_merkle_manifest": _merkle_sql(),
    "op4_perspectives": """
        WITH people AS (
            SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'
        ), rotated AS (
            SELECT c.conv_id, perspective, turn, coalesce(text, '') AS said,
                   CASE WHEN role = perspective THEN 'assistant'
                        WHEN role = 'system' THEN 'system' ELSE 'user' END AS shown,
                   CASE WHEN role IS NULL OR role IN (perspective, 'system') THEN NULL
                        ELSE role END AS name
            FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
        ), headed AS (
            SELECT *, '<|im_start|>' || shown || coalesce(' name=' || name, '') || chr(10) AS head
            FROM rotated
        )
        SELECT conv_id, perspective, turn, shown AS role, name,
               head || said || '<|im_end|>' || chr(10) AS rendered,
               CASE WHEN shown = 'assistant' THEN length(head) ELSE 0 END::INTEGER AS mask_start,
               CASE WHEN shown = 'assistant' THEN length(head || said) + 10 ELSE 0 END::INTEGER
                   AS mask_end
        FROM headed""",
    "op5_exact_dedup": f"""
        WITH folded AS (SELECT doc_id, {_FOLDED} AS folded FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY folded) AS keep_id,
               count(*) OVER (PARTITION BY folded) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY folded) AS kept,
               sha256(folded) AS text_sha256
        FROM folded""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_byte_bpe": _op1_byte_bpe,
        "op2_mix_sources": _op2_mix_sources,
        "op3_toxicity": _op3_toxicity,
        "op4_perspectives": _op4_perspectives,
        "op5_exact_dedup": _op5_exact_dedup,
        "op6_plane_files": _op6_plane_files,
        "op7_site_style": _op7_site_style,
        "op8_jaccard_join": _op8_jaccard_join,
        "op9_separator_scan": _op9_separator_scan,
        "op10_rare_features": _op10_rare_features,
        "op11_merkle_manifest": _op11_merkle_manifest,
        "op12_hilbert_neighbours": _op12_hilbert_neighbours,
        "op13_source_divergence": _op13_source_divergence,
    }
    return {name: _configured(query) for name, query in found.items()}


def _configured(
    query: Callable[[SparkSession, str], DataFrame],
) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run
