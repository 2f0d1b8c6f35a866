"""The corpus operators as registered queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import table

#: Names of the public vocabularies; their folder is a parameter of the operators.
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.rules import BASE, quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.huffman import huffman_roundtrip

    return huffman_roundtrip(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.warc import warc_roundtrip

    return warc_roundtrip(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.bpe import bpe_roundtrip

    return bpe_roundtrip(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict:
    return {
        "op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_rules": op3_rules,
        "op4_huffman": op4_huffman, "op5_warc": op5_warc, "op6_packing": op6_packing,
        "op7_licenses": op7_licenses,
        "op8_exact_dedup": op8_exact_dedup, "op9_bpe": op9_bpe, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": r"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
            d AS (
                SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c:
                           ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits
                FROM p),
            b AS (
                SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
                           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
                           + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest
                FROM d)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
                   CASE WHEN page_id = min(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = min(page_id) OVER (PARTITION BY payload_digest) THEN NULL ELSE min(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
            FROM b""",
        "op8_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
            FROM d""",
    }
