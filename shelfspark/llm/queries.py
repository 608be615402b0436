"""Queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from shelfspark.llm import byte_bpe, decontaminate, exact_dedup, merkle, ngram_join, pii, quality_cnn, secret_scan, sharding, token_files, url_filter, warc_zip, whitening

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_warc_zip": warc_zip.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_sharding": sharding.query,
    "op6_ngram_join": ngram_join.query,
    "op7_pii": pii.query,
    "op8_decontaminate": decontaminate.query,
    "op9_secret_scan": secret_scan.query,
    "op10_quality_cnn": quality_cnn.query,
    "op11_token_files": token_files.query,
    "op12_merkle": merkle.query,
    "op13_whitening": whitening.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op2_warc_zip": warc_zip.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_sharding": sharding.ORACLE_SQL,
    "op6_ngram_join": ngram_join.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op9_secret_scan": secret_scan.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
}
