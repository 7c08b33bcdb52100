"""Registry of the training-data queries; `__spark_entry__` reads it if this subpackage is there."""

from __future__ import annotations

from sheafmill.llm import op1_licenses, op2_langid, op3_secrets, op4_token_store, op5_jaccard, op6_media, op7_quality, op8_mixture, op9_warc, op10_subwords, op11_trie, op12_middle, op13_exact

QUERIES = {
    "op1_license_scan": op1_licenses.op1_license_scan,
    "op2_language_id": op2_langid.op2_language_id,
    "op3_secret_scan": op3_secrets.op3_secret_scan,
    "op4_token_store": op4_token_store.op4_token_store,
    "op5_jaccard_join": op5_jaccard.op5_jaccard_join,
    "op6_media_chunks": op6_media.op6_media_chunks,
    "op7_quality_rules": op7_quality.op7_quality_rules,
    "op8_source_mixture": op8_mixture.op8_source_mixture,
    "op9_warc_archive": op9_warc.op9_warc_archive,
    "op10_subword_samples": op10_subwords.op10_subword_samples,
    "op11_prefix_trie": op11_trie.op11_prefix_trie,
    "op12_fill_in_middle": op12_middle.op12_fill_in_middle,
    "op13_exact_dedup": op13_exact.op13_exact_dedup,
}
ORACLE_SQL = {
    "op5_jaccard_join": op5_jaccard.ORACLE,
    "op7_quality_rules": op7_quality.ORACLE,
    "op8_source_mixture": op8_mixture.ORACLE,
    "op11_prefix_trie": op11_trie.ORACLE,
    "op12_fill_in_middle": op12_middle.ORACLE,
    "op13_exact_dedup": op13_exact.ORACLE,
}
