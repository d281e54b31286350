"""Queries of the numbered operators: name -> function(spark, sf_dir), and the SQL for those that SQL can express."""

from . import bitplanes, bpe, codes, conversations, decontaminate, licences, ngrams, pages, quality, sharding, simhash, substrings, vectors
from .common import bounded_batches

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_bpe_encoding": bpe.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_html_extraction": pages.query,
    "op5_license_scans": licences.query,
    "op6_substring_dedup": substrings.query,
    "op7_kd_sharding": sharding.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_kmeans_tree_search": vectors.query,
    "op10_token_planes": bitplanes.query,
    "op11_vector_code_trie": codes.query,
    "op12_conversation_repair": conversations.query,
    "op13_ngram_jaccard_join": ngrams.query,
}

QUERIES = {name: bounded_batches(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": substrings.SQL,
    "op11_vector_code_trie": codes.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_ngram_jaccard_join": ngrams.SQL,
}
