"""Queries of this subpackage and their SQL."""

from . import bpe, conversation_repair, embedding_dedup, hard_negatives, html_extract, mixing, ngram_join, oracles, packing, quality_cnn, quality_rules, substring_dedup, token_output, url_filter

QUERIES = {
    "op3_html_extract": html_extract.op3_html_extract,
    "op9_quality_cnn": quality_cnn.op9_quality_cnn,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op1_bpe": bpe.op1_bpe,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op6_token_output": token_output.op6_token_output,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_mix_sources": mixing.op12_mix_sources,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLE_SQL = {
    "op2_substring_dedup": oracles.OP2_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_quality_rules": oracles.OP7_SQL,
    "op8_ngram_join": oracles.OP8_SQL,
    "op10_embedding_dedup": oracles.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_mix_sources": mixing.OP12_SQL,
    "op13_conversation_repair": oracles.OP13_SQL,
}
