"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ledger_spark.llm import (blob_ledger, bpe_codec, conversation_repair, decontaminate, jaccard_join, kneser_ney, language_crf,
                              projection_forest, skip_chain_pii, token_files, trie_bpe, vector_codes, warc_bundles)

QUERIES = {
    "op1_warc_bundles": warc_bundles.op1,
    "op2_language_crf": language_crf.op2,
    "op3_projection_forest": projection_forest.op3,
    "op4_bpe_codec": bpe_codec.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op6_blob_ledger": blob_ledger.op6,
    "op7_skip_chain_pii": skip_chain_pii.op7,
    "op8_token_files": token_files.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_kneser_ney": kneser_ney.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_trie_bpe": trie_bpe.op12,
    "op13_conversation_repair": conversation_repair.op13,
}

ORACLES = {
    "op1_warc_bundles": warc_bundles.SQL1,
    "op6_blob_ledger": blob_ledger.SQL6,
    "op11_vector_codes": vector_codes.SQL11,
    "op13_conversation_repair": conversation_repair.SQL13,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
