"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lintlake.llm import bpe, decontam, embed, kneser, langid, lines, packing, phrases, repeats, shingles, toxicity, trie, warc

QUERIES = {
    "op1_warc_transactions": warc.op1_warc_transactions,
    "op2_suffix_array_dedup": repeats.op2_suffix_array_dedup,
    "op3_embedding_near_dedup": embed.op3_embedding_near_dedup,
    "op4_language_fusion": langid.op4_language_fusion,
    "op5_benchmark_decontamination": decontam.op5_benchmark_decontamination,
    "op6_ngram_jaccard_join": shingles.op6_ngram_jaccard_join,
    "op7_bpe_roundtrip": bpe.op7_bpe_roundtrip,
    "op8_kneser_ney_scores": kneser.op8_kneser_ney_scores,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_toxicity_crf": toxicity.op10_toxicity_crf,
    "op11_phrase_mining": phrases.op11_phrase_mining,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_first_fit_packing": packing.op13_first_fit_packing,
}
ORACLES = {
    "op1_warc_transactions": warc.ORACLE_OP1,
    "op3_embedding_near_dedup": embed.ORACLE_OP3,
    "op5_benchmark_decontamination": decontam.ORACLE_OP5,
    "op11_phrase_mining": phrases.ORACLE_OP11,
    "op12_conversation_trie": trie.ORACLE_OP12,
}
