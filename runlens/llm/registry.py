"""Queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import codes, dedup, extract, fim, jaccard, langid, lexicon, packing, quality, rans, substring, topk, warc

QUERIES = {
    "op1_exact_dedup": dedup.op1_exact_dedup,
    "op2_max_subsequence_text": extract.op2_max_subsequence_text,
    "op3_bpe_lexicon": lexicon.op3_bpe_lexicon,
    "op4_rans_ids": rans.op4_rans_ids,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_impact_top_k": topk.op6_impact_top_k,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_bitmask_langid": langid.op8_bitmask_langid,
    "op9_warc_salvage": warc.op9_warc_salvage,
    "op10_quality_bayes": quality.op10_quality_bayes,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_laesa_codes": codes.op12_laesa_codes,
    "op13_automaton_substrings": substring.op13_automaton_substrings,
}
SQL = {"op1_exact_dedup": dedup.OP1_SQL, "op6_impact_top_k": topk.OP6_SQL, "op7_ngram_jaccard": jaccard.OP7_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_laesa_codes": codes.OP12_SQL, "op13_automaton_substrings": substring.OP13_SQL}
