"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from txloom.llm import ann, bpe, hardneg, jaccard, langid, lexical, lm, media, packing, substring, tokenfile, toxicity, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_packing": packing.op2_packing,
    "op3_media_copies": media.op3_media_copies,
    "op4_lm_score": lm.op4_lm_score,
    "op5_ann": ann.op5_ann,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_url_filter": urls.op7_url_filter,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_langid": langid.op10_langid,
    "op11_token_frames": tokenfile.op11_token_frames,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op4_lm_score": lm.OP4_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op8_substring_dedup": substring.OP8_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
