"""The corpus operators' queries, over whole tables, and SQL where SQL can express them."""

from . import ann, langid, licenses, merkle, mixing, nearjoin, packing, pii, quality, tokenbin

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_binary": tokenbin.op3_token_binary,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_merkle_fingerprint": merkle.op6_merkle_fingerprint,
    "op7_ann_search": ann.op7_ann_search,
    "op8_language_id": langid.op8_language_id,
    "op9_pii_spans": pii.op9_pii_spans,
    "op10_jaccard_join": nearjoin.op10_jaccard_join,
}

ORACLES = {"op1_license_scan": licenses.oracle(), "op5_mix_sources": mixing.ORACLE}
