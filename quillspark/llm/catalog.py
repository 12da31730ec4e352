"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import alignment, ann, decontamination, hard_negatives, line_dedup, near_dedup, packing, pii, quality, repeats, sharding, tokens, url_filter

QUERIES = {
    "op1_near_duplicates": near_dedup.op1_near_duplicates,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_pii": pii.op4_pii,
    "op5_bpe": tokens.op5_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_repeats": repeats.op7_repeats,
    "op8_shards": sharding.op8_shards,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_nearest": ann.op10_nearest,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_alignment": alignment.op12_alignment,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_near_duplicates": near_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_repeats": repeats.ORACLE,
    "op8_shards": sharding.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
