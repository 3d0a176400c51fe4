"""The queries of this subpackage and their SQL, by name."""

from loomery.llm import decontaminate, jaccard_join, line_dedup, neighbours, packing, quality, sampled_pieces, sharding, source_audit, token_records, toxicity, warc, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_records": token_records.op4_token_records,
    "op5_nearest_neighbours": neighbours.op5_nearest_neighbours,
    "op6_quality": quality.op6_quality,
    "op7_sampled_pieces": sampled_pieces.op7_sampled_pieces,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_packing": packing.op11_packing,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_ngram_jaccard": jaccard_join.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_source_audit": source_audit.OP12_SQL,
}
