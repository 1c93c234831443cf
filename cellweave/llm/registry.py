"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from cellweave.llm import chat_rotation, decontamination, interpolation, packing, permutation_index, quality, sharding, simhash, token_counts, warc

QUERIES = {
    "op1_deleted_interpolation": interpolation.op1_deleted_interpolation,
    "op2_quality_cotraining": quality.op2_quality_cotraining,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_permutation_index": permutation_index.op5_permutation_index,
    "op6_hierarchical_sharding": sharding.op6_hierarchical_sharding,
    "op7_chat_rotation": chat_rotation.op7_chat_rotation,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_warc_reassembly": warc.op10_warc_reassembly,
}

ORACLE_SQL = {
    "op3_benchmark_decontamination": decontamination.OP3_SQL,
    "op7_chat_rotation": chat_rotation.OP7_SQL,
    "op10_warc_reassembly": warc.OP10_SQL,
}
