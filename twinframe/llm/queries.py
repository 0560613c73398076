"""Registry of the training-data queries, and the SQL of those that SQL can express."""

from twinframe.llm import decontamination, exact_dedup, hard_negatives, licences, lm_scores, merkle, near_dedup, packing, secrets, simhash, token_counts, token_files, toxicity

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_licence_scans": licences.op9_licence_scans,
    "op10_lm_scores": lm_scores.op10_lm_scores,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_simhash_near_dedup": simhash.op12_simhash_near_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_minhash_near_dedup": near_dedup.SQL,
    "op10_lm_scores": lm_scores.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
