"""Queries and SQL twins of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from vetstone.llm import op01_toxicity, op02_secret_ledger, op03_decontamination, op04_mpeg_audio, op05_packing, op06_minhash, op07_line_dedup, op08_suffix_dedup, op09_substring_dedup, op10_cotraining

QUERIES = {
    "op1_toxicity": op01_toxicity.op1_toxicity,
    "op2_secret_ledger": op02_secret_ledger.op2_secret_ledger,
    "op3_decontamination": op03_decontamination.op3_decontamination,
    "op4_mpeg_audio": op04_mpeg_audio.op4_mpeg_audio,
    "op5_packing": op05_packing.op5_packing,
    "op6_minhash": op06_minhash.op6_minhash,
    "op7_line_dedup": op07_line_dedup.op7_line_dedup,
    "op8_suffix_dedup": op08_suffix_dedup.op8_suffix_dedup,
    "op9_substring_dedup": op09_substring_dedup.op9_substring_dedup,
    "op10_cotraining": op10_cotraining.op10_cotraining,
}

#: Where SQL can express the whole result.
SQL = {
    "op2_secret_ledger": op02_secret_ledger.SQL,
    "op7_line_dedup": op07_line_dedup.SQL,
    "op9_substring_dedup": op09_substring_dedup.SQL,
}
