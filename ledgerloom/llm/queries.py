"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import dialogues, langid, mining, mixing, ngrams, packing, pieces, quality, rules, secrets, simhash, vectors, warc

QUERIES = {
    "op1_elias_fano_lm": ngrams.op1_elias_fano_lm,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_string_kernel_language": langid.op3_string_kernel_language,
    "op4_warc_round_trip": warc.op4_warc_round_trip,
    "op5_boosted_quality": quality.op5_boosted_quality,
    "op6_rule_ledger": rules.op6_rule_ledger,
    "op7_water_filling": mixing.op7_water_filling,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_int8_tiles": vectors.op10_int8_tiles,
    "op11_pattern_packing": packing.op11_pattern_packing,
    "op12_rotated_negatives": mining.op12_rotated_negatives,
    "op13_signature_repair": dialogues.op13_signature_repair,
    "rule_ablations": rules.rule_ablations,
    "mixture_targets": mixing.mixture_targets,
    "secret_base_counts": secrets.secret_base_counts,
}

ORACLES = {
    "op4_warc_round_trip": warc.OP4_SQL,
    "op6_rule_ledger": rules.OP6_SQL,
    "op10_int8_tiles": vectors.OP10_SQL,
    "op12_rotated_negatives": mining.OP12_SQL,
    "op13_signature_repair": dialogues.OP13_SQL,
    "rule_ablations": rules.ABLATIONS_SQL,
    "mixture_targets": mixing.TARGETS_SQL,
    "secret_base_counts": secrets.COUNTS_SQL,
}
