"""The named queries of the corpus operators."""

from __future__ import annotations

from . import ann, crf, decontam, hosts, lattice, lexical, negatives, secrets, sharding, simhash, toxicity, warc, wfst


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_sentencepiece": wfst.op3_sentencepiece,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_secrets": secrets.op5_secrets,
        "op6_simhash": simhash.op6_simhash,
        "op7_learned_ann": ann.op7_learned_ann,
        "op8_language_id": crf.op8_language_id,
        "op9_kd_sharding": sharding.op9_kd_sharding,
        "op10_lattice_lm": lattice.op10_lattice_lm,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_host_rules": hosts.op13_host_rules,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_decontamination": decontam.OP2_SQL,
        "op11_lexical_search": lexical.OP11_SQL,
        "op12_hard_negatives": negatives.OP12_SQL,
        "op13_host_rules": hosts.OP13_SQL,
    }
