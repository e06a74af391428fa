"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, cascade, decontaminate, lattice_lm, licences, linkgraph, order_minhash, sharding, substring, warc

QUERIES = {
    "op1_order_minhash": order_minhash.op1_order_minhash,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_url_filters": linkgraph.op5_url_filters,
    "op6_sharding": sharding.op6_sharding,
    "op7_warc": warc.op7_warc,
    "op8_quality_rules": cascade.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_lm_scoring": lattice_lm.op10_lm_scoring,
}

ORACLES = {
    "op2_substring_dedup": substring.OP2_SQL,
    "op3_licence_scan": licences.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_url_filters": linkgraph.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_quality_rules": cascade.OP8_SQL,
}
