"""Registered queries of the operators and their DuckDB statements."""

from __future__ import annotations

from ordersight.llm import (ann, fingerprints, langid, merkle, mixing, packing, secret_scan, simhash_dedup, suffix_dedup,
                            toxicity, vector_packing, warc, whitening)

QUERIES = {
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_vector_packing": vector_packing.op11_vector_packing,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle": merkle.op13_merkle,
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ann": ann.op2_ann,
    "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_warc": warc.op6_warc,
    "op7_langid": langid.op7_langid,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
}

ORACLE = {
    "op13_merkle": merkle.ORACLE,
    "op4_secret_scan": secret_scan.ORACLE,
    "op6_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
