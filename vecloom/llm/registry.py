"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from vecloom.llm import licenses, linededup, mixing, packing, pii, quality, simhash, spotsigs, toxicity, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_linededup": linededup.op6_linededup,
    "op7_licenses": licenses.op7_licenses,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
    "spotsigs_classes": spotsigs.spotsigs_classes,
}

ORACLES = {
    "op1_quality": quality.ORACLE,
    "op2_spotsigs": spotsigs.ORACLE,
    "op10_warc": warc.ORACLE,
}
