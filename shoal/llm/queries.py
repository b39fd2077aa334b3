"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, minhash, mixing, packing, quality, spans, suffix_dedup, token_files, topk, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_token_files": token_files.op6_token_files,
    "op7_topk": topk.op7_topk,
    "op8_sentence_spans": spans.op8_sentence_spans,
    "op9_near_dedup": minhash.op9_near_dedup,
    "op10_quality": quality.op10_quality,
}

ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op5_warc": warc.ORACLE, "op7_topk": topk.ORACLE}
