"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from cairnwork.llm import bpe, chaining, exact_dedup, html_extract, langid, minhash, packing, repetition, resampling, spelling, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_html": html_extract.op1_html,
    "op2_chaining": chaining.op2_chaining,
    "op3_langid": langid.op3_langid,
    "op4_bpe": bpe.op4_bpe,
    "op5_minhash": minhash.op5_minhash,
    "op6_packing": packing.op6_packing,
    "op7_repetition": repetition.op7_repetition,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_warc": warc.op10_warc,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_resampling": resampling.op12_resampling,
    "op13_spelling": spelling.op13_spelling,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op12_resampling": resampling.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
