"""The registered queries of the text operators.

Only the manifest has SQL: alignments, compression, tokenizers and fitted models
cannot be written in it, or not at a speed that covers whole tables. The tests
hold each against a brute-force version.
"""

from __future__ import annotations

from cohortlab.llm.bpe import op5_bpe
from cohortlab.llm.chat import op3_chat_formatting
from cohortlab.llm.decontaminate import op9_decontamination
from cohortlab.llm.factorisation import op10_quality_classifier
from cohortlab.llm.interpolated_lm import op7_interpolated_lm
from cohortlab.llm.licenses import op2_license_scan
from cohortlab.llm.line_dedup import op8_substring_dedup
from cohortlab.llm.manifest import op12_merkle_manifest
from cohortlab.llm.oracle import ORACLE
from cohortlab.llm.order_minhash import op6_order_minhash
from cohortlab.llm.quality_rules import op1_quality_rules
from cohortlab.llm.resampling import op13_importance_resampling
from cohortlab.llm.suffix_dedup import op4_suffix_dedup
from cohortlab.llm.transducer import op11_transducer_bpe

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scan, op3_chat_formatting, op4_suffix_dedup, op5_bpe, op6_order_minhash,
        op7_interpolated_lm, op8_substring_dedup, op9_decontamination, op10_quality_classifier, op11_transducer_bpe,
        op12_merkle_manifest, op13_importance_resampling,
    )
}
