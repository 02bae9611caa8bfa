"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from chronofold.llm.audio_fingerprint import op10_audio_alignment
from chronofold.llm.chat_format import OP8_SQL, op8_chat_format
from chronofold.llm.decontaminate import OP4_SQL, op4_decontamination
from chronofold.llm.filter_audit import OP11_SQL, op11_filter_audit
from chronofold.llm.language_id import op6_language_id
from chronofold.llm.license_scan import op7_license_scan
from chronofold.llm.near_dedup import OP1_SQL, op1_near_duplicates
from chronofold.llm.ngram_join import OP13_SQL, op13_ngram_join
from chronofold.llm.packing import op3_pattern_packing
from chronofold.llm.record_files import op9_token_records
from chronofold.llm.source_tries import OP12_SQL, op12_source_divergence
from chronofold.llm.suffix_dedup import OP5_SQL, op5_suffix_repeats
from chronofold.llm.token_counts import op2_token_counts


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_counts": op2_token_counts,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_chat_format": op8_chat_format,
    "op9_token_records": op9_token_records,
    "op10_audio_alignment": op10_audio_alignment,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_ngram_join": op13_ngram_join,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": OP1_SQL, "op4_decontamination": OP4_SQL, "op5_suffix_repeats": OP5_SQL, "op8_chat_format": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_ngram_join": OP13_SQL}
