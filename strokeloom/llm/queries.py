"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from strokeloom.llm import chat, fingerprint, jaccard, langid, linededup, mixing, packing, quality, substring, warc


def queries() -> dict:
    return {
        "op1_line_dedup": linededup.query,
        "op2_chat_formatting": chat.query,
        "op3_quality_rules": quality.query,
        "op4_language_id": langid.query,
        "op5_packing": packing.query,
        "op6_warc": warc.query,
        "op7_ngram_jaccard": jaccard.query,
        "op8_mixing": mixing.query,
        "op9_substring_dedup": substring.query,
        "op10_fingerprints": fingerprint.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": linededup.ORACLE, "op2_chat_formatting": chat.ORACLE, "op3_quality_rules": quality.ORACLE, "op6_warc": warc.ORACLE, "op7_ngram_jaccard": jaccard.ORACLE, "op8_mixing": mixing.ORACLE, "op9_substring_dedup": substring.ORACLE}
