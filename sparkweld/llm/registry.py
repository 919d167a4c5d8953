"""Queries of the corpus operators, by the name under which ``__spark_entry__`` registers them."""

from __future__ import annotations

from sparkweld.llm import bpe, decontaminate, fingerprints, language, licenses, quality, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_byte_bpe": bpe.query,
    "op3_fingerprints": fingerprints.query,
    "op4_quality": quality.query,
    "op5_decontamination": decontaminate.query,
    "op6_toxicity": toxicity.query,
    "op7_substrings": substrings.query,
    "op8_simhash": simhash.query,
    "op9_licenses": licenses.query,
    "op10_language": language.query,
}
#: The other queries need a tokenizer, a model, XXH64 fingerprints with components, or alignments, which DuckDB lacks.
ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op7_substrings": substrings.ORACLE}
