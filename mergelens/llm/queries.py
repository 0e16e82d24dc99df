"""The registered queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mergelens.llm import bottomk, decontaminate, licenses, periodic, pieces, quality, shards, simhash, spelling, substring, suffix, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": shards.op1_shards,
    "op2_simhash": simhash.op2_simhash,
    "op3_suffix": suffix.op3_suffix,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_substring": substring.op5_substring,
    "op6_quality": quality.op6_quality,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_licenses": licenses.op8_licenses,
    "op9_urls": urls.op9_urls,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic": periodic.op11_periodic,
    "op12_minhash": bottomk.op12_minhash,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {
    "op6_quality": quality.ORACLE,
    "op8_licenses": licenses.ORACLE,
}
