"""The numbered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, collocations, decontaminate, html_extract, jaccard_join, language_id, line_dedup, mixing, sharding, substring, token_counts, warc_zip, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_lines": line_dedup.op2_lines,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_substring": substring.op4_substring,
    "op5_language": language_id.op5_language,
    "op6_html": html_extract.op6_html,
    "op7_ann": ann.op7_ann,
    "op8_warc": warc_zip.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_jaccard": jaccard_join.op10_jaccard,
    "op11_tokens": token_counts.op11_tokens,
    "op12_whitening": whitening.op12_whitening,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES: dict[str, str] = {
    "op2_lines": line_dedup.ORACLE,
    "op9_mixing": mixing.oracle(),
    "op8_warc": warc_zip.ORACLE,
    "op13_collocations": collocations.oracle(),
}
