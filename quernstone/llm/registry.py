"""Queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .bpe_codec import op11_bpe_codec
from .decontamination import op8_decontamination
from .language_id import op6_language_id
from .license_scan import op7_license_scan
from .line_dedup import op9_line_dedup
from .merkle import op13_merkle_manifest
from .ngram_join import op5_ngram_join
from .packing import op4_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import op2_quality_rules
from .spelling import op12_spelling_variants
from .token_counts import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality_rules, op3_quality_classifier, op4_packing, op5_ngram_join, op6_language_id, op7_license_scan, op8_decontamination, op9_line_dedup, warc.op10_warc, op11_bpe_codec, op12_spelling_variants, op13_merkle_manifest)
}

ORACLE_SQL: dict[str, str] = {"op10_warc": warc.ORACLE_SQL}
