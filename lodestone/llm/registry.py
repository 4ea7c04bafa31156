"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_words import op5_bpe_words
from .chat_preference import OP10_SQL, op10_preference_format
from .divergence import OP11_SQL, op11_source_divergence
from .fuzzy_lines import op4_fuzzy_lines
from .jaccard_forest import OP8_SQL, op8_jaccard_forest
from .jpeg_media import op1_jpeg_media
from .language_id import op6_language_id
from .license_scan import op2_license_scan
from .mixing import op7_source_mix
from .packing import op12_mixture_packing
from .repeats_rlindex import OP9_SQL, op9_repeats_rlindex
from .spelling import OP13_SQL, op13_spelling_variants
from .topk_fagin import OP3_SQL, op3_topk_fagin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_jpeg_media,
        op2_license_scan,
        op3_topk_fagin,
        op4_fuzzy_lines,
        op5_bpe_words,
        op6_language_id,
        op7_source_mix,
        op8_jaccard_forest,
        op9_repeats_rlindex,
        op10_preference_format,
        op11_source_divergence,
        op12_mixture_packing,
        op13_spelling_variants,
    )
}

SQL = {"op3_topk_fagin": OP3_SQL, "op8_jaccard_forest": OP8_SQL, "op9_repeats_rlindex": OP9_SQL, "op10_preference_format": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_spelling_variants": OP13_SQL}
