"""Queries of the training-data operators, with DuckDB SQL where that can express them."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .decontaminate import OP7_SQL, op7_decontaminate
from .divergence import OP12_SQL, op12_source_divergence
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .html_extract import op6_html_extract
from .language_id import op2_language_id
from .license_scan import OP13_SQL, op13_license_scan
from .mix_sources import OP3_SQL, op3_mix_sources
from .near_dedup import op5_minhash_near_dedup
from .secret_scan import op1_secret_scan
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .toxicity import op10_toxicity
from .warc import OP4_SQL, op4_warc_index

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_warc_index": op4_warc_index,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = {
    "op3_mix_sources": OP3_SQL,
    "op4_warc_index": OP4_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
