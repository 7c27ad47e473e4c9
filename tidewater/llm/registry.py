"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from tidewater.llm.decontamination import op5_decontamination
from tidewater.llm.html_text import op8_html_text
from tidewater.llm.jaccard_join import op3_ngram_jaccard
from tidewater.llm.language_id import op10_language_id
from tidewater.llm.media import op1_flac_media
from tidewater.llm.packing import op2_best_fit_packing
from tidewater.llm.pii import op6_pii_weak_supervision
from tidewater.llm.secrets import op9_secret_scan
from tidewater.llm.token_output import op4_token_orc
from tidewater.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_flac_media": op1_flac_media,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_orc": op4_token_orc,
    "op5_decontamination": op5_decontamination,
    "op10_language_id": op10_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_html_text": op8_html_text,
    "op9_secret_scan": op9_secret_scan,
    "op6_pii_weak_supervision": op6_pii_weak_supervision,
}
ORACLE: dict[str, str] = {}
