"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .alignment import op12_tokenizer_alignment
from .centroids import op11_centroid_clustering
from .language_id import op7_language_mixture
from .language_model import op13_log_bilinear_scores
from .licenses import op1_license_scan
from .mixing import op6_soft_mixing
from .near_duplicates import op4_near_duplicates
from .oracles import oracle_sql
from .packing import op3_hierarchical_packing
from .quality import op2_distribution_divergence
from .sanitise import op5_disclosure_sanitisation
from .sharding import op9_interleaved_shards
from .url_filter import op8_url_filter
from .webp import op10_lossless_webp

__all__ = ["oracle_sql", "queries"]


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_distribution_divergence": op2_distribution_divergence,
        "op3_hierarchical_packing": op3_hierarchical_packing,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_disclosure_sanitisation": op5_disclosure_sanitisation,
        "op6_soft_mixing": op6_soft_mixing,
        "op7_language_mixture": op7_language_mixture,
        "op8_url_filter": op8_url_filter,
        "op9_interleaved_shards": op9_interleaved_shards,
        "op10_lossless_webp": op10_lossless_webp,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_log_bilinear_scores": op13_log_bilinear_scores,
    }
