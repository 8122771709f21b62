"""Queries of the training-data operators and the SQL they are held against."""

from . import (
    backoff_lm,
    host_reputation,
    language_id,
    pii_sanitisation,
    simhash_golay,
    source_mixing,
    suffix_dedup,
    template_decontamination,
    toxicity,
    voronoi_knn,
)

QUERIES = {
    "op1_voronoi_knn": voronoi_knn.knn_query,
    "op2_suffix_dedup": suffix_dedup.suffix_query,
    "op3_simhash_golay": simhash_golay.simhash_query,
    "op4_pii_sanitisation": pii_sanitisation.pii_query,
    "op5_host_reputation": host_reputation.url_query,
    "op6_backoff_lm": backoff_lm.lm_query,
    "op7_template_decontamination": template_decontamination.decontamination_query,
    "op8_source_mixing": source_mixing.mixing_query,
    "op9_toxicity": toxicity.toxicity_query,
    "op10_language_id": language_id.language_query,
}
ORACLES = {
    "op1_voronoi_knn": voronoi_knn.KNN_SQL,
    "op5_host_reputation": host_reputation.URL_SQL,
}
