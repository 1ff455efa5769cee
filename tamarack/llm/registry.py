"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, codes, decontaminate, jaccard, lexical, neardup, packing, pii, quality, sharding, substrings, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_latent_decontamination": decontaminate.op1_latent_decontamination,
        "op2_chroma_fingerprints": audio.op2_chroma_fingerprints,
        "op3_setsketch_near_duplicates": neardup.op3_setsketch_near_duplicates,
        "op4_recurrent_toxicity": toxicity.op4_recurrent_toxicity,
        "op5_latent_neighbour_quality": quality.op5_latent_neighbour_quality,
        "op6_pii_spans": pii.op6_pii_spans,
        "op7_hypergeometric_shards": sharding.op7_hypergeometric_shards,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_url_language_models": urls.op9_url_language_models,
        "op10_fingerprint_index_repeats": substrings.op10_fingerprint_index_repeats,
        "op11_vector_codes": codes.op11_vector_codes,
        "op12_ranked_lexical_search": lexical.op12_ranked_lexical_search,
        "op13_ngram_jaccard_join": jaccard.op13_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_setsketch_near_duplicates": neardup.OP3_SQL,
        "op6_pii_spans": pii.op6_sql(),
        "op10_fingerprint_index_repeats": substrings.OP10_SQL,
        "op11_vector_codes": codes.op11_sql(),
        "op12_ranked_lexical_search": lexical.OP12_SQL,
        "op13_ngram_jaccard_join": jaccard.OP13_SQL,
    }
