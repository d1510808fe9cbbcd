"""The queries of this package and their SQL."""

from __future__ import annotations

from quern.shipping import shipped

from .common import short_batches

from . import op1_language, op2_bpe, op3_token_counts, op4_secrets, op5_decontaminate, op6_jaccard, op7_html, op8_importance, op9_quality, op10_sharding, op11_lexical, op12_sentencepiece, op13_centroids


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {
        "op1_language_id": op1_language.query,
        "op2_byte_bpe": op2_bpe.query,
        "op3_token_counts": op3_token_counts.query,
        "op4_secret_scan": op4_secrets.query,
        "op5_decontamination": op5_decontaminate.query,
        "op6_jaccard_join": op6_jaccard.query,
        "op7_html_text": op7_html.query,
        "op8_importance_resampling": op8_importance.query,
        "op9_quality_rules": op9_quality.query,
        "op10_sharding": op10_sharding.query,
        "op11_lexical_search": op11_lexical.query,
        "op12_sentencepiece": op12_sentencepiece.query,
        "op13_centroid_clustering": op13_centroids.query,
        "pipeline": pipeline,
    }

    def prepared(f):
        def run(spark, *args):
            short_batches(spark)
            return f(spark, *args)

        return run

    return {name: shipped(prepared(f)) for name, f in found.items()}


def oracle_sql() -> dict:
    return {
        "op5_decontamination": op5_decontaminate.ORACLE_SQL,
        "op6_jaccard_join": op6_jaccard.ORACLE_SQL,
        "op11_lexical_search": op11_lexical.ORACLE_SQL,
        "op13_centroid_clustering": op13_centroids.ORACLE_SQL,
    }
