"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpecount, centroids, chat, decontam, importance, jaccard, licenses, linededup, lmscore, mixing, pii, quality, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark, sf_dir):
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(own.unionByName(spark.createDataFrame(chat.EXTRA, "conv_id long, turn long, role string, text string")))


def op2_quality_rules(spark, sf_dir):
    return quality.score(_table(spark, sf_dir, "documents"))


def op3_token_shards(spark, sf_dir):
    return wavelet.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_personal_data(spark, sf_dir):
    return pii.scan(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return linededup.report(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark, sf_dir):
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return bpecount.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_decontaminate(spark, sf_dir):
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_importance_resample(spark, sf_dir):
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_lm_scores(spark, sf_dir):
    return lmscore.score(_table(spark, sf_dir, "documents"))


def op13_centroids(spark, sf_dir):
    return centroids.lloyd(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_token_shards, op4_personal_data, op5_jaccard_join, op6_line_dedup, op7_license_scan, op8_mix_sources, op9_token_counts, op10_decontaminate, op11_importance_resample, op12_lm_scores, op13_centroids)}

ORACLE_SQL = {
    "op1_chat_format": chat.DIGEST_SQL,
    "op5_jaccard_join": jaccard.CLASSES_SQL,
    "op6_line_dedup": linededup.REPORT_SQL,
    "op10_decontaminate": decontam.CONTAMINATION_SQL,
    "op8_mix_sources": mixing.PLAN_SQL,
    "op11_importance_resample": importance.RESAMPLE_SQL,
    "op13_centroids": centroids.LLOYD_SQL,
}
