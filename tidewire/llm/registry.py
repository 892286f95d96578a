"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tidewire.llm import byte_bpe, lm_scores, near_dedup, quality_rules, secrets_crf, source_mix, substring_dedup, token_files, top_inner, url_filters
from tidewire.session import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.COLUMNS)


def op2_token_files(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = f.read()
    return token_files.read_tokens(token_files.write_tokens(table(spark, sf_dir, "documents"), spec))


def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(list(url_filters.RULES), "host string, path string, verdict string")
    return url_filters.url_filter(table(spark, sf_dir, "pages"), rules)


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op5_source_mix(spark, sf_dir):
    return source_mix.mix_totals(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_top_inner(spark, sf_dir):
    return top_inner.top_inner(table(spark, sf_dir, "embeddings"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_lm_scores(spark, sf_dir):
    return lm_scores.lm_scores(table(spark, sf_dir, "documents"), lm_scores.good_documents(table(spark, sf_dir, "labels")))


def op9_secrets_crf(spark, sf_dir):
    return secrets_crf.digest(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digest(table(spark, sf_dir, "documents"), bpe)


def queries():
    return {f.__name__: f for f in (op1_quality_rules, op2_token_files, op3_url_filters, op4_substring_dedup, op5_source_mix, op6_top_inner, op7_near_dedup, op8_lm_scores, op9_secrets_crf, op10_byte_bpe)}


def oracle_sql():
    return {"op1_quality_rules": quality_rules.oracle(), "op3_url_filters": url_filters.oracle(), "op4_substring_dedup": substring_dedup.oracle(), "op5_source_mix": source_mix.oracle(), "op6_top_inner": top_inner.oracle(), "op7_near_dedup": near_dedup.oracle()}
