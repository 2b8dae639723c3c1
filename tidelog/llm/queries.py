"""The registered queries of the package, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import boilerplate, chat, contamination, embeddings, html_text, language, lexical, merkle, secret_scan, simhash, toxicity
from tidelog.llm.byte_bpe import token_digests
from tidelog.llm.common import read_table
from tidelog.llm.token_files import token_round_trip

CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_toxicity(spark, sf_dir):
    return toxicity.learn_and_score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_simhash_dedup(spark, sf_dir):
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return contamination.contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_token_files(spark, sf_dir):
    return token_round_trip(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html_text(spark, sf_dir):
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_embedding_dedup(spark, sf_dir):
    return embeddings.embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(control)))


def op9_line_dedup(spark, sf_dir):
    cleaned = boilerplate.without_boilerplate(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_language_id(spark, sf_dir):
    return language.learn_and_identify(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_html_text": op5_html_text,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_secret_scan": op11_secret_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op3_decontamination": contamination.PAIRS_SQL,
    "op7_embedding_dedup": embeddings.GROUPS_SQL,
    "op8_chat_format": chat.DIGESTS_SQL,
    "op9_line_dedup": boilerplate.LINES_SQL,
    "op12_merkle_manifest": merkle.MANIFEST_SQL,
    "op13_lexical_search": lexical.RANKED_SQL,
}
