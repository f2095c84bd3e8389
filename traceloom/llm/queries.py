"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import licences, vector_codes, warc
from traceloom.llm.chat import conversation_digests
from traceloom.llm.common import read
from traceloom.llm.decontamination import contamination
from traceloom.llm.id_files import id_digests
from traceloom.llm.near_dup import near_duplicates
from traceloom.llm.packing import pack_documents
from traceloom.llm.periodic_runs import planted, run_digests
from traceloom.llm.pieces import piece_digests
from traceloom.llm.quality import quality_scores
from traceloom.llm.scoring import score_texts
from traceloom.llm.vector_dup import vector_links

TOKENIZER = "word_bpe_49k.json"
CHAT_TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op4_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_labels(read(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return conversation_digests(rows.unionAll(probe), public_tokenizers.path(CHAT_TOKENIZER))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), threshold=0.8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(planted(read(spark, sf_dir, "documents")))


QUERIES = {q.__name__: q for q in (op1_packing, op2_warc, op3_scoring, op4_vector_dup, op5_licences, op6_chat, op7_id_files, op8_quality, op9_near_dup, op10_decontamination, op11_pieces, op12_vector_codes, op13_periodic_runs)}
ORACLE_SQL = {"op2_warc": warc.oracle(), "op5_licences": licences.oracle(), "op12_vector_codes": vector_codes.oracle()}
