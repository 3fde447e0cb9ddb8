"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscore.llm import (
    align,
    chat,
    decontaminate,
    language,
    mixing,
    neardup,
    neighbours,
    oracle,
    personal,
    pieces,
    repeats,
    runs,
    secrets,
    toxicity,
)
from geoscore.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation whose texts are control strings of a common template.
CONTROL = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
    more = spark.createDataFrame(rows, turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.digests(pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model")))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), shingle=4)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.find(table(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = toxicity.contract_labels(table(spark, sf_dir, "labels"))
    return toxicity.predictions(toxicity.score(docs, toxicity.fit(docs, labels)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted().alias("text"))
    return runs.digests(runs.periodic_runs(docs))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predictions(language.predict(docs, language.fit(docs.filter(~language.held_out()))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return align.digests(align.align(docs, *paths, public_tokenizers.PATTERN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_personal_data": op3_personal_data,
    "op4_secrets": op4_secrets,
    "op5_repeats": op5_repeats,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_neighbours": op10_neighbours,
    "op11_runs": op11_runs,
    "op12_language": op12_language,
    "op13_alignment": op13_alignment,
}
#: The others learn from data or follow a vocabulary file; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op2_near_duplicates": oracle.near_duplicates(shingle=4),
    "op4_secrets": oracle.secret_scan(),
    "op7_chat": oracle.chat_formatting(CONTROL),
    "op9_decontamination": oracle.leaks(),
    "op10_neighbours": oracle.NEIGHBOURS,
}
