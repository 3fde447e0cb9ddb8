"""Corpus preparation: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. Rows that repeat a document id are one
document after the near-duplicate stage. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscore.llm import decontaminate, neardup, personal, pieces, toxicity
from geoscore.llm.common import table
from geoscore.llm.queries import tokenizer
from geoscore.sources.storage import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's cut; trained on the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored_with_rows(docs, model)
    return scored.filter(F.col("toxicity") < toxicity.language_cut(model)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without an id stay."""
    groups = neardup.groups(docs)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    # Rows that repeat a kept id: the one with the smallest text stays.
    named = left.filter(F.col("doc_id").isNotNull())
    repeated = named.groupBy("doc_id").count().filter(F.col("count") > 1).select("doc_id")
    others = [c for c in docs.columns if c != "doc_id"]
    one = F.min(F.struct("text", *(c for c in others if c != "text"))).alias("row")
    single = named.join(repeated, "doc_id").groupBy("doc_id").agg(one).select("doc_id", "row.*")
    rest = left.join(repeated, "doc_id", "left_anti")
    return rest.unionByName(single.select(*docs.columns)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; ``n_chars`` follows the text."""
    masked = personal.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with hashes of them and of the text read back."""
    return pieces.digests(pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode),
]
#: No stage but the filters on equal text could be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
