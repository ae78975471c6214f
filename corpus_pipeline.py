"""A training-data pipeline over `documents`: rules, toxicity, near duplicates, benchmark leaks, tokens.

Each stage takes all documents that its predecessor kept, and its result is written as Parquet and
read again before the next one starts. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseline.llm import bpe, decontamination, jaccard_join, quality_rules, toxicity
from pulseline.llm.common import shipped, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MARK = "_mark"
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the default policy."""
    return quality_rules.ledger(docs.select(*COLUMNS)).filter(quality_rules.passes()).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(*COLUMNS), model)
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def marked(docs: DataFrame, name: str) -> DataFrame:
    """Stored: the documents and a mark of each row, which is unique whatever the ids are. A second
    computation could mark rows otherwise."""
    return stored(docs.select(*COLUMNS).withColumn(MARK, F.monotonically_increasing_id()), name)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id.

    Null ids come after all others, and the least mark decides between rows with one id. Rows
    without words are classes of their own and stay.
    """
    rows = marked(docs, "pipeline-distinct")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", MARK).alias("place")
    classes = jaccard_join.join(rows.select(order, "text"), key="place")
    extra = stored(classes.filter(f"class_id.{MARK} != place.{MARK}").select(f"place.{MARK}"), "pipeline-extra")
    return rows.join(extra, MARK, "left_anti").select(*COLUMNS)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever their ids."""
    rows = marked(docs, "pipeline-unleaked")
    found = decontamination.matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=MARK)
    return decontamination.without(rows, found, key=MARK).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text's bytes back."""
    coded = bpe.encode_checked(
        docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "exact"
    )


STAGES = [
    ("quality", shipped(quality)), ("toxicity", shipped(clean)), ("near_duplicates", shipped(distinct)),
    ("decontamination", shipped(unleaked)), ("tokens", shipped(tokens)),
]

#: Trained models and tokenizers are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
