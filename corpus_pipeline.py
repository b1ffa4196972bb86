"""The corpus pipeline: toxic texts go, one of each near-duplicate group stays, benchmark passages go, sources are
mixed to their target weights, and the rest is sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever their names. A stage without rows to work on
returns none. Null ids are documents without a name: no stage drops a row for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontam import regions_of
from quillon.llm.mixing import mixed_rows
from quillon.llm.near_dup import representatives
from quillon.llm.scratch import forget, written
from quillon.llm.sharding import shard_rows
from quillon.llm.toxicity import toxicity_udf, train_toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.5; the model learns from the labelled rows outside the held-out fold.

    Null and empty texts are scored as empty, long ones whole; repeated rows score alike and stand or fall together.
    Without labels of both kinds nothing is toxic.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_udf(spark, model)(docs["text"]) < 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id.

    Rows that repeat an id and a text are one document, and one of them stays; an id's other texts are judged for
    themselves. Null texts and those without a word are like nothing else; rows with a null id all stay.
    """
    return representatives(docs)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs; null and empty texts hold none, null and empty items are nowhere.
    Long texts are searched whole; repeated rows stand or fall together."""
    return docs.where(F.size(regions_of(docs["text"], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))) == 0)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them. A null source is one of its own. Rows without a word weigh nothing
    and are taken as often as their source's whole epochs; rows that repeat an id and tie in its key are taken together."""
    return mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; its text is found by doc_id. Equal texts, null ones as one of them, share a shard
    as far as the operator's law allows; repeated rows have slots of their own."""
    return shard_rows(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark_passages),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None  # SQL can't express the trained and the iterative stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
