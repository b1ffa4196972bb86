"""The index of a set of concepts: forms, postings, inverse document frequencies, vectors. Tables, saved as Parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.operators.concepts import forms, last_rows
from quillon.sources.tables import require_columns

Tokenizer = Callable[[Column], Column]
_TABLES = ("forms", "postings", "idf", "texts", "vectors")


@dataclass(frozen=True)
class Index:
    """forms (iri, form, pos), postings (token, iri), idf (token, df, idf), texts (iri, text), vectors (iri, embedding) or None."""

    forms: DataFrame
    postings: DataFrame
    idf: DataFrame
    texts: DataFrame
    vectors: DataFrame | None
    n_classes: int
    tokenizer_id: str = "default"
    encoder_id: str = ""
    normalized: bool = True


def labels_to_classes(of: DataFrame) -> DataFrame:
    """(form, iris): the classes of each form."""
    return of.groupBy("form").agg(F.array_sort(F.collect_set("iri")).alias("iris"))


def token_sets(of: DataFrame, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(iri, token), each once."""
    return of.select("iri", F.explode(tokenizer(F.col("form"))).alias("token")).distinct()


def inverted_index(postings: DataFrame) -> DataFrame:
    """(token, iris)."""
    return postings.groupBy("token").agg(F.array_sort(F.collect_set("iri")).alias("iris"))


def inverse_document_frequency(postings: DataFrame, n_classes: int) -> DataFrame:
    """(token, df, idf), idf = log10(n / df)."""
    if n_classes <= 0:
        raise ValueError("inverse document frequencies need at least one class")
    return postings.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log10(F.lit(float(n_classes)) / F.col("df")))


def build_index(
    concepts: DataFrame,
    tokenizer: Tokenizer = tokens,
    encoder: Callable[[Column], Column] | None = None,
    vectors: DataFrame | None = None,
    tokenizer_id: str = "default",
    encoder_id: str = "",
    normalized: bool = True,
) -> Index:
    """An index of concepts (iri, label, synonyms, text). Of rows that share an iri the last counts, for vectors too.

    vectors: ready ones (iri, embedding); else the encoder makes them of the texts; else there are none.
    """
    require_columns(concepts, ["iri", "label", "synonyms"], "concepts")
    of = forms(concepts)
    n = concepts.select("iri").distinct().count()
    postings = token_sets(of, tokenizer)
    latest = last_rows(concepts)
    text = F.col("text") if "text" in concepts.columns else F.col("label")
    texts = latest.select("iri", F.coalesce(text, F.lit("")).alias("text"))
    if vectors is None and encoder is not None:
        vectors = texts.select("iri", encoder(F.col("text")).alias("embedding"))
    return Index(of, postings, inverse_document_frequency(postings, n), texts, vectors, n, tokenizer_id, encoder_id, normalized)


def cached(index: Index) -> Index:
    """The index with its tables kept by Spark, for many queries."""
    return replace(index, **{t: getattr(index, t).cache() for t in _TABLES if getattr(index, t) is not None})


def save_index(index: Index, path: str, mode: str = "error") -> None:
    """One folder of Parquet tables; postings and idf are clustered by token for joins on it."""
    for name in _TABLES:
        table = getattr(index, name)
        if table is not None:
            key = "token" if "token" in table.columns else "iri"
            table.repartition(F.col(key)).sortWithinPartitions(key).write.mode(mode).parquet(f"{path}/{name}")
    spark = index.forms.sparkSession
    meta = [(index.n_classes, index.tokenizer_id, index.encoder_id, index.normalized, index.vectors is not None)]
    schema = "n_classes long, tokenizer_id string, encoder_id string, normalized boolean, has_vectors boolean"
    spark.createDataFrame(meta, schema).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, tokenizer_id: str | None = None) -> Index:
    """A saved index; ValueError if it was built with another tokenizer than the one named."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if tokenizer_id is not None and tokenizer_id != meta.tokenizer_id:
        raise ValueError(f"the index has tokens of {meta.tokenizer_id!r}, not of {tokenizer_id!r}")
    table = lambda n: spark.read.parquet(f"{path}/{n}")
    return Index(
        table("forms"), table("postings"), table("idf"), table("texts"), table("vectors") if meta.has_vectors else None,
        meta.n_classes, meta.tokenizer_id, meta.encoder_id, meta.normalized,
    )
