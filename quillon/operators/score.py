"""Pair scoring: which candidates are scored, their scores, and the best of each query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import scoring_text, strip, text_of, tokens
from quillon.functions.vectors import token_overlap
from quillon.operators.index import Index, Tokenizer
from quillon.operators.retrieve import RetrievalConfig, exact_least, search, split_budget, without_exact


@dataclass(frozen=True)
class AlignConfig:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    cross_top_k: int = 20
    keep_top_n: int = 0


def scoring_pairs(candidates: DataFrame, texts: DataFrame, cross_top_k: int = 20, mode: str = "hybrid", ratio_semantic: float = 0.5, budget: tuple[Column, Column] | None = None) -> DataFrame:
    """(query_id, iri, cand_rank, text) of the candidates to score.

    At least one a query, cross_top_k at most; exact hits aren't scored. In hybrid mode each source has its share of the
    budget, and what one lacks goes to the other's next candidates, semantic ones first. Candidates whose class has no
    text are dropped after the cut. `budget` gives the shares of both sources as columns of query_id, in place of cross_top_k and ratio.
    """
    k = budget[0] + budget[1] if budget else max(cross_top_k, 1)
    rows = candidates.where(F.col("source") != "exact")
    if mode == "hybrid":
        k_lexical, k_semantic = budget or split_budget(k, ratio_semantic)
        nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
        lexical = F.col("source") == "lexical"
        order = F.when(lexical & (nth <= k_lexical), 0).when(~lexical & (nth <= k_semantic), 1).when(~lexical, 2).otherwise(3)
        rows = rows.withColumn("turn", order)
        once = rows.groupBy("query_id", "iri").agg(F.min(F.struct("turn", "rank")).alias("t")).select("query_id", "iri", "t.turn", "t.rank")
    else:
        once = rows.groupBy("query_id", "iri").agg(F.min("rank").alias("rank")).withColumn("turn", F.lit(0))
    cut = once.withColumn("cand_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "rank")).cast("long")).where(F.col("cand_rank") <= k)
    return cut.select("query_id", "iri", "cand_rank").join(texts.select("iri", "text"), "iri").select("query_id", "iri", "cand_rank", "text")


def score_pairs(pairs: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """(query_id, iri, cand_rank, score) of pairs, against the scoring text of their query (scoring_query or query)."""
    said = scoring_text("scoring_query", "query") if "scoring_query" in queries.columns else strip(text_of("query"))
    asked = queries.select("query_id", said.alias("said")).where("said <> ''")
    joined = pairs.join(asked, "query_id")
    return joined.select("query_id", "iri", "cand_rank", scorer(F.col("said"), F.col("text")).alias("score"))


def rank_scored(scored: DataFrame) -> DataFrame:
    """With `place`: the rank by score; ties keep the candidates' order."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cand_rank")
    return scored.withColumn("place", F.row_number().over(by).cast("long"))


def best_predictions(scored: DataFrame, keep_top_n: int = 0) -> DataFrame:
    """(query_id, predicted_iri, predicted_score, num_scored, top): top lists the first keep_top_n (iri, score)."""
    return (
        rank_scored(scored)
        .groupBy("query_id")
        .agg(
            F.min(F.when(F.col("place") == 1, F.struct("iri", "score"))).alias("best"),
            F.count("*").alias("num_scored"),
            F.array_sort(F.collect_list(F.when(F.col("place") <= keep_top_n, F.struct("place", "iri", "score")))).alias("top"),
        )
        .select("query_id", F.col("best.iri").alias("predicted_iri"), F.col("best.score").alias("predicted_score"), "num_scored", "top")
    )


def top_columns(predictions: DataFrame, n: int) -> DataFrame:
    """Predictions with top1_iri, top1_score, ... in place of `top`."""
    at = lambda r, f: F.get("top", F.lit(r - 1))[f]
    wide = {f"top{r}_{f}": at(r, f) for r in range(1, n + 1) for f in ("iri", "score")}
    return predictions.withColumns(wide).drop("top") if wide else predictions.drop("top")


def align(
    queries: DataFrame,
    index: Index,
    config: AlignConfig = AlignConfig(),
    scorer: Callable[[Column, Column], Column] = token_overlap,
    query_vectors: DataFrame | None = None,
    encoder: Callable[[Column], Column] | None = None,
    tokenizer: Tokenizer = tokens,
    tokenizer_id: str = "default",
    encoder_id: str | None = None,
) -> DataFrame:
    """A prediction for each query (query_id, query and perhaps scoring_query), with one schema for all cases.

    query_id, attribute_text, retrieval_source (exact, lexical, semantic, hybrid or none), num_retrieved, num_scored,
    predicted_iri, predicted_score, top. An exact hit predicts its least iri with score 1, unscored and without top.
    ValueError if the index was built with another tokenizer, or with another encoder than the one named.
    """
    if tokenizer_id != index.tokenizer_id:
        raise ValueError(f"the index has tokens of {index.tokenizer_id!r}, not of {tokenizer_id!r}")
    if encoder_id is not None and encoder_id != index.encoder_id:
        raise ValueError(f"the index has vectors of {index.encoder_id!r}, not of {encoder_id!r}")
    found = search(without_exact(queries, index), index, config.retrieval, query_vectors, encoder, tokenizer)
    counts = found.groupBy("query_id").agg(F.count("*").alias("num_retrieved"), F.first("found").alias("retrieval_source"), F.first(F.lit(None).cast("string")).alias("exact_iri"))
    exact = exact_least(queries, index).select("query_id", F.col("hits").alias("num_retrieved"), F.lit("exact").alias("retrieval_source"), F.col("iri").alias("exact_iri"))
    counts = counts.union(exact)
    pairs = scoring_pairs(found, index.texts, config.cross_top_k, config.retrieval.mode, config.retrieval.ratio_semantic)
    best = best_predictions(score_pairs(pairs, queries, scorer), config.keep_top_n)
    return (
        queries.join(counts, "query_id", "left")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            text_of("query").alias("attribute_text"),
            F.coalesce("retrieval_source", F.lit("none")).alias("retrieval_source"),
            F.coalesce("num_retrieved", F.lit(0)).cast("long").alias("num_retrieved"),
            F.coalesce("num_scored", F.lit(0)).cast("long").alias("num_scored"),
            F.coalesce("exact_iri", "predicted_iri").alias("predicted_iri"),
            F.when(F.col("exact_iri").isNotNull(), 1.0).otherwise(F.col("predicted_score")).alias("predicted_score"),
            F.coalesce("top", F.expr("cast(array() as array<struct<place:bigint,iri:string,score:double>>)")).alias("top"),
        )
    )
