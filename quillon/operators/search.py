"""Search of retrieval configurations for the best precision at one, and the alignment as a graph.

Retrieval and pair scoring run once, at the largest budgets; a trial then only selects from their ranks.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import token_overlap
from quillon.operators.evaluate import ranking_metrics
from quillon.operators.index import Index
from quillon.operators.retrieve import COLUMNS, exact_least, lexical_candidates, merge_candidates, semantic_candidates, split_budget, without_exact
from quillon.operators.score import best_predictions, score_pairs, scoring_pairs

# The choices of each setting.
SPACE = {
    "lexical_top_k": (50, 100, 200, 300),
    "semantic_top_k": (50, 100, 200, 300),
    "merged_top_k": (100, 150, 200, 300),
    "ratio_semantic": (0.3, 0.5, 0.7),
    "cross_top_k": (20, 50, 75, 100, 150),
}


@dataclass(frozen=True)
class Trial:
    lexical_top_k: int
    semantic_top_k: int
    merged_top_k: int
    ratio_semantic: float
    cross_top_k: int

    def makes_sense(self) -> bool:
        return self.cross_top_k <= self.merged_top_k <= self.lexical_top_k + self.semantic_top_k


def trials(n: int = 100, seed: int = 42, space: dict[str, tuple] = SPACE) -> Iterator[Trial]:
    """n different sensible trials in random order, or all there are."""
    every = [t for values in product(*space.values()) if (t := Trial(**dict(zip(space, values, strict=True)))).makes_sense()]
    random.Random(seed).shuffle(every)
    yield from every[:n]


@dataclass(frozen=True)
class SearchState:
    """The least exact hits, lexical and semantic candidates at the largest budgets, and the scores of all their pairs."""

    queries: DataFrame
    exact: DataFrame
    lexical: DataFrame
    semantic: DataFrame
    scores: DataFrame
    texts: DataFrame


def prepare(queries: DataFrame, index: Index, query_vectors: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap, most: int = 300) -> SearchState:
    exact = exact_least(queries, index).select("query_id", "iri")
    rest = without_exact(queries, index)
    lexical = lexical_candidates(rest, index, most).select(*COLUMNS).cache()
    asked = query_vectors.join(rest.select("query_id"), "query_id", "left_semi")
    semantic = semantic_candidates(asked, index.vectors, most, index.normalized).select(*COLUMNS).cache()
    pairs = lexical.union(semantic).select("query_id", "iri").distinct().join(index.texts, "iri").withColumn("cand_rank", F.lit(0).cast("long"))
    return SearchState(queries, exact, lexical, semantic, score_pairs(pairs, queries, scorer).select("query_id", "iri", "score").cache(), index.texts)


def _planned(state: SearchState, tried: list[Trial]) -> DataFrame:
    """A row for each trial with its settings and budgets: the small side of all joins."""
    rows = [(n, *vars(t).values(), *split_budget(t.merged_top_k, t.ratio_semantic), *split_budget(max(t.cross_top_k, 1), t.ratio_semantic)) for n, t in enumerate(tried)]
    settings = ", ".join(f"{c} {'double' if c == 'ratio_semantic' else 'int'}" for c in Trial.__dataclass_fields__)
    return state.queries.sparkSession.createDataFrame(rows, f"trial int, {settings}, k_lexical long, k_semantic long, c_lexical long, c_semantic long")


def run_trials(state: SearchState, tried: list[Trial]) -> DataFrame:
    """(trial, query_id, predicted_iri) of all trials at once: trials are rows beside the ranks, and a query's name holds its trial."""
    plan = F.broadcast(_planned(state, tried))
    key = F.struct("trial", "query_id", "merged_top_k", "c_lexical", "c_semantic").alias("query_id")
    taken = lambda df, most: df.join(plan, F.col("rank") <= F.col(most)).select(key, *COLUMNS[1:])
    merged = merge_candidates(taken(state.lexical, "k_lexical"), taken(state.semantic, "k_semantic"), F.col("query_id.merged_top_k"))
    pairs = scoring_pairs(merged, state.texts, budget=(F.col("query_id.c_lexical"), F.col("query_id.c_semantic"))).drop("text")
    scores = state.scores.withColumnRenamed("query_id", "_query")
    scored = pairs.withColumn("_query", F.col("query_id.query_id")).join(scores, ["_query", "iri"]).select("query_id", "iri", "cand_rank", "score")
    best = best_predictions(scored).select("query_id.trial", "query_id.query_id", "predicted_iri")
    exact = state.exact.crossJoin(plan.select("trial")).select("trial", "query_id", F.col("iri").alias("predicted_iri"))
    return best.union(exact)


def run_trial(state: SearchState, trial: Trial) -> DataFrame:
    """(query_id, predicted_iri) of a trial."""
    return run_trials(state, [trial]).drop("trial")


def search(state: SearchState, gold: DataFrame, tried: list[Trial]) -> DataFrame:
    """A row for each trial with its precision at one, best first. gold: query_id, gold_target_iris, match."""
    if not tried:
        raise ValueError("no trial to run")
    plan = _planned(state, tried)
    every = state.queries.select("query_id").crossJoin(F.broadcast(plan.select("trial")))
    merged = every.join(run_trials(state, tried), ["trial", "query_id"], "left").join(gold, "query_id", "left")
    measured = ranking_metrics(merged, k=1, by=("trial",)).select("trial", "precision_at_1_pos")
    out = plan.join(measured, "trial", "left").withColumn("precision_at_1_pos", F.coalesce("precision_at_1_pos", F.lit(float("nan"))))
    return out.select("trial", *Trial.__dataclass_fields__, "precision_at_1_pos").orderBy(F.desc("precision_at_1_pos"), "trial")


def alignment_graph(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, side, degree), edges (src, dst)) of pairs with source_label and target_label, for drawing elsewhere."""
    edges = pairs.where("source_label is not null and target_label is not null").select(F.col("source_label").alias("src"), F.col("target_label").alias("dst")).distinct()
    ends = edges.select(F.col("src").alias("id"), F.lit("source").alias("side")).union(edges.select(F.col("dst").alias("id"), F.lit("target").alias("side")))
    return ends.groupBy("id", "side").agg(F.count("*").alias("degree")), edges
