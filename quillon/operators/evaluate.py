"""Evaluation of predictions against gold, and of pair classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import text_of
from quillon.functions.vectors import as_flag
from quillon.sources.tables import CONFIG_KEYS, append_metrics

METRICS = ("n_pos", "precision_at_1_pos", "hits_at_k_pos", "mrr_at_k_pos")


@dataclass(frozen=True)
class JoinPlan:
    method: str
    details: str


def gold_list(c: Column | str) -> Column:
    """Gold as array<string>: a list as it is, a text of a list (either quotes) parsed, another text alone, null empty."""
    text = F.trim(text_of(c))
    parsed = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    empty = F.expr("cast(array() as array<string>)")
    return F.when(text == "", empty).when(text.startswith("["), F.coalesce(parsed, F.array(text))).otherwise(F.array(text))


def join_predictions(gold: DataFrame, predictions: DataFrame, id_col: str | None = None, text_col: str = "source_text", attribute_col: str = "attribute_text") -> tuple[DataFrame, JoinPlan]:
    """Predictions with their gold, and how they were joined.

    By the id column if both have it; else by source_iri; else by row_id (gold must have its rows numbered as row_id);
    else by text if over 98 % of gold's texts differ; else ValueError. A prediction meets every row of its gold.
    """
    extra = [c for c in gold.columns if c not in predictions.columns]

    def joined(key: str) -> DataFrame:
        return predictions.join(gold.select(key, *[c for c in extra if c != key]), key, "left")

    for key, method in ((id_col, "id"), ("source_iri", "source_iri"), ("row_id", "row_id")):
        if key and key in gold.columns and key in predictions.columns:
            return joined(key), JoinPlan(method, key)
    if text_col in gold.columns and attribute_col in predictions.columns:
        n, distinct = gold.agg(F.count("*"), F.countDistinct(text_col)).first()
        if n and distinct / n > 0.98:
            named = gold.select(F.col(text_col).alias(attribute_col), *[c for c in extra if c != attribute_col])
            return predictions.join(named, attribute_col, "left"), JoinPlan("text", f"{attribute_col}={text_col}")
    raise ValueError("predictions and gold have no key in common")


def basic_stats(predictions: DataFrame) -> DataFrame:
    """One row: n, coverage (share with a prediction), distribution (share of each retrieval source, falling)."""
    each = predictions.groupBy(F.coalesce("retrieval_source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("rows"), F.count("predicted_iri").alias("covered")
    )
    return each.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        (F.sum("covered") / F.sum("rows")).alias("coverage"),
        F.array_sort(F.collect_list(F.struct("rows", "source")), lambda a, b: F.when(a["rows"] != b["rows"], (b["rows"] - a["rows"]).cast("int")).when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0)).alias("_d"),
    ).select("n", F.coalesce("coverage", F.lit(float("nan"))).alias("coverage"), F.transform("_d", lambda d: F.struct(d["source"].alias("source"), (d["rows"] / F.col("n")).alias("share"))).alias("distribution"))


def gold_attach_rate(merged: DataFrame, gold_col: str = "gold_target_iris") -> DataFrame:
    return merged.agg(F.coalesce(F.avg(F.col(gold_col).isNotNull().cast("double")), F.lit(float("nan"))).alias("gold_attach_rate"))


def _ranks(merged: DataFrame, gold_col: str, match_col: str, k: int) -> DataFrame:
    """Positives with `best`: the first of predicted_iri, top2_iri, ... topk_iri that is gold; null for none."""
    if k < 1:
        raise ValueError("k must be at least 1")
    listed = ["predicted_iri", *[f"top{r}_iri" for r in range(2, k + 1)]]
    if "top" in merged.columns:
        listed = [F.col("predicted_iri"), *[F.get("top", F.lit(r - 1))["iri"] for r in range(2, k + 1)]]
    else:
        listed = [F.col(c) if c in merged.columns else F.lit(None).cast("string") for c in listed]
    gold = F.col(gold_col) if dict(merged.dtypes)[gold_col].startswith("array") else gold_list(gold_col)
    gold = F.coalesce(gold, F.expr("cast(array() as array<string>)"))
    best = F.coalesce(*[F.when(F.array_contains(gold, iri), r) for r, iri in enumerate(listed, 1)])
    return merged.where(as_flag(match_col) == 1).withColumn("best", best)


def _measures() -> list[Column]:
    none = F.lit(float("nan"))
    return [
        F.count("*").alias("n_pos"),
        F.coalesce(F.avg(F.coalesce((F.col("best") == 1).cast("double"), F.lit(0.0))), none).alias("precision_at_1_pos"),
        F.coalesce(F.avg(F.col("best").isNotNull().cast("double")), none).alias("hits_at_k_pos"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), none).alias("mrr_at_k_pos"),
    ]


def ranking_metrics(merged: DataFrame, gold_col: str = "gold_target_iris", match_col: str = "match", k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of n_pos, P@1, Hits@k and MRR@k over the positives; NaN without any. With `by` one for each value that has positives."""
    return _ranks(merged, gold_col, match_col, k).groupBy(*by).agg(*_measures())


def metrics_by_source(merged: DataFrame, gold_col: str = "gold_target_iris", match_col: str = "match", k: int = 10) -> DataFrame:
    """ranking_metrics overall and for each retrieval source, in one pass: scope, retrieval_source, measures."""
    ranks = _ranks(merged, gold_col, match_col, k).withColumn("source", F.coalesce("retrieval_source", F.lit("none")))
    rolled = ranks.rollup("source").agg(F.grouping("source").alias("overall"), *_measures())
    every = rolled.select(
        F.when(F.col("overall") == 1, "overall").otherwise("by_source").alias("scope"),
        F.when(F.col("overall") == 1, "ALL").otherwise(F.col("source")).alias("retrieval_source"),
        *METRICS,
    )
    return every


def metrics_rows(merged: DataFrame, stats: DataFrame, plan: JoinPlan, k: int = 10, config: dict[str, str] | None = None, run_id: str | None = None, old: DataFrame | None = None) -> DataFrame:
    """Rows to append to a table of metrics: the run's id and settings, coverage, and the measures of each scope."""
    now = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "Europe/Rome"), "yyyyMMdd_HHmmss")
    config = config or {}
    rows = (
        metrics_by_source(merged, k=k)
        .crossJoin(F.broadcast(stats.select(F.col("n").alias("n_pred"), "coverage")))
        .crossJoin(F.broadcast(gold_attach_rate(merged)))
        .withColumns({"EVAL_RUN_ID": F.lit(run_id) if run_id else now, "k": F.lit(k), "join_method": F.lit(plan.method), "join_details": F.lit(plan.details)})
        .withColumns({key: F.lit(str(config.get(key, ""))) for key in CONFIG_KEYS})
    )
    return append_metrics(old, rows)


def classification_metrics(scored: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """One row of accuracy, precision, recall, f1 (of score > threshold) and average_precision; 0 where undefined."""
    yes, hit = F.col(score) > threshold, F.col(label) >= 0.5
    count = lambda c: F.sum(c.cast("long"))
    c = scored.agg(count(yes & hit).alias("tp"), count(yes & ~hit).alias("fp"), count(~yes & hit).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.crossJoin(average_precision(scored, label, score)).select(
        ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        "average_precision",
    )


STRETCHES = 4096


def _curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """By falling score, equal scores together: positives and rows down to it, and the next score below.

    Scores are dealt into STRETCHES equal stretches between the least and the greatest finite one; a window runs over
    the stretches, and one over the scores of each, so that no task holds all scores. A null score is below all others.
    """
    bottom = float("-inf")
    s = F.coalesce(F.col(score).cast("double"), F.lit(bottom))
    steps = scored.groupBy(F.when(s == 0, 0.0).otherwise(s).alias("s")).agg(F.sum((F.col(label) >= 0.5).cast("long")).alias("pos"), F.count("*").alias("rows"))
    finite = F.when(F.isnan("s") | (F.abs("s") == float("inf")), None).otherwise(F.col("s"))
    ends = scored.select(s.alias("s")).agg(F.min(finite).alias("least"), F.max(finite).alias("most"))
    share = F.coalesce((F.col("s") / 2 - F.col("least") / 2) / F.nullif(F.col("most") / 2 - F.col("least") / 2, F.lit(0.0)), F.lit(0.0))
    stretch = F.when(F.col("s") == bottom, -1).when(finite.isNull(), STRETCHES).otherwise(F.floor(share * (STRETCHES - 1)))
    steps = steps.crossJoin(F.broadcast(ends)).select("s", "pos", "rows", stretch.cast("int").alias("stretch"))
    sums = steps.groupBy("stretch").agg(F.sum("pos").alias("p"), F.sum("rows").alias("r"), F.max("s").alias("top"))
    before, whole = Window.orderBy(F.desc("stretch")), Window.partitionBy()
    upto = lambda c: F.sum(c).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    sums = sums.select(
        F.col("stretch").alias("_stretch"), upto("p").alias("p"), upto("r").alias("r"), F.sum("p").over(whole).alias("all_pos"), F.sum("r").over(whole).alias("all_rows"), F.lead("top").over(before).alias("next_top")
    )
    own = Window.partitionBy("stretch").orderBy(F.desc("s"))
    down = own.rowsBetween(Window.unboundedPreceding, 0)
    within = steps.withColumns({"tp_": F.sum("pos").over(down), "seen_": F.sum("rows").over(down), "below_": F.lead("s").over(own)})
    return within.join(F.broadcast(sums), F.col("stretch") == F.col("_stretch")).select(
        "s", "pos", (F.col("p") + F.col("tp_")).alias("tp"), (F.col("r") + F.col("seen_")).alias("seen"), "all_pos", "all_rows", F.coalesce("below_", "next_top").alias("below")
    )


def average_precision(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The mean over positives of the precision down to their score; equal scores count together."""
    return _curve(scored, label, score).agg(
        F.coalesce(F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("seen")), F.lit(0.0)).alias("average_precision")
    )


def best_threshold(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (threshold, accuracy): the most accurate cut, halfway between two scores (below the least: 10^-4 less);
    of equally accurate ones the highest."""
    curve = _curve(scored, label, score)
    right = F.col("tp") + (F.col("all_rows") - F.col("seen")) - (F.col("all_pos") - F.col("tp"))
    at = F.struct((right / F.col("all_rows")).alias("accuracy"), F.coalesce((F.col("s") + F.col("below")) / 2, F.col("s") - 1e-4).alias("threshold"))
    return curve.agg(F.max(at).alias("b")).select("b.threshold", "b.accuracy")
