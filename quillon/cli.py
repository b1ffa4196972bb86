"""Command line: python -m quillon.cli index | dataset | train | align | evaluate | search. Each has --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.models import hashing_encoder, overlap_scorer, transformer_encoder, transformer_scorer
from quillon.functions.text import SourceTextConfig
from quillon.operators import concepts, dataset, evaluate, index, retrieve, score, search, train
from quillon.sources import rdf, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def raw_classes(spark: SparkSession, path: str, prefix: str | None) -> DataFrame:
    """The classes of an ontology, or the concepts of a vocabulary if it has no classes."""
    triples = rdf.read_triples(spark, path).cache()
    classes = rdf.owl_classes(triples, prefix)
    return rdf.skos_concepts(triples, prefix) if classes.isEmpty() else classes


def _encoder(a):
    return transformer_encoder(a.encoder) if a.encoder else hashing_encoder()


def run_index(spark, a) -> None:
    if bool(a.concepts) == bool(a.ontology):
        raise ValueError("give either --concepts or --ontology")
    if a.concepts:
        made = tables.require_columns(read_table(spark, a.concepts), ["iri", "local_name", "label", "synonyms", "text"], a.concepts)
    else:
        made = concepts.internal_view(concepts.unified_view(raw_classes(spark, a.ontology, a.prefix)))
    if a.export:
        tables.write_csv(made, a.export)
    index.save_index(index.build_index(made, encoder=_encoder(a), encoder_id=a.encoder or "hashing"), a.out)


def run_dataset(spark, a) -> None:
    config = SourceTextConfig(use_description=a.description, use_synonyms=a.synonyms, use_parents=a.parents, use_equivalent=a.equivalent, use_disjoint=a.disjoint)
    s, t = concepts.load_views(raw_classes(spark, a.source, a.source_prefix), raw_classes(spark, a.target, a.target_prefix), config)
    encode = _encoder(a)
    s, t = (df.withColumn("embedding", encode(F.col(f"{p}_text"))).cache() for df, p in ((s, "source"), (t, "target")))
    pairs = dataset.training_dataset(s, t, rdf.read_alignment(spark, a.alignment))
    ratios = tuple(float(x) for x in a.ratios.split(","))
    dataset.save_splits(dataset.stratified_split(pairs, ratios), a.out)


def run_train(spark, a) -> None:
    parts = {n: spark.read.parquet(f"{a.dataset}/{n}") for n in ("train", "val", "test")}
    if a.trials:
        model, trials = train.optimize_pairs(parts["train"], parts["val"], a.kind, a.trials)
        trials.show(truncate=False)
    else:
        model = train.train_pairs(parts["train"], parts["val"], a.kind)
    train.evaluate_pairs(parts["test"], model).show()
    train.save_model(model, a.out)


def asked(spark, a) -> DataFrame:
    rows = tables.require_columns(read_table(spark, a.queries), [c for c in (a.retrieval_col, a.scoring_col, a.id_col) if c], a.queries)
    rows = rows if a.id_col else tables.in_file_order(rows).withColumnRenamed("row_no", "row_id")
    names = [F.col(a.id_col or "row_id").alias("query_id"), F.col(a.retrieval_col).alias("query")]
    return rows.select(*names, *([F.col(a.scoring_col).alias("scoring_query")] if a.scoring_col else []))


def align_config(a) -> score.AlignConfig:
    return score.AlignConfig(retrieve.RetrievalConfig(a.mode, a.lexical_top_k, a.semantic_top_k, a.merged_top_k, a.ratio), a.cross_top_k, a.keep_top_n)


def _scorer(a):
    if a.model:
        return train.load_model(a.model).scorer()
    return transformer_scorer(a.scorer) if a.scorer else overlap_scorer()


def run_align(spark, a) -> None:
    queries = asked(spark, a)
    out = score.align(queries, index.load_index(spark, a.index), align_config(a), _scorer(a), encoder=_encoder(a))
    out = score.top_columns(out.withColumnRenamed("query_id", a.id_col or "row_id"), a.keep_top_n)
    tables.write_csv(out, a.out)


def run_evaluate(spark, a) -> None:
    gold, predictions = read_table(spark, a.gold), read_table(spark, a.predictions)
    gold = gold if "match" in gold.columns else gold.withColumn("match", F.lit(1))
    if "row_id" in predictions.columns and "row_id" not in gold.columns:
        gold = tables.in_file_order(gold).withColumnRenamed("row_no", "row_id")
    merged, plan = evaluate.join_predictions(gold, predictions, a.id_col)
    config = tables.read_config(spark, a.config) if a.config else {}
    old = read_table(spark, a.append) if a.append else None
    rows = evaluate.metrics_rows(merged, evaluate.basic_stats(predictions), plan, a.k, config, old=old)
    rows.select("scope", "retrieval_source", "n_pred", "coverage", "gold_attach_rate", *evaluate.METRICS).show(truncate=False)
    tables.write_csv(rows, a.out)


def run_search(spark, a) -> None:
    ready = index.cached(index.load_index(spark, a.index))
    queries = asked(spark, a).cache()
    vectors = queries.select("query_id", _encoder(a)(F.coalesce("query", F.lit(""))).alias("embedding")).cache()
    gold = read_table(spark, a.gold)
    gold = gold.select(F.col(a.id_col or "row_id").alias("query_id"), "gold_target_iris", (F.col("match") if "match" in gold.columns else F.lit(1)).alias("match"))
    state = search.prepare(queries, ready, vectors, _scorer(a))
    tables.write_csv(search.search(state, gold, list(search.trials(a.trials))), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        for flag, *more in options:
            c.add_argument(flag, **(more[0] if more else {"required": True}))
        c.add_argument("--encoder", default="", help="folder of a local bi-encoder; without, hashed tokens")
        c.set_defaults(run=run)

    free, yes = {"default": None}, {"action": "store_true"}
    number = lambda n, kind=int: {"type": kind, "default": n}
    query = [("--index",), ("--queries",), ("--retrieval-col", {"default": "attribute"}), ("--scoring-col", free), ("--id-col", free), ("--model", free), ("--scorer", free), ("--out",)]
    command("index", run_index, ("--concepts", free), ("--ontology", free), ("--prefix", free), ("--export", free), ("--out",))
    texts = [(f"--{x}", yes) for x in ("description", "synonyms", "parents", "equivalent", "disjoint")]
    command("dataset", run_dataset, ("--source",), ("--target",), ("--alignment",), ("--source-prefix", free), ("--target-prefix", free), ("--ratios", {"default": "0.75,0.15,0.10"}), ("--out",), *texts)
    command("train", run_train, ("--dataset",), ("--kind", {"default": "cross", "choices": ["cross", "bi"]}), ("--trials", number(0)), ("--out",))
    budgets = [("--mode", {"default": "hybrid", "choices": ["lexical", "hybrid"]}), ("--lexical-top-k", number(100)), ("--semantic-top-k", number(100)), ("--merged-top-k", number(150))]
    budgets += [("--ratio", number(0.5, float)), ("--cross-top-k", number(20)), ("--keep-top-n", number(0))]
    command("align", run_align, *query, *budgets)
    command("evaluate", run_evaluate, ("--predictions",), ("--gold",), ("--k", number(10)), ("--id-col", free), ("--config", free), ("--append", free), ("--out",))
    command("search", run_search, *query, ("--gold",), ("--trials", number(100)))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
