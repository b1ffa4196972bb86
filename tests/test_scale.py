"""What retrieval keeps and shuffles when queries and classes repeat, and its blocks against plain expressions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import dataset as D
from quillon.operators import index as I
from quillon.operators import retrieve as R
from quillon.plans import catalog
from quillon.sources import rdf


def shuffled(spark, run):
    """What run returns, and the records that its stages shuffled."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        every = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteRecords() for i in range(every.size())}

    before = stages()
    out = run()
    return out, sum(n for stage, n in stages().items() if stage not in before)


@pytest.fixture(scope="module")
def repeated(spark):
    """600 classes of two labels, asked 60 times by the same texts."""
    concepts = spark.range(600).select(F.concat(F.lit("c:"), "id").alias("iri"), F.when(F.col("id") < 500, "red ring").otherwise("old bolt").alias("label"), F.lit("").alias("synonyms"), F.col("id").alias("row_no"))
    return I.build_index(concepts), spark.range(60).select(F.col("id").alias("query_id"), F.lit("a red red thing").alias("query"))


def test_lexical_of_equal_texts_is_done_once(spark, repeated):
    index, queries = repeated
    got, records = shuffled(spark, lambda: R.lexical_candidates(queries, index, 3).collect())
    least = sorted(f"c:{i}" for i in range(500))[:3]
    assert sorted((r.query_id, r.rank, r.iri) for r in got) == [(q, n, iri) for q in range(60) for n, iri in enumerate(least, 1)]
    assert records < 10_000  # a row for each query and class makes 30,000


def test_exact_of_equal_texts_is_done_once(spark, repeated):
    index, queries = repeated
    asked = queries.withColumn("query", F.lit("RedRing"))
    n, records = shuffled(spark, lambda: R.exact_candidates(asked, index).select(F.sum("rank")).first()[0])
    assert n == 60 * 500 * 501 // 2 and records < 5_000
    assert {(r.hits, r.iri) for r in R.exact_least(asked, index).collect()} == {(500, "c:0")}
    assert R.without_exact(asked, index).count() == 0 and R.without_exact(queries, index).count() == 60


def test_lexical_in_parts_and_against_a_plain_join(spark, monkeypatch):
    dice = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    said = lambda n, most: [" ".join(dice.choices(words, k=dice.randint(0, most))) for _ in range(n)]
    concepts = spark.createDataFrame([(f"c:{i}", t, "", i) for i, t in enumerate(said(150, 4))], "iri string, label string, synonyms string, row_no long")
    queries = spark.createDataFrame(list(enumerate(said(40, 6))), "query_id long, query string")
    index = I.build_index(concepts)
    asked = queries.select("query_id", F.explode(F.split("query", " ")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("n"))
    plain = asked.join(index.idf.where("idf > 0"), "token").join(index.postings, "token").groupBy("query_id", "iri").agg(F.sum(F.col("n") * F.col("idf")).alias("score"))
    want = sorted((r.query_id, r.rank, r.iri, round(r.score, 9)) for r in R.ranked(plain, 5).collect())
    rows = lambda: sorted((r.query_id, r.rank, r.iri, round(r.score, 9)) for r in R.lexical_candidates(queries, index, 5).collect())
    assert rows() == want and len(want) > 150
    monkeypatch.setattr(R, "SMALL_SIDE_ROWS", 9)
    assert rows() == want


@pytest.mark.parametrize("normalized", [True, False])
def test_semantic_of_odd_vectors_and_ties(spark, monkeypatch, normalized):
    dice = random.Random(3)
    odd = [None, [], [None, 1.0], [1.0, 2.0, 3.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    made = lambda n: [[dice.choice([-1.0, 0.0, 0.5, 1.0]), dice.choice([0.1, 0.7])] for _ in range(n)] + odd
    vectors = spark.createDataFrame([(f"c:{i}", x) for i, x in enumerate(made(300))], "iri string, embedding array<float>").repartition(7)
    queries = spark.createDataFrame(list(enumerate(made(20))), "query_id long, embedding array<float>")
    score = (V.dot if normalized else V.cosine)("q", "embedding")
    plain = vectors.join(F.broadcast(queries.withColumnRenamed("embedding", "q"))).select("query_id", "iri", score.alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "iri")
    plain = plain.withColumn("rank", F.row_number().over(by)).where("rank <= 8")
    rows = lambda df: sorted((r.query_id, r.rank, r.iri, str(r.score)) for r in df.collect())
    want = rows(plain)
    assert rows(R.semantic_candidates(queries, vectors, 8, normalized)) == want
    monkeypatch.setattr(R, "SMALL_SIDE_ROWS", 10)
    assert rows(R.semantic_candidates(queries, vectors, 8, normalized)) == want


def test_semantic_keeps_no_more_of_more_partitions(spark):
    vectors = spark.range(4_000).select(F.concat(F.lit("c:"), "id").alias("iri"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding")).repartition(64)
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.rand(3), F.rand(4)).cast("array<float>").alias("embedding"))
    n, records = shuffled(spark, lambda: R.semantic_candidates(queries, vectors, 10).count())
    assert n == 400 and records < 15_000  # ten of each query from each of 64 partitions are 25,600


def test_first_sampled_is_the_head_of_the_whole_order(spark):
    rows = spark.range(3_000).select(F.concat(F.lit("a"), F.col("id") % 60).alias("a"), F.concat(F.lit("b"), "id").alias("b"))
    for num in (0, 1, 700, 3_000, 5_000):
        want = rows.orderBy(*D.sample_order(42, "a", "b")).limit(num).collect()
        assert sorted(D.first_sampled(rows, num, 42, "a", "b").collect()) == sorted(want)


def test_training_dataset_has_no_task_for_a_whole_sample(spark):
    sources = spark.range(30).select(F.concat(F.lit("s"), "id").alias("source_iri"), F.lit("x").alias("source_label"), F.lit("").alias("source_text"))
    targets = spark.range(200).select(F.concat(F.lit("t"), "id").alias("target_iri"), F.lit("y").alias("target_label"), F.lit("").alias("target_text"))
    taken = spark.range(900).select(F.concat(F.lit("s"), F.col("id") % 30).alias("source_iri"), F.concat(F.lit("t"), F.col("id") % 200).alias("target_iri")).distinct()
    negatives = D.random_negatives(sources, targets, taken, 1_000)
    assert "TakeOrderedAndProject 1000" not in negatives._jdf.queryExecution().toString() and "limit=1000" not in negatives._jdf.queryExecution().toString()
    assert negatives.select("source_iri", "target_iri").distinct().count() == 1_000
    assert negatives.join(taken, ["source_iri", "target_iri"]).count() == 0


def test_classes_parse_each_document_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        parsed.add(1)
        return text

    text = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:owl='http://www.w3.org/2002/07/owl#'><owl:Class rdf:about='http://x/{}'/></rdf:RDF>"
    documents = spark.createDataFrame([(f"d{i}", text.format(i)) for i in range(5)], "path string, content string")
    made = rdf.owl_classes(rdf.parse_triples(documents.select("path", seen.asNondeterministic()("content").alias("content"))))
    assert sorted(r.iri for r in made.collect()) == [f"http://x/{i}" for i in range(5)]
    assert parsed.value == 5


def test_pairs_keep_their_parts_for_the_joins(spark, sf_dir):
    plan = catalog.training_positives(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3
