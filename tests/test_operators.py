import pytest
from pyspark.sql import functions as F

from quillon.operators import concepts as C
from quillon.operators import dataset as D
from quillon.operators import evaluate as E
from quillon.operators import index as I
from quillon.operators import retrieve as R
from quillon.operators import score as S
from quillon.operators import search as H
from quillon.sources.tables import with_row_no


@pytest.fixture(scope="module")
def concepts(spark):
    rows = [
        ("c:1", "", "Sea Ice", "", "Pack Ice | Ice", "", "", "", 0),
        ("c:2", "", "Sea Water", "", "", "", "", "", 1),
        ("c:3", "", "River", "", "Stream", "", "", "", 2),
        ("c:3", "", "River Bank", "", "", "", "", "", 3),
        ("c:4", "", "Sea Ice", "", "", "", "", "", 4),
    ]
    names = ", ".join(f"{c} string" for c in C.UNIFIED) + ", row_no long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def index(spark, concepts):
    vectors = spark.createDataFrame([("c:1", [1.0, 0.0]), ("c:2", [0.0, 1.0]), ("c:3", [0.6, 0.8]), ("c:4", [0.8, 0.6])], "iri string, embedding array<float>")
    return I.build_index(C.internal_view(concepts), vectors=vectors)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_last_row_of_an_iri_counts(index):
    assert index.n_classes == 4
    assert {r.form for r in index.forms.where("iri = 'c:3'").collect()} == {"river bank"}
    assert [r.form for r in index.forms.where("iri = 'c:1'").orderBy("pos").collect()] == ["sea ice", "pack ice", "ice"]


def test_exact_both_variants_and_empty(spark, index):
    got = R.exact_candidates(asked(spark, "SeaIce", "ICE", "", None, "nothing"), index).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.iri, r.score) for r in got] == [(0, 1, "c:1", 1.0), (0, 2, "c:4", 1.0), (1, 1, "c:1", 1.0)]


def test_lexical_counts_repeats_and_skips_tokens_of_all(spark, index):
    once = {r.iri: r.score for r in R.lexical_candidates(asked(spark, "ice"), index).collect()}
    twice = {r.iri: r.score for r in R.lexical_candidates(asked(spark, "ice ice"), index).collect()}
    assert twice == {k: pytest.approx(2 * v) for k, v in once.items()} and set(once) == {"c:1", "c:4"}
    every = I.Index(index.forms, index.postings, index.idf.withColumn("idf", F.lit(0.0)), index.texts, None, 4)
    assert R.lexical_candidates(asked(spark, "ice"), every).count() == 0
    assert R.lexical_candidates(asked(spark, "ice"), index, 0).count() == 0


def test_semantic_both_ways(spark, index):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "query_id long, embedding array<float>")
    plain = [tuple(r) for r in R.semantic_candidates(q, index.vectors, 2, normalized=False).select("query_id", "rank", "iri").collect()]
    blocked = [tuple(r) for r in R.blocked_semantic_candidates(q, index.vectors, 2, normalized=False).select("query_id", "rank", "iri").collect()]
    assert sorted(plain) == sorted(blocked) == [(0, 1, "c:1"), (0, 2, "c:4"), (1, 1, "c:2"), (1, 2, "c:3")]


def _list(spark, source, *iris):
    return spark.createDataFrame([(0, i, iri, 1.0 / i, source) for i, iri in enumerate(iris, 1)], "query_id long, rank int, iri string, score double, source string")


def test_merge_keeps_the_first(spark):
    got = R.merge_candidates(_list(spark, "lexical", "a", "b"), _list(spark, "semantic", "b", "c"), 3).orderBy("rank").collect()
    assert [(r.iri, r.source) for r in got] == [("a", "lexical"), ("b", "lexical"), ("c", "semantic")]
    assert R.merge_candidates(_list(spark, "lexical", "a"), _list(spark, "semantic", "b"), 0).count() == 0


def test_pairs_fill_a_short_side(spark):
    texts = spark.createDataFrame([(x, x) for x in "abcdefg"], "iri string, text string")
    merged = _list(spark, "lexical", "a").union(_list(spark, "semantic", *"bcdef").withColumn("rank", F.col("rank") + 1))
    got = S.scoring_pairs(merged, texts, 4, "hybrid", 0.5).orderBy("cand_rank").collect()
    assert [r.iri for r in got] == ["a", "b", "c", "d"]
    short = S.scoring_pairs(merged, texts.where("iri <> 'b'"), 4, "hybrid", 0.5)
    assert {r.iri for r in short.collect()} == {"a", "c", "d"}
    assert S.scoring_pairs(merged, texts, 0, "lexical").count() == 1


def test_align_has_one_row_a_query(spark, index):
    config = S.AlignConfig(R.RetrievalConfig("lexical", 5, 5), 5, 2)
    got = {r.query_id: r for r in S.align(asked(spark, "SeaIce", "ice water", "zzz", None), index, config).collect()}
    assert len(got) == 4
    assert (got[0].retrieval_source, got[0].predicted_iri, got[0].predicted_score, got[0].num_scored, got[0].top) == ("exact", "c:1", 1.0, 0, [])
    assert got[1].retrieval_source == "lexical" and got[1].num_scored == 3 and len(got[1].top) == 2
    assert (got[2].retrieval_source, got[2].predicted_iri, got[2].num_retrieved) == ("none", None, 0)
    assert got[3].attribute_text == ""
    with pytest.raises(ValueError):
        R.retrieve(asked(spark, "x"), index, R.RetrievalConfig("other"))


def test_index_round_trip(spark, index, tmp_path):
    I.save_index(index, str(tmp_path / "index"))
    again = I.load_index(spark, str(tmp_path / "index"), "default")
    for name in ("forms", "postings", "idf", "texts", "vectors"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(index, name).collect()))
    assert again.n_classes == 4
    with pytest.raises(ValueError):
        I.load_index(spark, str(tmp_path / "index"), "another")


@pytest.mark.parametrize("a, b, bad", [("mudflat", "mud flat", True), ("cancer", "lung cancer", True), ("river", "valley", False), ("", "x", True), ("b a", "a b c", True), ("ice", "pack", True)])
def test_hard_negative_predicate(spark, a, b, bad):
    said = F.array(F.lit("ice"))
    row = spark.range(1).select(D.is_bad_hard_negative(F.lit(a), F.lit(b), F.array().cast("array<string>"), said if a == "ice" else F.array().cast("array<string>")))
    assert row.first()[0] is bad


def test_random_negatives_end(spark):
    s = spark.createDataFrame([("a",), ("b",)], "source_iri string")
    t = spark.createDataFrame([("x",), ("y",)], "target_iri string")
    taken = s.crossJoin(t).where("not (source_iri = 'a' and target_iri = 'y')")
    assert [tuple(r)[:2] for r in D.random_negatives(s, t, taken, 50).collect()] == [("a", "y")]
    assert D.random_negatives(s, t, taken, 0).count() == 0
    many_s = spark.range(300).select(F.concat(F.lit("s"), "id").alias("source_iri"))
    many_t = spark.range(300).select(F.concat(F.lit("t"), "id").alias("target_iri"))
    got = D.random_negatives(many_s, many_t, taken, 50)
    assert got.distinct().count() == 50


def test_split_shares(spark):
    pairs = spark.range(100).select(F.col("id").alias("source_iri"), F.lit("t").alias("target_iri"), (F.col("id") < 40).cast("int").alias("match"))
    got = D.stratified_split(pairs)
    counts = {(r.match, r.split): r["count"] for r in got.groupBy("match", "split").count().collect()}
    assert counts == {(1, "test"): 4, (1, "val"): 6, (1, "train"): 30, (0, "test"): 6, (0, "val"): 9, (0, "train"): 45}
    again = D.stratified_split(pairs.repartition(7))
    assert got.exceptAll(again).count() == 0
    grouped = D.stratified_split(pairs.withColumn("g", F.col("source_iri") % 20), group="g")
    assert grouped.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        D.stratified_split(pairs, (0.9, 0.2, 0.1))


def test_queries_with_gold(spark, tmp_path):
    rows = [("a", "x", "A", "", "ta", "", "positive", 1.0), ("a", "y", "A", "", "ta", "", "positive", 1.0), ("a", "z", "A", "", "ta", "", "hard", 0.0), ("b", "x", "B", "", "tb", "", "hard", 0.0)]
    test = spark.createDataFrame(rows, D.PAIR_COLUMNS)
    got = D.queries_with_gold(test).collect()
    assert [(r.source_iri, r.gold_target_iris) for r in got] == [("a", ["x", "y"])]
    with pytest.raises(ValueError):
        D.queries_with_gold(test.where("match = 0"))
    D.save_splits(test.withColumn("split", F.lit("test")), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "test_gold")).count() == 1


def test_ranking_metrics(spark):
    rows = [("x", "g2", "g1", ["g1", "g2"], 1, "hybrid"), ("g", None, None, ["g"], 1, "exact"), ("g", None, None, ["g"], 0, "exact"), (None, None, None, None, None, None)]
    merged = spark.createDataFrame(rows, "predicted_iri string, top2_iri string, top3_iri string, gold_target_iris array<string>, match int, retrieval_source string")
    m = E.ranking_metrics(merged, k=3).first()
    assert (m.n_pos, m.precision_at_1_pos, m.hits_at_k_pos, m.mrr_at_k_pos) == (2, 0.5, 1.0, 0.75)
    by = {r.retrieval_source: r.mrr_at_k_pos for r in E.metrics_by_source(merged, k=3).collect()}
    assert by == {"ALL": 0.75, "hybrid": 0.5, "exact": 1.0}
    none = E.ranking_metrics(merged.where("match = 0")).first()
    assert none.n_pos == 0 and none.precision_at_1_pos != none.precision_at_1_pos
    with pytest.raises(ValueError):
        E.ranking_metrics(merged, k=0)
    stats = E.basic_stats(merged).first()
    assert stats.n == 4 and stats.coverage == 0.75 and [(d.source, d.share) for d in stats.distribution] == [("exact", 0.5), ("hybrid", 0.25), ("none", 0.25)]


def test_join_strategies(spark):
    pred = spark.createDataFrame([(0, "u", "a"), (1, "v", None)], "row_id long, attribute_text string, predicted_iri string")
    by_row = spark.createDataFrame([(0, ["a"], 1)], "row_id long, gold_target_iris array<string>, match int")
    merged, plan = E.join_predictions(by_row, pred)
    assert plan.method == "row_id" and merged.count() == 2 and E.gold_attach_rate(merged).first()[0] == 0.5
    by_text = spark.createDataFrame([("u", ["a"], 1), ("u2", ["b"], 1)], "source_text string, gold_target_iris array<string>, match int")
    assert E.join_predictions(by_text, pred)[1].method == "text"
    with pytest.raises(ValueError):
        E.join_predictions(by_text.union(by_text), pred)
    twice = by_row.union(by_row)
    assert E.join_predictions(twice, pred)[0].count() == 3


def test_classification(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.3), (0, 0.1)]
    scored = spark.createDataFrame(rows, "label int, score double")
    m = E.classification_metrics(scored).first()
    assert (m.accuracy, m.precision, m.recall) == (pytest.approx(0.6), pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert m.average_precision == pytest.approx((1 + 1 + 3 / 4) / 3)
    best = E.best_threshold(scored).first()
    assert best.accuracy == pytest.approx(0.8) and best.threshold == pytest.approx(0.75)
    assert E.classification_metrics(scored.where("false")).first().accuracy == 0


def test_search_and_graph(spark, index):
    queries = asked(spark, "sea water now", "bank")
    vectors = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.6, 0.8])], "query_id long, embedding array<float>")
    gold = spark.createDataFrame([(0, ["c:2"], 1), (1, ["c:3"], 1)], "query_id long, gold_target_iris array<string>, match int")
    state = H.prepare(queries, index, vectors)
    tried = list(H.trials(3))
    assert all(t.makes_sense() for t in tried)
    got = H.search(state, gold, tried).collect()
    assert len(got) == 3 and got[0].precision_at_1_pos == 1.0
    nodes, edges = H.alignment_graph(spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "source_label string, target_label string"))
    assert edges.count() == 2 and {(r.id, r.degree) for r in nodes.collect()} == {("a", 2), ("x", 1), ("y", 1)}


def test_random_negatives_find_all_that_are_asked_for(spark):
    """A dense table: 200 eligible pairs among 1,000, asked for in part, in whole and beyond."""
    s = spark.createDataFrame([(f"s{i}",) for i in range(25)], "source_iri string")
    t = spark.createDataFrame([(f"t{i}",) for i in range(40)], "target_iri string")
    taken = spark.createDataFrame([(f"s{i}", f"t{j}") for i in range(20) for j in range(40)], "source_iri string, target_iri string")
    for num, want in ((100, 100), (200, 200), (500, 200)):
        got = {tuple(r)[:2] for r in D.random_negatives(s, t, taken, num).collect()}
        assert len(got) == want and all(int(a[1:]) >= 20 for a, _ in got)


def test_scores_closer_than_a_ten_thousandth(spark):
    scored = spark.createDataFrame([(1.0, 0.90004), (0.0, 0.90003), (1.0, 0.90002), (0.0, 0.90001)], "label double, score double")
    assert E.average_precision(scored).first()[0] == pytest.approx((1 + 2 / 3) / 2)
    best = E.best_threshold(scored).first()
    assert best.accuracy == 0.75 and best.threshold == pytest.approx(0.900035)
    odd = spark.createDataFrame([(1.0, None), (0.0, float("inf")), (1.0, -5.0), (0.0, None), (1.0, 3.0)], "label double, score double")
    assert E.average_precision(odd).first()[0] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)
    assert E.average_precision(odd.where("false")).first()[0] == 0


def test_numbers_of_rows_are_those_of_their_order(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x").repartition(9)
    assert all(r.x == r.row_no for r in with_row_no(df, "x").collect())


def test_another_tokenizer_or_encoder_than_the_index_s_is_refused(spark, concepts):
    pieces = lambda c: F.split(F.lower(c), "")
    made = I.build_index(concepts, tokenizer=pieces, tokenizer_id="characters", encoder_id="hashed")
    asked = spark.createDataFrame([(1, "iec")], "query_id long, query string")
    for more in ({}, {"tokenizer": pieces, "tokenizer_id": "characters", "encoder_id": "other"}):
        with pytest.raises(ValueError):
            S.align(asked, made, **more)
    got = S.align(asked, made, tokenizer=pieces, tokenizer_id="characters", encoder_id="hashed").collect()
    assert len(got) == 1 and got[0].retrieval_source != "none"
