import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.functions.models import word_pieces
from quillon.operators.evaluate import gold_list
from quillon.operators.retrieve import split_budget


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else v[1]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "f, given_text, expected",
    [
        (T.normalize_label, "  Sea\tIce ", "sea ice"),
        (T.normalize_label, None, ""),
        (T.normalize_label, " a  b ", "a b"),
        (T.camelcase_split, "SeaIceArea", "Sea Ice Area"),
        (T.miner_normalize, "PrecipitableWater", "precipitable water"),
        (T.miner_normalize, "wave-number", "wave number"),
        (T.miner_normalize, None, ""),
        (T.humanize_name, "hasPartOf", "has part of"),
        (T.humanize_name, "DNA", "d n a"),
        (T.humanize_name, "is_part-of", "is part of"),
    ],
)
def test_text_functions(spark, f, given_text, expected):
    assert one(spark, f("t"), t=given_text) == expected


def test_lists(spark):
    assert one(spark, T.split_multi("t"), t=" a | |b\t|") == ["a", "b"]
    assert one(spark, T.split_multi("t"), t=None) == []
    assert one(spark, T.miner_synonyms("t"), t="SeaIce | x-y") == ["sea ice", "x y"]
    assert one(spark, T.class_forms(F.lit("Sea Ice"), "t"), t="sea ice | Pack |  ") == ["sea ice", "pack"]
    assert one(spark, T.scoring_text(F.lit("  "), "t"), t=" b ") == "b"
    assert one(spark, gold_list("t"), t="['a', 'b']") == ["a", "b"]
    assert one(spark, gold_list("t"), t="a") == ["a"]
    assert one(spark, gold_list("t"), t=None) == []


def test_texts(spark):
    row = spark.createDataFrame([("", "loc", "d", "s", "p", "", "x")], "label string, local_name string, description string, synonyms string, parents_label string, equivalent_to string, disjoint_with string")
    every = T.SourceTextConfig(True, True, True, True, True, True)
    assert row.select(T.source_text(every)).first()[0] == "local name: loc; description: d; synonyms: s; parents: p; disjoint with: x"
    assert row.select(T.source_text()).first()[0] == "local name: loc; description: d"
    assert row.select(T.target_text()).first()[0] == "local name: loc; description: d; Synonyms: s; Parents: p; Disjoint with: x"


def test_vectors(spark):
    row = spark.sql("select array(3.0f, 4.0f) a, array(0.0f, 1.0f) b, array(array(1.0f, 2.0f), array(3.0f, 4.0f)) h, array(1, 0) m, array(0, 0) z")
    assert row.select(V.dot("a", "b"), V.norm("a"), V.cosine("a", "b")).first()[:] == (4.0, 5.0, pytest.approx(0.8))
    assert row.select(V.mean_pool("h", "m")).first()[0] == [1.0, 2.0]
    assert row.select(V.mean_pool("h", "z")).first()[0] == [0.0, 0.0]
    for logits, score in (([0.0], 0.5), ([0.0, 0.0], 0.5), ([0.0, 0.0, 0.0], 1 / 3), ([2.0], 1 / (1 + math.exp(-2)))):
        assert spark.range(1).select(V.score_from_logits(F.lit(logits))).first()[0] == pytest.approx(score)
    code = spark.createDataFrame([("sea ice",), (None,)], "t string").select(V.hashed_encoding("t").alias("v")).collect()
    assert sum(x * x for x in code[0].v) == pytest.approx(1, abs=1e-6) and sum(code[1].v) == 0
    flags = spark.createDataFrame([("1",), ("0.4",), ("x",), (None,), ("0.5",)], "t string").select(V.as_flag("t").alias("f"))
    assert [r.f for r in flags.collect()] == [1, 0, None, None, 1]


def test_word_pieces(spark):
    split = word_pieces(["sea", "##ice", "ice", "a"])
    assert one(spark, split(F.col("t")), t="Seaice a zz") == ["sea", "##ice", "a", "[UNK]"]


@pytest.mark.parametrize("total, ratio, expected", [(150, 0.3, (105, 45)), (75, 0.5, (37, 38)), (5, 0.5, (3, 2)), (10, 2.0, (0, 10)), (0, 0.5, (0, 0))])
def test_budget(total, ratio, expected):
    assert split_budget(total, ratio) == expected


@given(st.integers(0, 1000), st.floats(-1, 2))
def test_budget_adds_up(total, ratio):
    lexical, semantic = split_budget(total, ratio)
    assert lexical + semantic == total and lexical >= 0 and semantic >= 0
