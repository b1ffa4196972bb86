from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        if name != "mixing":
            assert after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
        before = after
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.fixture(scope="module")
def hard(spark, sf_dir):
    """Null ids, texts and sources, empty and very long texts, repeated ids and rows, columns whose names clash."""
    prose = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").orderBy("doc_id").limit(30).collect()]
    rows = [(1, prose[0], "a"), (1, prose[0], "a"), (5, prose[0], "b"), (5, prose[1], "b"), (7, prose[2], "a"), (7, None, "a"), (8, "", None), (8, "", None)]
    rows += [(None, prose[2], "a"), (None, None, None), (9, " \n\t", "b"), (10, "\n".join(prose * 3), "c"), (11, prose[3], "a"), (12, prose[3] + " more", "c")]
    rows += [(20 + i, t, "abc"[i % 3]) for i, t in enumerate(prose[4:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ["id", "row", "d1", "d2", "set", "stays", "times", "copies", "target", "mix_key", "mix_row", "shard", "part", "g", "salt", "regions", "score"]
    return df.select("doc_id", "text", "source", *[F.lit(3).alias(c) for c in clash])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_hard_rows(spark, sf_dir, hard, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, hard, sf_dir)
    rows = got.collect()
    if name == "sharding":
        assert len(rows) == hard.count()
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        return
    assert got.columns == hard.columns
    key = lambda r: (r.doc_id, r.text, r.source)
    before, after = Counter(map(key, hard.collect())), Counter(map(key, rows))
    assert set(after) <= set(before)
    if name in ("toxicity", "decontamination"):
        assert all(after[k] == before[k] for k in after)
    if name == "mixing":
        assert all(after[k] <= 3 * before[k] for k in after)


def test_one_row_of_each_near_duplicate_group(spark, sf_dir, hard):
    got = corpus_pipeline.without_near_duplicates(spark, hard, sf_dir).collect()
    first = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    kept = Counter((r.doc_id, (r.text or "")[:200]) for r in got)
    text = lambda i, of: (i, of[:200])
    a, b, c = (next(r.text for r in hard.collect() if r.doc_id == i) for i in (1, 11, 7))
    assert kept[text(1, a)] == 1 and kept[text(5, a)] == 0 and kept[text(5, first[5])] == 1
    assert kept[text(7, c)] == 1 and kept[(7, "")] == 1 and kept[(8, "")] == 1 and kept[text(None, c)] == 1 and kept[(None, "")] == 1
    assert kept[text(11, b)] == 1 and kept[text(12, b)] == 0 and kept[(9, " \n\t")] == 1


def test_no_table_is_left_of_the_steps(spark, sf_dir, hard):
    from quillon.llm import scratch

    scratch.clear(spark)
    corpus_pipeline.without_near_duplicates(spark, hard, sf_dir).collect()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._ours}
    assert left <= {"minhash", "members", "least", "gone", "many", "touched", "bit-table"}
    scratch.clear(spark)
    assert not scratch._ours
