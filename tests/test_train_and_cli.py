import pytest

from quillon import cli
from quillon.operators import dataset, train
from tests.test_sources import ALIGNMENT, OWL


@pytest.fixture(scope="module")
def pairs(spark):
    names = ["sea ice", "river bank", "deep water", "dry valley", "salt lake", "snow field"]
    rows = [(f"s{i}", f"t{j}", a, b, f"label: {a}", f"label: {b}", "x", float(i == j)) for i, a in enumerate(names) for j, b in enumerate(names) if i == j or (i + j) % 3 == 0]
    return spark.createDataFrame(rows, dataset.PAIR_COLUMNS)


def test_train(pairs, tmp_path):
    for kind in ("cross", "bi"):
        model = train.train_pairs(pairs, pairs, kind)
        m = train.evaluate_pairs(pairs, model).first()
        assert m.accuracy > 0.95 and m.average_precision > 0.95
    train.save_model(model, str(tmp_path / "m.json"))
    assert train.load_model(str(tmp_path / "m.json")) == model
    best, trials = train.optimize_pairs(pairs, pairs, n=2)
    assert trials.count() == 2 and best.kind == "cross"
    with pytest.raises(ValueError):
        train.train_pairs(pairs, pairs, "other")


def test_commands(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    cells = ALIGNMENT.replace("http://t.org/1", "http://x.org/o#Water").replace("http://s.org/1", "http://x.org/o#SeaIce").replace("http://t.org/2", "http://x.org/o#FrozenSea").replace("http://other.org/2", "http://x.org/o#FrozenSea")
    (tmp_path / "a.rdf").write_text(cells)
    (tmp_path / "q.csv").write_text("attribute\nSeaIce\nfrozen water\n")
    at = lambda n: str(tmp_path / n)
    cli.main(["index", "--ontology", at("o.owl"), "--export", at("concepts.csv"), "--out", at("index")])
    cli.main(["align", "--index", at("index"), "--queries", at("q.csv"), "--keep-top-n", "2", "--out", at("pred.csv")])
    got = {r.attribute_text: r for r in cli.read_table(spark, at("pred.csv")).collect()}
    assert got["frozen water"].retrieval_source == "hybrid" and got["frozen water"].top2_iri
    assert got["SeaIce"].row_id == "0" and got["frozen water"].row_id == "1"
    (tmp_path / "gold.csv").write_text("row_id,gold_target_iris\n0,['http://x.org/o#SeaIce']\n1,http://x.org/o#SeaIce\n")
    (tmp_path / "unnumbered.csv").write_text("gold_target_iris\nhttp://x.org/o#SeaIce\nhttp://x.org/o#Water\n")
    cli.main(["evaluate", "--predictions", at("pred.csv"), "--gold", at("unnumbered.csv"), "--out", at("m2.csv")])
    assert cli.read_table(spark, at("m2.csv")).first().join_method == "row_id"
    cli.main(["evaluate", "--predictions", at("pred.csv"), "--gold", at("gold.csv"), "--out", at("m.csv")])
    assert cli.read_table(spark, at("m.csv")).where("scope = 'overall'").first().n_pos == "2"
    cli.main(["search", "--index", at("index"), "--queries", at("q.csv"), "--gold", at("gold.csv"), "--trials", "1", "--out", at("s.csv")])
    assert cli.read_table(spark, at("s.csv")).count() == 1
    cli.main(["dataset", "--source", at("o.owl"), "--target", at("o.owl"), "--alignment", at("a.rdf"), "--out", at("data")])
    assert sum(spark.read.parquet(f"{at('data')}/{n}").count() for n in ("train", "val", "test")) >= 2
    with pytest.raises(ValueError):
        cli.main(["index", "--out", at("none")])
