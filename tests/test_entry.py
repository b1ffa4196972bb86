import __spark_entry__ as entry_point


def test_contract(spark, sf_dir):
    assert entry_point.entry(spark).count() > 0
    found, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50
    names = {name: found[name](spark, sf_dir).columns for name in ("align", "idf", "metrics_by_source")}
    assert all(len(set(c)) == len(c) for c in names.values())


def test_workers_get_the_package(spark):
    from quillon.deploy import ship_package

    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext._quillon_shipped
