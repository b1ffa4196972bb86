from quillon.operators import concepts as C
from quillon.operators import index as I
from quillon.operators.retrieve import RetrievalConfig
from quillon.operators.score import AlignConfig
from quillon.streaming.align_stream import align_stream, exact_stream


def test_streams(spark, tmp_path):
    row = ("c:1", "", "Sea Ice", "", "", "", "", "", 0)
    concepts = spark.createDataFrame([row], ", ".join(f"{c} string" for c in C.UNIFIED) + ", row_no long")
    index = I.build_index(C.internal_view(concepts))
    spark.createDataFrame([(1, "SeaIce"), (2, "rock")], "query_id long, query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "in"))
    seen = []
    align_stream(stream, index, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"), AlignConfig(RetrievalConfig("lexical"))).awaitTermination()
    assert {(r.query_id, r.predicted_iri) for r in seen} == {(1, "c:1"), (2, None)}
    q = exact_stream(stream, index).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.query_id, r.iri) for r in spark.table("hits").collect()] == [(1, "c:1")]
