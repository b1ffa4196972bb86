"""Alignment of a stream of attributes against a static index. An extension: batch results, as the attributes come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.text import camelcase_split, normalize_label, text_of
from quillon.operators.index import Index
from quillon.operators.score import AlignConfig, align


def exact_stream(queries: DataFrame, index: Index) -> DataFrame:
    """A streaming (query_id, query, iri) of exact hits: a stream-static join on the normalised form, without state."""
    variants = F.array_distinct(F.array(normalize_label("query"), normalize_label(camelcase_split(text_of("query")))))
    asked = queries.select("query_id", "query", F.explode(variants).alias("form")).where("form <> ''")
    return asked.join(index.forms.select("form", "iri"), "form").select("query_id", "query", "iri")


def align_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, config: AlignConfig = AlignConfig(), **options) -> StreamingQuery:
    """Aligns each micro-batch of streaming queries and hands the predictions to the sink with the batch's number.

    After a failure a batch may come again with the same number: a sink that overwrites by number gets each once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(align(batch, index, config), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
