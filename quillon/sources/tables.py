"""Tables in files: CSV and Parquet, required columns, run configurations, archives."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.text import text_of

# The keys of a run configuration that a metrics row carries.
CONFIG_KEYS = (
    "RUN_ID",
    "RUN_MODE",
    "MODEL_TYPE",
    "MODEL_NAME",
    "CROSS_ENCODER_MODEL_ID",
    "BI_ENCODER_MODEL_ID",
    "CROSS_TOKENIZER_NAME",
    "NUM_EPOCHS",
    "LEARNING_RATE",
    "BATCH_SIZE",
    "WEIGHT_DECAY",
    "SPLIT_RATIOS",
    "OFFLINE_SEMANTIC_BATCH_SIZE",
    "OFFLINE_SEMANTIC_MAX_LENGTH",
    "INFER_MODE",
    "RETRIEVAL_LEXICAL_TOP_K",
    "RETRIEVAL_SEMANTIC_TOP_K",
    "RETRIEVAL_MERGED_TOP_K",
    "HYBRID_RATIO_SEMANTIC",
    "CROSS_TOP_K",
    "CROSS_BATCH_SIZE",
    "CROSS_MAX_LENGTH",
    "KEEP_TOP_N",
)


def resolve_source(path: str) -> str:
    """The path of a local file, or a URL that Spark or a loader can read; other schemes and missing files raise ValueError."""
    scheme = urlparse(path).scheme
    if scheme in ("http", "https", "file"):
        return path
    if (not scheme or len(scheme) == 1) and os.path.exists(path):
        return path
    raise ValueError(f"not an existing file and not a supported URL: {path}")


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """The table itself; ValueError naming the columns that it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header and quoted line breaks; all strings unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def text_map(concepts: DataFrame, iri: str = "iri", text: str = "text", order: str | None = None) -> DataFrame:
    """(iri, text): of repeated ids the last row in `order` (its greatest text without an order)."""
    require_columns(concepts, [iri, text], "concept table")
    by = F.col(order) if order else text_of(text)
    return concepts.groupBy(F.col(iri).alias("iri")).agg(F.max_by(text_of(text), by).alias("text"))


def append_metrics(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old rows and new rows, with the columns of both."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def config_rows(lines: DataFrame, keys: Iterable[str] = CONFIG_KEYS) -> DataFrame:
    """(key, value) of the lines 'key = value' or 'key: value' (column value) with a known key.

    Blank lines, comments from '#' on and '[section]' lines are skipped; an equals sign goes before a colon; keys are
    upper-cased. Of a repeated key every line is kept.
    """
    line = F.trim("value")
    useful = lines.where((line != "") & ~line.startswith("#") & ~line.startswith("["))
    at_equals = line.contains("=")
    key = F.when(at_equals, F.substring_index(line, "=", 1)).otherwise(F.substring_index(line, ":", 1))
    value = F.when(at_equals | line.contains(":"), F.expr("substring(trim(value), length(substring_index(trim(value), if(contains(trim(value), '='), '=', ':'), 1)) + 2)"))
    out = useful.select(F.upper(F.trim(key)).alias("key"), F.trim(value).alias("value"))
    return out.where(F.col("value").isNotNull() & F.col("key").isin(*keys))


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """The configuration of a file of at most a few dozen known keys; of a repeated key the last."""
    return {r.key: r.value for r in config_rows(spark.read.text(path)).collect()}


def write_config(config: dict[str, object], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k} = {v}\n" for k, v in config.items() if v is not None)


def zip_folder(folder: str, archive: str) -> None:
    """All files under a local folder in one ZIP archive."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(folder):
            for name in sorted(names):
                full = os.path.join(top, name)
                if os.path.abspath(full) != os.path.abspath(archive):
                    z.write(full, os.path.relpath(full, folder))


def fixed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rows keep their partitions whatever reads them. A local session without a folder for it gets one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint()


def with_row_no(df: DataFrame, *order: str) -> DataFrame:
    """The rows numbered from 0 in the given order, without one task for all: by range, then within each.

    The ranged rows are checkpointed, so that both uses of them have the same partitions.
    """
    ranged = fixed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(first, "_part").withColumn("row_no", F.col("_first") + F.col("_within")).drop("_part", "_first", "_within")


def in_file_order(df: DataFrame) -> DataFrame:
    """The rows of a file just read, numbered from 0 in its order (row_no). A CSV file is read whole by one task, in order."""
    return with_row_no(df.withColumn("_read", F.monotonically_increasing_id()), "_read").drop("_read")
