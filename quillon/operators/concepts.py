"""Unified concepts, their texts and their normalised forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import (
    DESCRIPTION_PROPERTIES,
    SEPARATOR,
    SourceTextConfig,
    class_forms,
    first_text,
    source_text,
    strip,
    target_text,
    text_of,
)

UNIFIED = ("iri", "local_name", "label", "description", "synonyms", "parents_label", "equivalent_to", "disjoint_with")


def unified_view(raw: DataFrame) -> DataFrame:
    """Unified concepts of raw classes: all strings, none null.

    Annotations come from a map column `annotations` (name to list of texts) if there is one, else from columns of
    those names. Descriptions: the first property of a fixed list with a text. Synonyms: the texts of every
    property whose name holds 'synonym', by name.
    """
    has_map = "annotations" in raw.columns
    if has_map:
        joined = F.transform_values("annotations", lambda _, v: F.array_join(F.filter(F.transform(v, strip), lambda x: x != ""), SEPARATOR))
        description = first_text(*[joined[p] for p in DESCRIPTION_PROPERTIES])
        named = F.array_sort(F.map_entries(F.map_filter(joined, lambda k, v: F.lower(k).contains("synonym") & (v != ""))))
        synonyms = F.array_join(F.transform(named, lambda e: e["value"]), SEPARATOR)
    else:
        present = [c for c in DESCRIPTION_PROPERTIES if c in raw.columns]
        description = first_text(*present) if present else F.lit(None)
        named = sorted(c for c in raw.columns if "synonym" in c.lower())
        synonyms = F.concat_ws(SEPARATOR, *[F.nullif(strip(text_of(c)), F.lit("")) for c in named])
    if "description" in raw.columns:
        description = F.coalesce(description, first_text("description"))
    if "synonyms" in raw.columns and has_map:
        synonyms = F.coalesce(F.nullif(synonyms, F.lit("")), text_of("synonyms"))
    optional = lambda c: strip(text_of(c)) if c in raw.columns else F.lit("")
    kept = ["row_no"] if "row_no" in raw.columns else []
    return raw.select(
        text_of("iri").alias("iri"),
        text_of("local_name").alias("local_name"),
        F.coalesce(first_text("label"), text_of("local_name")).alias("label"),
        F.coalesce(description, F.lit("")).alias("description"),
        synonyms.alias("synonyms"),
        optional("parents").alias("parents_label"),
        optional("equivalent_to").alias("equivalent_to"),
        optional("disjoint_with").alias("disjoint_with"),
        *kept,
    )


def source_view(concepts: DataFrame, config: SourceTextConfig = SourceTextConfig()) -> DataFrame:
    """source_iri, local_name, source_label, source_text, source_synonyms."""
    return concepts.select(
        F.col("iri").alias("source_iri"), "local_name", F.col("label").alias("source_label"), source_text(config).alias("source_text"), F.col("synonyms").alias("source_synonyms")
    )


def target_view(concepts: DataFrame) -> DataFrame:
    """target_iri, local_name, target_label, target_text, target_synonyms."""
    return concepts.select(
        F.col("iri").alias("target_iri"), "local_name", F.col("label").alias("target_label"), target_text().alias("target_text"), F.col("synonyms").alias("target_synonyms")
    )


def load_views(source_raw: DataFrame, target_raw: DataFrame, config: SourceTextConfig = SourceTextConfig()) -> tuple[DataFrame, DataFrame]:
    """Source and target views of two raw class tables."""
    return source_view(unified_view(source_raw), config), target_view(unified_view(target_raw))


def internal_view(concepts: DataFrame) -> DataFrame:
    """iri, local_name, label, synonyms, text: what an index is built from."""
    kept = ["row_no"] if "row_no" in concepts.columns else []
    return concepts.select("iri", "local_name", "label", "synonyms", target_text().alias("text"), *kept)


def last_rows(concepts: DataFrame, order: str = "row_no") -> DataFrame:
    """Of rows that share an iri the last; the order is by all columns if there is no row number."""
    names = [c for c in concepts.columns if c != "iri"]
    by = F.col(order) if order in names else F.struct(*names)
    best = concepts.groupBy("iri").agg(F.max_by(F.struct(*names), by).alias("_last"))
    return best.select("iri", "_last.*")


def forms(concepts: DataFrame) -> DataFrame:
    """(iri, form, pos): the normalised label and synonyms of each concept, each once, from 0."""
    latest = last_rows(concepts.select("iri", "label", "synonyms", *(["row_no"] if "row_no" in concepts.columns else [])))
    return latest.select("iri", F.posexplode(class_forms("label", "synonyms")).alias("pos", "form")).select("iri", "form", "pos")
