"""RDF/XML sources: triples, classes of ontologies and vocabularies, reference alignments.

A file becomes triples by a streaming XML parser in the task that reads it; everything after is joins and
aggregations over (s, p, o, kind, lang, pos), pos being the place in the document.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import collapse, first_text, humanize_name
from quillon.sources.tables import fixed, resolve_source

# Namespaces of the formats.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XML = "http://www.w3.org/XML/1998/namespace"

TRIPLES = "s string, p string, o string, kind string, lang string, pos long"


def _triples(data: bytes) -> Iterator[tuple]:
    base, blank, pos = "", 0, 0

    def full(iri: str) -> str:
        return base + iri if iri.startswith("#") else iri if ":" in iri or not base else base.rsplit("/", 1)[0] + "/" + iri

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def subject(e: ET.Element) -> tuple[str, str]:
        nonlocal blank
        about, own = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID")
        if about is not None:
            return full(about), "iri"
        if own is not None:
            return base + "#" + own, "iri"
        node = e.get(f"{{{RDF}}}nodeID")
        if node is None:
            blank += 1
            node = f"b{blank}"
        return f"_:{node}", "blank"

    def node(e: ET.Element) -> Iterator[tuple]:
        nonlocal pos, blank
        s, _ = subject(e)
        if e.tag != f"{{{RDF}}}Description":
            pos += 1
            yield s, RDF + "type", name(e.tag), "iri", None, pos
        for key, value in e.attrib.items():
            if not key.startswith((f"{{{RDF}}}", f"{{{XML}}}")) and key.startswith("{"):
                pos += 1
                yield s, name(key), value, "literal", None, pos
        for child in e:
            p = name(child.tag)
            resource, ref = child.get(f"{{{RDF}}}resource"), child.get(f"{{{RDF}}}nodeID")
            parse = child.get(f"{{{RDF}}}parseType")
            if resource is not None:
                pos += 1
                yield s, p, full(resource), "iri", None, pos
            elif ref is not None:
                pos += 1
                yield s, p, f"_:{ref}", "blank", None, pos
            elif parse == "Collection":
                for item in child:
                    o, kind = subject(item)
                    item.set(f"{{{RDF}}}about" if kind == "iri" else f"{{{RDF}}}nodeID", o if kind == "iri" else o[2:])
                    pos += 1
                    yield s, p, o, kind, None, pos
                    yield from node(item)
            elif parse == "Resource":
                blank += 1
                o = f"_:b{blank}"
                pos += 1
                yield s, p, o, "blank", None, pos
                inner = ET.Element(f"{{{RDF}}}Description", {f"{{{RDF}}}nodeID": o[2:]})
                inner.extend(list(child))
                yield from node(inner)
            elif len(child):
                for item in child:
                    o, kind = subject(item)
                    item.set(f"{{{RDF}}}about" if kind == "iri" else f"{{{RDF}}}nodeID", o if kind == "iri" else o[2:])
                    pos += 1
                    yield s, p, o, kind, None, pos
                    yield from node(item)
            else:
                pos += 1
                yield s, p, child.text or "", "literal", child.get(f"{{{XML}}}lang"), pos

    depth = 0
    for event, e in ET.iterparse(io.BytesIO(data), events=("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                base = (e.get(f"{{{XML}}}base") or "").rstrip("#")
        else:
            if depth == 2:
                yield from node(e)
                e.clear()
            depth -= 1


def parse_triples(documents: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The triples of RDF/XML documents, one a row; kind is iri, blank or literal.

    Blank nodes are told apart by the names of their documents. A document without content has no triples.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch["doc"], batch["content"], strict=True):
                own = lambda x: f"_:{doc}{x[2:]}" if x.startswith("_:") else x  # noqa: B023, E731
                for s, p, o, kind, lang, pos in _triples(data) if data else ():
                    rows.append((own(s), p, own(o) if kind == "blank" else o, kind, lang, pos))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["s", "p", "o", "kind", "lang", "pos"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["s", "p", "o", "kind", "lang", "pos"])

    return documents.select(F.lower(F.hex(F.xxhash64(name))).alias("doc"), F.col(content).cast("binary").alias("content")).mapInPandas(run, TRIPLES)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of RDF/XML files. A file is read by one task, which holds it whole: it must be under 2 GB."""
    return parse_triples(spark.read.format("binaryFile").load(resolve_source(path)).select("path", "content"))


def local_name(iri: Column | str) -> Column:
    """What follows the last '#', then the last '/'."""
    c = F.col(iri) if isinstance(iri, str) else iri
    return F.substring_index(F.substring_index(c, "#", -1), "/", -1)


def _ordered_text(group: Column, value: Column) -> Column:
    """Values joined in document order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(group, value.alias("v"))))), lambda x: x["v"]), " | ")


def _first_labels(triples: DataFrame) -> DataFrame:
    labels = triples.where((F.col("p") == RDFS + "label") & (F.trim("o") != ""))
    return labels.groupBy(F.col("s").alias("iri")).agg(F.min_by(F.trim("o"), F.struct("pos", "o")).alias("label"))


def _disjoint_members(triples: DataFrame) -> DataFrame:
    """(s, p, o, pos): each two members of an AllDisjointClasses axiom as disjoint, at the place of the other."""
    axioms = triples.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "AllDisjointClasses")).select(F.col("s").alias("axiom"))
    members = triples.where(F.col("p") == OWL + "members").select(F.col("s").alias("axiom"), F.col("o").alias("s"), "pos")
    others = members.select("axiom", F.col("s").alias("o"), "pos")
    pairs = axioms.distinct().join(members.drop("pos"), "axiom").join(others, "axiom").where("s <> o")
    return pairs.select("s", F.lit(OWL + "disjointWith").alias("p"), "o", "pos")


def owl_classes(triples: DataFrame, prefix: str | None = None) -> DataFrame:
    """Raw classes: iri, local_name, label, parents, restrictions, equivalent_to, disjoint_with, annotations.

    Named classes only. label is the first in the document, or else the local name. parents and the like are texts in
    document order; a restriction is 'property: filler'. annotations maps the local names of other properties with
    literal or named values to the list of their texts. Triples are read many times: they are parsed once, into a checkpoint.
    """
    triples = fixed(triples.coalesce(max(1, triples.sparkSession.sparkContext.defaultParallelism)))
    classes = triples.where((F.col("p") == RDF + "type") & F.col("o").isin(OWL + "Class", RDFS + "Class") & ~F.col("s").startswith("_:"))
    classes = classes.groupBy(F.col("s").alias("iri")).agg(F.min("pos").alias("pos"))
    if prefix:
        classes = classes.where(F.col("iri").startswith(prefix))
    labels = _first_labels(triples)
    named = labels.withColumnsRenamed({"iri": "o", "label": "o_label"})
    words = collapse(F.coalesce("o_label", humanize_name(local_name("o"))))

    parts = triples.where(F.col("p").isin(OWL + "onProperty", OWL + "someValuesFrom", OWL + "allValuesFrom", OWL + "hasValue"))
    parts = parts.join(named, "o", "left").groupBy("s").agg(
        F.min(F.when(F.col("p") == OWL + "onProperty", words)).alias("prop"), F.min(F.when(F.col("p") != OWL + "onProperty", words)).alias("filler")
    )
    construct = parts.select(F.col("s").alias("o"), F.concat("prop", F.lit(": "), "filler").alias("construct"))
    links = triples.where(F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass", OWL + "disjointWith") & (F.col("kind") != "literal"))
    links = links.select("s", "p", "o", "pos")
    mirrored = links.where(F.col("p") == OWL + "disjointWith").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "pos")
    links = links.union(mirrored).union(_disjoint_members(triples)).groupBy("s", "p", "o").agg(F.min("pos").alias("pos"))
    links = links.join(named, "o", "left").join(construct, "o", "left")
    is_blank = F.col("o").startswith("_:")
    said = lambda p, before: F.when(F.col("p") == p, F.concat(F.lit(before), words))
    linked = links.groupBy(F.col("s").alias("iri")).agg(
        _ordered_text(F.col("pos"), F.when(~is_blank, said(RDFS + "subClassOf", "sub class of "))).alias("parents"),
        _ordered_text(F.col("pos"), F.when(is_blank & (F.col("p") == RDFS + "subClassOf"), F.coalesce("construct", "o"))).alias("restrictions"),
        _ordered_text(
            F.col("pos"),
            F.when(is_blank & (F.col("p") == OWL + "equivalentClass"), F.concat(F.lit("equivalent to ("), F.coalesce("construct", "o"), F.lit(")"))).otherwise(
                said(OWL + "equivalentClass", "equivalent to ")
            ),
        ).alias("equivalent_to"),
        _ordered_text(F.col("pos"), F.when(~is_blank, said(OWL + "disjointWith", "disjoint with "))).alias("disjoint_with"),
    )
    structural = [RDF + "type", RDFS + "label", RDFS + "subClassOf", OWL + "equivalentClass", OWL + "disjointWith"]
    notes = triples.where(~F.col("p").isin(structural) & (F.col("kind") != "blank")).join(named, "o", "left")
    value = F.when(F.col("kind") == "iri", F.coalesce("o_label", "o")).otherwise(F.trim("o"))
    notes = notes.select(F.col("s").alias("iri"), local_name("p").alias("name"), value.alias("value"), "pos").where("value <> ''")
    notes = notes.groupBy("iri", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vals"))
    notes = notes.groupBy("iri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "vals")))).alias("annotations"))
    out = classes.join(labels, "iri", "left").join(linked, "iri", "left").join(notes, "iri", "left")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("parents", "restrictions", "equivalent_to", "disjoint_with")}
    return out.select(
        "iri",
        local_name("iri").alias("local_name"),
        F.coalesce("label", local_name("iri")).alias("label"),
        *(c.alias(n) for n, c in texts.items()),
        F.coalesce("annotations", F.expr("cast(map() as map<string,array<string>>)")).alias("annotations"),
        F.col("pos").alias("row_no"),
    )


def skos_concepts(triples: DataFrame, prefix: str | None = None) -> DataFrame:
    """Raw concepts of a vocabulary, with the columns of unified concepts' sources; texts in document order."""
    concepts = triples.where((F.col("p") == RDF + "type") & (F.col("o") == SKOS + "Concept")).select(F.col("s").alias("iri")).distinct()
    if prefix:
        concepts = concepts.where(F.col("iri").startswith(prefix))
    pos = F.col("pos")
    of = lambda p: F.min_by(F.when(F.col("p") == p, F.trim("o")), F.when((F.col("p") == p) & (F.trim("o") != ""), pos))
    said = lambda p, before="": F.when(F.col("p") == p, F.concat(F.lit(before), F.trim("o")))
    facts = triples.groupBy(F.col("s").alias("iri")).agg(
        of(SKOS + "prefLabel").alias("pref"),
        of(RDFS + "label").alias("named"),
        of(SKOS + "definition").alias("definition"),
        of(SKOS + "scopeNote").alias("scope"),
        of(RDFS + "comment").alias("comment"),
        _ordered_text(pos, said(SKOS + "altLabel")).alias("synonyms"),
        _ordered_text(pos, said(SKOS + "broader", "broader concept ")).alias("parents"),
        _ordered_text(F.struct((F.col("p") != SKOS + "exactMatch").alias("later"), pos), F.coalesce(said(SKOS + "exactMatch", "exact match "), said(SKOS + "closeMatch", "exact match "))).alias("equivalent_to"),
        F.min("pos").alias("row_no"),
    )
    return concepts.join(facts, "iri").select(
        "iri",
        local_name("iri").alias("local_name"),
        F.coalesce(first_text("pref", "named"), F.col("iri")).alias("label"),
        F.coalesce(first_text("definition", "scope", "comment"), F.lit("")).alias("description"),
        "synonyms",
        "parents",
        F.lit("").alias("restrictions"),
        "equivalent_to",
        F.lit("").alias("disjoint_with"),
        "row_no",
    )


CELL = "entity1 struct<`_rdf:resource`:string>, entity2 struct<`_rdf:resource`:string>, measure struct<_VALUE:string>, relation struct<_VALUE:string>"


def alignment_rows(cells: DataFrame, source_prefix: str | None = None, target_prefix: str | None = None) -> DataFrame:
    """(source_iri, target_iri, sample_type, match, measure, relation) of cells with the columns CELL.

    A cell's first entity is the target and its second the source. Each prefix filters its own column.
    """
    out = cells.select(
        F.col("entity2._rdf:resource").alias("source_iri"),
        F.col("entity1._rdf:resource").alias("target_iri"),
        F.lit("positive").alias("sample_type"),
        F.lit(1).alias("match"),
        F.col("measure._VALUE").cast("double").alias("measure"),
        F.col("relation._VALUE").alias("relation"),
    )
    if source_prefix:
        out = out.where(F.col("source_iri").startswith(source_prefix))
    return out.where(F.col("target_iri").startswith(target_prefix)) if target_prefix else out


def read_alignment(spark: SparkSession, path: str, source_prefix: str | None = None, target_prefix: str | None = None) -> DataFrame:
    """The rows of each cell of a reference alignment; its files are split by cells and read once."""
    cells = spark.read.format("xml").option("rowTag", "Cell").schema(CELL).load(resolve_source(path))
    return alignment_rows(cells, source_prefix, target_prefix)


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
