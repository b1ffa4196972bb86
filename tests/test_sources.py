import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators.concepts import load_views, unified_view
from quillon.sources import rdf, tables

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns="http://x.org/o#" xml:base="http://x.org/o" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
  xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:obo="http://x.org/obo/">
  <owl:ObjectProperty rdf:about="http://x.org/o#hasPart"/>
  <owl:Class rdf:about="http://x.org/o#Water"><rdfs:label>Water</rdfs:label></owl:Class>
  <owl:Class rdf:about="#SeaIce">
    <rdfs:label xml:lang="en"> Sea  Ice </rdfs:label><rdfs:label>Ice of the sea</rdfs:label>
    <rdfs:subClassOf rdf:resource="http://x.org/o#Water"/>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#hasPart"/><owl:someValuesFrom rdf:resource="#Water"/></owl:Restriction></rdfs:subClassOf>
    <owl:equivalentClass rdf:resource="#FrozenSea"/>
    <owl:disjointWith rdf:resource="#Water"/>
    <obo:definition>Frozen water.</obo:definition><obo:hasExactSynonym>pack</obo:hasExactSynonym><obo:hasExactSynonym>floe</obo:hasExactSynonym>
  </owl:Class>
  <owl:Class rdf:about="#FrozenSea"/>
</rdf:RDF>"""

SKOS = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">
  <skos:Concept rdf:about="http://x.org/v/ice"><skos:prefLabel>Ice</skos:prefLabel><skos:altLabel>frost</skos:altLabel><skos:altLabel>rime</skos:altLabel>
    <skos:scopeNote>Solid water.</skos:scopeNote><skos:broader rdf:resource="http://x.org/v/water"/>
    <skos:closeMatch rdf:resource="http://y.org/b"/><skos:exactMatch rdf:resource="http://y.org/a"/></skos:Concept>
  <rdf:Description rdf:about="http://x.org/v/water"><rdf:type rdf:resource="http://www.w3.org/2004/02/skos/core#Concept"/></rdf:Description>
</rdf:RDF>"""

ALIGNMENT = """<?xml version="1.0" encoding="utf-8"?>
<rdf:RDF xmlns="http://example.org/alignment" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Alignment>
<map><Cell><entity1 rdf:resource="http://t.org/1"/><entity2 rdf:resource="http://s.org/1"/><measure rdf:datatype="xsd:float">0.85</measure><relation>=</relation></Cell></map>
<map><Cell><entity1 rdf:resource="http://t.org/2"/><entity2 rdf:resource="http://other.org/2"/><measure rdf:datatype="xsd:float">0.7</measure><relation>=</relation></Cell></map>
</Alignment></rdf:RDF>"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    raw = rdf.owl_classes(rdf.read_triples(spark, str(tmp_path / "o.owl")))
    got = {r.local_name: r for r in raw.collect()}
    assert set(got) == {"Water", "SeaIce", "FrozenSea"}
    ice = got["SeaIce"]
    assert ice.label == "Sea  Ice" and ice.parents == "sub class of water" and ice.restrictions == "has part: water"
    assert ice.equivalent_to == "equivalent to frozen sea" and ice.disjoint_with == "disjoint with water"
    assert ice.annotations["hasExactSynonym"] == ["pack", "floe"] and got["Water"].disjoint_with == "disjoint with sea ice"
    assert got["FrozenSea"].label == "FrozenSea"
    view = {r.iri: r for r in unified_view(raw).collect()}["http://x.org/o#SeaIce"]
    assert view.description == "Frozen water." and view.synonyms == "pack | floe" and view.parents_label == "sub class of water"
    assert rdf.owl_classes(rdf.read_triples(spark, str(tmp_path / "o.owl")), "http://x.org/o#W").count() == 1
    source, target = load_views(raw, raw)
    assert source.count() == target.count() == 3


def test_disjoint_members_and_blank_nodes_of_several_documents(spark, tmp_path):
    head = OWL[: OWL.index("<owl:ObjectProperty")]
    for name, filler in (("a", "Water"), ("b", "Rock")):
        members = "".join(f'<rdf:Description rdf:about="#{x}"/>' for x in (f"In{name}", "Water", "Rock"))
        restriction = f'<owl:Restriction><owl:onProperty rdf:resource="#hasPart"/><owl:someValuesFrom rdf:resource="#{filler}"/></owl:Restriction>'
        body = f'<owl:Class rdf:about="#In{name}"><rdfs:subClassOf>{restriction}</rdfs:subClassOf></owl:Class>'
        axiom = f'<owl:AllDisjointClasses><owl:members rdf:parseType="Collection">{members}</owl:members></owl:AllDisjointClasses>'
        (tmp_path / f"{name}.owl").write_text(head + body + axiom + "</rdf:RDF>")
    got = {r.local_name: r for r in rdf.owl_classes(rdf.read_triples(spark, str(tmp_path))).collect()}
    assert {k: (r.restrictions, r.disjoint_with) for k, r in got.items()} == {
        "Ina": ("has part: water", "disjoint with water | disjoint with rock"),
        "Inb": ("has part: rock", "disjoint with water | disjoint with rock"),
    }


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.rdf").write_text(SKOS)
    got = {r.local_name: r for r in rdf.skos_concepts(rdf.read_triples(spark, str(tmp_path / "v.rdf"))).collect()}
    ice = got["ice"]
    assert (ice.label, ice.description, ice.synonyms) == ("Ice", "Solid water.", "frost | rime")
    assert ice.parents == "broader concept http://x.org/v/water" and ice.equivalent_to == "exact match http://y.org/a | exact match http://y.org/b"
    assert got["water"].label == "http://x.org/v/water"


def test_alignment(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(ALIGNMENT)
    got = rdf.read_alignment(spark, str(tmp_path / "a.rdf")).collect()
    assert [(r.source_iri, r.target_iri, r.sample_type, r.match, r.measure) for r in got][0] == ("http://s.org/1", "http://t.org/1", "positive", 1, 0.85)
    assert rdf.read_alignment(spark, str(tmp_path / "a.rdf"), "http://s.org/").count() == 1
    assert rdf.read_alignment(spark, str(tmp_path / "a.rdf"), None, "http://s.org/").count() == 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None)], "id int, text string")
    tables.write_csv(df, str(tmp_path / "t.csv"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv"), "id int, text string").collect()} == {(1, 'a "quoted"\nline'), (2, None)}
    with pytest.raises(ValueError):
        tables.require_columns(df, ["id", "nope"])
    with pytest.raises(ValueError):
        tables.resolve_source("ftp://x/y")
    with pytest.raises(ValueError):
        tables.resolve_source(str(tmp_path / "missing"))
    assert tables.resolve_source("http://x.org/o.owl") == "http://x.org/o.owl"
    joined = tables.append_metrics(df.select("id"), df.select("text", F.lit(3).alias("id")))
    assert joined.count() == 4 and tables.append_metrics(None, df) is df
    numbered = tables.with_row_no(df, "id").orderBy("id").collect()
    assert [r.row_no for r in numbered] == [0, 1]


def test_config_and_archive(spark, tmp_path):
    tables.write_config({"MODEL_TYPE": "cross", "KEEP_TOP_N": 5, "OTHER": 1, "RUN_ID": None}, str(tmp_path / "config.txt"))
    (tmp_path / "more.txt").write_text("# c\n[s]\n\ncross_top_k: 20\n")
    assert tables.read_config(spark, str(tmp_path / "config.txt")) == {"MODEL_TYPE": "cross", "KEEP_TOP_N": "5"}
    assert tables.read_config(spark, str(tmp_path / "more.txt")) == {"CROSS_TOP_K": "20"}
    tables.zip_folder(str(tmp_path), str(tmp_path / "all.zip"))
    assert sorted(zipfile.ZipFile(tmp_path / "all.zip").namelist()) == ["config.txt", "more.txt"]
