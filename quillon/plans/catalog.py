"""The registered queries over the driver's tables, and their SQL.

Parts are the classes (label: name; synonyms: brand and type), every twentieth part asks a query: by its name in capitals
and without spaces, or by its type and brand. Embeddings give vectors to the parts of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import concepts as C
from quillon.operators import dataset as D
from quillon.operators import evaluate as E
from quillon.operators import index as I
from quillon.operators import retrieve as R
from quillon.operators import score as S
from quillon.operators import search as H
from quillon.plans.sql import TOKEN, camel, norm, query
from quillon.sources import rdf
from quillon.sources import tables as X

SPEC = S.AlignConfig(R.RetrievalConfig("hybrid", 15, 15, 30, 0.5), cross_top_k=10, keep_top_n=5)
_queries: dict = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = query(sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_concepts(spark: SparkSession, d: str) -> DataFrame:
    iri, synonyms = F.concat(F.lit("part:"), F.col("p_partkey")), F.concat_ws(" | ", "p_brand", "p_type")
    named = table(spark, d, "part").select(
        iri.alias("iri"), F.lit("").alias("local_name"), F.col("p_name").alias("label"), F.lit("").alias("description"), synonyms.alias("synonyms"),
        F.lit("").alias("parents_label"), F.lit("").alias("equivalent_to"), F.lit("").alias("disjoint_with"), F.col("p_partkey").alias("row_no"),
    )
    return C.internal_view(named)


def class_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("part:"), F.col("vec_id")).alias("iri"), "embedding")


def part_index(spark: SparkSession, d: str) -> I.Index:
    return I.build_index(part_concepts(spark, d), vectors=class_vectors(spark, d))


def _camel(c: str):
    return F.regexp_replace(F.initcap(c), " ", "")


def asked(spark: SparkSession, d: str) -> DataFrame:
    by_code = F.concat_ws(" ", "p_type", "p_brand", "p_type")
    text = F.when(F.col("p_partkey") % 40 == 0, _camel("p_name")).otherwise(by_code)
    return table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), text.alias("query"))


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), "embedding")
    return asked(spark, d).select("query_id").join(vectors, "query_id")


def _rounded(df: DataFrame, c: str = "score") -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


# ---- functions ----


@registered(f"SELECT p_partkey, {norm(chr(39) + '  ' + chr(39) + ' || upper(p_name) || chr(9) || chr(32) || p_type || chr(10)')} AS out FROM part")
def normalize_label(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_label(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "), F.col("p_type"), F.lit("\n"))).alias("out"))


@registered(f"SELECT p_partkey, regexp_replace({camel('p_name')}, '([a-z])([A-Z])', '\\1 \\2', 'g') AS out FROM part")
def camelcase_split(spark, d):
    return table(spark, d, "part").select("p_partkey", T.camelcase_split(_camel("p_name")).alias("out"))


@registered(
    f"SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace({camel('p_name')} || '-' || p_brand, '([A-Z])', ' \\1', 'g'), '[^a-zA-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))) AS out FROM part"
)
def miner_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.miner_normalize(F.concat(_camel("p_name"), F.lit("-"), F.col("p_brand"))).alias("out"))


@registered(f"SELECT p_partkey, trim(lower(regexp_replace(replace('has_' || {camel('p_name')}, '_', ' '), '([A-Z])', ' \\1', 'g'))) AS out FROM part")
def humanize_name(spark, d):
    return table(spark, d, "part").select("p_partkey", T.humanize_name(F.concat(F.lit("has_"), _camel("p_name"))).alias("out"))


@registered(
    f"""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split(p_brand || ' | | ' || p_type || '|', '|'), lambda x: trim(x)), lambda x: x <> ''),
    lambda x: trim(lower(regexp_replace(regexp_replace(regexp_replace(x, '([A-Z])', ' \\1', 'g'), '[^a-zA-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g')))), ';') AS out FROM part"""
)
def miner_synonyms(spark, d):
    out = T.miner_synonyms(F.concat(F.col("p_brand"), F.lit(" | | "), F.col("p_type"), F.lit("|")))
    return table(spark, d, "part").select("p_partkey", F.array_join(out, ";").alias("out"))


@registered("SELECT event_id, coalesce(nullif(trim(CASE WHEN user_id % 3 = 0 THEN '  ' WHEN user_id % 3 = 1 THEN ' ' || event_type ELSE NULL END), ''), trim(props)) AS out FROM events")
def scoring_text_fallback(spark, d):
    said = F.when(F.col("user_id") % 3 == 0, "  ").when(F.col("user_id") % 3 == 1, F.concat(F.lit(" "), F.col("event_type")))
    return table(spark, d, "events").select("event_id", T.scoring_text(said, "props").alias("out"))


@registered("SELECT event_id, CASE WHEN TRY_CAST(v AS DOUBLE) >= 0.5 THEN 1 WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 0 ELSE -1 END AS out FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'yes' WHEN event_type = 'click' THEN NULL ELSE CAST(value / 50 AS VARCHAR) END AS v FROM events)")
def as_flag(spark, d):
    v = F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", None).otherwise((F.col("value") / 50).cast("string"))
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", F.coalesce(V.as_flag("v"), F.lit(-1)).alias("out"))


_NUMBERS = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@registered(
    f"""SELECT vec_id, round(1 / (1 + exp(-a[1])), 6) AS one, round(1 / (1 + exp(a[1] - a[2])), 6) AS two, round(1 / list_sum(list_transform(a, lambda x: exp(x - list_max(a)))), 6) AS more
    FROM (SELECT vec_id, {_NUMBERS} AS a FROM embeddings)"""
)
def scores_from_logits(spark, d):
    at = lambda x: F.round(V.score_from_logits(x), 6)
    return table(spark, d, "embeddings").select("vec_id", at(F.slice("embedding", 1, 1)).alias("one"), at(F.slice("embedding", 1, 2)).alias("two"), at(F.col("embedding")).alias("more"))


@registered(
    f"""SELECT vec_id, CAST(i AS BIGINT) AS i, round((a[i] + a[i + half] * (vec_id % 2)) / (1 + vec_id % 2), 6) AS v
    FROM (SELECT vec_id, a, half, unnest(range(1, half + 1)) AS i FROM (SELECT vec_id, {_NUMBERS} AS a, len(embedding) // 2 AS half FROM embeddings))"""
)
def mean_pool(spark, d):
    half = (F.size("embedding") / 2).cast("int")
    hidden = F.array(F.slice("embedding", 1, half), F.slice("embedding", half + 1, half))
    pooled = V.mean_pool(hidden, F.array(F.lit(1), (F.col("vec_id") % 2).cast("int")))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(pooled).alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 6).alias("v"))


@registered(
    f"""SELECT vec_id, round(n, 5) AS norm, CAST(i AS BIGINT) AS i, round(CAST(CAST(3 * a[i] / n AS FLOAT) AS DOUBLE), 4) + 0.0 AS v
    FROM (SELECT vec_id, a, list_sum(list_transform(a, lambda x: 9 * x * x)) ** 0.5 AS n, unnest(range(1, len(a) + 1)) AS i FROM (SELECT vec_id, {_NUMBERS} AS a FROM embeddings))"""
)
def l2_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("x"))
    v = v.select("vec_id", F.round(V.norm("x"), 5).alias("norm"), F.posexplode(V.l2_normalized("x")).alias("i", "v"))
    return v.select("vec_id", "norm", (F.col("i") + 1).cast("long").alias("i"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


@registered(
    "SELECT total, ratio, CAST(total AS BIGINT) - CAST(round_even(total * least(1, greatest(0, ratio)), 0) AS BIGINT) AS k_lexical, CAST(round_even(total * least(1, greatest(0, ratio)), 0) AS BIGINT) AS k_semantic FROM (SELECT unnest([150, 75, 5, 10, 0]) AS total, unnest([CAST(0.3 AS DOUBLE), 0.5, 0.5, 2.0, 0.5]) AS ratio)"
)
def split_budget(spark, d):
    cases = [(150, 0.3), (75, 0.5), (5, 0.5), (10, 2.0), (0, 0.5)]
    return spark.createDataFrame([(n, r, *R.split_budget(n, r)) for n, r in cases], "total int, ratio double, k_lexical long, k_semantic long")


# ---- sources ----

_OPEN = """<rdf:RDF xml:base="http://parts.test/c" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"
 xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xmlns:n="http://parts.test/n#">"""
_CLOSE = "</rdf:RDF>"


def _xml(template: str):
    """A text with columns for {names}, escaped; {{ and }} are not for use."""
    import re

    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(*[escaped(x[1:-1]) if x.startswith("{") else F.lit(x) for x in re.split(r"({\w+})", template) if x])


def part_ontology(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): parts as RDF/XML classes, three in a document, which says that they are disjoint; and a document for each brand.

    A part is below its brand's class, has a restriction to its type, and each second one is equivalent to its brand's second
    class, which has no label; each fifth has no label of its own.
    """
    parts = table(spark, d, "part").withColumns({"brand": F.replace("p_brand", F.lit("#"), F.lit("")), "size": F.col("p_size").cast("string")})
    label = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(_xml("<rdfs:label xml:lang='en'> {p_name}  {p_partkey} </rdfs:label><rdfs:label>other</rdfs:label>"))
    same = F.when(F.col("p_partkey") % 2 == 0, _xml("<owl:equivalentClass rdf:resource='#{brand}Like'/>")).otherwise("")
    facts = _xml(
        "<rdfs:subClassOf rdf:resource='#{brand}'/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource='#hasType'/>"
        "<owl:someValuesFrom rdf:resource='#{p_type}'/></owl:Restriction></rdfs:subClassOf><n:definition> size {size} </n:definition>"
        "<n:hasExactSynonym>{p_brand}</n:hasExactSynonym><n:hasExactSynonym>{p_type}</n:hasExactSynonym><n:note rdf:resource='#{brand}'/>"
    )
    made = F.concat(_xml("<owl:Class rdf:about='#P{p_partkey}'>"), label, facts, same, F.lit("</owl:Class>"))
    third = F.floor(F.col("p_partkey") / 3).alias("third")
    grouped = parts.select(third, F.struct("p_partkey", made.alias("made"), _xml("<rdf:Description rdf:about='#P{p_partkey}'/>").alias("member")).alias("x"))
    grouped = grouped.groupBy("third").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda x: x[c]), "")
    axiom = F.concat(F.lit("<owl:AllDisjointClasses><owl:members rdf:parseType='Collection'>"), joined("member"), F.lit("</owl:members></owl:AllDisjointClasses>"))
    threes = grouped.select(F.concat(F.lit("three"), "third").alias("path"), F.concat(F.lit(_OPEN), joined("made"), axiom, F.lit(_CLOSE)).alias("content"))
    brands = parts.select("p_brand", "brand").distinct()
    return threes.union(brands.select("brand", F.concat(F.lit(_OPEN), _xml("<owl:Class rdf:about='#{brand}'><rdfs:label>{p_brand}</rdfs:label></owl:Class>"), F.lit(_CLOSE))))


@registered(
    """WITH p AS (
        SELECT *, replace(p_brand, '#', '') AS brand, p_partkey // 3 AS third, CASE WHEN p_partkey % 5 = 0 THEN 'P' || p_partkey ELSE p_name || '  ' || p_partkey END AS label,
               CASE WHEN p_partkey % 5 = 0 THEN 'p' || p_partkey ELSE lower(p_name) || ' ' || p_partkey END AS words FROM part),
    other AS (SELECT a.p_partkey, string_agg('disjoint with ' || b.words, ' | ' ORDER BY b.p_partkey) AS others FROM p a JOIN p b ON a.third = b.third AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey)
    SELECT 'http://parts.test/c#P' || p_partkey AS iri, 'P' || p_partkey AS local_name, label, 'sub class of ' || lower(p_brand) AS parents,
           'has type: ' || trim(lower(regexp_replace(p_type, '([A-Z])', ' \\1', 'g'))) AS restrictions,
           CASE WHEN p_partkey % 2 = 0 THEN 'equivalent to ' || lower(brand) || ' like' ELSE '' END AS equivalent_to, coalesce(others, '') AS disjoint_with,
           'definition=size ' || p_size || ';hasExactSynonym=' || p_brand || ',' || p_type || ';note=' || p_brand AS annotations
    FROM p LEFT JOIN other USING (p_partkey)
    UNION ALL SELECT DISTINCT 'http://parts.test/c#' || brand, brand, p_brand, '', '', '', '', '' FROM p"""
)
def ontology_classes(spark, d):
    raw = rdf.owl_classes(rdf.parse_triples(part_ontology(spark, d)))
    notes = F.transform(F.array_sort(F.map_entries("annotations")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return raw.drop("row_no").withColumn("annotations", F.array_join(notes, ";"))


@registered("SELECT 'http://parts.test/c#' || brand AS iri, p_brand AS label FROM (SELECT DISTINCT p_brand, replace(p_brand, '#', '') AS brand FROM part)")
def ontology_prefix(spark, d):
    return rdf.owl_classes(rdf.parse_triples(part_ontology(spark, d)), "http://parts.test/c#Brand").select("iri", "label")


@registered(
    """SELECT 'http://parts.test/v/' || c_custkey AS iri, CAST(c_custkey AS VARCHAR) AS local_name,
        CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'also ' || c_name ELSE 'http://parts.test/v/' || c_custkey END AS label,
        CASE c_custkey % 2 WHEN 0 THEN 'in ' || c_mktsegment ELSE 'by ' || c_name END AS description, lower(c_name) || ' | ' || lower(c_mktsegment) AS synonyms,
        'broader concept http://parts.test/v/n' || c_nationkey AS parents, 'exact match http://other.test/e | exact match http://other.test/c' AS equivalent_to FROM customer"""
)
def vocabulary_concepts(spark, d):
    """Customers as concepts of a vocabulary, a document each."""
    said = table(spark, d, "customer").withColumns({"name": F.lower("c_name"), "segment": F.lower("c_mktsegment")})
    key = F.col("c_custkey") % 3
    label = F.when(key == 0, _xml("<rdfs:label>no</rdfs:label><skos:prefLabel> {c_name} </skos:prefLabel>")).when(key == 1, _xml("<rdfs:label>also {c_name}</rdfs:label>")).otherwise("")
    about = F.when(F.col("c_custkey") % 2 == 0, _xml("<rdfs:comment>no</rdfs:comment><skos:scopeNote>in {c_mktsegment}</skos:scopeNote>")).otherwise(_xml("<rdfs:comment>by {c_name}</rdfs:comment>"))
    facts = _xml(
        "<skos:altLabel>{name}</skos:altLabel><skos:altLabel>{segment}</skos:altLabel><skos:broader rdf:resource='http://parts.test/v/n{c_nationkey}'/>"
        "<skos:closeMatch rdf:resource='http://other.test/c'/><skos:exactMatch rdf:resource='http://other.test/e'/>"
    )
    content = F.concat(F.lit(_OPEN), _xml("<skos:Concept rdf:about='http://parts.test/v/{c_custkey}'>"), label, about, facts, F.lit("</skos:Concept>"), F.lit(_CLOSE))
    documents = said.select(F.col("c_custkey").alias("path"), content.alias("content"))
    return rdf.skos_concepts(rdf.parse_triples(documents)).drop("row_no", "restrictions", "disjoint_with")


@registered(
    """SELECT 'http://s.test/' || l_suppkey AS source_iri, 'http://t.test/' || l_returnflag || '/' || l_partkey AS target_iri, 'positive' AS sample_type, 1 AS match, l_discount AS measure, '=' AS relation
    FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_suppkey AS VARCHAR) LIKE '1%'"""
)
def alignment_cells(spark, d):
    """Line items as cells of a reference alignment, a text each."""
    line = table(spark, d, "lineitem")
    cell = _xml(
        "<Cell><entity1 rdf:resource='http://t.test/{l_returnflag}/{l_partkey}'/><entity2 rdf:resource='http://s.test/{l_suppkey}'/>"
        "<measure rdf:datatype='xsd:float'>{l_discount}</measure><relation>=</relation></Cell>"
    )
    return rdf.alignment_rows(line.select(F.from_xml(cell, rdf.CELL).alias("c")).select("c.*"), "http://s.test/1", "http://t.test/R/")


# ---- concepts and their index ----


def _raw_nations(spark, d) -> DataFrame:
    """Raw classes with annotations: nations, their regions as parents."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = lambda *c: F.array(*c)
    notes = F.map_from_arrays(
        F.array(F.lit("definition"), F.lit("hasExactSynonym"), F.lit("relatedSynonym"), F.lit("note")),
        F.array(
            texts(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" nation of "), F.col("r_name"))).otherwise(F.lit("  "))),
            texts(F.lower("n_name"), F.lit("")),
            texts(F.concat(F.lit("n"), F.col("n_nationkey"))),
            texts(F.lit("a note")),
        ),
    )
    return joined.select(
        F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("iri"), F.col("n_name").alias("local_name"),
        F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.initcap("n_name")).alias("label"),
        F.concat(F.lit("sub class of "), F.lower("r_name")).alias("parents"), F.lit(None).cast("string").alias("equivalent_to"),
        F.lit("").alias("disjoint_with"), notes.alias("annotations"), F.col("n_nationkey").alias("row_no"),
    )


_UNIFIED = """SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS iri, n_name AS local_name,
    CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE upper(n_name[1]) || lower(n_name[2:]) END AS label,
    CASE WHEN n_nationkey % 2 = 0 THEN 'nation of ' || r_name ELSE 'a note' END AS description,
    lower(n_name) || ' | ' || 'n' || CAST(n_nationkey AS VARCHAR) AS synonyms, 'sub class of ' || lower(r_name) AS parents_label, '' AS equivalent_to, '' AS disjoint_with
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


@registered(_UNIFIED)
def unified_view(spark, d):
    return C.unified_view(_raw_nations(spark, d)).drop("row_no")


@registered(f"SELECT iri, 'label: ' || label || '; description: ' || description || '; parents: ' || parents_label AS source_text FROM ({_UNIFIED})")
def source_text(spark, d):
    view = C.source_view(C.unified_view(_raw_nations(spark, d)), T.SourceTextConfig(use_parents=True))
    return view.select(F.col("source_iri").alias("iri"), "source_text")


@registered(f"SELECT iri, 'label: ' || label || '; description: ' || description || '; Synonyms: ' || synonyms || '; Parents: ' || parents_label AS target_text FROM ({_UNIFIED})")
def target_text(spark, d):
    return C.target_view(C.unified_view(_raw_nations(spark, d))).select(F.col("target_iri").alias("iri"), "target_text")


@registered(f"SELECT iri, label FROM ({_UNIFIED}) WHERE starts_with(iri, 'nation:1')")
def prefix_filter(spark, d):
    return C.unified_view(_raw_nations(spark, d).where(F.col("iri").startswith("nation:1"))).select("iri", "label")


@registered("SELECT iri, form, pos FROM forms")
def class_forms(spark, d):
    return C.forms(part_concepts(spark, d)).select("iri", "form", F.col("pos").cast("long").alias("pos"))


@registered("SELECT form, string_agg(iri, ',' ORDER BY iri) AS iris FROM (SELECT DISTINCT form, iri FROM forms) GROUP BY form")
def labels_to_classes(spark, d):
    return I.labels_to_classes(C.forms(part_concepts(spark, d))).select("form", F.array_join("iris", ",").alias("iris"))


@registered("SELECT iri, token FROM postings")
def token_sets(spark, d):
    return I.token_sets(C.forms(part_concepts(spark, d)))


@registered("SELECT token, count(*) AS n, string_agg(iri, ',' ORDER BY iri) AS iris FROM postings GROUP BY token")
def inverted_index(spark, d):
    made = I.inverted_index(I.token_sets(C.forms(part_concepts(spark, d))))
    return made.select("token", F.size("iris").cast("long").alias("n"), F.array_join("iris", ",").alias("iris"))


@registered("SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf(spark, d):
    return part_index(spark, d).idf.select("token", "df", F.round("idf", 9).alias("idf"))


@registered(f"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({norm("text")}, {TOKEN})) AS token FROM documents)
    SELECT token, count(*) AS df, round(log10(CAST((SELECT count(*) FROM documents) AS DOUBLE) / count(*)), 9) AS idf FROM t GROUP BY token""")
def documents_idf(spark, d):
    docs = table(spark, d, "documents")
    sets = docs.select(F.col("doc_id").alias("iri"), F.explode(F.array_distinct(T.tokens(T.normalize_label("text")))).alias("token"))
    return I.inverse_document_frequency(sets, docs.count()).select("token", "df", F.round("idf", 9).alias("idf"))


@registered("SELECT p_name AS iri, arg_max(p_brand, p_partkey) AS text FROM part GROUP BY p_name")
def text_map(spark, d):
    return X.text_map(table(spark, d, "part").select(F.col("p_name").alias("iri"), F.col("p_brand").alias("text"), "p_partkey"), order="p_partkey")


# ---- retrieval ----


@registered("SELECT query_id, rank, iri, score, source FROM exact")
def exact_match(spark, d):
    return R.exact_candidates(asked(spark, d), part_index(spark, d)).select(*R.COLUMNS)


@registered("SELECT query_id, rank, iri, round(score, 6) AS score FROM lexical_all WHERE rank <= 10")
def lexical_topk(spark, d):
    return _rounded(R.lexical_candidates(asked(spark, d), part_index(spark, d), 10)).select("query_id", "rank", "iri", "score")


@registered(f"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({norm("text")}, {TOKEN})) AS token FROM documents),
    w AS (SELECT token, log10(CAST((SELECT count(*) FROM documents) AS DOUBLE) / count(*)) AS idf FROM t GROUP BY token),
    q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({norm("text")}, {TOKEN})) AS token FROM benchmark) GROUP BY item_id, token),
    s AS (SELECT item_id AS query_id, 'doc:' || CAST(doc_id AS VARCHAR) AS iri, sum(times * idf) AS score FROM q JOIN w USING (token) JOIN t USING (token) WHERE idf > 0 GROUP BY 1, 2)
    SELECT query_id, rank, iri, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, iri) AS rank FROM s) WHERE rank <= 10""")
def lexical_topk_documents(spark, d):
    docs = table(spark, d, "documents")
    spread = spark.sparkContext.defaultParallelism
    forms = docs.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("iri"), "text").repartition(spread)
    postings = forms.select("iri", F.explode(F.array_distinct(T.tokens(T.normalize_label("text")))).alias("token"))
    n = docs.count()
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = I.Index(None, postings, I.inverse_document_frequency(postings, n), None, None, n)
    return _rounded(R.lexical_candidates(queries, index, 10)).select("query_id", "rank", "iri", "score")


@registered("SELECT query_id, rank, iri, round(score, 6) AS score FROM semantic_all WHERE rank <= 10")
def semantic_topk(spark, d):
    return _rounded(R.semantic_candidates(asked_vectors(spark, d), class_vectors(spark, d), 10)).select("query_id", "rank", "iri", "score")


@registered("SELECT query_id, rank, iri, round(score, 6) AS score FROM semantic_all WHERE rank <= 10")
def semantic_topk_blocked(spark, d):
    return _rounded(R.blocked_semantic_candidates(asked_vectors(spark, d), class_vectors(spark, d), 10)).select("query_id", "rank", "iri", "score")


@registered("""SELECT query_id, rank, iri, round(score, 6) AS score FROM (
    SELECT query_id, iri, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, iri) AS rank FROM (
        SELECT query_id, iri, s.score / (sqrt(n.nn) * sqrt(m.nn) + 1e-12) AS score FROM semantic_all s
        JOIN (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nn FROM embeddings) n ON n.vec_id = s.query_id + 1
        JOIN (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nn FROM embeddings) m ON 'part:' || CAST(m.vec_id AS VARCHAR) = s.iri)) WHERE rank <= 10""")
def semantic_topk_unnormalized(spark, d):
    longer = class_vectors(spark, d).withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2.0).cast("float")))
    return _rounded(R.semantic_candidates(asked_vectors(spark, d), longer, 10, normalized=False)).select("query_id", "rank", "iri", "score")


@registered("SELECT query_id, rank, iri, round(score, 6) AS score, source FROM merged WHERE rank <= 20")
def hybrid_merge(spark, d):
    index, queries = part_index(spark, d), asked(spark, d)
    rest = R.without_exact(queries, index)
    lexical = R.lexical_candidates(rest, index, 15)
    semantic = R.semantic_candidates(asked_vectors(spark, d).join(rest, "query_id", "left_semi"), index.vectors, 15)
    return _rounded(R.merge_candidates(lexical, semantic, 20)).select(*R.COLUMNS)


@registered("""SELECT query_id, rank, iri, round(score, 6) AS score, source, source AS found FROM exact
    UNION ALL SELECT query_id, rank, iri, round(score, 6), source, source FROM lexical WHERE rank <= 15
    UNION ALL SELECT query_id, rank, iri, round(score, 6), source, source FROM semantic WHERE rank <= 15 AND query_id NOT IN (SELECT query_id FROM lexical)""")
def retrieve_lexical_mode(spark, d):
    config = R.RetrievalConfig("lexical", 15, 15)
    return _rounded(R.retrieve(asked(spark, d), part_index(spark, d), config, asked_vectors(spark, d)))


@registered("SELECT query_id, rank, iri, round(score, 6) AS score, source, found FROM hybrid")
def retrieve_hybrid_mode(spark, d):
    return _rounded(R.retrieve(asked(spark, d), part_index(spark, d), SPEC.retrieval, asked_vectors(spark, d)))


# ---- scoring ----


def _found(spark, d):
    index = part_index(spark, d)
    return index, R.search(R.without_exact(asked(spark, d), index), index, SPEC.retrieval, asked_vectors(spark, d))


def _pairs(spark, d):
    index, found = _found(spark, d)
    return S.scoring_pairs(found, index.texts, SPEC.cross_top_k)


@registered("SELECT query_id, iri, cand_rank, text FROM pairs")
def scoring_pairs(spark, d):
    return _pairs(spark, d)


@registered("SELECT query_id, iri, cand_rank, round(score, 6) AS score, place FROM placed")
def pair_rerank(spark, d):
    return _rounded(S.rank_scored(S.score_pairs(_pairs(spark, d), asked(spark, d))))


@registered("SELECT query_id, predicted_iri, round(predicted_score, 6) AS predicted_score, num_scored FROM best")
def best_prediction(spark, d):
    return _rounded(S.best_predictions(S.score_pairs(_pairs(spark, d), asked(spark, d))), "predicted_score").drop("top")


@registered("""SELECT query_id, max(CASE WHEN place = 1 THEN iri END) AS top1_iri, round(max(CASE WHEN place = 1 THEN score END), 6) AS top1_score,
    max(CASE WHEN place = 2 THEN iri END) AS top2_iri, round(max(CASE WHEN place = 2 THEN score END), 6) AS top2_score FROM placed GROUP BY query_id""")
def topn_wide(spark, d):
    wide = S.top_columns(S.best_predictions(S.score_pairs(_pairs(spark, d), asked(spark, d)), 2), 2)
    return _rounded(_rounded(wide, "top1_score"), "top2_score").select("query_id", "top1_iri", "top1_score", "top2_iri", "top2_score")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return S.align(asked(spark, d), part_index(spark, d), SPEC, query_vectors=asked_vectors(spark, d))


@registered("SELECT query_id, attribute_text, retrieval_source, num_retrieved, num_scored, predicted_iri, round(predicted_score, 6) AS predicted_score FROM aligned")
def align(spark, d):
    return _rounded(aligned(spark, d), "predicted_score").drop("top")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return align(spark, d)


# ---- datasets ----


def source_classes(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("source_iri"), F.col("s_name").alias("source_label"), F.concat(F.lit("label: "), F.col("s_name")).alias("source_text")
    )


def target_classes(spark, d) -> DataFrame:
    return part_concepts(spark, d).select(F.col("iri").alias("target_iri"), F.col("label").alias("target_label"), F.col("text").alias("target_text"), F.col("synonyms").alias("target_synonyms"))


def alignment(spark, d) -> DataFrame:
    keys = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey", "l_partkey").distinct()
    return keys.select(F.concat(F.lit("supplier:"), F.col("l_suppkey") * 2).alias("source_iri"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("target_iri"))


@registered("SELECT source_iri, target_iri FROM valid")
def valid_alignment(spark, d):
    return D.valid_alignment(alignment(spark, d), source_classes(spark, d), target_classes(spark, d))


_BAD = """(contains(a, b) OR contains(b, a) OR (len(wa) > 0 AND len(wb) > 0 AND (len(list_intersect(wa, wb)) = len(list_distinct(wa)) OR len(list_intersect(wa, wb)) = len(list_distinct(wb))
    OR contains(replace(a, ' ', ''), replace(b, ' ', '')) OR contains(replace(b, ' ', ''), replace(a, ' ', '')) OR list_contains(sb, a) OR list_contains(sa, b))))"""
_NAMES = "SELECT p_name AS n, string_split(p_name, ' ') AS w, list_distinct(list(lower(p_type))) AS s FROM part GROUP BY p_name"


@registered(f"""WITH names AS ({_NAMES}) SELECT x.n AS a, y.n AS b, {_BAD.replace("wa", "x.w").replace("wb", "y.w").replace("sa,", "x.s,").replace("sb,", "y.s,").replace("(a, ' '", "(x.n, ' '").replace("(b, ' '", "(y.n, ' '").replace("(a, b)", "(x.n, y.n)").replace("(b, a)", "(y.n, x.n)").replace(", a)", ", x.n)").replace(", b)", ", y.n)")} AS bad
    FROM names x JOIN (SELECT split_part(n, ' ', 2) AS k, * FROM names) y ON split_part(x.n, ' ', 2) = y.k OR split_part(x.n, ' ', 1) = split_part(y.n, ' ', 1)""")
def hard_negative_filter(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.collect_set(F.lower("p_type")).alias("s")).select(F.col("p_name").alias("n"), "s")
    word = lambda c, i: F.split(c, " ")[i - 1]
    x, y = (names.select(F.col("n").alias(k), F.col("s").alias("s" + k)) for k in "ab")
    same = [x.join(y, word("a", i) == word("b", i)) for i in (1, 2)]
    return same[0].union(same[1]).dropDuplicates(["a", "b"]).select("a", "b", D.is_bad_hard_negative(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("bad"))


@registered("SELECT source_iri, target_iri, round(score, 6) AS score FROM near_vectors n WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE n.source_iri = 'vec:' || CAST(e.vec_id AS VARCHAR) AND n.target_iri = 'part:' || CAST(e.vec_id AS VARCHAR))")
def hard_negatives(spark, d):
    vectors = table(spark, d, "embeddings")
    side = lambda p, name, df: df.select(
        F.concat(F.lit(name), F.col("vec_id")).alias(f"{p}_iri"), F.concat(F.lit(f"{p} "), F.col("vec_id")).alias(f"{p}_label"), F.lit(None).cast("string").alias(f"{p}_synonyms"), "embedding"
    )
    own = vectors.select(F.concat(F.lit("vec:"), F.col("vec_id")).alias("source_iri"), F.concat(F.lit("part:"), F.col("vec_id")).alias("target_iri"))
    return _rounded(D.hard_negative_pool(side("source", "vec:", vectors.where("vec_id % 20 = 0")), side("target", "part:", vectors), own, 20, 0.1, 0.8))


def _random_sql(num: str, taken: str) -> str:
    """CTEs that end in random_picked: num pairs of source_classes and target_classes that aren't among `taken`."""
    numbered = lambda c, t: f"SELECT {c}, row_number() OVER (ORDER BY md5('42|' || {c}), {c}) - 1 AS no FROM (SELECT DISTINCT {c} FROM {t})"
    return f"""s AS ({numbered("source_iri", "source_classes")}), t AS ({numbered("target_iri", "target_classes")}),
    sizes AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM s) * (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM {taken}) AS nd, {num} AS num),
    steps AS (SELECT min(k) AS step FROM (SELECT unnest(range(CAST(floor(total * CAST(0.6180339887498949 AS DOUBLE)) AS BIGINT), CAST(floor(total * CAST(0.6180339887498949 AS DOUBLE)) AS BIGINT) + 1000)) AS k, total FROM sizes) WHERE gcd(k, total) = 1),
    drawn AS (SELECT CAST((CAST(id AS HUGEINT) * step) % total AS BIGINT) AS p, nt FROM (SELECT unnest(range(least(total, 4 * num + nd))) AS id, total, nt FROM sizes) CROSS JOIN steps),
    random_picked AS (SELECT source_iri, target_iri FROM drawn JOIN s ON s.no = p // nt JOIN t ON t.no = p % nt
        WHERE (source_iri, target_iri) NOT IN (SELECT (source_iri, target_iri) FROM {taken})
        ORDER BY md5('42|' || source_iri || '|' || target_iri), source_iri, target_iri LIMIT (SELECT num FROM sizes))"""


@registered(f"WITH {_random_sql('200', 'valid')} SELECT source_iri, target_iri, 'random_negative' AS sample_type, 0 AS match FROM random_picked")
def random_negatives(spark, d):
    taken = D.valid_alignment(alignment(spark, d), source_classes(spark, d), target_classes(spark, d))
    return D.random_negatives(source_classes(spark, d), target_classes(spark, d), taken, 200)


@registered("""SELECT source_iri, target_iri, source_label, target_label, source_text, target_text, 'positive' AS sample_type, CAST(1.0 AS DOUBLE) AS match
    FROM valid JOIN source_classes USING (source_iri) JOIN target_classes USING (target_iri)""")
def training_positives(spark, d):
    positives = D.valid_alignment(alignment(spark, d), source_classes(spark, d), target_classes(spark, d))
    return D.with_texts(positives.select("source_iri", "target_iri", F.lit("positive").alias("sample_type"), F.lit(1).alias("match")), source_classes(spark, d), target_classes(spark, d))


@registered(f"""WITH supplier_vectors AS (SELECT source_iri, v.embedding FROM source_classes JOIN embeddings v ON v.vec_id = s_suppkey),
    near AS (SELECT source_iri, target_iri, score, row_number() OVER (PARTITION BY source_iri ORDER BY round(score, 9) DESC, target_iri) AS rank
        FROM (SELECT x.source_iri, y.iri AS target_iri, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score
            FROM supplier_vectors x CROSS JOIN class_vectors y)),
    hard AS (SELECT source_iri, target_iri FROM near WHERE rank <= 20 AND round(score, 9) BETWEEN 0.65 AND 0.8 AND (source_iri, target_iri) NOT IN (SELECT (source_iri, target_iri) FROM valid)
        AND target_iri IN (SELECT target_iri FROM target_classes)
        ORDER BY md5('42|' || source_iri || '|' || target_iri), source_iri, target_iri LIMIT (SELECT count(*) // 2 FROM valid)),
    samples AS (SELECT * FROM valid UNION ALL SELECT * FROM hard),
    {_random_sql("(SELECT count(*) // 2 FROM valid)", "samples")}
    SELECT source_iri, target_iri, source_label, target_label, source_text, target_text, sample_type, match FROM (
        SELECT *, 'positive' AS sample_type, CAST(1.0 AS DOUBLE) AS match FROM valid UNION ALL SELECT *, 'hard_negative', 0.0 FROM hard UNION ALL SELECT *, 'random_negative', 0.0 FROM random_picked)
    JOIN source_classes USING (source_iri) JOIN target_classes USING (target_iri)""")
def training_dataset(spark, d):
    """All rows; suppliers and parts have the vectors of their number. No supplier's name says anything of a part's, so no near pair is bad."""
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("supplier:"), F.col("vec_id")).alias("source_iri"), "embedding")
    sources = source_classes(spark, d).withColumn("source_synonyms", F.lit("")).join(vectors, "source_iri", "left")
    targets = target_classes(spark, d).join(class_vectors(spark, d).withColumnRenamed("iri", "target_iri"), "target_iri", "left")
    return D.training_dataset(sources, targets, alignment(spark, d))


_SPLIT = """SELECT doc_id, toxic, CASE WHEN place <= t THEN 'test' WHEN place <= t + ceil((n - t) * (0.15 / (0.75 + 0.15)) - 1e-9) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, ceil(n * 0.10 - 1e-9) AS t FROM (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n,
        row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM labels))"""


@registered(_SPLIT)
def stratified_split(spark, d):
    return D.stratified_split(table(spark, d, "labels"), by="toxic", keys=("doc_id",)).select("doc_id", "toxic", "split")


@registered("""SELECT source_iri, min(source_label) AS source_label, string_agg(target_iri, ',' ORDER BY target_iri) AS gold
    FROM valid JOIN source_classes USING (source_iri) GROUP BY source_iri""")
def queries_gold(spark, d):
    made = D.queries_with_gold(training_positives(spark, d))
    return made.select("source_iri", "source_label", F.array_join("gold_target_iris", ",").alias("gold"))


# ---- evaluation ----


def gold(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    least = part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    iri = lambda c: F.concat(F.lit("part:"), F.col(c))
    return part.where("p_partkey % 20 = 0").join(least, "p_name").select(
        F.col("p_partkey").alias("query_id"), F.array(iri("p_partkey"), iri("k")).alias("gold_target_iris"), (F.col("p_size") >= 10).cast("int").alias("match")
    )


def judged(spark, d) -> DataFrame:
    merged, _ = E.join_predictions(gold(spark, d), aligned(spark, d), id_col="query_id")
    return merged


@registered("SELECT p_partkey, array_to_string(g, ';') AS gold FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_name, p_type] WHEN p_partkey % 3 = 1 THEN [p_brand] ELSE [] END AS g FROM part)")
def parse_gold(spark, d):
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_type"), F.lit("']"))).when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(E.gold_list(said), ";").alias("gold"))


@registered("SELECT query_id, predicted_iri, own || ';' || same AS gold, match FROM judged")
def eval_join(spark, d):
    return judged(spark, d).select("query_id", "predicted_iri", F.array_join("gold_target_iris", ";").alias("gold"), "match")


@registered("""SELECT count(*) AS n, round(avg(CASE WHEN predicted_iri IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage,
    (SELECT string_agg(retrieval_source || '=' || CAST(c AS VARCHAR), ';' ORDER BY c DESC, retrieval_source) FROM (SELECT retrieval_source, count(*) AS c FROM aligned GROUP BY 1)) AS distribution FROM aligned""")
def basic_stats(spark, d):
    made = E.basic_stats(aligned(spark, d))
    shares = F.array_join(F.transform("distribution", lambda x: F.concat(x["source"], F.lit("="), F.round(x["share"] * F.col("n")).cast("long"))), ";")
    return made.select("n", F.round("coverage", 6).alias("coverage"), shares.alias("distribution"))


@registered("SELECT round(avg(CASE WHEN own IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS gold_attach_rate FROM aligned LEFT JOIN gold USING (query_id)")
def gold_attach_rate(spark, d):
    return _rounded(E.gold_attach_rate(judged(spark, d)), "gold_attach_rate")


_MEASURES = """count(*) AS n_pos, round(avg(CASE WHEN best_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1_pos,
    round(avg(CASE WHEN best_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hits_at_k_pos, round(avg(coalesce(1.0 / best_rank, 0)), 6) AS mrr_at_k_pos"""


def _rounded_measures(df: DataFrame) -> DataFrame:
    for c in E.METRICS[1:]:
        df = _rounded(df, c)
    return df


@registered(f"SELECT {_MEASURES} FROM judged WHERE match = 1")
def ranking_metrics(spark, d):
    return _rounded_measures(E.ranking_metrics(judged(spark, d), k=5))


_BY_SOURCE = f"""SELECT 'overall' AS scope, 'ALL' AS retrieval_source, {_MEASURES} FROM judged WHERE match = 1
    UNION ALL SELECT 'by_source', retrieval_source, {_MEASURES} FROM judged WHERE match = 1 GROUP BY retrieval_source"""


@registered(_BY_SOURCE)
def metrics_by_source(spark, d):
    return _rounded_measures(E.metrics_by_source(judged(spark, d), k=5))


@registered(f"""SELECT 'old' AS "EVAL_RUN_ID", NULL AS scope, NULL AS retrieval_source, CAST(-1 AS BIGINT) AS n_pos, NULL AS join_method
    UNION ALL SELECT 'new', scope, retrieval_source, n_pos, 'id' FROM ({_BY_SOURCE})""")
def metrics_append(spark, d):
    merged, plan = E.join_predictions(gold(spark, d), aligned(spark, d), id_col="query_id")
    old = spark.createDataFrame([("old",)], "EVAL_RUN_ID string")
    rows = E.metrics_rows(merged, E.basic_stats(merged), plan, 5, {"MODEL_TYPE": "overlap"}, "new", old)
    return rows.select("EVAL_RUN_ID", "scope", "retrieval_source", F.coalesce("n_pos", F.lit(-1)).cast("long").alias("n_pos"), "join_method")


_CURVE = """steps AS (SELECT score AS s, sum(quality) AS pos, count(*) AS n FROM lab GROUP BY score),
    curve AS (SELECT s, pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen, sum(pos) OVER () AS all_pos, sum(n) OVER () AS total,
        lead(s) OVER (ORDER BY s DESC) AS below FROM steps)"""


def _labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 1000 / 1000 + F.col("doc_id") / 1e9).alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), "score")


_LABELLED = "WITH lab AS (SELECT doc_id, quality, CAST(n_chars % 1000 AS DOUBLE) / 1000 + CAST(doc_id AS DOUBLE) / CAST(1000000000 AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)), "


@registered(
    _LABELLED + _CURVE + """ SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1, (SELECT round(sum(pos / all_pos * tp / seen), 6) FROM curve) AS average_precision
    FROM (SELECT CAST(sum(CASE WHEN score > 0.5 AND quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN score > 0.5 AND quality = 0 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN score <= 0.5 AND quality = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN score <= 0.5 AND quality = 0 THEN 1 ELSE 0 END) AS tn, count(*) AS n FROM lab)"""
)
def classification_metrics(spark, d):
    made = E.classification_metrics(_labelled(spark, d))
    for c in made.columns:
        made = _rounded(made, c)
    return made


@registered(
    _LABELLED + _CURVE + """ SELECT round(coalesce((s + below) / 2, s - 1e-4), 12) AS threshold, round((tp + (total - seen) - (all_pos - tp)) / total, 6) AS accuracy
    FROM curve ORDER BY (tp + (total - seen) - (all_pos - tp)) DESC, s DESC LIMIT 1"""
)
def best_threshold(spark, d):
    return _rounded(E.best_threshold(_labelled(spark, d)).withColumn("threshold", F.round("threshold", 12)), "accuracy")


# ---- search, graph, settings ----


_EDGES = "SELECT DISTINCT source_label AS src, target_label AS dst FROM valid JOIN source_classes USING (source_iri) JOIN target_classes USING (target_iri)"


@registered(f"""SELECT src AS id, 'source' AS side, count(*) AS degree, CAST(NULL AS VARCHAR) AS dst FROM ({_EDGES}) GROUP BY src
    UNION ALL SELECT dst, 'target', count(*), NULL FROM ({_EDGES}) GROUP BY dst
    UNION ALL SELECT src, 'edge', 1, dst FROM ({_EDGES})""")
def alignment_graph(spark, d):
    nodes, edges = H.alignment_graph(training_positives(spark, d))
    return nodes.withColumn("dst", F.lit(None).cast("string")).union(edges.select("src", F.lit("edge"), F.lit(1).cast("long"), "dst"))


_TRIALS = [t for r in (0.3, 0.5, 0.7) for a in (5, 10, 15) for b in (5, 10, 15) for m in (10, 20, 30) for c in (2, 5, 8, 10) if (t := H.Trial(a, b, m, r, c)).makes_sense()]
_TRIED = ", ".join(
    f"({n}, {t.merged_top_k}, {', '.join(map(str, R.split_budget(t.merged_top_k, t.ratio_semantic)))}, {', '.join(map(str, R.split_budget(t.cross_top_k, t.ratio_semantic)))})" for n, t in enumerate(_TRIALS[:100])
)


@registered(f"""WITH trials AS (SELECT * FROM (VALUES {_TRIED}) v(trial, merged_k, kl, ks, cl, cs)), said AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), {TOKEN})) AS a FROM asked),
    texts AS (SELECT iri, list_distinct(regexp_extract_all(lower(text), {TOKEN})) AS b FROM concepts),
    lists AS (SELECT trial, merged_k, cl, cs, l.query_id, l.iri, l.source, l.rank, 0 AS list FROM lexical l CROSS JOIN trials WHERE l.rank <= least(15, kl)
        UNION ALL SELECT trial, merged_k, cl, cs, m.query_id, m.iri, m.source, m.rank, 1 FROM semantic m CROSS JOIN trials WHERE m.rank <= least(15, ks)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY trial, query_id ORDER BY list, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY trial, query_id, iri ORDER BY list, rank) AS n FROM lists) WHERE n = 1),
    dealt AS (SELECT *, row_number() OVER (PARTITION BY trial, query_id, source ORDER BY place) AS nth FROM kept WHERE place <= merged_k),
    placed_pairs AS (SELECT trial, query_id, iri, row_number() OVER (PARTITION BY trial, query_id ORDER BY
        CASE WHEN source = 'lexical' AND nth <= cl THEN 0 WHEN source <> 'lexical' AND nth <= cs THEN 1 WHEN source <> 'lexical' THEN 2 ELSE 3 END, place) AS cand_rank, cl + cs AS k FROM dealt),
    pair_scores AS (SELECT trial, query_id, iri, cand_rank, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS score
        FROM placed_pairs JOIN said USING (query_id) JOIN texts USING (iri) WHERE cand_rank <= k),
    winners AS (SELECT trial, query_id, iri FROM (SELECT *, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, cand_rank) AS n FROM pair_scores) WHERE n = 1
        UNION ALL SELECT trial, query_id, min(iri) FROM exact CROSS JOIN trials GROUP BY trial, query_id)
    SELECT trial, round(avg(CASE WHEN w.iri IN (own, same) THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1_pos
    FROM gold CROSS JOIN trials LEFT JOIN winners w USING (trial, query_id) WHERE match = 1 GROUP BY trial""")
def config_search(spark, d):
    """A hundred trials over candidates to rank 15."""
    state = H.prepare(asked(spark, d), part_index(spark, d), asked_vectors(spark, d), most=15)
    made = H.search(state, gold(spark, d), _TRIALS[:100])
    return _rounded(made.select("trial", "precision_at_1_pos"), "precision_at_1_pos")


@registered("SELECT unnest(['MODEL_TYPE', 'CROSS_TOP_K', 'KEEP_TOP_N']) AS key, unnest(['cross: x', '20', '5']) AS value")
def config_parse(spark, d):
    lines = ["# a comment", "[section]", "", "model_type = cross: x", "CROSS_TOP_K: 20", "UNKNOWN = 1", " keep_top_n=5 "]
    return X.config_rows(spark.createDataFrame([(x,) for x in lines], "value string"))


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
