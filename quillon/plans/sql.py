"""Pieces of DuckDB SQL that the oracles share: common table expressions, by name, each after those it needs."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def camel(x: str) -> str:
    """'red widget' to 'RedWidget'."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), '')"


TOKEN = r"'[\p{L}\p{N}]+'"

CTES: dict[str, tuple[str, ...] | str] = {
    "concepts": """
        SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS iri, p_name AS label, p_brand || ' | ' || p_type AS synonyms, p_partkey AS row_no,
               'label: ' || p_name || '; Synonyms: ' || p_brand || ' | ' || p_type AS text
        FROM part""",
    "raw_forms": f"""
        SELECT iri, 0 AS ord, {norm("label")} AS form FROM concepts
        UNION ALL
        SELECT iri, ord, {norm("v")} AS form FROM (
            SELECT iri, unnest(string_split(synonyms, '|')) AS v, unnest(range(1, len(string_split(synonyms, '|')) + 1)) AS ord FROM concepts)""",
    "forms": """
        SELECT iri, form, row_number() OVER (PARTITION BY iri ORDER BY ord) - 1 AS pos
        FROM (SELECT iri, form, min(ord) AS ord FROM raw_forms WHERE form <> '' GROUP BY iri, form)""",
    "postings": f"SELECT DISTINCT iri, unnest(regexp_extract_all(form, {TOKEN})) AS token FROM forms",
    "idf": """
        SELECT token, count(*) AS df, log10(CAST((SELECT count(DISTINCT iri) FROM concepts) AS DOUBLE) / count(*)) AS idf
        FROM postings GROUP BY token""",
    "asked": f"""
        SELECT p_partkey AS query_id,
               CASE WHEN p_partkey % 40 = 0 THEN {camel("p_name")} ELSE p_type || ' ' || p_brand || ' ' || p_type END AS query
        FROM part WHERE p_partkey % 20 = 0""",
    "exact_hits": f"""
        SELECT DISTINCT query_id, iri FROM (
            SELECT query_id, {norm("query")} AS form FROM asked
            UNION SELECT query_id, {norm("regexp_replace(query, '([a-z])([A-Z])', '\\1 \\2', 'g')")} FROM asked) JOIN forms USING (form)""",
    "exact": "SELECT query_id, iri, CAST(1.0 AS DOUBLE) AS score, 'exact' AS source, row_number() OVER (PARTITION BY query_id ORDER BY iri) AS rank FROM exact_hits",
    "rest": "SELECT * FROM asked WHERE query_id NOT IN (SELECT query_id FROM exact_hits)",
    "asked_tokens": f"""
        SELECT query_id, token, count(*) AS times
        FROM (SELECT query_id, unnest(regexp_extract_all({norm("query")}, {TOKEN})) AS token FROM asked) GROUP BY query_id, token""",
    "lexical_scores": """
        SELECT query_id, iri, sum(times * idf) AS score
        FROM asked_tokens JOIN idf USING (token) JOIN postings USING (token) WHERE idf > 0 GROUP BY query_id, iri""",
    "lexical_all": """
        SELECT query_id, iri, score, 'lexical' AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, iri) AS rank
        FROM lexical_scores""",
    "lexical": "SELECT * FROM lexical_all WHERE query_id NOT IN (SELECT query_id FROM exact_hits)",
    "class_vectors": "SELECT 'part:' || CAST(vec_id AS VARCHAR) AS iri, embedding FROM embeddings",
    "asked_vectors": "SELECT query_id, embedding FROM asked JOIN embeddings ON vec_id = query_id + 1",
    "semantic_all": """
        SELECT query_id, iri, score, 'semantic' AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, iri) AS rank
        FROM (SELECT q.query_id, v.iri, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score
              FROM asked_vectors q CROSS JOIN class_vectors v)""",
    "semantic": "SELECT * FROM semantic_all WHERE query_id NOT IN (SELECT query_id FROM exact_hits)",
    # the hybrid budget of the tests: 30 merged, half each
    "both_lists": """
        SELECT query_id, iri, score, source, rank, 0 AS list FROM lexical WHERE rank <= 15
        UNION ALL SELECT query_id, iri, score, source, rank, 1 FROM semantic WHERE rank <= 15""",
    "merged": """
        SELECT query_id, iri, score, source, row_number() OVER (PARTITION BY query_id ORDER BY list, rank) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, iri ORDER BY list, rank) AS n FROM both_lists) WHERE n = 1""",
    "hybrid": """
        SELECT query_id, rank, iri, score, source, 'exact' AS found FROM exact
        UNION ALL SELECT query_id, rank, iri, score, source, 'hybrid' FROM merged WHERE rank <= 30""",
    # 10 pairs a query, half of them semantic
    "turns": """
        SELECT query_id, iri, rank, CASE WHEN source = 'lexical' AND n <= 5 THEN 0 WHEN source <> 'lexical' AND n <= 5 THEN 1
               WHEN source <> 'lexical' THEN 2 ELSE 3 END AS turn
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM hybrid WHERE source <> 'exact')""",
    "pairs": """
        SELECT query_id, iri, cand_rank, text
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank) AS cand_rank FROM turns) JOIN (SELECT iri, text FROM concepts) USING (iri)
        WHERE cand_rank <= 10""",
    "pair_tokens": f"""
        SELECT query_id, iri, cand_rank, list_distinct(regexp_extract_all(lower(query), {TOKEN})) AS a, list_distinct(regexp_extract_all(lower(text), {TOKEN})) AS b
        FROM pairs JOIN asked USING (query_id)""",
    "scored": """
        SELECT query_id, iri, cand_rank, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS score FROM pair_tokens""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS place FROM scored",
    "best": """
        SELECT query_id, max(CASE WHEN place = 1 THEN iri END) AS predicted_iri, max(CASE WHEN place = 1 THEN score END) AS predicted_score,
               count(*) AS num_scored FROM placed GROUP BY query_id""",
    "found_counts": """
        SELECT query_id, count(*) AS num_retrieved, min(found) AS retrieval_source, min(CASE WHEN source = 'exact' THEN iri END) AS exact_iri
        FROM hybrid GROUP BY query_id""",
    "aligned": """
        SELECT a.query_id, a.query AS attribute_text, coalesce(f.retrieval_source, 'none') AS retrieval_source, coalesce(f.num_retrieved, 0) AS num_retrieved,
               coalesce(b.num_scored, 0) AS num_scored, coalesce(f.exact_iri, b.predicted_iri) AS predicted_iri,
               CASE WHEN f.exact_iri IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE b.predicted_score END AS predicted_score
        FROM asked a LEFT JOIN found_counts f USING (query_id) LEFT JOIN best b USING (query_id)""",
    # gold: the classes of the query's own part and of the part with the same name and least key
    "gold": """
        SELECT p.p_partkey AS query_id, 'part:' || CAST(p.p_partkey AS VARCHAR) AS own, 'part:' || CAST(m.k AS VARCHAR) AS same, CAST(p.p_size >= 10 AS INTEGER) AS match
        FROM part p JOIN (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) m USING (p_name) WHERE p.p_partkey % 20 = 0""",
    "judged": """
        SELECT a.*, g.match, g.own, g.same,
               CASE WHEN a.predicted_iri IN (g.own, g.same) THEN 1
                    ELSE (SELECT min(place) FROM placed s WHERE s.query_id = a.query_id AND place BETWEEN 2 AND 5 AND s.iri IN (g.own, g.same)) END AS best_rank
        FROM aligned a JOIN gold g USING (query_id)""",
    "source_classes": """
        SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS source_iri, s_name AS source_label, 'label: ' || s_name AS source_text, s_suppkey FROM supplier""",
    "target_classes": """
        SELECT iri AS target_iri, label AS target_label, text AS target_text, row_no FROM concepts""",
    "alignment": """
        SELECT DISTINCT 'supplier:' || CAST(l_suppkey * 2 AS VARCHAR) AS source_iri, 'part:' || CAST(l_partkey AS VARCHAR) AS target_iri
        FROM lineitem""",
    "valid": """
        SELECT source_iri, target_iri FROM alignment
        WHERE source_iri IN (SELECT source_iri FROM source_classes) AND target_iri IN (SELECT target_iri FROM target_classes)""",
    "near_vectors": """
        SELECT source_iri, target_iri, score FROM (
            SELECT *, row_number() OVER (PARTITION BY source_iri ORDER BY round(score, 9) DESC, target_iri) AS rank FROM (
                SELECT 'vec:' || CAST(a.vec_id AS VARCHAR) AS source_iri, 'part:' || CAST(b.vec_id AS VARCHAR) AS target_iri,
                       list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score
                FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 20 AND round(score, 9) BETWEEN 0.1 AND 0.8""",
}
_NEEDS = list(CTES)


def query(final: str) -> str:
    """The final SELECT with the expressions it needs, and those they need."""
    import re

    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in _NEEDS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|IN \(SELECT \w+ FROM|, )\s*{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    if not needed:
        return final
    shared = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in _NEEDS if n in needed)
    return f"{shared},\n{final.removeprefix('WITH ')}" if final.startswith("WITH ") else f"{shared}\n{final}"
