"""TF-IDF, text search and recommendation (ids V8-V12, V17, V22-V24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import extremes as ex, text as tx, vectors as vx
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import ITEMS
from millrace.sources import datasets as ds, readers

Q = QuerySet()

# A short stop word list both engines of the check share.
_STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of",
         "on", "or", "that", "the", "this", "to", "was", "with"]
_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP)

_TEXT_QUERIES = {"first": "der die und rewh", "second": "le des et th nd", "third": "que el es un"}
_ITEM_QUERIES = {"q": "small red ring"}
_DOCS_SQL = "(SELECT doc_id AS id, text FROM documents)"


def _model_sql(source: str, max_features: int, bigrams: bool, max_df: float,
               queries: dict[str, str] | None = None) -> str:
    """WITH-list: toks, v (vocabulary), w (weights) and, with queries, s (scores)."""
    def tokens(table, key):
        cut = (f"SELECT {key}, list_filter(regexp_extract_all(lower(text), "
               f"'[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP_SQL})) AS t FROM {table}")
        if not bigrams:
            return f"SELECT {key}, UNNEST(t) AS term FROM ({cut}) AS c"
        return (f"SELECT {key}, UNNEST(list_concat(t, list_transform(range(1, len(t)), "
                f"lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM ({cut}) AS c")

    parts = [
        f"src AS (SELECT * FROM {source} AS d0)",
        "nd AS (SELECT COUNT(*) AS n FROM src)",
        f"tc AS (SELECT id, term, COUNT(*) AS c FROM ({tokens('src', 'id')}) AS k GROUP BY 1, 2)",
        f"""v AS (SELECT term, COUNT(*) AS df, SUM(c) AS total,
            ln((1 + (SELECT n FROM nd))::DOUBLE / (1 + COUNT(*))) + 1.0::DOUBLE AS idf FROM tc
            GROUP BY 1 HAVING COUNT(*) <= {max_df} * (SELECT n FROM nd)
            ORDER BY total DESC, term LIMIT {max_features})""",
        """w AS (SELECT id, term, x / sqrt(SUM(x * x) OVER (PARTITION BY id)) AS weight FROM (
            SELECT id, term, c * idf AS x FROM tc JOIN v USING (term)) AS y)"""]
    if queries:
        listed = " UNION ALL ".join(f"SELECT '{k}' AS qid, '{t}' AS text"
                                    for k, t in queries.items())
        parts += [
            f"qs AS ({listed})",
            f"""qc AS (SELECT qid, term, COUNT(*) AS c FROM ({tokens('qs', 'qid')}) AS k
                GROUP BY 1, 2)""",
            """qw AS (SELECT qid, term, x / sqrt(SUM(x * x) OVER (PARTITION BY qid)) AS weight
                FROM (SELECT qid, term, c * idf AS x FROM qc JOIN v USING (term)) AS y)""",
            """dots AS (SELECT qid, id, SUM(w.weight * qw.weight) AS dot FROM w JOIN qw USING (term)
                GROUP BY 1, 2)""",
            """s AS (SELECT qs.qid AS query_id, src.id, round(COALESCE(dot, 0), 9) AS similarity
                FROM qs CROSS JOIN src LEFT JOIN dots ON dots.qid = qs.qid AND dots.id = src.id)"""]
    return "WITH " + ", ".join(parts)


def _doc_model(spark, sf):
    return tx.fit_weighed(ds.documents(spark, sf), "text", 128, stop_words=_STOP, columns=["id"])


def _item_model(spark, sf):
    return tx.fit_weighed(ds.items(spark, sf), "text", 200, bigrams=True, max_df=0.8, stop_words=_STOP)


_DOC_SQL = _model_sql(_DOCS_SQL, 128, False, 1.0)
_DOC_SEARCH_SQL = _model_sql(_DOCS_SQL, 128, False, 1.0, _TEXT_QUERIES)


def _item_sql(queries):
    return _model_sql(ITEMS, 200, True, 0.8, queries)


@Q.add("V8_tfidf", "id long, term str, weight dbl6", f"{_DOC_SQL} SELECT id, term, weight FROM w")
def v8(spark, sf):
    return tx.long_form(_doc_model(spark, sf)[0], "id")


@Q.add("V9_tfidf_bigrams", "id long, term str, weight dbl6",
       f"{_model_sql(_DOCS_SQL, 200, True, 0.8)} SELECT id, term, weight FROM w")
def v9(spark, sf):
    return tx.long_form(tx.fit_weighed(ds.documents(spark, sf), "text", 200, bigrams=True, max_df=0.8,
                                       stop_words=_STOP)[0], "id")


@Q.add("V10_query_projection", "query_id str, term str, weight dbl6",
       f"{_DOC_SEARCH_SQL} SELECT qid AS query_id, term, weight FROM qw")
def v10(spark, sf):
    model = _doc_model(spark, sf)[1]
    return tx.long_form(tx.project_queries(spark, _TEXT_QUERIES, model), "query_id")


_RANKED = """SELECT query_id, rank, id, similarity FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s{where}) AS r
    WHERE rank <= {k}"""


@Q.add("V11_semantic_search", "query_id str, rank long, id long, similarity dbl6",
       _DOC_SEARCH_SQL + " " + _RANKED.format(where="", k=3))
def v11(spark, sf):
    weighted, model = _doc_model(spark, sf)
    return tx.search(weighted, "id", _TEXT_QUERIES, model, 3)


@Q.add("V12_search_profile", "field str, value str, amount dbl6",
       f"""{_item_sql(_ITEM_QUERIES)}, m AS (SELECT src.* FROM ({_RANKED.format(where='', k=5)}) AS h
             JOIN src ON src.id = h.id)
           SELECT 'avg_complexity' AS field, '' AS value, AVG(complexity::DOUBLE) AS amount FROM m
           UNION ALL SELECT 'avg_cost', '', AVG(cost::DOUBLE) FROM m
           UNION ALL SELECT 'category', category, COUNT(*) FROM m GROUP BY 2
           UNION ALL SELECT 'domain', domain, COUNT(*) FROM m GROUP BY 2""")
def v12(spark, sf):
    weighted, model = _item_model(spark, sf)
    hits = tx.search(weighted, "id", _ITEM_QUERIES, model, 5,
                     ["complexity", "cost", "category", "domain"])
    return tx.match_profile(hits, ["complexity", "cost"], ["category", "domain"])


def _doc_vectors(spark, sf):
    weighted, model = _doc_model(spark, sf)
    langs = ds.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
    return tx.dense(weighted, model).select("id", "vector").join(langs, "id")


@Q.add("V16_tfidf_norms", "id long, norm dbl6",
       f"""{_DOC_SQL} SELECT src.id, COALESCE(n2, 0) AS norm FROM src LEFT JOIN (
           SELECT id, sqrt(SUM(weight * weight)) AS n2 FROM w GROUP BY 1) AS l ON l.id = src.id""")
def v16_tfidf(spark, sf):
    weighted, model = _doc_model(spark, sf)
    return vx.norms(tx.dense(weighted, model))


@Q.add("V15_tfidf_mean_similarity", "id long, mean_similarity dbl6",
       f"""{_DOC_SQL}, m AS (SELECT term, SUM(weight) / (SELECT n FROM nd) AS m FROM w GROUP BY 1)
           SELECT src.id, COALESCE(x, 0) AS mean_similarity FROM src LEFT JOIN (
           SELECT id, SUM(weight * m) AS x FROM w JOIN m USING (term) GROUP BY 1) AS l
           ON l.id = src.id""")
def v15_tfidf(spark, sf):
    weighted, model = _doc_model(spark, sf)
    return vx.mean_similarity_per_row(tx.dense(weighted, model).select("id", "vector"))


@Q.add("V18_tfidf_nearest_centroid", "id long, cluster str, distance dbl6",
       f"""{_DOC_SQL}, lg AS (SELECT doc_id AS id, lang FROM documents),
           ln AS (SELECT lang, COUNT(*) AS n FROM lg GROUP BY 1),
           c AS (SELECT lang, term, SUM(weight) / any_value(ln.n) AS x FROM w JOIN lg USING (id)
             JOIN ln USING (lang) GROUP BY 1, 2),
           cn AS (SELECT lang, SUM(x * x) AS sq FROM c GROUP BY 1),
           dn AS (SELECT src.id, COALESCE(SUM(weight * weight), 0) AS sq FROM src
             LEFT JOIN w ON w.id = src.id GROUP BY 1),
           dots AS (SELECT id, lang, SUM(weight * x) AS dot FROM w JOIN c USING (term) GROUP BY 1, 2),
           g AS (SELECT dn.id, cn.lang, round(dn.sq - 2 * COALESCE(dot, 0) + cn.sq, 9) AS d
             FROM dn CROSS JOIN cn LEFT JOIN dots ON dots.id = dn.id AND dots.lang = cn.lang)
           SELECT id, lang AS cluster, d AS distance FROM (SELECT *, ROW_NUMBER() OVER (
             PARTITION BY id ORDER BY d, lang) AS rn FROM g) AS r WHERE rn = 1""")
def v18_tfidf(spark, sf):
    v = _doc_vectors(spark, sf)
    return vx.assign_nearest(v, vx.category_centroids(v))


@Q.add("V17_top_terms", "term str, mean_weight dbl6",
       f"""{_DOC_SQL} SELECT term, round(SUM(weight) / (SELECT n FROM nd), 9) AS mean_weight
           FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def v17(spark, sf):
    return tx.top_terms(_doc_model(spark, sf)[0], 10)


def _rare_word_model(spark, sf):
    return tx.fit_weighed(ds.documents(spark, sf), "text", 300, max_df=0.05, stop_words=_STOP, columns=["id"])


_CLASSES_SQL = f"""{_model_sql(_DOCS_SQL, 300, False, 0.05)},
    e AS (SELECT id, list(term || ':' || round(weight, 9) ORDER BY term) AS k FROM w GROUP BY 1),
    c AS (SELECT k, MIN(id) AS class_id, COUNT(*) AS size FROM e GROUP BY 1)"""


@Q.add("V13_similar_pairs", "class_a long, class_b long, size_a long, size_b long, similarity dbl6",
       f"""{_CLASSES_SQL}, cw AS (SELECT class_id, size, term, weight FROM c JOIN w ON w.id = class_id)
           SELECT a.class_id AS class_a, b.class_id AS class_b, any_value(a.size) AS size_a,
           any_value(b.size) AS size_b, round(SUM(a.weight * b.weight), 8) AS similarity
           FROM cw a JOIN cw b ON a.term = b.term AND a.class_id < b.class_id GROUP BY 1, 2
           HAVING round(SUM(a.weight * b.weight), 8) >= 0.8""")
def v13_pairs(spark, sf):
    """Documents of cosine 0.8 or more over their rarer words; documents of equal weights are one class."""
    weighted, model = _rare_word_model(spark, sf)
    return tx.similar_classes(tx.vector_classes(weighted, "id")[0], model)


@Q.add("V13_class_members", "id long, class_id long",
       f"{_CLASSES_SQL} SELECT e.id, class_id FROM e JOIN c USING (k)")
def v13_members(spark, sf):
    return tx.vector_classes(_rare_word_model(spark, sf)[0], "id")[1]


@Q.add("V14_matrix_extremes", "row_count long, max_below_one dbl6, min_similarity dbl6",
       f"""{_DOC_SQL}, m AS (SELECT a.id AS i, b.id AS j, round(SUM(a.weight * b.weight), 7) AS s
             FROM w a JOIN w b ON a.term = b.term AND a.id <= b.id GROUP BY 1, 2),
           z AS (SELECT (SELECT n FROM nd) * ((SELECT n FROM nd) + 1) / 2 > COUNT(*) AS zeros,
             MAX(CASE WHEN s < 1 THEN s END) AS hi, MIN(s) AS lo FROM m)
           SELECT (SELECT n FROM nd) AS row_count, CASE WHEN zeros THEN COALESCE(hi, 0) ELSE hi END AS max_below_one,
           CASE WHEN zeros THEN 0 ELSE lo END AS min_similarity FROM z""")
def v14_extremes(spark, sf):
    """Highest similarity below one and lowest of the documents' TF-IDF rows, over the whole matrix."""
    weighted, model = _doc_model(spark, sf)
    return ex.similarity_extremes(weighted, "id", model)


@Q.add("V22_recommend_similar", "rank long, id long, text str, similarity dbl6",
       f"""{_item_sql({'query': 'small red ring'})} SELECT rank, r.id, src.text, similarity FROM (
           SELECT *, ROW_NUMBER() OVER (ORDER BY similarity DESC, id) AS rank FROM s WHERE id IN (
             SELECT id FROM src WHERE lower(text) <> 'small red ring')) AS r
           JOIN src ON src.id = r.id WHERE rank <= 3""")
def v22(spark, sf):
    weighted, model = _item_model(spark, sf)
    return tx.recommend(weighted, "id", "text", "small red ring", model, 3)


_INTERESTS = ["red ring", "cold widget", "large gear", "blue rod"]
_PROFILE_DOMAINS = ["PROMO", "SMALL", "ECONOMY", "LARGE"]


@Q.add("V23_profile_recommendations", "id long, similarity dbl6, reason str",
       f"""{_item_sql({i: i for i in _INTERESTS})},
           h AS (SELECT r.*, src.complexity, src.domain FROM (SELECT *, ROW_NUMBER() OVER (
               PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) AS r
             JOIN src ON src.id = r.id WHERE rank <= 2),
           b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id
               ORDER BY similarity DESC, query_id) AS best FROM h
             WHERE complexity <= 40 AND domain IN ('PROMO', 'SMALL', 'ECONOMY', 'LARGE'))
           SELECT id, similarity, 'Based on interest: ' || query_id AS reason FROM b
           WHERE best = 1 ORDER BY similarity DESC, id LIMIT 10""")
def v23(spark, sf):
    weighted, model = _item_model(spark, sf)
    return tx.recommend_for_profile(weighted, "id", _INTERESTS, model, 40, _PROFILE_DOMAINS)


@Q.add("U2_best_per_id", "id long, similarity dbl6, query_id str",
       f"""{_item_sql({i: i for i in _INTERESTS})} SELECT id, similarity, query_id FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, query_id) AS best
           FROM s) AS r WHERE best = 1 ORDER BY similarity DESC, id LIMIT 10""")
def u2(spark, sf):
    weighted, model = _item_model(spark, sf)
    scored = tx.score(weighted, {i: i for i in _INTERESTS}, model)
    order = [F.desc("similarity"), F.asc("id"), F.asc("query_id")]
    return tx.best_per_id(scored.select("id", "query_id", "similarity"), "id", order, 10,
                          F.col("query_id"))


@Q.add("L5_top_k_similarity", "id long, similarity dbl6",
       f"""{_model_sql(_DOCS_SQL, 128, False, 1.0, {'one': 'der die und rewh'})}
           SELECT id, similarity FROM s ORDER BY similarity DESC, id LIMIT 5""")
def l5(spark, sf):
    weighted, model = _doc_model(spark, sf)
    hits = tx.search(weighted, "id", {"one": "der die und rewh"}, model, 5)
    return hits.orderBy("rank").select("id", "similarity")


@Q.add("V24_hybrid_search", "source str, ref str, score dbl6",
       f"""{_model_sql(_DOCS_SQL, 128, False, 1.0, {'one': 'der die und rewh'})}
           SELECT 'vector' AS source, CAST(id AS VARCHAR) AS ref, similarity AS score FROM (
             SELECT * FROM s ORDER BY similarity DESC, id LIMIT 2) AS t
           UNION ALL SELECT 'keyword', CAST(id AS VARCHAR), NULL FROM src WHERE text ILIKE '%rewh%'
           UNION ALL SELECT 'file', 'documents.parquet', NULL""")
def v24(spark, sf):
    weighted, model = _doc_model(spark, sf)
    hits = tx.search(weighted, "id", {"one": "der die und rewh"}, model, 2)
    words = ds.documents(spark, sf).filter(F.col("text").ilike("%rewh%"))
    files = readers.list_files(spark, sf, "doc*.parquet")
    return tx.hybrid_search(
        hits.select(F.col("id").cast("string").alias("ref"), F.col("similarity").alias("score")),
        words.select(F.col("id").cast("string").alias("ref")),
        files.select(F.element_at(F.split("path", "/"), -1).alias("ref")))
