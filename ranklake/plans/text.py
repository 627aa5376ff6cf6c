"""Text search, fusion, measures and ranking models as queries, with their SQL. Every benchmark text is a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions import tokenize
from ranklake.functions.text import hash_embedding, markdown_chunks
from ranklake.operators import dense, fusion, ltr, metrics, sparse
from ranklake.plans import dense as D
from ranklake.plans.dense import table
from ranklake.shared import shared_dir
from ranklake.stores import bundle, ltr_cache

K = 10


def docs_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")


def queries_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _terms(tokenizer: str):
    def f(spark, sf_dir):
        d = docs_of(spark, sf_dir).select("row_id", tokenize.terms("text", tokenizer).alias("terms"))
        return d.select("row_id", F.size("terms").alias("n"), F.md5(F.array_join("terms", " ")).alias("digest"))

    f.__doc__ = f"The terms of every document by the {tokenizer} tokenizer: their number and a digest."
    return f


def term_stats(spark, sf_dir):
    """Document frequency of every term."""
    return sparse.build(docs_of(spark, sf_dir)).terms


def postings(spark, sf_dir):
    """Postings of every document."""
    return sparse.build(docs_of(spark, sf_dir)).postings


def describe(spark, sf_dir):
    """The size of the text index."""
    return sparse.build(docs_of(spark, sf_dir)).describe().withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def term_lookup(spark, sf_dir):
    """Document frequencies of all terms of the queries."""
    q = queries_of(spark, sf_dir).select(F.explode(tokenize.query_terms("query")).alias("term"))
    return sparse.find_terms(sparse.build(docs_of(spark, sf_dir)), q)


def bm25(spark, sf_dir):
    """Top 10 documents for every query."""
    return shown(sparse.search(sparse.build(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), K))


def bm25_identifiers(spark, sf_dir):
    """The same by the identifier tokenizer."""
    return shown(sparse.search(sparse.build(docs_of(spark, sf_dir), tokenize.IDENTIFIERS), queries_of(spark, sf_dir), K))


def bm25_allowed(spark, sf_dir):
    """Top 10 among the English documents."""
    d = docs_of(spark, sf_dir)
    return shown(sparse.search(sparse.build(d), queries_of(spark, sf_dir), K, d.filter("lang = 'en'").select("row_id")))


def bm25_per_query(spark, sf_dir):
    """Top 10 for every query among the documents whose label's quality is the query's parity."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality").distinct()
    q = queries_of(spark, sf_dir).withColumn("group", F.col("qid") % 2)
    return shown(sparse.search_in_groups(sparse.build(docs_of(spark, sf_dir)), q, K, labels.withColumnRenamed("quality", "group")))


def sparse_checks(spark, sf_dir):
    """What must hold of the text index, and how often it doesn't."""
    return sparse.checks(sparse.build(docs_of(spark, sf_dir)))


def sparse_bundle(spark, sf_dir):
    """Top 10 by a text index that was written beside the vectors' index and read again.

    Both indexes of a bundle have the same rows: documents without a vector of their id, and vectors without a document, are left out.
    """
    d = docs_of(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    both = d.join(v, "row_id")
    path = f"{shared_dir(spark)}/hybrid-{uuid.uuid4().hex}"
    bundle.write(dense.build(both), path, auxiliaries=bundle.text_auxiliaries(sparse.build(both)))
    _, text = bundle.open_hybrid(spark, path)
    return shown(sparse.search(text, queries_of(spark, sf_dir), K))


def normalized_lists(spark, sf_dir):
    """Event values as ranked lists: users are queries, and the hour of the day is the row."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    return fusion.normalize(e.select(F.col("user_id").alias("qid"), F.hour("ts").cast("long").alias("row_id"), F.col("value").alias("score")))


def flat_lists(spark, sf_dir):
    """The same from arrays side by side, where a negative id is an empty place."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    hit = F.struct(F.when(F.col("event_type") == "error", -1).otherwise(F.hour("ts")).cast("long").alias("id"), "value")
    lists = e.groupBy(F.col("user_id").alias("qid")).agg(F.collect_list(hit).alias("h"))
    return fusion.from_lists(lists.select("qid", F.col("h.id").alias("ids"), F.col("h.value").alias("scores")))


def list_offsets(spark, sf_dir):
    """Where each user's list would lie in one list of all."""
    return fusion.offsets(normalized_lists(spark, sf_dir))


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse hits for every benchmark item that has a vector of its id.

    The tables have no vectors of texts, so that ids stand for what would join them; items without such a vector are left out.
    """
    v = D.vectors(spark, sf_dir)
    q = queries_of(spark, sf_dir).join(v.select(F.col("row_id").alias("qid"), "embedding"), "qid")
    return dense.search(dense.build(v), q, 50), sparse.search(sparse.build(docs_of(spark, sf_dir)), q, 50)


def rrf(spark, sf_dir):
    """Reciprocal rank fusion of vectors and text: 50 hits of each, 20 of both."""
    a, b = _both(spark, sf_dir)
    return fusion.rrf(a, b, fusion.Rrf(dense_window=40, sparse_window=50, top_k=20)).withColumns({c: F.round(c, 6) for c in ("fused_score", "dense_score", "sparse_score")})


def qrels_of(spark, sf_dir) -> DataFrame:
    """Every labelled document is relevant to every query by its quality, and more so if it isn't toxic."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") * (2 - F.col("toxic"))).alias("relevance"))
    return queries_of(spark, sf_dir).select("qid").crossJoin(labels.select(F.col("doc_id").alias("row_id"), "relevance"))


def measures(spark, sf_dir):
    """Recall, nDCG and reciprocal rank of text search, a row a query."""
    run = sparse.search(sparse.build(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), K)
    return metrics.per_query(run, qrels_of(spark, sf_dir), K).select("qid", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")))


def mean_measures(spark, sf_dir):
    """Their means."""
    run = sparse.search(sparse.build(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), K)
    return metrics.evaluate(run, qrels_of(spark, sf_dir), K).select("queries", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")))


def percentiles(spark, sf_dir):
    """Interpolated percentiles of event values."""
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99]).select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


def nearest(spark, sf_dir):
    """The same by nearest rank."""
    return metrics.nearest_percentiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99])


def ltr_export(spark, sf_dir):
    """Training rows for a ranking model: 10 documents a query with label and features."""
    labels = qrels_of(spark, sf_dir).select("qid", "row_id", F.col("relevance").alias("label"))
    rows = ltr.export(sparse.build(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), labels, K)
    f = lambda i: F.get("features", F.lit(i)).cast("double")
    return rows.select("qid", "row_id", F.col("label").cast("double").alias("label"), F.round(f(0), 3).alias("bm25_score"), f(1).cast("int").alias("bm25_rank"), f(2).cast("int").alias("query_len_chars"))


MODEL = {
    "schema_version": ltr.MODEL_SCHEMA, "model_id": "stumps", "model_family": "tree_ensemble", "training_objective": "rank:pairwise", "booster": "gbtree", "base_score": 0.25, "learning_rate": 0.5,
    "feature_schema": {"schema_version": ltr.FEATURE_SCHEMA, "feature_names": ["rrf_score", "bm25_rank", "doc_len_chars", "query_len_chars"]},
    "trees": [
        {"nodes": [{"split_feature": 1, "threshold": 5.5, "left": 1, "right": 2}, {"split_feature": 2, "threshold": 1000.0, "left": 3, "right": 4}, {"leaf_value": -0.5}, {"leaf_value": 1.0}, {"leaf_value": 0.75}]},
        {"nodes": [{"split_feature": 3, "threshold": 100.0, "left": 1, "right": 2}, {"leaf_value": 0.125}, {"leaf_value": -0.125}]},
    ],
}


def _features(spark, sf_dir) -> DataFrame:
    d, q = docs_of(spark, sf_dir), queries_of(spark, sf_dir)
    hits = sparse.search(sparse.build(d), q, 20)
    fused = fusion.rrf(hits, hits)
    return ltr.features(fused, MODEL["feature_schema"]["feature_names"], bm25=hits, doc_len=ltr.doc_lengths(d), query_len=ltr.query_lengths(q))


def ltr_features(spark, sf_dir):
    """Features of 20 documents a query."""
    f = lambda i: F.get("features", F.lit(i)).cast("double")
    return _features(spark, sf_dir).select("qid", "row_id", F.round(f(0), 6).alias("rrf_score"), *(f(i + 1).cast("int").alias(n) for i, n in enumerate(("bm25_rank", "doc_len_chars", "query_len_chars"))))


def ltr_rerank(spark, sf_dir):
    """The best 5 of them by a tree ensemble."""
    model = ltr.parse(MODEL)
    return shown(ltr.rerank(_features(spark, sf_dir), model, 5, model.names))


def ltr_cached(spark, sf_dir):
    """Training rows that were written with a manifest and read again: rows and labels of each query."""
    labels = qrels_of(spark, sf_dir).select("qid", "row_id", F.col("relevance").alias("label"))
    q = queries_of(spark, sf_dir)
    path = f"{shared_dir(spark)}/ltr-{uuid.uuid4().hex}"
    ltr_cache.write(ltr.export(sparse.build(docs_of(spark, sf_dir)), q, labels, K), q, ltr.EXPORTED, path)
    rows, own, _ = ltr_cache.read(spark, path)
    sums = rows.groupBy("qid").agg(F.sum("label").alias("label_sum"))
    return ltr_cache.groups(rows, own).join(sums, "qid", "left").select("qid", "n", F.coalesce("label_sum", F.lit(0.0)).alias("label_sum"))


def chunks(spark, sf_dir):
    """Every document as Markdown chunks."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return markdown_chunks(d)


def hashed_search(spark, sf_dir):
    """Top 10 documents for every query by hashed embeddings, which tell equal texts alone."""
    d = docs_of(spark, sf_dir).filter("text is not null").select("row_id", hash_embedding("text", 64).alias("embedding"))
    q = queries_of(spark, sf_dir).select("qid", hash_embedding("query", 64).alias("embedding"))
    return shown(dense.search(dense.build(d, dim=64), q, K))


def best_of_each(spark, sf_dir):
    """The best hit of every query with its document's length: hydration after the cut."""
    hits = sparse.search(sparse.build(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), 1)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source", "n_chars")
    return hits.join(d, "row_id").select("qid", "row_id", "source", "n_chars")


QUERIES = {
    "text_terms": _terms(tokenize.SIMPLE), "text_identifiers": _terms(tokenize.IDENTIFIERS), "text_postings": postings, "text_term_stats": term_stats, "text_describe": describe, "text_find_terms": term_lookup,
    "text_bm25": bm25, "text_bm25_identifiers": bm25_identifiers, "text_bm25_allowlist": bm25_allowed, "text_bm25_per_query": bm25_per_query, "text_checks": sparse_checks, "text_bundle": sparse_bundle, "text_hydrate": best_of_each,
    "fusion_normalize": normalized_lists, "fusion_flat_lists": flat_lists, "fusion_offsets": list_offsets, "fusion_rrf": rrf,
    "metrics_per_query": measures, "metrics_mean": mean_measures, "metrics_percentiles": percentiles, "metrics_nearest_percentiles": nearest,
    "ltr_export": ltr_export, "ltr_features": ltr_features, "ltr_rerank": ltr_rerank, "ltr_cache": ltr_cached, "chunk_markdown": chunks, "hash_embedding_search": hashed_search,
}


def terms_sql(text: str) -> str:
    """A list of a text's terms, by the simple tokenizer."""
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda t: regexp_replace(lower(t), '^(.{{4,}}?)s+$', '\\1')), lambda t: length(t) >= 3)"


def identifiers_sql(text: str) -> str:
    pieces = r"string_split(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"
    runs = f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda t: CASE WHEN len({pieces}) > 1 THEN list_concat([t], {pieces}) ELSE [t] END))"
    return f"list_filter(list_transform({runs}, lambda t: regexp_replace(lower(t), '^(.{{4,}}?)s+$', '\\1')), lambda t: length(t) >= 3)"


def index_sql(terms=terms_sql, docs: str = "documents") -> str:
    """CTEs dt (row_id, terms), post (row_id, term, tf), df (term, df), co (n, avgdl)."""
    return f"""dt AS (SELECT doc_id AS row_id, {terms("text")} AS terms FROM {docs}),
    post AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM dt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    co AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt)"""


def bm25_sql(terms=terms_sql, where: str = "true", join: str = "", docs: str = "documents") -> str:
    """CTE h (qid, row_id, score) over index_sql()."""
    return f"""{index_sql(terms, docs)},
    qt AS (SELECT item_id AS qid, unnest(list_distinct({terms("text")})) AS term FROM benchmark),
    h AS (SELECT qid, post.row_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(dt.terms) / greatest(avgdl, 1)))), 9) AS score
        FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dt ON dt.row_id = post.row_id CROSS JOIN co {join} WHERE {where} GROUP BY qid, post.row_id)"""


BM25 = f"WITH {bm25_sql()} "
TOP = D.top(K)
RANKED = "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM h"
LISTS = "SELECT user_id AS qid, {id} AS row_id, max(value) AS score FROM events WHERE value IS NOT NULL AND {where} GROUP BY ALL"
NORMALIZED = "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS INTEGER) AS rank, row_id, score FROM ({})"
BY_HOUR = LISTS.format(id="CAST(hour(ts) AS BIGINT)", where="true")
QRELS = "(SELECT item_id AS qid, doc_id AS row_id, relevance FROM benchmark CROSS JOIN (SELECT doc_id, max(quality * (2 - toxic)) AS relevance FROM labels GROUP BY doc_id))"
MEASURES = f"""r AS (SELECT * FROM ({RANKED}) WHERE rank <= 10),
    g AS (SELECT * FROM {QRELS} WHERE relevance > 0),
    i AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, row_id) AS p, relevance FROM g),
    b AS (SELECT qid, count(*) AS n, sum(CASE WHEN p <= 10 THEN (2 ** relevance - 1) / log2(p + 1) END) AS idcg FROM i GROUP BY qid),
    m AS (SELECT qid, count(*) AS hits, sum((2 ** relevance - 1) / log2(rank + 1)) AS dcg, min(rank) AS first FROM r JOIN g USING (qid, row_id) GROUP BY qid),
    z AS (SELECT qid, coalesce(hits / n, 0) AS recall, coalesce(dcg / idcg, 0) AS ndcg, coalesce(1 / first, 0) AS mrr FROM b LEFT JOIN m USING (qid))"""
FUSED = f"""s50 AS (SELECT * FROM ({RANKED}) WHERE rank <= 50)"""
FEATURES = f"""f AS (SELECT r.qid, r.row_id, round(2 / (60.0::DOUBLE + r.rank), 18) AS rrf, r.rank AS bm25_rank, length(coalesce(d.text, '')) AS doc_len, length(b.text) AS query_len
    FROM ({RANKED}) r JOIN documents d ON d.doc_id = r.row_id JOIN benchmark b ON b.item_id = r.qid WHERE r.rank <= 20)"""

SQL = {
    "text_terms": f"SELECT doc_id AS row_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)",
    "text_identifiers": f"SELECT doc_id AS row_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {identifiers_sql('text')} AS t FROM documents)",
    "text_postings": f"WITH {index_sql()} SELECT term, row_id, CAST(tf AS INTEGER) AS tf FROM post",
    "text_term_stats": f"WITH {index_sql()} SELECT term, df FROM df",
    "text_describe": f"WITH {index_sql()} SELECT n AS doc_count, round(avgdl, 6) AS avg_doc_len, (SELECT count(*) FROM df) AS term_count, (SELECT count(*) FROM post) AS posting_count, 'simple' AS tokenizer, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b FROM co",
    "text_find_terms": f"WITH {index_sql()} SELECT term, df FROM df WHERE term IN (SELECT unnest({terms_sql('text')}) FROM benchmark)",
    "text_bm25": BM25 + TOP,
    "text_bm25_identifiers": f"WITH {bm25_sql(identifiers_sql)} {TOP}",
    "text_bm25_allowlist": f"WITH {bm25_sql(where='post.row_id IN (SELECT doc_id FROM documents WHERE lang = $$en$$)')} {TOP}",
    "text_bm25_per_query": f"WITH {bm25_sql(where='(post.row_id, qid % 2) IN (SELECT (doc_id, quality) FROM labels)')} {TOP}",
    "text_checks": "SELECT unnest(['row_ids are unique', 'postings are unique', 'lengths are sums of frequencies', 'document frequencies are counts', 'frequencies are positive', 'corpus counts its documents']) AS \"check\", 0 AS failures",
    "text_bundle": f"WITH {bm25_sql(docs='(SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))')} {TOP}",
    "text_hydrate": BM25 + f"SELECT qid, row_id, source, n_chars FROM ({RANKED}) JOIN documents ON doc_id = row_id WHERE rank = 1",
    "fusion_normalize": NORMALIZED.format(BY_HOUR),
    "fusion_flat_lists": NORMALIZED.format(LISTS.format(id="CAST(hour(ts) AS BIGINT)", where="event_type IS DISTINCT FROM 'error'")),
    "fusion_offsets": f"""SELECT qid, CAST("end" - n AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM (SELECT qid, n, sum(n) OVER (ORDER BY qid) AS "end" FROM (SELECT qid, count(*) AS n FROM ({BY_HOUR}) GROUP BY qid))""",
    "fusion_rrf": f"""WITH {D.codes_sql(2)}, sh AS (WITH {bm25_sql()} SELECT * FROM ({RANKED}) WHERE rank <= 50 AND qid IN (SELECT vec_id FROM embeddings)),
        h AS (SELECT q.row_id AS qid, d.row_id, round(list_dot_product(CAST(q.v AS DOUBLE[]), d.e), 9) AS score FROM v q CROSS JOIN e d WHERE q.row_id IN (SELECT item_id FROM benchmark)),
        dh AS (SELECT * FROM ({RANKED}) WHERE rank <= 40),
        x AS (SELECT qid, row_id, round(coalesce(1 / (60.0::DOUBLE + dh.rank), 0) + coalesce(1 / (60.0::DOUBLE + sh.rank), 0), 18) AS fused, dh.rank AS dense_rank, sh.rank AS sparse_rank, dh.score AS dense_score, sh.score AS sparse_score FROM dh FULL JOIN sh USING (qid, row_id)),
        y AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY fused DESC, row_id) AS INTEGER) AS rank FROM x)
        SELECT qid, rank, row_id, round(fused, 6) AS fused_score, dense_rank, sparse_rank, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score FROM y WHERE rank <= 20""",
    "metrics_per_query": BM25[:-1] + f", {MEASURES} SELECT qid, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM z",
    "metrics_mean": BM25[:-1] + f", {MEASURES} SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM z",
    "metrics_percentiles": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events",
    "metrics_nearest_percentiles": "WITH s AS (SELECT list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL) SELECT v[1 + CAST(floor((len(v) - 1) * 0.5::DOUBLE + 0.5::DOUBLE) AS BIGINT)] AS p50, v[1 + CAST(floor((len(v) - 1) * 0.95::DOUBLE + 0.5::DOUBLE) AS BIGINT)] AS p95, v[1 + CAST(floor((len(v) - 1) * 0.99::DOUBLE + 0.5::DOUBLE) AS BIGINT)] AS p99 FROM s",
    "ltr_export": BM25 + f"SELECT r.qid, r.row_id, coalesce(CAST(relevance AS DOUBLE), 0) AS label, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 3) AS bm25_score, rank AS bm25_rank, CAST(length(b.text) AS INTEGER) AS query_len_chars FROM ({RANKED}) r JOIN benchmark b ON b.item_id = r.qid LEFT JOIN {QRELS} g ON g.qid = r.qid AND g.row_id = r.row_id WHERE rank <= 10",
    "ltr_features": BM25[:-1] + f", {FEATURES} SELECT qid, row_id, round(CAST(CAST(rrf AS FLOAT) AS DOUBLE), 6) AS rrf_score, bm25_rank, CAST(doc_len AS INTEGER) AS doc_len_chars, CAST(query_len AS INTEGER) AS query_len_chars FROM f",
    "ltr_rerank": BM25[:-1] + f""", {FEATURES}, s AS (SELECT qid, row_id, 0.25 + 0.5 * CASE WHEN bm25_rank < 5.5 THEN CASE WHEN doc_len < 1000 THEN 1.0 ELSE 0.75 END ELSE -0.5 END + 0.5 * CASE WHEN query_len < 100 THEN 0.125 ELSE -0.125 END AS score FROM f),
        t AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS INTEGER) AS rank, row_id, CAST(score AS DOUBLE) AS score FROM s) SELECT qid, rank, row_id, round(score, 6) AS score FROM t WHERE rank <= 5""",
    "ltr_cache": BM25 + f"SELECT b.item_id AS qid, count(r.row_id) AS n, coalesce(CAST(sum(relevance) AS DOUBLE), 0) AS label_sum FROM benchmark b LEFT JOIN (SELECT * FROM ({RANKED}) WHERE rank <= 10) r ON r.qid = b.item_id LEFT JOIN {QRELS} g ON g.qid = r.qid AND g.row_id = r.row_id GROUP BY b.item_id",
}
