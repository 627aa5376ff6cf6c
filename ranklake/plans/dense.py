"""Dense search and row ids as queries over the embeddings, with their SQL. Every row is a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.config import Mode, SearchOptions
from ranklake.functions import encode as E
from ranklake.operators import dense, ids, metrics
from ranklake.shared import shared_dir, written
from ranklake.stores import bundle
from ranklake.streaming import ingest

K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")


def queries_of(v: DataFrame) -> DataFrame:
    return v.select(F.col("row_id").alias("qid"), "embedding")


def shown(hits: DataFrame) -> DataFrame:
    """Scores as they are compared."""
    return hits.withColumn("score", F.round("score", 6))


def encode(spark, sf_dir):
    """Rank codes of every vector at each width."""
    v = vectors(spark, sf_dir)
    return v.select("row_id", *(F.array_join(E.codes("embedding", b), ",").alias(f"codes{b}") for b in (1, 2, 4)))


def packed(spark, sf_dir):
    """The same codes out of the packed form that an index keeps, 2 bits each; a code's value in the bytes is counted."""
    v = vectors(spark, sf_dir)
    index = dense.build(v)
    return index.rows.select("row_id", F.lower(F.hex("codes")).alias("codes"), F.lower(F.hex("sign")).alias("sign"))


def signs(spark, sf_dir):
    """Sign words of every vector, and how far it is from the first by id."""
    v = vectors(spark, sf_dir)
    words = v.select("row_id", F.get(E.sign_words("embedding", 64), F.lit(0)).alias("word"))
    first = words.agg(F.min_by("word", "row_id").alias("first"))
    return words.crossJoin(F.broadcast(first)).select("row_id", "word", F.bit_count(F.col("word").bitwiseXOR(F.col("first"))).alias("hamming"))


def validate(spark, sf_dir):
    """Vectors by length and validity."""
    v = vectors(spark, sf_dir)
    return v.groupBy(F.size("embedding").alias("dim"), E.is_valid("embedding", 64).alias("valid")).agg(F.count("*").alias("n"))


def _exact(bits: int):
    def f(spark, sf_dir):
        v = vectors(spark, sf_dir)
        return shown(dense.search(dense.build(v, bits), queries_of(v), K))

    f.__doc__ = f"Exact top 10 for every vector, {bits} bits a coordinate."
    return f


def two_stage(spark, sf_dir):
    """Top 10 in two stages: candidates by signs, then exact scores."""
    v = vectors(spark, sf_dir)
    return shown(dense.search(dense.build(v), queries_of(v), K, SearchOptions.sign_two_stage()))


def auto(spark, sf_dir):
    """Top 10 in whatever way the index allows: two stages, as it has sign bits."""
    v = vectors(spark, sf_dir)
    return shown(dense.search(dense.build(v), queries_of(v), K, SearchOptions(Mode.AUTO)))


def allowed(spark, sf_dir):
    """Top 10 among the rows of one label."""
    v = vectors(spark, sf_dir)
    return shown(dense.search_allowed(dense.build(v), queries_of(v), K, v.filter("label = 3").select("row_id")))


def masked(spark, sf_dir):
    """Top 10 under a mask over all rows."""
    v = vectors(spark, sf_dir)
    mask = v.select("row_id", F.coalesce(F.col("label") >= 5, F.lit(False)).alias("allowed"))
    return shown(dense.search_mask(dense.build(v), queries_of(v), K, mask))


def per_query(spark, sf_dir):
    """Top 10 for every vector among those of its own label."""
    v = vectors(spark, sf_dir)
    q, groups = v.select(F.col("row_id").alias("qid"), "embedding", F.col("label").alias("group")), v.select("row_id", F.col("label").alias("group"))
    return shown(dense.search_in_groups(dense.build(v), q, K, groups))


def float_cosine(spark, sf_dir):
    """Top 10 by the float cosine."""
    v = vectors(spark, sf_dir)
    return shown(dense.float_search(v, queries_of(v), K))


def prefix(spark, sf_dir):
    """Exact top 10 over the first 32 coordinates."""
    v = vectors(spark, sf_dir).withColumn("embedding", E.prefix("embedding", 32))
    return shown(dense.search(dense.build(v), queries_of(v), K))


def report(spark, sf_dir):
    """How an automatic search is planned."""
    v = vectors(spark, sf_dir)
    return dense.search_with_report(dense.build(v), queries_of(v), K)[1].as_row(spark)


def describe(spark, sf_dir):
    """Shape and size of the index."""
    return dense.build(vectors(spark, sf_dir)).describe(spark)


def removed(spark, sf_dir):
    """Exact top 10 after the rows of one label are removed."""
    v = vectors(spark, sf_dir)
    index = ids.remove_all(dense.build(v), v.filter("label = 0"))
    return shown(dense.search(index, queries_of(v), K))


def added(spark, sf_dir):
    """Exact top 10 of an index to which each label's rows were added as a batch with ids."""
    v = vectors(spark, sf_dir)
    index = dense.create(spark, 64)
    for half in (v.filter("label < 5"), v.filter("label >= 5 or label is null")):
        index = ids.add_with_ids(index, half)
    return shown(dense.search(index, queries_of(v), K))


def slot_table(spark, sf_dir):
    """The slot of every id."""
    return ids.slots(vectors(spark, sf_dir).select("row_id"), "row_id").select("slot", "row_id")


def swapped(spark, sf_dir):
    """Slots after slot 3 is removed."""
    slotted = ids.slots(vectors(spark, sf_dir).select("row_id"), "row_id")
    return ids.swap_remove(slotted, 3)[0].select("slot", "row_id")


def lookup(spark, sf_dir):
    """Hits by slot as hits by id."""
    v = vectors(spark, sf_dir)
    mapping = ids.slots(v.select("row_id"), "row_id").withColumn("row_id", F.col("row_id") + 1000)
    hits = dense.search(dense.build(v), queries_of(v), K)
    return shown(ids.to_ids(hits.withColumnRenamed("row_id", "slot"), mapping))


def overlap(spark, sf_dir):
    """How much of the exact result two stages keep, and rank codes of the float result."""
    v = vectors(spark, sf_dir)
    q, index = queries_of(v), dense.build(v)
    exact = written(dense.search(index, q, K))  # both are held against it
    parts = {"two_stage": dense.search(index, q, K, SearchOptions.sign_two_stage()), "float": dense.float_search(v, q, K)}
    out = None
    for name, run in parts.items():
        row = metrics.overlap(exact, run, K).select(F.lit(name).alias("against"), "queries", F.round("overlap", 6).alias("overlap"))
        out = row if out is None else out.unionByName(row)
    return out


def self_recall(spark, sf_dir):
    """How many vectors find themselves first, and among the first ten."""
    v = vectors(spark, sf_dir)
    run = written(dense.search(dense.build(v), queries_of(v), K))
    truth = v.select(F.col("row_id").alias("qid"), "row_id")
    at = [metrics.self_recall(run, truth, n).select(F.lit(n).alias("at"), "queries", F.round("recall", 6).alias("recall")) for n in (1, 10)]
    return at[0].unionByName(at[1])


def decoded(spark, sf_dir):
    """Hits by row as hits by name."""
    v = vectors(spark, sf_dir)
    hits = dense.search(dense.build(v), queries_of(v), K)
    return metrics.decode(hits, v.select("row_id", F.concat(F.lit("v"), F.col("row_id").cast("string")).alias("id")))


def bundled(spark, sf_dir):
    """Exact top 10 of an index that was written as a bundle and read again."""
    v = vectors(spark, sf_dir)
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    bundle.write(dense.build(v), path)
    return shown(dense.search(bundle.load(spark, path), queries_of(v), K))


def bundle_checks(spark, sf_dir):
    """What is wrong with a freshly written bundle, by problem: nothing; and its shape."""
    v = vectors(spark, sf_dir)
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    bundle.write(dense.build(v), path)
    return bundle.inspect(spark, path).select("kind", "dim", "bits", "vector_count", "bytes_per_vector", "has_sign", F.lit(bundle.verify(spark, path).count()).alias("problems"))


def streamed(spark, sf_dir):
    """Exact top 10 of an index to which the vectors were appended as a stream."""
    v = vectors(spark, sf_dir)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings*.parquet")
    ingest.append_vectors(source, f"{base}/rows", f"{base}/checkpoint", 64, id_col="vec_id").awaitTermination()
    return shown(dense.search(ingest.read(spark, f"{base}/rows", 64), queries_of(v), K))


def selectivity(spark, sf_dir):
    """Hits of searches that a filter restricts to none, one, one in a hundred, half and all of the rows."""
    v = vectors(spark, sf_dir)
    index, q, n = dense.build(v), queries_of(v), v.count()
    out = None
    for name, most in (("none", 0), ("one", 1), ("hundredth", max(1, n // 100)), ("half", n // 2), ("all", n)):
        hits = dense.search_allowed(index, q, K, v.filter(F.col("row_id") < most), check=False)
        row = hits.agg(F.count("*").alias("hits"), F.coalesce(F.max("row_id"), F.lit(-1)).alias("largest"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 3).alias("total")).select(F.lit(name).alias("case"), "hits", "largest", "total")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    "dense_encode": encode, "dense_packed": packed, "dense_signs": signs, "dense_validate": validate, "dense_exact_topk": _exact(2), "dense_exact_bits1": _exact(1), "dense_exact_bits4": _exact(4),
    "dense_two_stage": two_stage, "dense_auto": auto, "dense_allowlist": allowed, "dense_mask": masked, "dense_per_query_allowlist": per_query, "dense_float_cosine": float_cosine, "dense_prefix": prefix,
    "dense_report": report, "dense_describe": describe, "dense_selectivity": selectivity, "ids_remove": removed, "ids_add": added, "ids_slots": slot_table, "ids_swap_remove": swapped, "ids_lookup": lookup,
    "metrics_overlap": overlap, "metrics_self_recall": self_recall, "metrics_decode": decoded, "bundle_roundtrip": bundled, "bundle_inspect": bundle_checks, "stream_append": streamed,
}


def codes_sql(bits: int, vec: str = "embedding", dim: int = 64) -> str:
    """CTEs v (row_id, v, label), c (row_id, i, code) and e (row_id, e: centred codes)."""
    bins = 1 << bits
    return f"""v AS (SELECT vec_id AS row_id, {vec} AS v, label FROM embeddings),
    u AS (SELECT row_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
    c AS (SELECT row_id, i, CAST(floor((row_number() OVER (PARTITION BY row_id ORDER BY x, i) - 1) * {bins} / {dim}) AS INTEGER) AS code FROM u),
    e AS (SELECT row_id, list(CAST(2 * code - {bins - 1} AS DOUBLE) ORDER BY i) AS e FROM c GROUP BY row_id)"""


SIGNS = """s AS (SELECT vec_id AS row_id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END FOR i IN range(1, 65)])::HUGEINT AS w FROM embeddings)"""


def scored(join: str = "", where: str = "true") -> str:
    """CTE h (qid, row_id, score)."""
    return f"h AS (SELECT q.row_id AS qid, d.row_id AS row_id, round(list_dot_product(CAST(q.v AS DOUBLE[]), d.e), 9) AS score FROM v q CROSS JOIN e d {join} WHERE {where})"


def top(k: int = K, order: str = "score DESC, row_id") -> str:
    return f"""SELECT qid, rank, row_id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}) AS INTEGER) AS rank FROM h) WHERE rank <= {k}"""


def exact_sql(bits: int = 2, where: str = "true", join: str = "", vec: str = "embedding", dim: int = 64, final: str | None = None) -> str:
    return f"WITH {codes_sql(bits, vec, dim)}, {scored(join, where)} {final or top()}"


LABEL = "JOIN v l ON l.row_id = d.row_id"
STAGED = f"""WITH {codes_sql(2)}, {SIGNS},
    m AS (SELECT q.row_id AS qid, d.row_id, row_number() OVER (PARTITION BY q.row_id ORDER BY bit_count(xor(q.w, d.w)), d.row_id) AS r FROM s q CROSS JOIN s d),
    {scored("JOIN m ON m.qid = q.row_id AND m.row_id = d.row_id", "m.r <= 320")} """
COSINE = """WITH n AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS d, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings),
    v AS (SELECT row_id, CASE WHEN len > 0 THEN [x / len FOR x IN d] ELSE d END AS v FROM n),
    h AS (SELECT q.row_id AS qid, d.row_id, round(list_dot_product(q.v, d.v), 9) AS score FROM v q CROSS JOIN v d) """
HEX = "lower(printf('%02x', CAST(b AS INTEGER)))"
RANKED = "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM h)"

SQL = {
    "dense_encode": f"""WITH {codes_sql(1)}, c2 AS (SELECT row_id, i, CAST(floor((row_number() OVER (PARTITION BY row_id ORDER BY x, i) - 1) * 4 / 64) AS INTEGER) AS code FROM u),
        c4 AS (SELECT row_id, i, CAST(floor((row_number() OVER (PARTITION BY row_id ORDER BY x, i) - 1) * 16 / 64) AS INTEGER) AS code FROM u)
        SELECT c.row_id, string_agg(c.code, ',' ORDER BY c.i) AS codes1, string_agg(c2.code, ',' ORDER BY c.i) AS codes2, string_agg(c4.code, ',' ORDER BY c.i) AS codes4
        FROM c JOIN c2 USING (row_id, i) JOIN c4 USING (row_id, i) GROUP BY c.row_id""",
    "dense_packed": f"""WITH {codes_sql(2)},
        b AS (SELECT row_id, (i - 1) // 4 AS k, sum(code << (2 * ((i - 1) % 4))) AS b FROM c GROUP BY ALL),
        p AS (SELECT row_id, string_agg({HEX}, '' ORDER BY k) AS codes FROM b GROUP BY row_id),
        g AS (SELECT row_id, (i - 1) // 8 AS k, sum(CASE WHEN x > 0 THEN 1 << ((i - 1) % 8) ELSE 0 END) AS b FROM u GROUP BY ALL),
        t AS (SELECT row_id, string_agg({HEX}, '' ORDER BY k) AS sign FROM g GROUP BY row_id)
        SELECT row_id, codes, sign FROM p JOIN t USING (row_id)""",
    "dense_signs": f"""WITH {SIGNS}, f AS (SELECT w FROM s ORDER BY row_id LIMIT 1)
        SELECT row_id, CAST(CASE WHEN s.w >= 9223372036854775808 THEN s.w - 18446744073709551616 ELSE s.w END AS BIGINT) AS word, CAST(bit_count(xor(s.w, f.w)) AS INTEGER) AS hamming FROM s, f""",
    "dense_validate": "SELECT CAST(len(embedding) AS INTEGER) AS dim, coalesce(len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR abs(x) >= 1e16]) = 0, false) AS valid, count(*) AS n FROM embeddings GROUP BY ALL",
    "dense_exact_topk": exact_sql(),
    "dense_exact_bits1": exact_sql(1),
    "dense_exact_bits4": exact_sql(4),
    "dense_two_stage": STAGED + top(),
    "dense_auto": STAGED + top(),
    "dense_allowlist": exact_sql(join=LABEL, where="l.label = 3"),
    "dense_mask": exact_sql(join=LABEL, where="l.label >= 5"),
    "dense_per_query_allowlist": exact_sql(join=LABEL, where="l.label = q.label"),
    "dense_float_cosine": COSINE + top(),
    "dense_prefix": exact_sql(vec="embedding[1:32]", dim=32),
    "dense_report": "SELECT 'sign_two_stage' AS execution, 64 AS dim, count(*) AS nq, 10 AS requested_k, CAST(least(10, count(*)) AS INTEGER) AS effective_k, count(*) AS search_space, CAST(least(320, count(*)) AS INTEGER) AS candidate_count FROM embeddings",
    "dense_describe": "SELECT 64 AS dim, 2 AS bits, count(*) AS vector_count, 24 AS bytes_per_vector, true AS has_sign FROM embeddings",
    "dense_selectivity": f"""WITH {codes_sql(2)}, {scored()}, z AS (SELECT count(*) AS n FROM embeddings),
        w AS (SELECT 'none' AS kind, 0 AS most FROM z UNION ALL SELECT 'one', 1 FROM z UNION ALL SELECT 'hundredth', greatest(1, n // 100) FROM z UNION ALL SELECT 'half', n // 2 FROM z UNION ALL SELECT 'all', n FROM z),
        t AS (SELECT kind, row_id, score, row_number() OVER (PARTITION BY kind, qid ORDER BY score DESC, row_id) AS rank FROM w JOIN h ON h.row_id < most)
        SELECT kind AS "case", count(row_id) AS hits, coalesce(max(row_id), -1) AS largest, round(coalesce(sum(score), 0), 3) AS total FROM w LEFT JOIN (SELECT * FROM t WHERE rank <= 10) USING (kind) GROUP BY kind""",
    "ids_remove": exact_sql(join=LABEL, where="l.label IS DISTINCT FROM 0"),
    "ids_add": exact_sql(),
    "ids_slots": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id AS row_id FROM embeddings",
    "ids_swap_remove": "WITH t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id AS row_id, count(*) OVER () AS n FROM embeddings) SELECT CASE WHEN slot = n - 1 THEN 3 ELSE slot END AS slot, row_id FROM t WHERE slot <> 3",
    "ids_lookup": f"SELECT qid, rank, row_id + 1000 AS row_id, score FROM ({exact_sql()})",
    "metrics_overlap": f"""WITH x AS ({exact_sql()}), s AS ({STAGED + top()}), f AS ({COSINE + top()}),
        n AS (SELECT count(*) AS n FROM embeddings)
        SELECT 'two_stage' AS against, n AS queries, round((SELECT count(*) FROM x JOIN s USING (qid, row_id)) / 10 / n, 6) AS overlap FROM n
        UNION ALL SELECT 'float', n, round((SELECT count(*) FROM x JOIN f USING (qid, row_id)) / 10 / n, 6) FROM n""",
    "metrics_self_recall": f"""WITH x AS ({exact_sql()}), a AS (SELECT unnest([1, 10]) AS "at")
        SELECT "at", (SELECT count(*) FROM embeddings) AS queries, round((SELECT count(*) FROM x WHERE qid = row_id AND rank <= "at") / (SELECT count(*) FROM embeddings), 6) AS recall FROM a""",
    "metrics_decode": f"SELECT qid, rank, 'v' || row_id AS id FROM ({exact_sql()})",
    "bundle_roundtrip": exact_sql(),
    "bundle_inspect": "SELECT 'ids' AS kind, 64 AS dim, 2 AS bits, count(*) AS vector_count, 16 AS bytes_per_vector, true AS has_sign, 0 AS problems FROM embeddings",
    "stream_append": exact_sql(),
}
