"""Filters, records and write policies as queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.operators import filters
from ranklake.plans.dense import codes_sql, table
from ranklake.shared import shared_dir
from ranklake.stores import generations, records
from ranklake.stores.records import Records


def docs_of(spark, sf_dir) -> DataFrame:
    """Documents with metadata as JSON."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.to_json(F.struct("lang", "source", "n_chars")).alias("metadata"))


def events_of(spark, sf_dir) -> DataFrame:
    """Events with their properties as metadata."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("document"), F.col("props").alias("metadata"))


def _filtered(rows, condition, doc: str):
    def f(spark, sf_dir):
        return rows(spark, sf_dir).filter(condition()).select("id")

    f.__doc__ = doc
    return f


def c(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


def k(key, operator, value):
    return {"key": key, "operator": operator, "value": value}


def called(spark, sf_dir):
    """Events that a Python function of document and metadata lets pass."""
    return filters.callable_filter(events_of(spark, sf_dir), lambda d, m: d == "click" and (m.get("k") or 0) % 10 == 3).select("id")


def unknown(spark, sf_dir):
    """Metadata keys that no event has."""
    return filters.unknown_keys(events_of(spark, sf_dir), ["k", "nope", "other"])


def nested_paths(spark, sf_dir):
    """Events whose properties, a level down, are within a range; and those where a list holds a value."""
    rows = events_of(spark, sf_dir).select("id", F.to_json(F.struct(F.struct(F.get_json_object("metadata", "$.k").cast("int").alias("k")).alias("a"), F.array("document", F.lit("x")).alias("tags"))).alias("metadata"))
    return rows.filter(filters.list_filter({"filters": [k("a.k", ">=", 20), k("a.k", "<", 60), k("tags", "any", ["click", "view"]), k("tags", "all", ["x"])]})).select("id")


def turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as documents of a content, with derived ids."""
    t = table(spark, sf_dir, "conversations")
    return t.select(records.derived_id(F.lit(None).cast("string"), F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn")).alias("id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("content_id"), "role", "text", "conv_id", "turn")


def derived(spark, sf_dir):
    """Derived ids of all turns."""
    return turns(spark, sf_dir).select("id", "conv_id", "turn")


def upserted(spark, sf_dir):
    """Turns after the users' turns of the odd conversations are written anew, in place of all that those had."""
    t = turns(spark, sf_dir).select("id", "content_id", "role", "text")
    batch = t.filter("role = 'user' and cast(substr(content_id, 2) as bigint) % 2 = 1").withColumn("text", F.concat("text", F.lit(" (again)")))
    touched = batch.select("content_id").distinct().withColumn("touched", F.lit(True))
    rows = t.join(touched, "content_id", "left").select(*t.columns, "touched")
    return records.content_upsert(rows, batch.withColumn("touched", F.lit(True)), F.coalesce("touched", F.lit(False))).select("id", "role", F.md5("text").alias("digest"))


def _incoming(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.hour("ts").cast("string")).alias("id"), F.col("event_id").alias("pos"), "value")


def _existing(spark, sf_dir) -> DataFrame:
    return _incoming(spark, sf_dir).filter("id like '%-click-%'").select("id").distinct()


def skipped(spark, sf_dir):
    """Events as writings under the policy to skip what is there: clicks are."""
    return records.under_policy(_incoming(spark, sf_dir), _existing(spark, sf_dir), "SKIP")[0]


def overwritten(spark, sf_dir):
    """The same under the policy to overwrite: the last of each id, in the place of its first."""
    return records.under_policy(_incoming(spark, sf_dir), _existing(spark, sf_dir), "OVERWRITE")[0]


def duplicates(spark, sf_dir):
    """The ids for which a policy to fail would refuse the batch."""
    return records.duplicates(_incoming(spark, sf_dir), _existing(spark, sf_dir))


def stamped(spark, sf_dir):
    """Events' properties with the user as the document they refer to."""
    e = table(spark, sf_dir, "events")
    m = records.stamp("props", F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")))
    return e.select("event_id", *(F.get_json_object(m, f"$.{x}").alias(x) for x in ("k", "ref_doc_id", "document_id")))


def latest_states(spark, sf_dir):
    """The last event of every user, as clean-up takes the last state of every path."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("user_id").alias("path"), F.col("event_type").alias("state"))
    return generations.latest_states(e)


def _store(spark, sf_dir) -> Records:
    v = table(spark, sf_dir, "embeddings")
    store = Records(spark)
    store.add(v.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("document"), F.to_json(F.struct("label")).alias("metadata"), F.col("vec_id").alias("pos")))
    return store


def saved(spark, sf_dir):
    """All vectors as records, published and loaded again."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    generations.save(_store(spark, sf_dir), path)
    return generations.load(spark, path).records()


def searched(spark, sf_dir):
    """The best 4 records of label 2 for every vector, with their documents."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return _store(spark, sf_dir).search(v, 4, {"label": 2}).select("qid", "rank", "id", "document", F.round("score", 6).alias("score"))


def changed(spark, sf_dir):
    """Records after those of label 1 are deleted, those of label 2 written anew, and those of label 3 described anew."""
    store = _store(spark, sf_dir)
    label = filters.Meta().number("label")
    v = table(spark, sf_dir, "embeddings").filter("label = 2")
    store.delete_where(label == 1)
    store.add(v.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding", F.lit("again").alias("document"), F.lit('{"label": 20}').alias("metadata"), F.col("vec_id").alias("pos")), upsert=True)
    store.patch_metadata(store.rows.filter(label == 3).select("id", F.lit('{"label": 30}').alias("metadata")))
    return store.records()


def store_checks(spark, sf_dir):
    """What must hold of a table of records, and how often it doesn't."""
    return _store(spark, sf_dir).checks()


def collected(spark, sf_dir):
    """What clean-up of a store with three generations says: how many lie in each state before, and after."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = _store(spark, sf_dir)
    generations.save(store, path)
    for label in (1, 2):
        store.warn_unsaved = False
        store.delete_where(filters.Meta().number("label") == label)
        generations.save(store, path)
    report = generations.gc(spark, path, retain=1)
    return spark.createDataFrame([(s, len(report[s])) for s in ("active", "retained", "reclaimable", "deleted", "pinned")], "state string, n int")


NESTED = {"operator": "AND", "conditions": [c("meta.lang", "in", ["en", "de"]), {"operator": "OR", "conditions": [c("meta.n_chars", ">=", 2000), {"operator": "NOT", "conditions": [c("meta.source", "==", "src1")]}]}, c("id", "!=", "3")]}

QUERIES = {
    "filter_portable": _filtered(docs_of, lambda: filters.portable({"lang": "en", "source": "src2"}), "Documents of one language and source."),
    "filter_list": _filtered(events_of, lambda: filters.list_filter({"condition": "or", "filters": [k("k", "<", 10), {"condition": "not", "filters": [k("k", "<=", 90)]}, k("k", "in", [42, 43])]}), "Events by nested conditions on a number."),
    "filter_missing_keys": _filtered(events_of, lambda: filters.list_filter({"filters": [k("nope", "!=", 1), k("nope", "nin", [1, 2]), k("k", "!=", 7)]}), "Events where conditions on a missing key hold."),
    "filter_nested": _filtered(docs_of, lambda: filters.nested_filter(NESTED), "Documents by nested conditions on fields."),
    "filter_paths": nested_paths, "filter_callable": called, "filter_unknown_keys": unknown,
    "write_derived_ids": derived, "write_content_upsert": upserted, "write_skip": skipped, "write_overwrite": overwritten, "write_duplicates": duplicates, "write_stamp": stamped,
    "store_save_load": saved, "store_search": searched, "store_changes": changed, "store_checks": store_checks, "store_gc": collected, "store_latest_states": latest_states,
}

KEY = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
INCOMING = "i AS (SELECT user_id || '-' || event_type || '-' || hour(ts) AS id, event_id AS pos, value FROM events), x AS (SELECT DISTINCT id FROM i WHERE id LIKE '%-click-%')"

SQL = {
    "filter_portable": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'en' AND source = 'src2'",
    "filter_list": f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE coalesce({KEY} < 10, false) OR NOT coalesce({KEY} <= 90, false) OR coalesce({KEY} IN (42, 43), false)",
    "filter_missing_keys": f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {KEY} IS DISTINCT FROM 7",
    "filter_nested": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang IN ('en', 'de') AND (coalesce(n_chars >= 2000, false) OR source IS DISTINCT FROM 'src1') AND doc_id <> 3",
    "filter_paths": f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {KEY} >= 20 AND {KEY} < 60 AND event_type IN ('click', 'view')",
    "filter_callable": f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'click' AND coalesce({KEY}, 0) % 10 = 3",
    "filter_unknown_keys": "SELECT unnest(['nope', 'other']) AS key",
    "write_derived_ids": "SELECT 'c' || conv_id || ':' || turn AS id, conv_id, turn FROM conversations",
    "write_content_upsert": """WITH t AS (SELECT 'c' || conv_id || ':' || turn AS id, conv_id, role, text FROM conversations),
        b AS (SELECT id, conv_id, role, text || ' (again)' AS text FROM t WHERE role = 'user' AND conv_id % 2 = 1)
        SELECT id, role, md5(text) AS digest FROM (SELECT * FROM t WHERE conv_id NOT IN (SELECT conv_id FROM b) UNION ALL SELECT * FROM b)""",
    "write_skip": f"WITH {INCOMING}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM i) SELECT id, pos, value FROM r WHERE n = 1 AND id NOT IN (SELECT id FROM x)",
    "write_overwrite": f"WITH {INCOMING} SELECT id, min(pos) AS pos, arg_max(value, pos) AS value FROM i GROUP BY id",
    "write_duplicates": f"WITH {INCOMING} SELECT id FROM i GROUP BY id HAVING count(*) > 1 UNION SELECT id FROM x",
    "write_stamp": "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'None' END AS ref_doc_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'None' END AS document_id FROM events",
    "store_latest_states": "SELECT user_id AS path, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id",
    "store_save_load": "SELECT 'v' || vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS u64_id, 'vector ' || vec_id AS document, CASE WHEN label IS NULL THEN '{}' ELSE '{\"label\":' || label || '}' END AS metadata FROM embeddings",
    "store_search": f"""WITH {codes_sql(2)}, h AS (SELECT q.row_id AS qid, d.row_id, round(list_dot_product(CAST(q.v AS DOUBLE[]), d.e), 9) AS score FROM v q CROSS JOIN e d JOIN v l ON l.row_id = d.row_id WHERE l.label = 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM h) SELECT qid, rank, 'v' || row_id AS id, 'vector ' || row_id AS document, round(score, 6) AS score FROM r WHERE rank <= 4""",
    "store_changes": """WITH a AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS u, count(*) OVER () AS n FROM embeddings), b AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS m FROM a WHERE label = 2)
        SELECT 'v' || a.vec_id AS id, CAST(CASE WHEN a.label = 2 THEN a.n + b.m ELSE a.u END AS BIGINT) AS u64_id, CASE WHEN a.label = 2 THEN 'again' ELSE 'vector ' || a.vec_id END AS document,
            CASE WHEN a.label IS NULL THEN '{}' WHEN a.label = 2 THEN '{"label": 20}' WHEN a.label = 3 THEN '{"label": 30}' ELSE '{"label":' || a.label || '}' END AS metadata
        FROM a LEFT JOIN b ON b.vec_id = a.vec_id WHERE a.label IS DISTINCT FROM 1""",
    "store_checks": "SELECT unnest(['ids are unique', 'u64_ids are unique', 'u64_ids are below the next', 'codes fit the shape', 'signs fit the shape', 'documents are there']) AS \"check\", 0 AS failures",
    "store_gc": "SELECT unnest(['active', 'retained', 'reclaimable', 'deleted', 'pinned']) AS state, unnest([1, 1, 1, 1, 0]) AS n",
}
