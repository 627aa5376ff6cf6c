"""Framework-like stores, readers, operations and checks as queries, with their SQL."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.errors import StorePathWarning
from ranklake.indexes import IdIndex, SlotIndex
from ranklake.operators import dense, filters, fusion, ltr, sparse
from ranklake.plans.dense import codes_sql, queries_of, shown, table, vectors
from ranklake.plans.text import MODEL, docs_of
from ranklake.shared import scratch, written
from ranklake.sources import readers
from ranklake.stores import bundle, frameworks, generations, ltr_cache
from ranklake.stores.files import Files
from ranklake.stores.records import Records

PROBE = [float((7 * i) % 13 - 6) for i in range(64)]


def _path(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark, sf_dir, path: str | None = None) -> Records:
    """Every vector as a record v<id>, with label, document d<label>, content c<label>, name n<id modulo 7> and tags in its metadata."""
    v = table(spark, sf_dir, "embeddings")
    word = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    metadata = F.to_json(F.struct("label", F.array(word("t", F.col("vec_id") % 3), word("u", F.col("vec_id") % 5)).alias("tags"), word("d", F.col("label")).alias(frameworks.REF), word("c", F.col("label")).alias(frameworks.CONTENT_ID), word("n", F.col("vec_id") % 7).alias(frameworks.NAME), word("node ", F.col("vec_id")).alias(frameworks.NODE)))
    store = Records(spark, path=path)
    store.add(v.select(word("v", F.col("vec_id")).alias("id"), "embedding", word("vector ", F.col("vec_id")).alias("document"), metadata.alias("metadata"), F.col("vec_id").alias("pos")))
    store.warn_unsaved = False
    return store


def _refused(action: Callable[[], object]) -> bool:
    """Whether an action raises one of the library's errors; other errors pass through."""
    try:
        action()
    except (ValueError, NotImplementedError):
        return True
    return False


def _cases(spark, cases: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame(list(cases.items()), 'check string, holds boolean')


def _best(hits: DataFrame) -> DataFrame:
    return shown(hits).select("rank", "id", "score")


# stores


def texts(spark, sf_dir):
    """The best 6 texts of label 2, once those of label 1 are deleted by a filter."""
    s = frameworks.TextStore(spark, _records(spark, sf_dir))
    s.delete(where={"label": 1})
    return _best(s.similarity_search_with_score_by_vector(PROBE, 6, {"label": 2}))


def nodes(spark, sf_dir):
    """Nodes left after those of one document, and those that a filter names, are deleted."""
    s = frameworks.NodeStore(spark, _records(spark, sf_dir))
    s.delete("d1")
    s.delete_nodes(where={"filters": [{"key": "label", "operator": "==", "value": 2}]})
    return s.get_nodes(where={"filters": [{"key": "label", "operator": "<=", "value": 5}]})


def node_query(spark, sf_dir):
    """The best 8 nodes that pass a filter and are of certain documents."""
    s = frameworks.NodeStore(spark, _records(spark, sf_dir))
    return _best(s.query(PROBE, 8, {"filters": [{"key": "label", "operator": "in", "value": [2, 3, 4]}]}, doc_ids=["d3", "d4", "d9"]))


def list_operators(spark, sf_dir):
    """Nodes by what their lists of tags hold, by inequality, and by an alternative."""
    s = frameworks.NodeStore(spark, _records(spark, sf_dir))
    where = {"condition": "or", "filters": [{"condition": "and", "filters": [{"key": "tags", "operator": "any", "value": ["t1", "u4"]}, {"key": "tags", "operator": "all", "value": ["u4"]}, {"key": "label", "operator": "!=", "value": 3}]}, {"key": "label", "operator": "==", "value": 7}]}
    return s.get_nodes(where=where).select("id")


def documents(spark, sf_dir):
    """Documents by nested conditions, after some are deleted by id."""
    s = frameworks.DocumentStore(spark, _records(spark, sf_dir))
    s.delete_documents(["v3", "v5", "nothing"])
    where = {"operator": "OR", "conditions": [{"field": "meta.label", "operator": "in", "value": [3, 5]}, {"operator": "NOT", "conditions": [{"field": "meta.label", "operator": "<", "value": 8}]}]}
    return s.filter_documents(where).select("id", "document")


def retrieved(spark, sf_dir):
    """The best 5 documents by a retriever's own filter, and the best 2 by a filter of the call."""
    r = frameworks.Retriever(frameworks.DocumentStore(spark, _records(spark, sf_dir)), {"field": "meta.label", "operator": ">=", "value": 6}, 5)
    other = r.run(PROBE, {"field": "meta.label", "operator": "==", "value": 0}, 2)
    return _best(r.run(PROBE)).withColumn("by", F.lit("own")).unionByName(_best(other).withColumn("by", F.lit("call")))


def contents(spark, sf_dir):
    """Ids left after deletions by content, name and metadata."""
    s = frameworks.ContentStore(spark, _records(spark, sf_dir))
    s.delete_by_content_id("c1")
    s.delete_by_name("n2")
    s.delete_by_metadata({"label": 3})
    return s.store.ids()


def content_written(spark, sf_dir):
    """Documents of content c4 after it was written anew with two, of which one takes the id of a record that is there."""
    s = frameworks.ContentStore(spark, _records(spark, sf_dir))
    first = s.store.rows.filter(filters.Meta().number("label") == 4).agg(F.min_by("id", "u64_id").alias("id")).first().id
    s.upsert("c4", [{"id": first, "content": "one", "embedding": PROBE}, {"content": "two", "embedding": PROBE, "name": "second"}])
    return s.store.filter(filters.Meta().string(frameworks.CONTENT_ID) == "c4").select("id", "document")


def content_checks(spark, sf_dir):
    """What a content store says is there, before and after all is dropped."""
    s = frameworks.ContentStore(spark, _records(spark, sf_dir))
    out = {
        "id is there": s.id_exists("v0"), "other id is there": s.id_exists("w0"), "name is there": s.name_exists("n3"), "other name is there": s.name_exists("n7"),
        "content is there": s.content_hash_exists("c2"), "other content is there": s.content_id_exists("x"), "something is there": s.exists(),
        "an id is taken": _refused(lambda: s.insert("c0", [{"id": "v0", "content": "x", "embedding": PROBE}])),
    }
    s.delete()
    return _cases(spark, out | {"something is left": s.exists()})


def kept(spark, sf_dir):
    """Records of each kind of store, published and loaded again by its own means; all four have the same."""
    out = None
    for name, cls in (("texts", frameworks.TextStore), ("nodes", frameworks.NodeStore), ("documents", frameworks.DocumentStore), ("contents", frameworks.ContentStore)):
        path = _path(spark, name)
        cls(spark, _records(spark, sf_dir)).save(path)
        row = cls.load(spark, path).store.rows.agg(F.count("*").alias("n"), F.min("u64_id").alias("first"), F.max("u64_id").alias("last")).withColumn("kind", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def unsupported(spark, sf_dir):
    """What the stores refuse."""
    s = _records(spark, sf_dir)
    t, n, d = frameworks.TextStore(spark, s), frameworks.NodeStore(spark, s), frameworks.DocumentStore(spark, s)
    return _cases(spark, {
        "marginal relevance is refused": _refused(lambda: t.max_marginal_relevance_search("x")), "a normalized score is refused": _refused(lambda: t.similarity_search_with_relevance_scores("x")),
        "another mode is refused": _refused(lambda: n.query(PROBE, mode="sparse")), "no id and no filter is refused": _refused(lambda: t.delete()), "text without an embedder is refused": _refused(lambda: t.similarity_search("x")),
        "a node without a vector is refused": _refused(lambda: n.add([{"id": "a", "text": "x"}])), "an unknown policy is refused": _refused(lambda: d.write_documents([{"id": "z", "content": "", "embedding": PROBE}], "MERGE")),
        "an id twice is refused": _refused(lambda: frameworks.TextStore(spark, embedder=lambda x: [PROBE for _ in x]).add_texts(["a", "b"], ids=["1", "1"])),
        "an unknown operator is refused": _refused(lambda: n.get_nodes(where={"filters": [{"key": "label", "operator": "like", "value": 1}]})),
    })


# operations


def published(spark, sf_dir):
    """What two writers of one store, a patch of metadata, a pin and a file out of place come to."""
    path = _path(spark, "store")
    out = {"nothing is there": generations.classify(spark, path) == "unknown"}
    generations.save(_records(spark, sf_dir), path)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        generations.check_fresh(spark, path)
    out["a store that is there is warned of"] = any(issubclass(w.category, StorePathWarning) for w in seen)
    a, b = generations.load(spark, path), generations.load(spark, path)
    before = a.revision
    for s in (a, b):
        s.warn_unsaved = False
    a.delete("v0")
    generations.save(a)
    b.delete("v1")
    out |= {"the second writer is refused": _refused(lambda: generations.save(b)), "a stale patch is refused": _refused(lambda: generations.patch_metadata(spark, path, before, a.rows.select("id", F.lit("{}").alias("metadata"))))}
    generations.patch_metadata(spark, path, generations.load(spark, path).revision, a.rows.select("id", F.lit('{"label": 1}').alias("metadata")))
    patched = generations.load(spark, path)
    out["a patch keeps ids and vectors"] = patched.ids().exceptAll(a.ids()).isEmpty() and len(patched) == len(a) and patched.rows.filter("metadata <> '{\"label\": 1}'").isEmpty()
    out["it is a store, and verifies"] = generations.classify(spark, path) == "store" and generations.verify(spark, path).isEmpty()
    out["all commits are listed"] = [r.action for r in generations.audit(spark, path).orderBy("sequence").collect()] == ["save"] * 3
    first = generations.audit(spark, path).orderBy("sequence").first().generation
    generations.pin(spark, path, first)
    report = generations.gc(spark, path, retain=0)
    out |= {"a pinned generation stays": len(report["pinned"]) == 1 and Files(spark, path).is_dir(first), "what is not active goes": len(report["deleted"]) == 1}
    Files(spark, path).write("generations/g-odd/file", b"x")
    out["an unknown folder is debris"] = generations.inspect(spark, path).first().debris == 1
    generations.remove_debris(spark, path, "generations/g-odd")
    out["debris is removed"] = generations.inspect(spark, path).first().debris == 0
    return _cases(spark, out)


def exported(spark, sf_dir):
    """All vectors as records, published, exported as JSON, and imported as another store."""
    path, plain = _path(spark, "store"), _path(spark, "json")
    generations.save(_records(spark, sf_dir), path)
    generations.export_json(spark, path, plain)
    return generations.import_json(spark, plain, _path(spark, "store")).records().select("id", "u64_id", "document")


def bundle_operations(spark, sf_dir):
    """What a bundle says of itself, whole, with a byte too many, away, and recovered from its backup."""
    path = _path(spark, "bundle")
    index = dense.build(vectors(spark, sf_dir))
    bundle.write(index, path)
    n = index.rows.count()
    out = {"it verifies": bundle.verify(spark, path).isEmpty(), "its count is right": bundle.inspect(spark, path).first().vector_count == n, "its parts have sizes": bundle.stats(spark, path).filter("bytes <= 0 and component <> 'manifest.json'").isEmpty()}
    out["nothing is to be recovered"] = not bundle.recover(spark, path)
    files = Files(spark, path.rsplit("/", 1)[0])
    name = path.rsplit("/", 1)[1]
    files.move(name, f".{name}.bak-1")
    out["a backup is recovered"] = bundle.recover(spark, path) and bundle.verify(spark, path).isEmpty()
    out["another kind is refused"] = _refused(lambda: bundle.load(spark, path, bundle.SLOTS))
    out["another width is refused"] = _refused(lambda: bundle.load(spark, path, bits=4))
    Files(spark, path).write("rows/odd", b"x")
    out["a file too many is refused"] = _refused(lambda: bundle.load(spark, path)) and not bundle.verify(spark, path).isEmpty()
    return _cases(spark, out)


# readers


def _lines(rows: DataFrame, name: str) -> str:
    path = _path(rows.sparkSession, name)
    rows.write.text(path)
    return path


def read_queries(spark, sf_dir):
    """Queries of JSON lines, under either name of their fields."""
    b = table(spark, sf_dir, "benchmark")
    line = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")))).otherwise(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), "text")))
    return readers.queries_jsonl(spark, _lines(b.select(line), "queries"))


def read_judgements(spark, sf_dir):
    """Judgements of lines of three fields, of four, and comments."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    line = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.lit("q1"), F.lit("0"), "doc_id", "quality")).otherwise(F.concat_ws("\t", F.lit("q2"), "doc_id", "quality"))
    return readers.qrels(spark, _lines(rows.select(line.alias("line")).unionByName(spark.range(3).select(F.lit("# a comment").alias("line"))), "qrels"))


def read_corpus(spark, sf_dir):
    """A corpus of JSON lines with titles."""
    d = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), "text"))
    return readers.corpus_jsonl(spark, _lines(d.select(line), "corpus")).select("doc_id", F.md5("text").alias("digest"))


def read_benchmark(spark, sf_dir):
    """Judgements of a table with a heading, of documents and queries that are known."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    path = _path(spark, "qrels")
    rows.select(F.concat(F.lit("q"), F.col("doc_id") % 10).alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score")).write.csv(path, sep="\t", header=True)
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"))
    queries = spark.createDataFrame([(f"q{i}",) for i in range(5)], "query_id string")
    return readers.benchmark_qrels(spark, path, docs, queries)


def read_truth(spark, sf_dir):
    """The row that each query is to find, in the order of a file's lines."""
    e = table(spark, sf_dir, "embeddings").coalesce(1).sortWithinPartitions("vec_id")
    return readers.truth_jsonl(spark, _lines(e.select(F.to_json(F.struct((F.col("vec_id") * 2).alias("row_index")))), "truth"))


def read_cache(spark, sf_dir):
    """Embeddings of all documents, made once and read again."""
    d = table(spark, sf_dir, "documents")
    made = []

    def embed(x: DataFrame) -> DataFrame:
        made.append(1)
        return x.select("doc_id", F.array(F.length("text").cast("float")).alias("embedding"))

    folder = _path(spark, "cache")
    for _ in range(2):
        out = readers.cached_embeddings(d, folder, embed, "doc_id")
    return out.select("doc_id", F.element_at("embedding", 1).cast("long").alias("n"), F.lit(len(made)).alias("made"))


# indexes and checks


def index_objects(spark, sf_dir):
    """Hits of an index by slots, among the even ones, and of an index by ids, within each query's own label."""
    v = vectors(spark, sf_dir)
    slots, own = SlotIndex(spark, 64), IdIndex(spark, 64)
    slots.add(v)
    own.add_with_ids(v)
    q = queries_of(v)
    mask = slots.index.rows.select("row_id", (F.col("row_id") % 2 == 0).alias("allowed"))
    own_label = v.select("row_id", F.col("label").alias("group"))
    a, b = shown(slots.search(q, 5, mask)), shown(own.search_in_groups(q.join(own_label.withColumnRenamed("row_id", "qid"), "qid"), 5, own_label))
    return a.withColumn("side", F.lit("slots")).unionByName(b.withColumn("side", F.lit("ids")))


def slot_changes(spark, sf_dir):
    """Slots and their codes after slot 2 is removed, whose place the last takes; the same by id."""
    v = vectors(spark, sf_dir)
    slots, own = SlotIndex(spark, 64), IdIndex(spark, 64)
    slots.add(v)
    own.add_with_ids(v)
    n = len(own)
    moved = slots.swap_remove(2)
    return _cases(spark, {"the last row moves": moved == n - 1, "a row is gone": len(slots) == n - 1, "an id is there": own.contains(2), "it is removed": own.remove(2) and not own.contains(2), "it is removed once": not own.remove(2), "a slot too high is refused": _refused(lambda: slots.search_slots(queries_of(v), 1, [n]).count()), "an id twice is refused": _refused(lambda: own.add_with_ids(v))})


def checks(spark, sf_dir):
    """What ranked lists, fusion, features, models and caches refuse."""
    v = vectors(spark, sf_dir)
    hits = written(dense.search(dense.build(v), queries_of(v), 5))
    few = hits.filter("qid > 0")
    rows = hits.select("qid", "row_id", F.lit(1.0).alias("label"), F.array(F.col("score").cast("float"), F.col("rank").cast("float")).alias("features"))
    q = queries_of(v)
    other = MODEL | {"trees": [{"nodes": [{"split_feature": 9, "threshold": 1.0, "left": 1, "right": 2}, {"leaf_value": 1.0}, {"leaf_value": 2.0}]}]}
    text = sparse.build(docs_of(spark, sf_dir))
    return _cases(spark, {
        "a sorted list passes": not _refused(lambda: fusion.check_sorted(hits)), "ranks in disorder are refused": _refused(lambda: fusion.check_sorted(hits.withColumn("rank", F.col("rank") + 1))),
        "the same queries pass": not _refused(lambda: fusion.check_same_queries(hits, hits)), "other queries are refused": _refused(lambda: fusion.check_same_queries(hits, few)),
        "a constant of 0 is refused": _refused(lambda: fusion.Rrf(rank_constant=0.0).check()), "the same rows pass": not _refused(lambda: sparse.check_same_rows(text, text.docs)),
        "other rows are refused": _refused(lambda: sparse.check_same_rows(text, text.docs.filter("row_id <> (select min(doc_id) from {d})".replace("{d}", f"parquet.`{sf_dir}/documents.parquet`")))),
        "features pass": not _refused(lambda: ltr_cache.check(rows, ["a", "b"], q)), "features too few are refused": _refused(lambda: ltr_cache.check(rows, ["a", "b", "c"], q)),
        "a label of no number is refused": _refused(lambda: ltr_cache.check(rows.withColumn("label", F.lit(float("nan"))), ["a", "b"], q)), "an unknown query is refused": _refused(lambda: ltr_cache.check(rows, ["a", "b"], q.filter("qid > 0"))),
        "a pair twice is refused": _refused(lambda: ltr_cache.check(rows.unionByName(rows), ["a", "b"], q)), "a model passes": not _refused(lambda: ltr.parse(MODEL)),
        "a split of no feature is refused": _refused(lambda: ltr.parse(other)), "too many trees are refused": _refused(lambda: ltr.parse(MODEL, ltr.Limits(trees=1))),
        "too many bytes are refused": _refused(lambda: ltr.parse(json.dumps(MODEL), ltr.Limits(model_bytes=10))), "a limit of 0 is refused": _refused(lambda: ltr.Limits(nodes=0).check()), "a blank feature is refused": _refused(lambda: ltr.check_names(["a", " "])),
    })


QUERIES = {
    "store_texts": texts, "store_nodes": nodes, "store_node_query": node_query, "store_list_operators": list_operators, "store_documents": documents, "store_retriever": retrieved, "store_contents": contents,
    "store_content_written": content_written, "store_content_checks": content_checks, "store_kept": kept, "store_unsupported": unsupported, "store_published": published, "store_exported": exported,
    "bundle_operations": bundle_operations, "read_queries": read_queries, "read_judgements": read_judgements, "read_corpus": read_corpus, "read_benchmark": read_benchmark, "read_truth": read_truth,
    "read_cache": read_cache, "index_objects": index_objects, "index_changes": slot_changes, "checks_refuse": checks,
}


def _top(where: str, k: int, more: str = "") -> str:
    probe = "[" + ", ".join(map(str, PROBE)) + "]"
    return f"""SELECT CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score{more} FROM (SELECT 'v' || d.row_id AS id, row_number() OVER (ORDER BY round(list_dot_product(CAST({probe} AS DOUBLE[]), d.e), 9) DESC, d.row_id) AS rank,
        round(list_dot_product(CAST({probe} AS DOUBLE[]), d.e), 9) AS score FROM e d JOIN v l ON l.row_id = d.row_id WHERE {where}) WHERE rank <= {k}"""


def _all_hold(names: dict[str, bool]) -> str:
    return f"""SELECT unnest([{', '.join(f"'{n}'" for n in names)}]) AS "check", unnest([{', '.join(str(x).lower() for x in names.values())}]) AS holds"""


_BY = ", '%s' AS by"
_UNSUPPORTED = ["marginal relevance is refused", "a normalized score is refused", "another mode is refused", "no id and no filter is refused", "text without an embedder is refused", "a node without a vector is refused", "an unknown policy is refused", "an id twice is refused", "an unknown operator is refused"]
_PUBLISHED = ["nothing is there", "a store that is there is warned of", "the second writer is refused", "a stale patch is refused", "a patch keeps ids and vectors", "it is a store, and verifies", "all commits are listed", "a pinned generation stays", "what is not active goes", "an unknown folder is debris", "debris is removed"]
_BUNDLE = ["it verifies", "its count is right", "its parts have sizes", "nothing is to be recovered", "a backup is recovered", "another kind is refused", "another width is refused", "a file too many is refused"]
_CHANGES = ["the last row moves", "a row is gone", "an id is there", "it is removed", "it is removed once", "a slot too high is refused", "an id twice is refused"]
_CHECKS = [
    "a sorted list passes", "ranks in disorder are refused", "the same queries pass", "other queries are refused", "a constant of 0 is refused", "the same rows pass", "other rows are refused", "features pass", "features too few are refused",
    "a label of no number is refused", "an unknown query is refused", "a pair twice is refused", "a model passes", "a split of no feature is refused", "too many trees are refused", "too many bytes are refused", "a limit of 0 is refused", "a blank feature is refused",
]
_CONTENT = {"id is there": True, "other id is there": False, "name is there": True, "other name is there": False, "content is there": True, "other content is there": False, "something is there": True, "an id is taken": True, "something is left": False}

SQL = {
    "store_texts": f"WITH {codes_sql(2)} {_top('l.label = 2', 6)}",
    "store_nodes": "SELECT 'v' || vec_id AS id, 'vector ' || vec_id AS document, 'node ' || vec_id AS node FROM embeddings WHERE label <= 5 AND label NOT IN (1, 2)",
    "store_node_query": f"WITH {codes_sql(2)} {_top('l.label IN (3, 4)', 8)}",
    "store_list_operators": "SELECT 'v' || vec_id AS id FROM embeddings WHERE (vec_id % 5 = 4 AND label IS DISTINCT FROM 3) OR label = 7",
    "store_documents": "SELECT 'v' || vec_id AS id, 'vector ' || vec_id AS document FROM embeddings WHERE vec_id NOT IN (3, 5) AND (coalesce(label IN (3, 5), false) OR NOT coalesce(label < 8, false))",
    "store_retriever": f"WITH {codes_sql(2)} ({_top('l.label >= 6', 5, _BY % 'own')}) UNION ALL ({_top('l.label = 0', 2, _BY % 'call')})",
    "store_contents": "SELECT 'v' || vec_id AS id FROM embeddings WHERE label IS DISTINCT FROM 1 AND vec_id % 7 <> 2 AND label IS DISTINCT FROM 3",
    "store_content_written": "SELECT 'v' || min(vec_id) AS id, 'one' AS document FROM embeddings WHERE label = 4 UNION ALL SELECT 'c4:1', 'two'",
    "store_content_checks": _all_hold(_CONTENT),
    "store_kept": "SELECT unnest(['texts', 'nodes', 'documents', 'contents']) AS kind, n, 0 AS first, n - 1 AS last FROM (SELECT count(*) AS n FROM embeddings)",
    "store_unsupported": _all_hold(dict.fromkeys(_UNSUPPORTED, True)),
    "store_published": _all_hold(dict.fromkeys(_PUBLISHED, True)),
    "store_exported": "SELECT 'v' || vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS u64_id, 'vector ' || vec_id AS document FROM embeddings",
    "bundle_operations": _all_hold(dict.fromkeys(_BUNDLE, True)),
    "read_queries": "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark",
    "read_judgements": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'q1' ELSE 'q2' END AS query_id, doc_id AS row_id, CAST(max(quality) AS FLOAT) AS label FROM labels GROUP BY doc_id",
    "read_corpus": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) ELSE '' END || trim(text, ' ')) AS digest FROM documents",
    "read_benchmark": "SELECT 'q' || doc_id % 10 AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, max(quality) AS relevance FROM labels WHERE doc_id % 10 < 5 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY doc_id HAVING max(quality) > 0",
    "read_truth": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS qid, vec_id * 2 AS row_id FROM embeddings",
    "read_cache": "SELECT doc_id, length(text) AS n, 1 AS made FROM documents",
    "index_objects": f"""WITH {codes_sql(2)}, n AS (SELECT row_id, label, row_number() OVER (ORDER BY row_id) - 1 AS slot FROM v),
        h AS (SELECT q.row_id AS qid, 'slots' AS side, n.slot AS row_id, round(list_dot_product(CAST(q.v AS DOUBLE[]), d.e), 9) AS score FROM v q CROSS JOIN e d JOIN n ON n.row_id = d.row_id WHERE n.slot % 2 = 0
            UNION ALL SELECT q.row_id, 'ids' AS side, d.row_id, round(list_dot_product(CAST(q.v AS DOUBLE[]), d.e), 9) FROM v q CROSS JOIN e d JOIN n ON n.row_id = d.row_id WHERE n.label = q.label)
        SELECT qid, side, row_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY score DESC, row_id) AS rank FROM h) WHERE rank <= 5""",
    "index_changes": _all_hold(dict.fromkeys(_CHANGES, True)),
    "checks_refuse": _all_hold(dict.fromkeys(_CHECKS, True)),
}
