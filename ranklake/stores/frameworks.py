"""Stores in the manner of four retrieval frameworks, over one table of records.

Documents and nodes are plain dictionaries; results are tables, and scores are those of dense search. None ranks by
marginal relevance, normalizes scores or searches in another mode than by vectors.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.errors import DuplicateIdError, OptionError, StoreError
from ranklake.operators import filters
from ranklake.shared import written
from ranklake.stores import generations, records
from ranklake.stores.records import Records

Embedder = Callable[[list[str]], list[list[float]]]
NODE, CONTENT_ID, NAME, REF = "_node_json", "_content_id", "_name", "ref_doc_id"


class _Kept:
    """A store with a table of records and, maybe, a path."""

    kind = "records"

    def __init__(self, spark: SparkSession, store: Records | None = None, path: str | None = None, dim: int | None = None, bits: int = 2, embedder: Embedder | None = None):
        if store is None and path is not None and generations.classify(spark, path) == "store":
            store = generations.load(spark, path, self.kind)
        elif store is None and path is not None:
            generations.check_fresh(spark, path)
        self.spark, self.embedder = spark, embedder
        self.store = store or Records(spark, dim, bits, path=path, name=self.kind)

    def _embed(self, texts: list[str]) -> list[list[float]]:
        if self.embedder is None:
            raise OptionError("an embedder is needed for text")
        return self.embedder(texts)

    def save(self, path: str | None = None) -> None:
        """Publish the records; see generations.save()."""
        generations.save(self.store, path, self.kind)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options: Any):
        return cls(spark, generations.load(spark, path, cls.kind), **options)

    def get_count(self) -> int:
        return len(self.store)

    __len__ = get_count


def _unsupported(what: str) -> Callable:
    def f(self, *_, **__):
        raise NotImplementedError(f"{what} is not supported")

    return f


class TextStore(_Kept):
    """Texts with metadata, looked up by similarity."""

    kind = "texts"
    save_local = dump = persist = _Kept.save

    @classmethod
    def load_local(cls, spark: SparkSession, path: str, **options: Any) -> TextStore:
        return cls.load(spark, path, **options)

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: Iterable[str], embedder: Embedder, metadatas: Iterable[dict] | None = None, ids: Iterable[str] | None = None, **options: Any) -> TextStore:
        out = cls(spark, embedder=embedder, **options)
        out.add_texts(texts, metadatas, ids)
        return out

    def add_texts(self, texts: Iterable[str], metadatas: Iterable[dict] | None = None, ids: Iterable[str] | None = None) -> list[str]:
        """Add texts; an id that is there is replaced, one that comes twice in the batch is an error. Without ids, random ones."""
        texts = list(texts)
        ids = [i or str(uuid.uuid4()) for i in ids] if ids is not None else [str(uuid.uuid4()) for _ in texts]
        if len(set(ids)) != len(ids):
            raise DuplicateIdError("an id comes twice in the batch")
        return self.store.add_lists(ids, self._embed(texts) if texts else [], texts, metadatas, upsert=True)

    def add_documents(self, documents: Iterable[dict[str, Any]]) -> list[str]:
        """Documents {text, metadata, id}."""
        docs = list(documents)
        return self.add_texts([d["text"] for d in docs], [d.get("metadata") for d in docs], [d.get("id") for d in docs])

    def similarity_search_with_score_by_vector(self, vector: Iterable[float], k: int = 4, where: dict | Column | Callable | None = None) -> DataFrame:
        return self.store.search_by_vector(vector, k, where)

    def similarity_search_by_vector(self, vector: Iterable[float], k: int = 4, where: dict | Column | Callable | None = None) -> DataFrame:
        return self.similarity_search_with_score_by_vector(vector, k, where).drop("score")

    def similarity_search_with_score(self, query: str, k: int = 4, where: dict | Column | Callable | None = None) -> DataFrame:
        return self.similarity_search_with_score_by_vector(self._embed([query])[0], k, where)

    def similarity_search(self, query: str, k: int = 4, where: dict | Column | Callable | None = None) -> DataFrame:
        return self.similarity_search_with_score(query, k, where).drop("score")

    def get_by_ids(self, ids: Iterable[str]) -> DataFrame:
        return self.store.get(ids)

    def delete(self, ids: Iterable[str] | None = None, where: dict | Column | None = None) -> bool:
        """By ids or by a filter, not both; at least one of them."""
        if (ids is None) == (where is None):
            raise OptionError("either ids or a filter is needed")
        if ids is not None:
            return self.store.delete(ids)
        return self.store.delete_where(filters.portable(where) if isinstance(where, dict) else where)

    max_marginal_relevance_search = _unsupported("marginal relevance")
    max_marginal_relevance_search_by_vector = _unsupported("marginal relevance")
    similarity_search_with_relevance_scores = _unsupported("a normalized score")


class NodeStore(_Kept):
    """Nodes {id, text, metadata, ref_doc_id, embedding}, with filters in lists of conditions."""

    kind = "nodes"

    def add(self, nodes: Iterable[dict[str, Any]]) -> list[str]:
        nodes = list(nodes)
        if any(n.get("embedding") is None for n in nodes):
            raise StoreError("a node needs an embedding")
        metadatas = []
        for n in nodes:
            ref = n.get("ref_doc_id") or "None"
            plain = {k: v for k, v in n.items() if k != "embedding"}
            metadatas.append((n.get("metadata") or {}) | dict.fromkeys((REF, "doc_id", "document_id"), ref) | {NODE: json.dumps(plain, ensure_ascii=False)})
        return self.store.add_lists([n["id"] for n in nodes], [n["embedding"] for n in nodes], [n.get("text") or "" for n in nodes], metadatas, upsert=True)

    def query(self, embedding: Iterable[float], top_k: int = 4, where: dict | None = None, node_ids: Iterable[str] | None = None, doc_ids: Iterable[str] | None = None, mode: str = "default") -> DataFrame:
        """The best nodes, restricted by filter, ids and documents together."""
        if mode != "default":
            raise NotImplementedError(f"query mode {mode!r} is not supported")
        return self.store.search_by_vector(embedding, top_k, self._condition(where, node_ids, doc_ids))

    def _condition(self, where: dict | None, node_ids: Iterable[str] | None, doc_ids: Iterable[str] | None = None) -> Column | None:
        if where is None and node_ids is None and doc_ids is None:
            return None
        out = filters.list_filter(where)
        if node_ids is not None:
            out = out & F.col("id").isin(list(node_ids))
        if doc_ids is not None:
            out = out & F.coalesce(filters.Meta().string(REF).isin(list(doc_ids)), F.lit(False))
        return out

    def get_nodes(self, node_ids: Iterable[str] | None = None, where: dict | None = None) -> DataFrame:
        """(id, document, node): nodes that are among the ids and pass the filter; node is the JSON that was added."""
        return self.store.filter(self._condition(where, node_ids)).select("id", "document", filters.Meta().string(NODE).alias("node"))

    def delete(self, ref_doc_id: str) -> bool:
        return self.store.delete_where(filters.Meta().string(REF) == ref_doc_id)

    def delete_nodes(self, node_ids: Iterable[str] | None = None, where: dict | None = None) -> bool:
        if node_ids is None and where is None:
            return False
        return self.store.delete_where(self._condition(where, node_ids))

    def clear(self) -> None:
        self.store.clear()

    def persist(self, path: str | None = None) -> None:
        """save(); a path that names a JSON file stands for its folder."""
        self.save(os.path.dirname(path) if path and path.endswith(".json") else path)

    @classmethod
    def from_persist_path(cls, spark: SparkSession, path: str) -> NodeStore:
        return cls.load(spark, os.path.dirname(path) if path.endswith(".json") else path)

    @classmethod
    def from_persist_dir(cls, spark: SparkSession, path: str) -> NodeStore:
        return cls.load(spark, path)


class DocumentStore(_Kept):
    """Documents {id, content, meta, embedding} under a policy for duplicates, with nested filters."""

    kind = "documents"

    def write_documents(self, documents: Iterable[dict[str, Any]], policy: str | None = None) -> int:
        docs = list(documents)
        if not docs:
            return 0
        if any(d.get("embedding") is None for d in docs):
            raise StoreError("a document needs an embedding")
        incoming = records.batch(self.spark, [str(d["id"]) for d in docs], [d["embedding"] for d in docs], [d.get("content") or "" for d in docs], [d.get("meta") for d in docs])
        chosen, replaces = records.under_policy(incoming, self.store.rows, policy)
        return self.store.add(chosen, upsert=replaces)

    def filter_documents(self, where: dict | None = None) -> DataFrame:
        return self.store.filter(filters.nested_filter(where) if where else None)

    def delete_documents(self, ids: Iterable[str]) -> None:
        self.store.delete(ids)

    def count_documents(self) -> int:
        return len(self.store)

    def search_by_embedding(self, embedding: Iterable[float], top_k: int = 10, where: dict | None = None) -> DataFrame:
        out = self.store.search_by_vector(embedding, top_k, filters.nested_filter(where) if where else None)
        if where and top_k and out.isEmpty():
            self.store.warn_unknown(filters.nested_keys(where))
        return out

    def to_dict(self) -> dict[str, Any]:
        return {"path": self.store.path, "dim": self.store.dim, "bits": self.store.bits}

    @classmethod
    def from_dict(cls, spark: SparkSession, value: dict[str, Any]) -> DocumentStore:
        return cls(spark, path=value.get("path"), dim=value.get("dim"), bits=value.get("bits", 2))


class Retriever:
    """Search of a DocumentStore with settings of its own, which a call may override."""

    def __init__(self, store: DocumentStore, where: dict | None = None, top_k: int = 10):
        self.store, self.where, self.top_k = store, where, top_k

    def run(self, embedding: Iterable[float], where: dict | None = None, top_k: int | None = None) -> DataFrame:
        return self.store.search_by_embedding(embedding, self.top_k if top_k is None else top_k, where if where is not None else self.where)


class ContentStore(_Kept):
    """Documents {id, content, name, meta_data, embedding} written under a content's hash, which a later writing replaces."""

    kind = "contents"

    def __init__(self, *args: Any, auto_save: bool = False, **options: Any):
        super().__init__(*args, **options)
        self.auto_save = auto_save
        self.store.warn_unsaved = not auto_save

    def _done(self) -> None:
        if self.auto_save and self.store.path:
            self.save()

    def create(self) -> None:
        """Publish what is there, if there is a path."""
        if self.store.path:
            self.save()

    def _write(self, content_id: str | None, documents: Iterable[dict[str, Any]], stale: Column | None, upsert: bool, extra: dict[str, Any] | None) -> list[str]:
        docs = list(documents)
        ids = [str(d.get("id") or (f"{c}:{i}" if (c := content_id or d.get("content_id")) is not None else uuid.uuid4())) for i, d in enumerate(docs)]
        texts = [str(d.get("content") or d.get("text") or "") for d in docs]
        vectors = [d["embedding"] if d.get("embedding") is not None else None for d in docs]
        if missing := [i for i, v in enumerate(vectors) if v is None]:
            for i, v in zip(missing, self._embed([texts[i] for i in missing])):
                vectors[i] = v
        metadatas = []
        for d in docs:
            m = dict(d.get("meta_data") or {}) | (extra or {})
            for key, value in ((CONTENT_ID, content_id or d.get("content_id")), (NAME, d.get("name"))):
                if value is not None:
                    m[key] = value
            metadatas.append(m)
        gone = None
        if stale is not None:  # written before the records change
            given = self.spark.createDataFrame([(i,) for i in ids], "id string")
            gone = written(self.store.rows.filter(F.coalesce(stale, F.lit(False))).select("id").join(given, "id", "left_anti"))
        self.store.add_lists(ids, vectors, texts, metadatas, upsert)
        if gone is not None and not gone.isEmpty():
            self.store.delete(gone)
        self._done()
        return ids

    @staticmethod
    def _is(key: str, value: Any) -> Column:
        return filters.list_condition({"key": key, "value": value}, filters.Meta())

    def _all(self, metadata: dict[str, Any]) -> Column:
        out = F.lit(True)
        for k, v in metadata.items():
            out = out & self._is(k, v)
        return out

    def upsert(self, content_hash: str, documents: Iterable[dict[str, Any]], where: dict[str, Any] | None = None) -> list[str]:
        """Write documents; those of the same content, or that where matches, which the batch doesn't rewrite, go."""
        stale = self._is(CONTENT_ID, content_hash)
        return self._write(content_hash, documents, stale | self._all(where) if where else stale, True, where)

    def insert(self, content_hash: str, documents: Iterable[dict[str, Any]], where: dict[str, Any] | None = None) -> list[str]:
        """The same for ids that must be new; only what where matches goes."""
        return self._write(content_hash, documents, self._all(where) if where else None, False, where)

    def _delete_where(self, condition: Column) -> bool:
        changed = self.store.delete_where(condition)
        if changed:
            self._done()
        return changed

    def delete(self, ids: str | Iterable[str] | None = None) -> bool:
        """By ids; all for None."""
        if ids is not None:
            return self.delete_by_id(ids)
        changed = len(self.store) > 0
        self.drop()
        return changed

    def delete_by_id(self, ids: str | Iterable[str]) -> bool:
        changed = self.store.delete(ids)
        self._done()
        return changed

    def delete_by_content_id(self, content_id: str) -> bool:
        return self._delete_where(self._is(CONTENT_ID, content_id))

    delete_by_content_hash = delete_by_content_id

    def delete_by_name(self, name: str) -> bool:
        return self._delete_where(self._is(NAME, name))

    def delete_by_metadata(self, metadata: dict[str, Any]) -> bool:
        return self._delete_where(self._all(metadata))

    def drop(self) -> None:
        self.store.clear()
        self._done()

    def exists(self) -> bool:
        return bool(self.store.path and generations.classify(self.spark, self.store.path) == "store") or len(self.store) > 0

    def id_exists(self, id_: str) -> bool:
        return self.store.contains(str(id_))

    def content_hash_exists(self, content_hash: str) -> bool:
        return not self.store.rows.filter(self._is(CONTENT_ID, content_hash)).isEmpty()

    content_id_exists = content_hash_exists

    def name_exists(self, name: str) -> bool:
        return not self.store.rows.filter(self._is(NAME, name)).isEmpty()

    def search(self, query: str, limit: int = 5, where: dict[str, Any] | None = None) -> DataFrame:
        return self.search_by_vector(self._embed([query])[0], limit, where)

    def search_by_vector(self, vector: Iterable[float], limit: int = 5, where: dict[str, Any] | None = None) -> DataFrame:
        return self.store.search_by_vector(vector, limit, where)

    def get_supported_search_types(self) -> list[str]:
        return ["vector"]
