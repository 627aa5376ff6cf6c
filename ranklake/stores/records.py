"""Records: string ids, documents, JSON metadata and encoded vectors, in one table."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.config import SignPolicy, check_shape, resolve_sign
from ranklake.errors import DuplicateIdError, OptionError, StoreError, UnknownFilterKeyWarning, UnsavedWriteWarning
from ranklake.functions import encode as E
from ranklake.operators import dense, filters, ids
from ranklake.shared import checkpointed

SCHEMA = "pos long, id string, u64_id long, document string, metadata string, codes binary, sign binary"
BATCH = "id string, embedding array<float>, document string, metadata string"
#: Changes after which the table is written, so that its plan doesn't grow without end.
CUT = 8


def metadata_json(value: dict[str, Any] | None) -> str:
    """Metadata as JSON text: an object with string keys, of plain, finite values unless nested ones are kept as they are."""

    def check(v: Any) -> None:
        if isinstance(v, float) and not math.isfinite(v):
            raise StoreError(f"metadata must be finite: {v!r}")
        if isinstance(v, dict):
            for k, x in v.items():
                if not isinstance(k, str):
                    raise StoreError(f"metadata keys must be strings: {k!r}")
                check(x)
        elif isinstance(v, (list, tuple)):
            for x in v:
                check(x)
        elif not (v is None or isinstance(v, (str, int, float, bool))):
            raise StoreError(f"metadata can't hold {type(v).__name__}")

    value = value or {}
    if not isinstance(value, dict):
        raise StoreError("metadata must be an object")
    check(value)
    return json.dumps(value, ensure_ascii=False)


def batch(spark: SparkSession, ids_: Iterable[str], embeddings: Iterable[Iterable[float]], documents: Iterable[str], metadatas: Iterable[dict[str, Any] | None] | None = None) -> DataFrame:
    """A batch of lists as a table (id, embedding, document, metadata, pos)."""
    ids_, documents = list(ids_), list(documents)
    vectors = [[float(x) for x in e] for e in embeddings]
    metadata = [metadata_json(m) for m in (metadatas if metadatas is not None else [None] * len(ids_))]
    if not len(ids_) == len(documents) == len(vectors) == len(metadata):
        raise StoreError("ids, embeddings, documents and metadata must be as many")
    for i in ids_:
        if not isinstance(i, str) or not i:
            raise StoreError(f"an id must be a string that isn't empty: {i!r}")
    if any(not isinstance(d, str) for d in documents):
        raise StoreError("a document must be a string")
    return spark.createDataFrame(list(zip(ids_, vectors, documents, metadata, range(len(ids_)))), BATCH + ", pos long")


class Records:
    """A table of records that changes as a whole: each change makes another plan, and none happens in part."""

    def __init__(self, spark: SparkSession, dim: int | None = None, bits: int = 2, policy: SignPolicy | str = SignPolicy.OPTIONAL, rows: DataFrame | None = None, next_u64: int = 0, next_pos: int = 0, path: str | None = None, name: str = "records"):
        if dim is not None:
            check_shape(dim, bits)
        else:
            dense.lazy(bits, policy)
        self.spark, self.dim, self.bits, self.policy = spark, dim, bits, SignPolicy.of(policy)
        self.rows = rows if rows is not None else spark.createDataFrame([], SCHEMA)
        self.next_u64, self.next_pos = next_u64, next_pos
        self.path, self.name, self.revision = path, name, None
        self.warn_unsaved, self._warned, self._changes = True, False, 0

    def __len__(self) -> int:
        return self.rows.count()

    @property
    def index(self) -> dense.Index:
        return dense.Index(self.rows.select(F.col("u64_id").alias("row_id"), "codes", "sign"), self.dim, self.bits, self.policy)

    # changes

    def _changed(self, rows: DataFrame) -> None:
        self._changes += 1
        self.rows = checkpointed(rows) if self._changes % CUT == 0 else rows
        if self.path and self.warn_unsaved and not self._warned:
            self._warned = True
            warnings.warn(f"changes to {self.path} are kept only once it is saved", UnsavedWriteWarning, stacklevel=3)

    def add(self, rows: DataFrame, upsert: bool = False) -> int:
        """Add a batch (id, embedding, document, metadata; pos for its order, else by id), all of it or nothing; its size.

        Ids must be new and come once; with upsert those that are there are replaced, keep their place and get a fresh
        u64_id. Null documents and metadata are errors, as are vectors of another length or with wrong coordinates.
        """
        order = "pos" if "pos" in rows.columns else "id"
        fresh = rows.select(F.col(order).alias("order"), "id", "embedding", "document", F.coalesce("metadata", F.lit("{}")).alias("metadata"))
        facts = fresh.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.expr("id is null or id = ''")).alias("bad"), F.count_if(F.expr("document is null")).alias("no_text"), F.count_if(F.expr("try_parse_json(metadata) is null or schema_of_variant(try_parse_json(metadata)) not like 'OBJECT%'")).alias("no_json")).first()
        if facts.n == 0:
            return 0
        if facts.bad or facts.no_text or facts.no_json:
            raise StoreError(f"{facts.bad} ids, {facts.no_text} documents and {facts.no_json} metadata are not valid")
        if facts.ids != facts.n:
            twice = fresh.groupBy("id").count().filter("count > 1").orderBy("id").first()
            raise DuplicateIdError(f"id {twice.id!r} is there {twice['count']} times")
        if not upsert and (row := fresh.join(self.rows, "id", "left_semi").orderBy("id").first()):
            raise DuplicateIdError(f"id {row.id!r} is there already")
        dim = self.dim or dense.dim_of(fresh)
        if dim is None:
            raise StoreError("the batch has no vectors")
        check_shape(dim, self.bits)
        sign = resolve_sign(dim, self.bits, self.policy)
        dense.check_vectors(fresh, dim, "id")
        placed = ids.slots(fresh, "order").withColumn("u64_id", F.lit(self.next_u64) + F.col("slot"))
        placed = checkpointed(placed)
        coded = E.encoded(placed, dim, self.bits, sign, "u64_id").withColumnRenamed("row_id", "u64_id")
        new = placed.join(coded, "u64_id").select((F.lit(self.next_pos) + F.col("slot")).alias("pos"), "id", "u64_id", "document", "metadata", "codes", "sign")
        if upsert:
            places = self.rows.select("id", F.col("pos").alias("old_pos"))
            new = new.join(places, "id", "left").withColumn("pos", F.coalesce("old_pos", "pos")).drop("old_pos")
        kept = self.rows.join(new.select("id"), "id", "left_anti") if upsert else self.rows
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        self.dim = dim
        self.next_u64 += facts.n
        self.next_pos += facts.n
        self._changed(kept.select(*cols).unionByName(new.select(*cols)))
        return facts.n

    def add_lists(self, ids_, embeddings, documents, metadatas=None, upsert: bool = False) -> list[str]:
        """add() for lists."""
        ids_ = list(ids_)
        if ids_:
            self.add(batch(self.spark, ids_, embeddings, documents, metadatas), upsert)
        return ids_

    def _id_table(self, ids_: str | Iterable[str] | DataFrame) -> DataFrame:
        """(id, nth) of ids in their order."""
        if isinstance(ids_, DataFrame):
            return ids_.select("id", F.lit(0).alias("nth"))
        given = [ids_] if isinstance(ids_, str) else list(ids_)
        if any(not isinstance(i, str) or not i for i in given):
            raise StoreError("an id must be a string that isn't empty")
        return self.spark.createDataFrame([(x, i) for i, x in enumerate(given)], "id string, nth int")

    def delete(self, ids_: str | Iterable[str] | DataFrame, missing_ok: bool = True) -> bool:
        """Delete records by id; whether there were any. Without missing_ok an unknown id is an error, and nothing goes."""
        gone = self._id_table(ids_)
        if not missing_ok and (row := gone.join(self.rows, "id", "left_anti").orderBy("nth").first()):
            raise StoreError(f"id {row.id!r} is not there")
        if self.rows.join(gone, "id", "left_semi").isEmpty():
            return False
        self._changed(self.rows.join(gone, "id", "left_anti").select(*self.rows.columns))
        return True

    def delete_where(self, condition: Column) -> bool:
        """Delete the records for which a condition holds; whether there were any."""
        sure = F.coalesce(condition, F.lit(False))
        if self.rows.filter(sure).isEmpty():
            return False
        self._changed(self.rows.filter(~sure))
        return True

    def clear(self) -> None:
        self._changed(self.rows.limit(0))

    def patch_metadata(self, patches: DataFrame) -> None:
        """Replace the whole metadata of records by patches (id, metadata); vectors and u64_ids stay. Unknown ids are errors."""
        if row := patches.join(self.rows, "id", "left_anti").orderBy("id").first():
            raise StoreError(f"id {row.id!r} is not there")
        if not patches.groupBy("id").count().filter("count > 1").isEmpty():
            raise DuplicateIdError("an id is patched twice")
        new = patches.select("id", F.col("metadata").alias("new__"))
        self._changed(self.rows.join(new, "id", "left").withColumn("metadata", F.coalesce("new__", "metadata")).select(*self.rows.columns))

    # reading

    def records(self) -> DataFrame:
        """(id, u64_id, document, metadata) in the order of insertion."""
        return self.rows.orderBy("pos").select("id", "u64_id", "document", "metadata")

    def ids(self) -> DataFrame:
        return self.rows.orderBy("pos").select("id")

    def get(self, ids_: str | Iterable[str] | DataFrame | None = None) -> DataFrame:
        """Records by id, in the order asked for and as often; unknown ids are left out. All for None."""
        if ids_ is None:
            return self.records()
        return self._id_table(ids_).join(self.rows, "id").orderBy("nth").select("id", "u64_id", "document", "metadata")

    def contains(self, id_: str) -> bool:
        return not self.rows.filter(F.col("id") == id_).isEmpty()

    def _where(self, rows: DataFrame, where: dict[str, Any] | Column | Callable[..., bool] | None) -> DataFrame:
        if where is None:
            return rows
        if isinstance(where, dict):
            return rows.filter(filters.portable(where))
        if isinstance(where, Column):
            return rows.filter(F.coalesce(where, F.lit(False)))
        return filters.callable_filter(rows, where)

    def filter(self, where: dict[str, Any] | Column | Callable[..., bool] | None) -> DataFrame:
        """(id, u64_id, document, metadata) of the records that a filter lets pass: exact matches, an expression, or a function."""
        return self._where(self.rows, where).orderBy("pos").select("id", "u64_id", "document", "metadata")

    def allowlist(self, where: dict[str, Any] | Column | Callable[..., bool] | None) -> DataFrame:
        """(row_id) of those records."""
        return self._where(self.rows, where).select(F.col("u64_id").alias("row_id"))

    def search(self, queries: DataFrame, k: int = 4, where: dict[str, Any] | Column | Callable[..., bool] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id, u64_id, document, metadata, score): the k best records for each query (qid, embedding).

        where or allowed (row_id), not both, says among which; documents are joined to the hits alone.
        """
        if where is not None and allowed is not None:
            raise OptionError("a filter and an allowlist exclude each other")
        dense._check_k(k)
        if where is not None:
            allowed = self.allowlist(where)
        hits = dense.search_allowed(self.index, queries, k, allowed, check=False) if allowed is not None else dense.search(self.index, queries, k, checked=False)
        return hits.join(self.rows, hits.row_id == self.rows.u64_id).select("qid", "rank", "id", "u64_id", "document", "metadata", "score")

    def search_by_vector(self, vector: Iterable[float], k: int = 4, where: dict[str, Any] | Column | Callable[..., bool] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """search() for one vector, best first. No hits with an equality filter on a key that no record has is a warning."""
        q = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, embedding array<float>")
        out = self.search(q, k, where, allowed).orderBy("rank").select("rank", "id", "u64_id", "document", "metadata", "score")
        if isinstance(where, dict) and where and k and self.dim is not None and out.isEmpty():
            self.warn_unknown(where)
        return out

    def warn_unknown(self, keys: Iterable[str]) -> None:
        unknown = [r.key for r in filters.unknown_keys(self.rows, keys).collect()]
        if unknown and not self.rows.isEmpty():
            warnings.warn(f"no record has the metadata keys {unknown}", UnknownFilterKeyWarning, stacklevel=3)

    def checks(self) -> DataFrame:
        """(check, failures): what must hold of the table."""
        r = self.rows
        width, sign = (self.dim or 0) * self.bits // 8, (self.dim or 0) // 8
        unique = {"ids are unique": "id", "u64_ids are unique": "u64_id"}
        each = {
            "u64_ids are below the next": F.col("u64_id") >= self.next_u64,
            "codes fit the shape": F.coalesce(F.octet_length("codes") != width, F.lit(True)),
            "signs fit the shape": F.octet_length("sign") != sign,
            "documents are there": F.col("document").isNull() | F.col("metadata").isNull(),
        }
        # what concerns single rows takes one scan together
        counts = r.agg(*(F.count_if(bad).alias(name) for name, bad in each.items()))
        out = counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("failures")) for name in each))).alias("c")).select("c.*")
        for name, column in unique.items():
            out = out.unionByName(r.groupBy(column).count().agg(F.count_if((F.col("count") > 1) | F.col(column).isNull()).alias("failures")).select(F.lit(name).alias("check"), "failures"))
        return out

    def check(self) -> None:
        if bad := self.checks().filter("failures > 0").collect():
            raise StoreError("; ".join(f"{b.check}: {b.failures}" for b in bad))


# batches under a policy for ids that are there already


def duplicates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id) of incoming ids that come twice or exist."""
    twice = incoming.groupBy("id").count().filter("count > 1").select("id")
    return twice.unionByName(incoming.join(existing, "id", "left_semi").select("id")).distinct()


def keep_new(incoming: DataFrame, existing: DataFrame, order: str = "pos") -> DataFrame:
    """The first row of each id that doesn't exist."""
    first = incoming.withColumn("nth__", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("nth__ = 1").drop("nth__")
    return first.join(existing.select("id"), "id", "left_anti").select(*incoming.columns)


def keep_last(incoming: DataFrame, order: str = "pos") -> DataFrame:
    """The last row of each id, in the place of its first."""
    last = incoming.groupBy("id").agg(F.max_by(F.struct(*incoming.columns), order).alias("r"), F.min(order).alias("first__"))
    return last.select(*(F.col("first__").alias(c) if c == order else F.col(f"r.{c}").alias(c) for c in incoming.columns))


def under_policy(incoming: DataFrame, existing: DataFrame, policy: str | None = None, order: str = "pos") -> tuple[DataFrame, bool]:
    """What of a batch is written, and whether it replaces: FAIL (and NONE) refuses duplicates, SKIP leaves out what exists,
    OVERWRITE writes the last of each id."""
    name = (policy or "NONE").upper()
    if name in ("FAIL", "NONE"):
        if found := [r.id for r in duplicates(incoming, existing).orderBy("id").limit(20).collect()]:
            raise DuplicateIdError(f"duplicate ids under policy {name}: {found}")
        return incoming, False
    if name == "SKIP":
        return keep_new(incoming, existing, order), False
    if name == "OVERWRITE":
        return keep_last(incoming, order), True
    raise OptionError(f"unknown policy {policy!r}")


def derived_id(id_: Column, content_id: Column, offset: Column) -> Column:
    """An explicit id, else content_id:offset, else a random one."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.when(content_id.isNotNull(), F.concat_ws(":", content_id, offset.cast("string"))), F.uuid())


def stamp(metadata: str | Column, ref_doc_id: str | Column) -> Column:
    """Metadata JSON with ref_doc_id, doc_id and document_id; the string None where there is none."""
    ref = F.coalesce(F.col(ref_doc_id) if isinstance(ref_doc_id, str) else ref_doc_id, F.lit("None"))
    m = F.coalesce(F.from_json(F.col(metadata) if isinstance(metadata, str) else metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keys = ("ref_doc_id", "doc_id", "document_id")
    own = F.map_filter(m, lambda k, _: ~k.isin(*keys))
    return F.to_json(F.map_concat(own, F.create_map(*(x for k in keys for x in (F.lit(k), ref)))))


def content_upsert(rows: DataFrame, batch_: DataFrame, stale: Column) -> DataFrame:
    """rows (id, ...) with batch_ in place of the rows of its ids and of those for which stale holds."""
    kept = rows.filter(~F.coalesce(stale, F.lit(False))).join(batch_.select("id"), "id", "left_anti")
    return kept.select(*rows.columns).unionByName(batch_.select(*rows.columns))
