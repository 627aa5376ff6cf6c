"""Learning to rank: features of ranked rows, tree ensembles compiled to expressions, and reranking."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.errors import ModelError, OptionError
from ranklake.operators import sparse
from ranklake.operators.dense import DECIMALS, ranked

FEATURES = ("rrf_score", "bm25_score", "bm25_rank", "rank_cos", "rank_cos_rank", "dense_cos", "dense_rank", "doc_len_chars", "query_len_chars")
#: Feature: (table of hits, column).
FROM_HITS = {"bm25_score": ("bm25", "score"), "bm25_rank": ("bm25", "rank"), "rank_cos": ("rank_cos", "score"), "rank_cos_rank": ("rank_cos", "rank"), "dense_cos": ("dense_cos", "score"), "dense_rank": ("dense_cos", "rank")}
MODEL_SCHEMA, FEATURE_SCHEMA = "tree_ensemble.v1", "features.v1"
FAMILIES = ("xgboost_gbtree", "tree_ensemble")
#: A feature that tells the label.
LEAKS = ("doc_cat_match",)
#: Up to so many nodes a model is one expression; a larger one walks its trees over Arrow batches.
EXPRESSION_NODES = 600


# features


def check_names(names: list[str]) -> None:
    if not names:
        raise ModelError("feature names must not be empty")
    for i, n in enumerate(names):
        if not n.strip():
            raise ModelError("a feature name must not be blank")
        if n in names[:i]:
            raise ModelError(f"feature {n!r} is there twice")


def features(fused: DataFrame, names: list[str], bm25: DataFrame | None = None, rank_cos: DataFrame | None = None, dense_cos: DataFrame | None = None, doc_len: DataFrame | None = None, query_len: DataFrame | None = None, fill: float | None = None) -> DataFrame:
    """(qid, row_id, features) of each row of fused (qid, row_id, fused_score), features in the order of names.

    The other tables are hits (qid, row_id, rank, score), doc_len (row_id, doc_len_chars) and query_len (qid,
    query_len_chars). A value that a table lacks raises where it is read, unless fill stands for it.
    """
    check_names(names)
    if unknown := [n for n in names if n not in FEATURES]:
        raise ModelError(f"unsupported feature {unknown[0]!r}")
    tables = {"bm25": bm25, "rank_cos": rank_cos, "dense_cos": dense_cos}
    out = fused.select("qid", "row_id", F.col("fused_score").cast("double").alias("rrf_score"))
    for name, hits in tables.items():
        own = [(n, FROM_HITS[n][1]) for n in names if n in FROM_HITS and FROM_HITS[n][0] == name]
        if not own:
            continue
        if hits is None:
            raise ModelError(f"{own[0][0]} needs the hits of {name}")
        first = hits.groupBy("qid", "row_id").agg(F.min_by(F.struct("rank", "score"), "rank").alias("h"))
        out = out.join(first.select("qid", "row_id", *(F.col(f"h.{c}").cast("double").alias(n) for n, c in own)), ["qid", "row_id"], "left")
    for name, table, key in (("doc_len_chars", doc_len, "row_id"), ("query_len_chars", query_len, "qid")):
        if name in names:
            if table is None:
                raise ModelError(f"{name} needs its table")
            out = out.join(table.select(key, F.col(name).cast("double").alias(name)), key, "left")

    def sure(n: str) -> Column:
        missing = F.raise_error(F.concat(F.lit(f"no finite {n} of row "), F.col("row_id").cast("string"))).cast("double") if fill is None else F.lit(float(fill))
        return F.when(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < math.inf), F.col(n)).otherwise(missing)

    return out.select("qid", "row_id", F.array(*(sure(n).cast("float") for n in names)).alias("features"))


def check_features(rows: DataFrame, names: list[str]) -> None:
    """Raise for the first row whose features are not as many as names, or not finite."""
    check_names(names)
    bad = F.coalesce(F.size("features") != len(names), F.lit(True)) | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= math.inf))
    if row := rows.filter(bad).orderBy("qid", "row_id").first():
        raise ModelError(f"row {row.row_id} of query {row.qid} needs {len(names)} finite features")


def doc_lengths(docs: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_len_chars); 0 for a null text."""
    return docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("doc_len_chars"))


def query_lengths(queries: DataFrame, qid_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, query_len_chars)."""
    return queries.select(F.col(qid_col).alias("qid"), F.char_length(text_col).alias("query_len_chars"))


def export(index: sparse.TextIndex, queries: DataFrame, qrels: DataFrame, k: int, qid_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, row_id, label, features): the k best rows by BM25 for each query with bm25_score, bm25_rank and query_len_chars.

    qrels is (qid, row_id, label); rows that it lacks have label 0.
    """
    if k < 1:
        raise OptionError("k must be positive")
    hits = sparse.search(index, queries, k, qid_col=qid_col, text_col=text_col)
    labelled = hits.join(qrels.select("qid", "row_id", F.col("label").cast("float").alias("label")), ["qid", "row_id"], "left").join(query_lengths(queries, qid_col, text_col), "qid")
    return labelled.select("qid", "row_id", F.coalesce("label", F.lit(0.0).cast("float")).alias("label"), F.array(*(F.col(c).cast("float") for c in ("score", "rank", "query_len_chars"))).alias("features"))


EXPORTED = ["bm25_score", "bm25_rank", "query_len_chars"]


# models


@dataclass(frozen=True)
class Limits:
    """What a model may have at most."""

    model_bytes: int = 64 << 20
    trees: int = 4096
    nodes: int = 4096
    depth: int = 32
    features: int = 256
    allow_leaks: bool = False

    def check(self) -> None:
        for name in ("model_bytes", "trees", "nodes", "depth", "features"):
            if getattr(self, name) < 1:
                raise OptionError(f"{name} must be positive")
        if self.features > 65_535:
            raise OptionError("features must be below 65536")


@dataclass(frozen=True)
class Node:
    feature: int = -1  # -1: a leaf
    value: float = 0.0  # threshold, or a leaf's value
    left: int = 0
    right: int = 0


@dataclass(frozen=True)
class Model:
    model_id: str
    family: str
    names: list[str]
    base: float
    rate: float
    trees: list[list[Node]]
    provenance: dict[str, Any] = field(default_factory=dict)

    @property
    def nodes(self) -> int:
        return sum(map(len, self.trees))


class Reranker(Protocol):
    """What rerank() takes: anything that names its features and scores rows (qid, row_id, features)."""

    names: list[str]

    def score(self, rows: DataFrame) -> DataFrame: ...


def _f32(x: Any) -> float:
    return float(np.float32(x))


def parse(record: str | bytes | dict[str, Any], limits: Limits = Limits()) -> Model:
    """A model of its JSON record, checked: header, features, and each tree whole, within its limits."""
    limits.check()
    if not isinstance(record, dict):
        raw = record.encode() if isinstance(record, str) else record
        if len(raw) > limits.model_bytes:
            raise ModelError(f"the model has {len(raw)} bytes; the limit is {limits.model_bytes}")
        try:
            record = json.loads(raw)
        except ValueError as e:
            raise ModelError(f"the model is no JSON: {e}") from None
    known = {"schema_version", "model_id", "model_family", "training_objective", "booster", "base_score", "learning_rate", "feature_schema", "training_provenance", "trees"}
    if extra := set(record) - known:
        raise ModelError(f"unknown fields: {sorted(extra)}")
    if missing := known - {"learning_rate", "training_provenance"} - set(record):
        raise ModelError(f"missing fields: {sorted(missing)}")
    if not str(record["schema_version"]).endswith(MODEL_SCHEMA):
        raise ModelError(f"unsupported model schema {record['schema_version']!r}")
    if not str(record["model_id"]).strip():
        raise ModelError("the model has no id")
    if not str(record["model_family"]).endswith(FAMILIES):
        raise ModelError(f"unsupported model family {record['model_family']!r}")
    if record["training_objective"] != "rank:pairwise":
        raise ModelError(f"unsupported objective {record['training_objective']!r}")
    if record["booster"] != "gbtree":
        raise ModelError(f"unsupported booster {record['booster']!r}")
    base, rate = _f32(record["base_score"]), _f32(record.get("learning_rate", 1.0))
    if not math.isfinite(base) or not math.isfinite(rate):
        raise ModelError("base score and learning rate must be finite")
    schema = record["feature_schema"]
    if not str(schema.get("schema_version")).endswith(FEATURE_SCHEMA):
        raise ModelError(f"unsupported feature schema {schema.get('schema_version')!r}")
    names = list(schema.get("feature_names") or [])
    check_names(names)
    if len(names) > limits.features:
        raise ModelError(f"the model has {len(names)} features; the limit is {limits.features}")
    banned = {*LEAKS, *(schema.get("forbidden_features") or [])}
    if not limits.allow_leaks and (leaks := [n for n in names if n in banned]):
        raise ModelError(f"feature {leaks[0]!r} is forbidden")
    if not record["trees"] or len(record["trees"]) > limits.trees:
        raise ModelError(f"a model has 1 to {limits.trees} trees, not {len(record['trees'])}")
    trees = [_tree(i, t.get("nodes") or [], len(names), limits) for i, t in enumerate(record["trees"])]
    return Model(record["model_id"], record["model_family"], names, base, rate, trees, record.get("training_provenance") or {})


def _tree(i: int, nodes: list[dict[str, Any]], n_features: int, limits: Limits) -> list[Node]:
    if not 1 <= len(nodes) <= limits.nodes:
        raise ModelError(f"tree {i} has {len(nodes)} nodes, not 1 to {limits.nodes}")
    out = []
    for k, node in enumerate(nodes):
        split = [node.get(x) for x in ("split_feature", "threshold", "left", "right")]
        leaf = node.get("leaf_value")
        if (leaf is None) == (None in split) or (leaf is not None and any(x is not None for x in split)):
            raise ModelError(f"node {k} of tree {i} must be a leaf or a whole split")
        value = _f32(leaf if leaf is not None else split[1])
        if not math.isfinite(value):
            raise ModelError(f"node {k} of tree {i} is not finite")
        if leaf is not None:
            out.append(Node(value=value))
            continue
        feature, _, left, right = split
        if not 0 <= feature < n_features:
            raise ModelError(f"node {k} of tree {i} splits by feature {feature} of {n_features}")
        if not (0 <= left < len(nodes) and 0 <= right < len(nodes)):
            raise ModelError(f"node {k} of tree {i} has a child out of range")
        out.append(Node(feature, value, left, right))
    # nodes of more than one parent may be met often, so depths are by the longest way, each node once
    depth, state = [0] * len(out), [0] * len(out)
    todo = [(0, False)]
    while todo:
        k, done = todo.pop()
        if done:
            state[k] = 2
            depth[k] = 1 + (max(depth[out[k].left], depth[out[k].right]) if out[k].feature >= 0 else 0)
        elif state[k] == 0:
            state[k] = 1
            todo.append((k, True))
            if out[k].feature >= 0:
                for c in (out[k].left, out[k].right):
                    if state[c] == 1:
                        raise ModelError(f"tree {i} has a cycle at node {c}")
                    todo.append((c, False))
        elif state[k] == 1:
            raise ModelError(f"tree {i} has a cycle at node {k}")
    if 0 in state:
        raise ModelError(f"node {state.index(0)} of tree {i} can't be reached")
    if depth[0] > limits.depth:
        raise ModelError(f"tree {i} is deeper than {limits.depth}")
    return out


def load(path: str | Path, limits: Limits = Limits()) -> Model:
    p = Path(path)
    if p.stat().st_size > limits.model_bytes:
        raise ModelError(f"the model has {p.stat().st_size} bytes; the limit is {limits.model_bytes}")
    return parse(p.read_bytes(), limits)


def expression(model: Model, features_col: str | Column = "features") -> Column:
    """The score as one expression of a features column: left where the feature is below the threshold."""
    x = F.col(features_col) if isinstance(features_col, str) else features_col

    def node(tree: list[Node], k: int) -> Column:
        n = tree[k]
        if n.feature < 0:
            return F.lit(n.value)
        return F.when(F.get(x, F.lit(n.feature)).cast("double") < F.lit(n.value), node(tree, n.left)).otherwise(node(tree, n.right))

    out = F.lit(model.base)
    for tree in model.trees:
        out = out + F.lit(model.rate) * node(tree, 0)
    return out


def walk(model: Model, x: np.ndarray) -> np.ndarray:
    """The scores of rows of features, by walking all rows down each tree a level at a time."""
    out = np.full(len(x), model.base)
    rows = np.arange(len(x))
    for tree in model.trees:
        feature, value, left, right = (np.array([getattr(n, a) for n in tree]) for a in ("feature", "value", "left", "right"))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            go = at[inner]
            at[inner] = np.where(x[rows[inner], feature[go]] < value[go], left[go], right[go])
        out += model.rate * value[at]
    return out


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(qid, row_id, score) of rows (qid, row_id, features); features that don't fit raise where they are read."""
    n = len(model.names)
    good = F.coalesce(F.size("features") == n, F.lit(False)) & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= math.inf))
    sure = F.when(good, F.col("features")).otherwise(F.raise_error(F.lit(f"a row needs {n} finite features")).cast("array<float>"))
    if model.nodes <= EXPRESSION_NODES:
        return rows.select("qid", "row_id", sure.alias("features")).select("qid", "row_id", F.round(expression(model), DECIMALS).alias("score"))
    kinds = dict(rows.dtypes)

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("row_id"), pa.array(np.round(walk(model, x), DECIMALS))], ["qid", "row_id", "score"])

    return rows.select("qid", "row_id", sure.cast("array<float>").alias("features")).mapInArrow(f, f"qid {kinds['qid']}, row_id {kinds['row_id']}, score double")


def rerank(rows: DataFrame, model: Model | Reranker, k: int | None = None, names: list[str] | None = None) -> DataFrame:
    """(qid, rank, row_id, score) of rows (qid, row_id, features), by the model's score, then row_id, cut at k.

    names, if given, must be the model's features in its order.
    """
    if names is not None and list(names) != list(model.names):
        raise ModelError("the features are not those of the model")
    if k is not None and k < 0:
        raise OptionError("k must not be negative")
    return ranked(score(rows, model) if isinstance(model, Model) else model.score(rows), k)
