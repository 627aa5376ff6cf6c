"""Metadata filters as column expressions, in three dialects.

Metadata is JSON text in a string column. A filter is compiled once to one boolean column that is never null; values are read
as VARIANT, so that strings, numbers, booleans, nulls, lists and nested objects stay apart.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.errors import FilterError

NUMBER = "^(TINYINT|SMALLINT|INT|INTEGER|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


class Meta:
    """Access to a JSON object in a column."""

    def __init__(self, column: str | Column = "metadata"):
        self.json = F.col(column) if isinstance(column, str) else column
        self.variant = F.try_parse_json(self.json)

    @staticmethod
    def path(*keys: str) -> str:
        return "$" + "".join("[" + json.dumps(k, ensure_ascii=False) + "]" for k in keys)

    def at(self, *keys: str) -> Column:
        """The value under keys, as a variant; null where a key is missing."""
        return F.try_variant_get(self.variant, self.path(*keys), "variant")

    def kind(self, *keys: str) -> Column:
        """bool, number, string, array, object, null; SQL null where the key is missing."""
        t = F.upper(F.schema_of_variant(self.at(*keys)))
        return F.when(t.rlike(NUMBER), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "bool").when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")

    def string(self, *keys: str) -> Column:
        return F.try_variant_get(self.variant, self.path(*keys), "string")

    def number(self, *keys: str) -> Column:
        return F.try_variant_get(self.variant, self.path(*keys), "double")

    def boolean(self, *keys: str) -> Column:
        return F.try_variant_get(self.variant, self.path(*keys), "boolean")

    def array(self, *keys: str) -> Column:
        return F.try_variant_get(self.variant, self.path(*keys), "array<variant>")


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array"


def _number(value: Any) -> Column:
    if isinstance(value, int) and abs(value) > 2**53:
        return F.lit(str(value)).cast("decimal(38,0)").cast("double")
    return F.lit(float(value))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _every(parts: list[Column], empty: bool = True) -> Column:
    out = F.lit(empty)
    for i, p in enumerate(parts):
        out = p if i == 0 else out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for i, p in enumerate(parts):
        out = p if i == 0 else out | p
    return out


# exact matches, all of which must hold


def portable(filters: dict[str, Any], column: str | Column = "metadata") -> Column:
    """Every key has the value given. A missing key is no match; comparing values of two kinds, or anything but a plain
    value, is an error, raised where the first mismatch of the keys in order isn't before it."""
    meta, out = Meta(column), F.lit(True)
    for key in filters:
        value = filters[key]
        if not isinstance(key, str):
            raise FilterError(f"a filter key must be a string: {key!r}")
        if kind_of(value) in ("array", "object") or isinstance(value, float) and not math.isfinite(value):
            raise FilterError(f"a filter value must be plain and finite: {value!r}")
    for key, value in reversed(filters.items()):
        kind, want = meta.kind(key), kind_of(value)
        equal = F.lit(True) if want == "null" else _scalar_equal(meta, (key,), value)
        mixed = F.raise_error(F.concat(F.lit(f"filter on {key!r} compares {want} with "), kind)).cast("boolean")
        out = F.when(kind.isNull(), F.lit(False)).when(kind != want, mixed).when(~_sure(equal), F.lit(False)).otherwise(out)
    return out


def _scalar_equal(meta: Meta, keys: tuple[str, ...], value: Any) -> Column:
    kind = kind_of(value)
    if kind == "bool":
        return meta.boolean(*keys) == F.lit(value)
    if kind == "number":
        return meta.number(*keys) == _number(value)
    return meta.string(*keys) == F.lit(value)


# conditions in lists


def _loose_equal(meta: Meta, keys: tuple[str, ...], value: Any) -> Column:
    """Equality where booleans are the numbers 0 and 1 and a missing key is null."""
    kind, want = meta.kind(*keys), kind_of(value)
    if want == "null":
        return kind.isNull() | (kind == "null")
    if want in ("bool", "number"):
        return _sure(F.when(kind == "bool", meta.boolean(*keys).cast("double") == _number(value)).when(kind == "number", meta.number(*keys) == _number(value)).otherwise(False))
    if want == "string":
        return _sure((kind == "string") & (meta.string(*keys) == F.lit(value)))
    return _sure((kind == want) & (F.to_json(meta.at(*keys)) == F.to_json(F.parse_json(F.lit(json.dumps(value))))))


def _element_is(value: Any) -> Callable[[Column], Column]:
    want = json.dumps(value, ensure_ascii=False)
    return lambda x: F.coalesce(F.to_json(x), F.lit("null")) == F.to_json(F.parse_json(F.lit(want)))


def _items(value: Any) -> list[Any] | None:
    return None if isinstance(value, (str, bytes, dict)) or not isinstance(value, Iterable) else list(value)


def list_condition(item: dict[str, Any], meta: Meta) -> Column:
    """One condition {key, operator, value}; a dotted key walks nested objects."""
    if item.get("key") is None:
        raise FilterError("a condition needs a key")
    keys, op, value = tuple(str(item["key"]).split(".")), str(item.get("operator", "==")).lower(), item.get("value")
    if op in ("==", "eq"):
        return _loose_equal(meta, keys, value)
    if op in ("!=", "ne"):
        return ~_loose_equal(meta, keys, value)
    if op in (">", ">=", "<", "<=", "gt", "gte", "lt", "lte"):
        if kind_of(value) != "number":
            return F.lit(False)
        n, v = meta.number(*keys), _number(value)
        compared = {">": n > v, "gt": n > v, ">=": n >= v, "gte": n >= v, "<": n < v, "lt": n < v, "<=": n <= v, "lte": n <= v}[op]
        return _sure((meta.kind(*keys) == "number") & compared)
    if op in ("in", "nin", "not in"):
        values = _items(value)
        found = _any([_loose_equal(meta, keys, v) for v in values]) if values else F.lit(False)
        return found if op == "in" else ~found
    if op in ("any", "all"):
        values = _items(value)
        a = meta.array(*keys)
        tests = [F.exists(a, _element_is(v)) for v in (values if values is not None else [value])]
        return _sure((meta.kind(*keys) == "array") & (_any(tests) if op == "any" else _every(tests)))
    raise NotImplementedError(f"unsupported filter operator {op!r}")


def list_filter(filters: dict[str, Any] | None, column: str | Column = "metadata") -> Column:
    """{condition: and | or | not, filters: [...]} over conditions and further such lists; not takes exactly one."""
    meta = Meta(column)

    def walk(node: dict[str, Any]) -> Column:
        if "filters" not in node:
            return list_condition(node, meta)
        how, parts = str(node.get("condition", "and")).lower(), list(node["filters"] or [])
        if how == "and":
            return _every([walk(p) for p in parts])
        if how == "or":
            return _any([walk(p) for p in parts])
        if how == "not":
            if len(parts) != 1:
                raise FilterError("not takes exactly one condition")
            return ~walk(parts[0])
        raise NotImplementedError(f"unsupported filter condition {how!r}")

    return walk(filters) if filters else F.lit(True)


# nested conditions on fields

FIELDS = {"id": "id", "content": "document", "score": "score"}
LOGIC = ("AND", "OR", "NOT")
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=", "in", "not in")


def nested_filter(filters: dict[str, Any] | None, column: str | Column = "metadata") -> Column:
    """{operator: AND | OR | NOT, conditions: [...]} over {field, operator, value}.

    meta.x is metadata, as is any bare name but id, content and score, which are columns. Ordered comparisons are between
    numbers or between ISO dates; with null they are false. NOT holds where not all of its conditions do.
    """
    meta = Meta(column)

    def walk(node: dict[str, Any]) -> Column:
        op = node.get("operator")
        if "field" not in node:
            if op not in LOGIC:
                raise FilterError(f"unknown filter operator {op!r}")
            parts = [walk(p) for p in node.get("conditions") or []]
            return _any(parts) if op == "OR" else _every(parts) if op == "AND" else ~_every(parts)
        if op not in COMPARISONS:
            raise FilterError(f"unknown filter operator {op!r}")
        if "value" not in node:
            raise FilterError("a condition needs a value")
        return compare(str(node["field"]), op, node["value"])

    def compare(name: str, op: str, value: Any) -> Column:
        if name in FIELDS:
            c = F.col(FIELDS[name])
            equal = lambda v: c.isNull() if v is None else _sure(c == F.lit(v))
            text, number, is_text, is_number = c.cast("string"), c.try_cast("double"), F.lit(name != "score"), F.lit(name == "score")
        else:
            keys = tuple((name[5:] if name.startswith("meta.") else name).split("."))
            equal = lambda v: _loose_equal(meta, keys, v)
            text, number = meta.string(*keys), meta.number(*keys)
            is_text, is_number = _sure(meta.kind(*keys) == "string"), _sure(meta.kind(*keys) == "number")
        if op in ("==", "!="):
            return equal(value) if op == "==" else ~equal(value)
        if op in ("in", "not in"):
            values = _items(value)
            if values is None:
                raise FilterError(f"{op} needs a list")
            found = _any([equal(v) for v in values])
            return found if op == "in" else ~found
        kind = kind_of(value)
        if kind == "null":
            return F.lit(False)
        if kind not in ("number", "string"):
            raise FilterError(f"{op} can't compare {kind}")
        a, b, right = (number, _number(value), is_number) if kind == "number" else (text, F.lit(value), is_text)
        return _sure(right & {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op])

    return walk(filters) if filters else F.lit(True)


def nested_keys(filters: dict[str, Any] | None) -> set[str]:
    """The first metadata keys that a nested filter names."""
    if not filters:
        return set()
    out = set().union(*(nested_keys(p) for p in filters.get("conditions") or []))
    name = filters.get("field")
    if name and name.startswith("meta."):
        out.add(name.split(".")[1])
    elif name and "." not in name and name not in FIELDS:
        out.add(name)
    return out


def callable_filter(records: DataFrame, predicate: Callable[..., bool], metadata_col: str = "metadata", document_col: str = "document") -> DataFrame:
    """The records for which predicate(metadata) or predicate(document, metadata) is true, by its number of parameters.

    It runs on Arrow batches in Python; a filter in one of the dialects stays in the plan and is the better choice.
    """
    import inspect

    import pandas as pd

    two = len([p for p in inspect.signature(predicate).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]) == 2

    def test(document, metadata):
        parsed = [json.loads(m) if m else {} for m in metadata]
        return pd.Series([bool(predicate(d, m) if two else predicate(m)) for d, m in zip(document, parsed)])

    test.__annotations__ = {"document": pd.Series, "metadata": pd.Series, "return": pd.Series}
    return records.filter(F.pandas_udf(test, "boolean")(F.col(document_col), F.col(metadata_col)))


def unknown_keys(records: DataFrame, keys: Iterable[str], column: str = "metadata") -> DataFrame:
    """(key) of those that no record's metadata has."""
    meta = Meta(column)
    keys = sorted(set(keys))
    if not keys:
        return records.sparkSession.createDataFrame([], "key string")
    seen = records.agg(*(F.coalesce(F.bool_or(meta.kind(k).isNotNull()), F.lit(False)).alias(f"k{i}") for i, k in enumerate(keys)))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"k{i}").alias("seen")) for i, k in enumerate(keys))))
    return seen.select(pairs.alias("p")).filter("not p.seen").select("p.key")
