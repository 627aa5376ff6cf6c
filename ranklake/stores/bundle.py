"""Bundles: an index as Parquet with a manifest of digests, replaced as a whole or not at all."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.config import SignLoad, SignPolicy, check_shape, sign_compatible
from ranklake.errors import DuplicateIdError, MissingSignError, StoreError
from ranklake.operators import ltr
from ranklake.operators.dense import Index
from ranklake.operators.sparse import TextIndex
from ranklake.operators.sparse import checks as sparse_checks
from ranklake.stores.files import Files, relative

MANIFEST, ROWS = "manifest.json", "rows"
RESERVED = (MANIFEST, ROWS)
SLOTS, IDS = "slots", "ids"
VERSION = 1


@dataclass(frozen=True)
class Auxiliary:
    """A further table or file of a bundle: its name, its place in it, and whether the bundle is whole without it."""

    name: str
    path: str
    required: bool = True

    @staticmethod
    def optional(name: str, path: str) -> Auxiliary:
        return Auxiliary(name, path, False)


def _check_auxiliaries(auxiliaries: list[Auxiliary]) -> None:
    seen: set[str] = set()
    for a in auxiliaries:
        path = relative(a.path)
        if not a.name.strip() or path.split("/")[0] in RESERVED:
            raise StoreError(f"the auxiliary {a.name!r} has no name or a reserved place")
        if a.name in seen or path in seen:
            raise StoreError(f"the auxiliary {a.name!r} is there twice")
        seen |= {a.name, path}


def write(index: Index, path: str, kind: str = IDS, auxiliaries: dict[Auxiliary, DataFrame | bytes] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    """Write an index to path, and return its manifest.

    All goes to a folder beside it, is verified there and takes path's place by renaming; what was there before is kept
    until then, and recover() puts it back if that is cut off.
    """
    if index.rows is None or index.dim is None:
        raise StoreError("an index without a dimension can't be written")
    spark = spark or index.rows.sparkSession
    parent, name = path.rstrip("/").rsplit("/", 1)
    files = Files(spark, parent)
    if files.is_link(name) or (files.exists(name) and not files.is_dir(name)):
        raise StoreError(f"{path} is a link or no folder")
    auxiliaries = auxiliaries or {}
    _check_auxiliaries(list(auxiliaries))
    stage = f".{name}.tmp-{uuid.uuid4().hex}"
    try:
        index.rows.write.parquet(files.full(f"{stage}/{ROWS}"))
        written = spark.read.parquet(files.full(f"{stage}/{ROWS}"))
        if row := written.groupBy("row_id").count().filter("count > 1 or row_id is null").first():
            raise DuplicateIdError(f"row {row.row_id} is there {row['count']} times")
        for a, content in auxiliaries.items():
            if isinstance(content, bytes):
                files.write(f"{stage}/{relative(a.path)}", content)
            else:
                content.write.parquet(files.full(f"{stage}/{relative(a.path)}"))
        sign_bytes = index.dim // 8 if index.has_sign else 0
        manifest = {
            "version": VERSION,
            "kind": kind,
            "dim": index.dim,
            "bits": index.bits,
            "vector_count": written.count(),
            "bytes_per_vector": index.dim * index.bits // 8,
            "sign_bytes_per_vector": sign_bytes,
            "policy": index.policy.value,
            "files": files.digest_list(stage),
            "auxiliaries": [{"name": a.name, "path": relative(a.path), "required": a.required} for a in auxiliaries],
        }
        files.write_json(f"{stage}/{MANIFEST}", manifest)
        _raise_problems(problems(files, stage))
        backup = f".{name}.bak-{uuid.uuid4().hex}"
        if files.exists(name):
            files.move(name, backup)
        try:
            files.move(stage, name)
        except OSError:
            if files.exists(backup):
                files.move(backup, name)
            raise
        if files.exists(backup):
            files.delete(backup)
        return manifest
    finally:
        if files.exists(stage):
            files.delete(stage)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back a backup that verifies if path is missing; whether it did."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    files = Files(spark, parent)
    if files.exists(name):
        return False
    backups = [e.name for e in files.list() if e.is_dir and e.name.startswith(f".{name}.bak-")]
    stamped = sorted(backups, key=lambda b: files._fs.getFileStatus(files._path(b)).getModificationTime(), reverse=True)
    for b in stamped:
        if not problems(files, b):
            files.move(b, name)
            return True
    return False


def problems(files: Files, name: str = "", most_auxiliary_bytes: int | None = None) -> list[str]:
    """What is wrong with a bundle; nothing if it verifies."""
    at = f"{name}/{MANIFEST}" if name else MANIFEST
    if not files.exists(at):
        return ["no manifest"]
    try:
        m = files.read_json(at)
        check_shape(m["dim"], m["bits"])
        listed = {f["path"]: f for f in m["files"]}
        auxiliaries = {a["path"]: a for a in m["auxiliaries"]}
    except (StoreError, KeyError, TypeError, ValueError) as e:
        return [f"the manifest is not valid: {e}"]
    out = [] if m.get("version") == VERSION else [f"unknown version {m.get('version')!r}"]
    if m["bytes_per_vector"] != m["dim"] * m["bits"] // 8:
        out.append("bytes_per_vector doesn't fit the shape")
    there = {f["path"]: f for f in files.digest_list(name)}
    there.pop(MANIFEST, None)
    of = lambda p: next((a for q, a in auxiliaries.items() if p == q or p.startswith(q + "/")), None)
    for p, f in listed.items():
        a = of(p)
        if p not in there:
            if a is None or a["required"]:
                out.append(f"{p} is missing")
        elif there[p]["sha256"] != f["sha256"] or there[p]["bytes"] != f["bytes"]:
            out.append(f"{p} has another digest")
        elif a and most_auxiliary_bytes is not None and f["bytes"] > most_auxiliary_bytes:
            out.append(f"{p} has {f['bytes']} bytes; the limit is {most_auxiliary_bytes}")
    out += [f"{p} is not in the manifest" for p in there if p not in listed]
    return out


def _raise_problems(found: list[str]) -> None:
    if found:
        raise StoreError("; ".join(found[:5]))


def load(spark: SparkSession, path: str, kind: str | None = IDS, sign: SignLoad = SignLoad.REQUIRE_IF_SUPPORTED, bits: int | None = None, dim: int | None = None, verify: bool = True, most_auxiliary_bytes: int | None = None) -> Index:
    """The index at path, once its digests, kind and, if given, shape hold.

    sign says whether sign bits must be there (if the shape can have them), may be, or must not.
    """
    files = Files(spark, path)
    recover(spark, path)
    if verify:
        _raise_problems(problems(files, "", most_auxiliary_bytes))
    m = files.read_json(MANIFEST)
    if kind is not None and m["kind"] != kind:
        raise StoreError(f"{path} is a bundle of {m['kind']}, not of {kind}")
    for what, want in (("bits", bits), ("dim", dim)):
        if want is not None and m[what] != want:
            raise StoreError(f"{path} has {what}={m[what]}, not {want}")
    has = m["sign_bytes_per_vector"] > 0
    if sign is SignLoad.FORBID and has:
        raise StoreError(f"{path} has sign bits")
    if not has and (sign is SignLoad.REQUIRE or sign is SignLoad.REQUIRE_IF_SUPPORTED and sign_compatible(m["dim"], m["bits"]) and m["policy"] != SignPolicy.DISABLED.value):
        raise MissingSignError(f"{path} has no sign bits")
    rows = spark.read.parquet(files.full(ROWS))
    if rows.count() != m["vector_count"]:
        raise StoreError(f"{path} doesn't have the {m['vector_count']} rows of its manifest")
    return Index(rows, m["dim"], m["bits"], SignPolicy(m["policy"]) if has or m["policy"] != "optional" else SignPolicy.DISABLED)


def auxiliary(spark: SparkSession, path: str, name: str) -> str:
    """Where an auxiliary of a bundle is."""
    files = Files(spark, path)
    for a in files.read_json(MANIFEST)["auxiliaries"]:
        if a["name"] == name:
            return files.full(a["path"])
    raise StoreError(f"{path} has no auxiliary {name!r}")


TEXT = ("postings", "docs", "terms", "corpus")


def text_auxiliaries(index: TextIndex, folder: str = "sparse") -> dict[Auxiliary, DataFrame]:
    """The tables of a text index for write(); postings are sorted by term, so that a look-up prunes."""
    tables = {t: getattr(index, t) for t in TEXT}
    tables["postings"] = index.postings.repartitionByRange("term").sortWithinPartitions("term", "row_id")
    tables["terms"] = index.terms.repartitionByRange("term").sortWithinPartitions("term")
    tables["corpus"] = index.corpus.withColumn("tokenizer", F.lit(index.tokenizer))
    return {Auxiliary(f"{folder}.{t}", f"{folder}/{t}"): df for t, df in tables.items()}


def load_text(spark: SparkSession, path: str, folder: str = "sparse", check: bool = True) -> TextIndex:
    """The text index of a bundle; with check, its tables must agree, and its rows be those of the bundle."""
    tables = {t: spark.read.parquet(auxiliary(spark, path, f"{folder}.{t}")) for t in TEXT}
    tokenizer = tables["corpus"].first().tokenizer
    index = TextIndex(**(tables | {"corpus": tables["corpus"].drop("tokenizer")}), tokenizer=tokenizer)
    if check:
        from ranklake.operators.sparse import check_same_rows

        _raise_problems([f"{r.check}: {r.failures}" for r in sparse_checks(index).filter("failures > 0").collect()])
        check_same_rows(index, spark.read.parquet(Files(spark, path).full(ROWS)))
    return index


def open_hybrid(spark: SparkSession, path: str, folder: str = "sparse") -> tuple[Index, TextIndex]:
    """Both indexes of one bundle; an error says which side failed."""
    try:
        dense = load(spark, path)
    except ValueError as e:
        raise StoreError(f"dense: {e}") from e
    try:
        return dense, load_text(spark, path, folder)
    except ValueError as e:
        raise StoreError(f"sparse: {e}") from e


def load_model(spark: SparkSession, path: str, name: str = "model", limits: ltr.Limits = ltr.Limits()) -> ltr.Model:
    """The ranking model of a bundle, once the bundle verifies."""
    _raise_problems(problems(Files(spark, path)))
    at = auxiliary(spark, path, name)
    folder, file = at.rsplit("/", 1)
    return ltr.parse(Files(spark, folder).read(file), limits)


def structure(spark: SparkSession, path: str) -> list[str]:
    """What is wrong within the auxiliaries that are known by name: text indexes, feature tables and ranking models."""
    files, out = Files(spark, path), []
    names = {a["name"]: a["path"] for a in files.read_json(MANIFEST)["auxiliaries"] if files.exists(a["path"])}
    for name, at in names.items():
        try:
            if name.endswith(".postings"):
                load_text(spark, path, name.removesuffix(".postings"))
            elif name.endswith(".rows"):
                rows = spark.read.parquet(files.full(at))
                first = rows.first()
                if first is not None:
                    ltr.check_features(rows, [f"f{i}" for i in range(len(first.features))])
            elif name.endswith("model"):
                ltr.parse(files.read(at))
        except ValueError as e:
            out.append(f"{name}: {e}")
    return out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, kind, dim, bits, vector_count, bytes_per_vector, has_sign, auxiliaries)."""
    m = Files(spark, path).read_json(MANIFEST)
    row = (path, m["kind"], m["dim"], m["bits"], m["vector_count"], m["bytes_per_vector"], m["sign_bytes_per_vector"] > 0, [a["name"] for a in m["auxiliaries"]])
    return spark.createDataFrame([row], "path string, kind string, dim int, bits int, vector_count long, bytes_per_vector int, has_sign boolean, auxiliaries array<string>")


def verify(spark: SparkSession, path: str, most_auxiliary_bytes: int | None = None) -> DataFrame:
    """(problem) of a bundle; no row if it verifies."""
    found = problems(Files(spark, path), "", most_auxiliary_bytes)
    return spark.createDataFrame([(p,) for p in found or structure(spark, path)], "problem string")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(component, files, bytes): what the parts of a bundle or store take."""
    found = list(Files(spark, path).walk())
    rows = spark.createDataFrame([(p.split("/")[0], n) for p, n in found], "component string, bytes long")
    return rows.groupBy("component").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
