"""Files on whatever file system a path names, through Spark's own access to it."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.errors import StoreError


class Entry(NamedTuple):
    name: str
    is_dir: bool
    size: int
    is_link: bool


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.full(name))

    def full(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def is_dir(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._path(name)).isDirectory()

    def is_link(self, name: str = "") -> bool:
        """Whether a local path is a symbolic link; other file systems have none here."""
        import os

        p = self.full(name)
        local = p.removeprefix("file://") if p.startswith("file://") else p if p.startswith("/") else None
        return bool(local) and os.path.islink(local)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str = "") -> list[Entry]:
        """What a folder holds, by name; nothing if there is none."""
        if not self.is_dir(name):
            return []
        found = [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self._fs.listStatus(self._path(name))]
        return [Entry(n, d, size, self.is_link(f"{name}/{n}" if name else n)) for n, d, size in sorted(found) if not n.endswith(".crc")]

    def walk(self, name: str = "") -> Iterator[tuple[str, int]]:
        """(path below root, bytes) of all files below a folder; symbolic links are refused."""
        for e in self.list(name):
            path = f"{name}/{e.name}" if name else e.name
            if e.is_link:
                raise StoreError(f"{path} is a symbolic link")
            if e.is_dir:
                yield from self.walk(path)
            else:
                yield path, e.size

    def read(self, name: str) -> bytes:
        s = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(s))
        finally:
            s.close()

    def write(self, name: str, data: bytes, new: bool = False) -> None:
        """Write a small file; with new, fail if it is there."""
        if new and self.exists(name):
            raise FileExistsError(self.full(name))
        try:
            s = self._fs.create(self._path(name), not new)
        except Exception as e:
            if new and "exist" in str(e).lower():
                raise FileExistsError(self.full(name)) from None
            raise OSError(str(e)[:300]) from e
        try:
            s.write(bytearray(data))
        finally:
            s.close()

    def read_json(self, name: str) -> Any:
        try:
            return json.loads(self.read(name))
        except ValueError as e:
            raise StoreError(f"{self.full(name)} is no JSON: {e}") from None

    def write_json(self, name: str, value: Any, new: bool = False) -> None:
        self.write(name, json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False).encode(), new)

    def move(self, name: str, to: str) -> None:
        """Rename within root; to must not be there."""
        if self.exists(to) or not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"can't rename {self.full(name)} to {self.full(to)}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def digests(self, name: str = "") -> DataFrame:
        """(path, bytes, sha256) of the data files below a folder; each is read and hashed in a task."""
        read = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.full(name))
        return read.select(F.col("path").alias("full"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def digest_list(self, name: str) -> list[dict[str, Any]]:
        """The same as a list, with paths below name, in order."""
        base = self.full(name).removeprefix("file://").rstrip("/") + "/"
        if not any(True for _ in self.walk(name)):
            return []
        rows = [(r.full.removeprefix("file:").lstrip("/"), r.bytes, r.sha256) for r in self.digests(name).collect()]
        cut = base.lstrip("/")
        return sorted(({"path": (p.split(cut, 1)[1] if cut in p else p), "bytes": n, "sha256": h} for p, n, h in rows if not p.endswith(("_SUCCESS", ".crc"))), key=lambda x: x["path"])


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@contextmanager
def writer_lock(files: Files, name: str = "writer.lock"):
    """One writer at a time: the lock is a file that only one can create."""
    files.make()
    try:
        files.write_json(name, {"since_ms": now_ms()}, new=True)
    except FileExistsError:
        raise StoreError(f"{files.root} has a writer already ({name})") from None
    try:
        yield
    finally:
        files.delete(name)


def relative(path: str) -> str:
    """A path that stays below its root: no absolute one, no step up, none that is empty."""
    parts = [p for p in str(path).split("/") if p != "."]
    if not path or str(path).startswith("/") or "\\" in path or ":" in path or any(p in ("", "..") for p in parts):
        raise StoreError(f"{path!r} doesn't stay below its folder")
    return "/".join(parts)
