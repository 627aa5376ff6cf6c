"""Text preparation: Markdown chunks and hashed embeddings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,3})\s+(.*?)\s*$")
BREAKS = ("\n\n", "\n", " ", "")


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of each part of a Markdown text, cut at headings of the first three levels outside code blocks.

    The heading is the nearest of the deepest level that the part is under; the heading's line stays in the body.
    """
    out: list[tuple[str, list[str]]] = [("(no heading)", [])]
    path, fence = ["", "", ""], ""
    for line in text.split("\n"):
        bare = line.strip()
        if not fence and bare.startswith(("```", "~~~")):
            fence = bare[:3]
        elif fence and bare.startswith(fence):
            fence = ""
        elif not fence and (m := HEADING.match(bare)):
            level = len(m[1])
            path[level - 1 :] = [m[2]] + [""] * (3 - level)
            out.append((path[2] or path[1] or path[0] or "(no heading)", []))
        out[-1][1].append(line)
    joined = [(h, "\n".join(body).strip()) for h, body in out]
    return [(h, body) for h, body in joined if body]


def pieces(text: str, size: int = 800, overlap: int = 120, breaks: tuple[str, ...] = BREAKS) -> list[str]:
    """Pieces of at most size characters, broken at paragraphs if that will do, else at lines, blanks, anywhere; each begins
    with what ended the one before, up to overlap characters."""
    mark = next((b for b in breaks if b == "" or b in text), "")
    finer = breaks[breaks.index(mark) + 1 :]
    parts = list(text) if mark == "" else text.split(mark)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        if joined := mark.join(held).strip():
            out.append(joined)

    for part in filter(None, parts):
        if len(part) > size:
            flush()
            held, length = [], 0
            out += pieces(part, size, overlap, finer)
            continue
        gap = len(mark) if held else 0
        if length + gap + len(part) > size:
            flush()
            while held and (length > overlap or length + len(mark) + len(part) > size):
                length -= len(held.pop(0)) + (len(mark) if held else 0)
            gap = len(mark) if held else 0
        held.append(part)
        length += gap + len(part)
    flush()
    return out


def markdown_chunks(files: DataFrame, path_col: str = "path", text_col: str = "text", size: int = 800, overlap: int = 120) -> DataFrame:
    """(id, document, source, section, doc_type, file_name) of the chunks of Markdown texts, ids path#0000 in order.

    doc_type is docs below docs/, else root. Null and blank texts have no chunks.
    """
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                chunks = [(h, p) for h, body in sections(text or "") for p in pieces(body, size, overlap)]
                kind, name = "docs" if (path or "").startswith("docs/") else "root", (path or "").rsplit("/", 1)[-1]
                out += [(f"{path}#{i:04d}", p, path, h, kind, name) for i, (h, p) in enumerate(chunks)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["id", "document", "source", "section", "doc_type", "file_name"])

    return rows.mapInArrow(f, "id string, document string, source string, section string, doc_type string, file_name string")


MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def _fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 & MASK
    return h


def hash_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Unit vectors that depend on nothing but the texts' bytes: each state of a generator seeded by them is a coordinate."""
    state = np.array([_fnv1a(t.encode()) for t in texts], np.uint64) ^ np.uint64(GOLDEN)
    out = np.empty((len(texts), dim), np.float32)
    for k in range(dim):
        z = state + np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        state = z ^ (z >> np.uint64(31))
        out[:, k] = (state >> np.uint64(11)).astype(np.float64) / 2**53 * 2 - 1
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 0, out / np.where(norm > 0, norm, 1), out)


def hash_embedding(text: str | Column, dim: int = 384) -> Column:
    """A deterministic stand-in for an embedding; null for null. It says nothing about meaning."""

    def embed(t):
        vectors = iter(hash_vectors([x for x in t if x is not None], dim))
        return pd.Series([None if x is None else next(vectors) for x in t], dtype=object)

    embed.__annotations__ = {"t": pd.Series, "return": pd.Series}
    return F.pandas_udf(embed, "array<float>")(F.col(text) if isinstance(text, str) else text)
