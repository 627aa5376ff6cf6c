"""Term extraction for text search, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE, IDENTIFIERS = "simple", "identifiers"


def normalized(term: Column) -> Column:
    """Lower case without plural s: each s at the end goes while more than four letters are left."""
    return F.regexp_replace(F.lower(term), "^(.{4,}?)s+$", "$1")


def _kept(terms: Column) -> Column:
    return F.filter(F.transform(terms, normalized), lambda t: F.length(t) >= 3)


def runs(text: str | Column) -> Column:
    """Longest runs of ASCII letters and digits; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))


def subtokens(run: Column) -> Column:
    """A run, and if capitals divide it, its pieces after it."""
    pieces = F.split(run, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.when(F.size(pieces) > 1, F.concat(F.array(run), pieces)).otherwise(F.array(run))


def terms(text: str | Column, tokenizer: str = SIMPLE) -> Column:
    """The terms of a text, in order and as often as they come up: three letters or more once normalized."""
    if tokenizer == SIMPLE:  # as _kept(runs(text)), by four passes over the whole text in place of two a term
        c = F.col(text) if isinstance(text, str) else text
        ascii_ = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]++", " "))
        return F.regexp_extract_all(F.regexp_replace(ascii_, "(?<=[a-z0-9]{4})s++(?![a-z0-9])", ""), F.lit("([a-z0-9]{3,}+)"), F.lit(1))
    if tokenizer == IDENTIFIERS:
        return _kept(F.flatten(F.transform(runs(text), subtokens)))
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def query_terms(text: str | Column, tokenizer: str = SIMPLE) -> Column:
    """terms(), each once, where it first is."""
    return F.array_distinct(terms(text, tokenizer))
