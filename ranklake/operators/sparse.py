"""Text search: an inverted index as tables, and BM25 over it.

Scores add up as doubles; they are rounded to nine decimals before ranking, so that the order of summation decides no tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.errors import DuplicateIdError, OptionError, StoreError, UnknownIdError
from ranklake.functions import tokenize
from ranklake.operators.dense import DECIMALS, ranked
from ranklake.shared import written

K1, B = 1.2, 0.75
MOST_TF = 65_535
#: Terms of queries that are sent to all tasks, at most.
MOST_WANTED = 1_000_000
#: Terms of documents that a task counts at once, but for a longer document.
SLICE = 1 << 20


@dataclass(frozen=True)
class TextIndex:
    """postings (term, row_id, tf), docs (row_id, doc_len), terms (term, df), corpus: one row (n, avg_doc_len).

    tokens (row_id, doc_len, terms) is there where postings are made from it: a search then takes its own terms from it
    before it groups or shuffles any.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame
    tokenizer: str = tokenize.SIMPLE
    tokens: DataFrame | None = None

    def describe(self) -> DataFrame:
        """One row: documents, terms and postings, mean length, tokenizer and constants."""
        counts = self.terms.agg(F.count("*").alias("term_count"), F.coalesce(F.sum("df"), F.lit(0)).alias("posting_count"))
        return self.corpus.select(F.col("n").alias("doc_count"), "avg_doc_len").crossJoin(counts).withColumns({"tokenizer": F.lit(self.tokenizer), "k1": F.lit(K1), "b": F.lit(B)})


def build(docs: DataFrame, tokenizer: str = tokenize.SIMPLE, id_col: str = "row_id", text_col: str = "text") -> TextIndex:
    """The index of docs, one row for each id. A null text has no terms, but counts as a document.

    Texts are tokenised once, to a table in the shared folder.
    """
    return from_terms(docs.select(F.col(id_col).cast("long").alias("row_id"), tokenize.terms(text_col, tokenizer).alias("terms")), tokenizer)


def from_terms(docs: DataFrame, tokenizer: str = tokenize.SIMPLE) -> TextIndex:
    """The index of rows (row_id, terms) whose terms are normalized already."""
    tokens = written(docs.select("row_id", F.size("terms").alias("doc_len"), "terms"))
    lengths = tokens.select("row_id", "doc_len")
    twice = not lengths.groupBy("row_id").count().filter("count > 1").isEmpty()
    if not twice:  # a row is a document, so that its terms are counted in place
        return TextIndex(_postings(tokens), lengths, _frequencies(tokens), _corpus(lengths), tokenizer, tokens)
    postings = _counted(tokens.select("row_id", F.explode("terms").alias("term"))).select("term", "row_id", "tf")
    return TextIndex(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), _corpus(lengths), tokenizer, tokens)


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"))


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (terms, ...) in pieces of about SLICE terms: what counting takes grows with those."""
    for b in it:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, to - at)
            at = to


def _distinct(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a batch, each once, and by place in those: term, document and how often."""
    names = b.column("terms").flatten().dictionary_encode()
    found = _tallied(b, names.indices.to_numpy(zero_copy_only=False).astype(np.int64), _documents(b))
    return names.dictionary, *found


def _documents(b: pa.RecordBatch) -> np.ndarray:
    """The place of each term's document."""
    return np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))


def _tallied(b: pa.RecordBatch, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(1, b.num_rows)
    pairs, tf = np.unique(term * n + doc, return_counts=True)
    if len(tf) and tf.max() > MOST_TF:
        raise ValueError("a term is too frequent in a document")
    return pairs // n, pairs % n, tf


def _postings(tokens: DataFrame) -> DataFrame:
    """(term, row_id, tf) of rows (row_id, terms), one for each row_id: counted in place, neither grouped nor shuffled."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            names, term, doc, tf = _distinct(b)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), b.column("row_id").take(pa.array(doc)), pa.array(tf.astype(np.int32))], ["term", "row_id", "tf"])

    return tokens.select("row_id", "terms").mapInArrow(f, "term string, row_id long, tf int")


def _frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df) of such rows; what is shuffled is a count for each term of a task."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            names, term, _, _ = _distinct(b)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names)))], ["term", "df"])

    return tokens.select("terms").mapInArrow(f, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _counted(terms: DataFrame, *carried: str) -> DataFrame:
    """Rows (row_id, term) with tf in place of repeated ones; other columns are the same for a row_id."""
    tf = terms.groupBy("term", "row_id").agg(F.count("*").alias("tf"), *(F.first(c).alias(c) for c in carried))
    return tf.withColumn("tf", F.when(F.col("tf") <= MOST_TF, F.col("tf")).otherwise(F.raise_error(F.lit("a term is too frequent in a document"))).cast("int"))


def check_unique(docs: DataFrame, id_col: str = "row_id") -> None:
    if row := docs.groupBy(F.col(id_col).alias("id")).count().filter("count > 1").orderBy("id").first():
        raise DuplicateIdError(f"row {row.id} is there {row['count']} times")


def find_terms(index: TextIndex, terms: DataFrame) -> DataFrame:
    """(term, df) of those terms that the index has."""
    return index.terms.join(terms.select("term").distinct(), "term", "left_semi")


def bm25(tf: Column, df: Column, n: Column, doc_len: Column, avg_doc_len: Column) -> Column:
    idf = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
    share = F.lit(1 - B) + F.lit(B) * doc_len / F.greatest(avg_doc_len, F.lit(1.0))
    return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * share)


def scored(index: TextIndex, queries: DataFrame, allowed: DataFrame | None = None, qid_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, row_id, score) of all documents that share a term with a query. allowed: ids (row_id), or (qid, row_id) where
    each query has its own; it restricts who is scored, not the statistics."""
    wanted = _wanted(index, queries, qid_col, text_col)
    # the terms of all queries are few next to the postings: they prune those before anything else is shuffled
    own = wanted.select("term").distinct()
    if index.tokens is not None:
        found = _counted(index.tokens.select("row_id", "doc_len", F.explode("terms").alias("term")).join(own, "term", "left_semi"), "doc_len")
        df = found.groupBy("term").agg(F.count("*").alias("df"))
    else:
        found = index.postings.join(own, "term", "left_semi").join(index.docs, "row_id")
        df = index.terms.join(own, "term", "left_semi")
    hits = found.join(df, "term").join(wanted, "term")
    if allowed is not None:
        on = ["qid", "row_id"] if "qid" in allowed.columns else ["row_id"]
        hits = hits.join(allowed.select(*(F.col(c).cast("long").alias(c) for c in on)).distinct(), on, "left_semi")
    parts = hits.crossJoin(F.broadcast(index.corpus))  # one row
    score = bm25(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("n").cast("double"), F.col("doc_len").cast("double"), F.col("avg_doc_len"))
    return parts.groupBy("qid", "row_id").agg(F.round(F.sum(score), DECIMALS).alias("score"))


def _wanted(index: TextIndex, queries: DataFrame, qid_col: str, text_col: str) -> DataFrame:
    """(qid, term) of the queries."""
    return queries.select(F.col(qid_col).cast("long").alias("qid"), F.explode(tokenize.query_terms(text_col, index.tokenizer)).alias("term"))


def _pairs(b: pa.RecordBatch, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of names, places of documents in a batch (terms, ...), and how often the one is in the other; by name."""
    found = pc.index_in(b.column("terms").flatten(), value_set=names)
    there = found.is_valid().to_numpy(zero_copy_only=False)
    return _tallied(b, found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), _documents(b)[there])


def _scan(index: TextIndex, rows: DataFrame, wanted: list, k: int, group: dict[int, int] | None = None) -> DataFrame:
    """Hits without final ranks: of every batch of rows (row_id, doc_len, terms), the best k for each query; where queries
    have a group, of those rows that have it among theirs (groups).

    wanted are rows (qid, term): as many as a broadcast may hold. One pass over the terms counts documents, one scores
    them; terms are neither grouped nor shuffled.
    """
    names = sorted({r.term for r in wanted})
    place = {t: i for i, t in enumerate(names)}
    own: dict[int, set[int]] = {}
    for r in wanted:
        own.setdefault(r.qid, set()).add(place[r.term])
    sc = rows.sparkSession.sparkContext
    known = sc.broadcast(pa.array(names, pa.string()))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known.value), np.int64)
        for b in _slices(it):
            sums += np.bincount(_pairs(b, known.value)[0], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["term", "df"])

    df = np.zeros(len(names))
    for r in index.tokens.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    n, mean = index.corpus.first()
    shared = sc.broadcast((np.log((n - df + 0.5) / (df + 0.5) + 1.0), {q: np.array(sorted(t)) for q, t in own.items()}, group))

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, own, group = shared.value
        for b in _slices(it):
            if group is not None:
                theirs = b.column("groups")
                of = np.repeat(np.arange(b.num_rows), pc.list_value_length(theirs).to_numpy(zero_copy_only=False))
                flat = theirs.flatten().to_numpy(zero_copy_only=False)
                may: dict[int, np.ndarray] = {}
            term, doc, tf = _pairs(b, known.value)
            length = b.column("doc_len").to_numpy(zero_copy_only=False)[doc]
            part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1.0)))
            bounds = np.searchsorted(term, np.arange(len(idf) + 1))
            ids = b.column("row_id").to_numpy(zero_copy_only=False)
            qids, hits, scores = [], [], []
            for q, terms in own.items():
                at = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in terms])
                some = np.bincount(doc[at], minlength=b.num_rows) > 0
                if group is not None:
                    g = group.get(q)
                    if g not in may:
                        may[g] = np.bincount(of[flat == g], minlength=b.num_rows) > 0
                    some &= may[g]
                which = np.flatnonzero(some)
                if not len(which):
                    continue
                score = np.round(np.bincount(doc[at], part[at], b.num_rows)[which], DECIMALS) + 0.0
                if k < len(which):  # all that tie with the k-th stay
                    good = score >= np.partition(score, len(score) - k)[len(score) - k]
                    which, score = which[good], score[good]
                best = np.lexsort((ids[which], -score))[:k]
                qids.append(np.full(len(best), q, np.int64))
                hits.append(ids[which[best]])
                scores.append(score[best])
            if qids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qids, hits, scores)], ["qid", "row_id", "score"])

    return rows.select("row_id", "doc_len", "terms", *(["groups"] if group is not None else [])).mapInArrow(f, "qid long, row_id long, score double")


def search(index: TextIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, check: bool = False, qid_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, rank, row_id, score): the k best documents for each query, by score, then row_id.

    Any shared term will do; those without one are no hits. Queries of up to MOST_WANTED terms together are sent to all tasks, which
    score their documents in place; terms of more queries, of queries with their own allowlists or for an index that was
    read again are joined, with the same result. With check, ids in allowed that the index lacks are an error.
    """
    if k < 0:
        raise OptionError("k must not be negative")
    if check and allowed is not None:
        check_known(index, allowed)
    if k and index.tokens is not None and allowed is not None and "qid" in allowed.columns:
        each = queries.select(F.col(qid_col).alias("qid"), F.col(text_col).alias("query"), F.col(qid_col).cast("long").alias("group"))
        if (out := _in_groups(index, each, k, allowed.select("row_id", F.col("qid").alias("group")))) is not None:
            return out
    elif k and index.tokens is not None:
        wanted = _wanted(index, queries, qid_col, text_col).limit(MOST_WANTED + 1).collect()
        if len(wanted) <= MOST_WANTED:
            rows = index.tokens if allowed is None else index.tokens.join(allowed.select(F.col("row_id").cast("long").alias("row_id")), "row_id", "left_semi")
            return ranked(_scan(index, rows, wanted, k), k)
    return ranked(scored(index, queries, allowed, qid_col, text_col), k)


def _in_groups(index: TextIndex, queries: DataFrame, k: int, groups: DataFrame) -> DataFrame | None:
    """search_in_groups() in place, or None if the queries have too many terms for that."""
    wanted = _wanted(index, queries, "qid", "query").limit(MOST_WANTED + 1).collect()
    if index.tokens is None or len(wanted) > MOST_WANTED:
        return None
    of = {r.qid: r.group for r in queries.select(F.col("qid").cast("long").alias("qid"), F.col("group").cast("long").alias("group")).join(_wanted(index, queries, "qid", "query").select("qid").distinct(), "qid").filter("group is not null").collect()}
    theirs = groups.select(F.col("row_id").cast("long").alias("row_id"), F.col("group").cast("long").alias("group")).groupBy("row_id").agg(F.collect_set("group").alias("groups"))
    return ranked(_scan(index, index.tokens.join(theirs, "row_id"), [w for w in wanted if w.qid in of], k, of), k)


def search_in_groups(index: TextIndex, queries: DataFrame, k: int, groups: DataFrame) -> DataFrame:
    """The k best documents for each query (qid, query, group) among those of its group: groups has them as (row_id, group).

    The same as search() with all pairs of a query and a row of its group, without listing them. Groups are whole numbers,
    null is none; a row may be in several, a query in one.
    """
    if k < 0:
        raise OptionError("k must not be negative")
    if k and (out := _in_groups(index, queries, k, groups)) is not None:
        return out
    pairs = queries.select("qid", F.col("group").cast("long").alias("group")).join(groups.select("row_id", F.col("group").cast("long").alias("group")), "group")
    return search(index, queries, k, pairs.select("qid", "row_id"))


def check_known(index: TextIndex, allowed: DataFrame) -> None:
    if row := allowed.select(F.col("row_id").cast("long").alias("row_id")).join(index.docs, "row_id", "left_anti").orderBy("row_id").first():
        raise UnknownIdError(f"the text index has no row {row.row_id}")


def _repeated(postings: DataFrame) -> DataFrame:
    """Pairs (term, row_id) that come up more than once. All are told apart by hashes first, and only those of equal ones by themselves."""
    key = F.xxhash64("term", "row_id")  # nearly all differ: summing up before the shuffle would only spill
    suspect = postings.select(key.alias("key")).repartition("key").groupBy("key").count().filter("count > 1").select("key")
    return postings.join(suspect, key == suspect["key"], "left_semi").groupBy("term", "row_id").count().filter("count > 1")


def checks(index: TextIndex) -> DataFrame:
    """(check, failures): what must hold between the tables."""
    spark = index.docs.sparkSession
    index = replace(index, postings=written(index.postings))  # five scans
    by_doc = index.postings.groupBy("row_id").agg(F.sum("tf").alias("len"))
    by_term = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    parts = {
        "row_ids are unique": index.docs.groupBy("row_id").count().filter("count > 1"),
        "postings are unique": _repeated(index.postings),
        "lengths are sums of frequencies": index.docs.join(by_doc, "row_id", "full_outer").filter("doc_len is null or doc_len <> coalesce(len, 0)"),
        "document frequencies are counts": index.terms.join(by_term, "term", "full_outer").filter("df is null or n is null or df <> n"),
        "frequencies are positive": index.postings.filter(f"tf is null or tf < 1 or tf > {MOST_TF}"),
        "corpus counts its documents": index.corpus.crossJoin(index.docs.agg(F.count("*").alias("docs"))).filter("n <> docs"),
    }
    out = None
    for name, bad in parts.items():
        row = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "check string, failures long")


def check_same_rows(index: TextIndex, dense_ids: DataFrame) -> None:
    """Raise unless the text index and a dense index (row_id) have the same rows."""
    other = dense_ids.select("row_id", F.lit(1).alias("d"))
    if not index.docs.select("row_id", F.lit(1).alias("s")).join(other, "row_id", "full_outer").filter("s is null or d is null").isEmpty():
        raise StoreError("the text index and the dense index have different rows")
