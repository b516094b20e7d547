"""Vectors: dense cosine in a row, and TF-IDF as a sparse long table (id, term, weight) with unit length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import stored
from .terms import STOPWORDS
from .text import vector_tokens
from .topk import sparse_topk


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length, and where the norms' product is at most 1e-12."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 1e-12), dot(a, b) / norms).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; zeros where its length is 1e-6 or less."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 1e-6, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


#: Most frequent terms whose weights every task holds; rarer ones are looked up by a join.
HEAD = 200_000
#: Tokens that a task counts at once.
TOKENS = 2_000_000


def _one_row_an_id(texts: DataFrame) -> DataFrame:
    """texts: id, text. Texts of one id as one text; where no id repeats, nothing but ids is shuffled."""
    again = texts.groupBy("id").count().where("count > 1")
    return texts.groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text")) if not again.isEmpty() else texts


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, code and count of the different tokens of each row of tokens, by row; and the tokens that the codes stand for."""
    coded = pc.list_flatten(column).dictionary_encode()
    owner = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = max(1, len(coded.dictionary))
    pair, count = np.unique(owner * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pair // kinds, pair % kinds, count, coded.dictionary


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tokens) of at most TOKENS tokens together, or one row."""
    for batch in batches:
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        _, code, _, terms = _pairs(part.column(1))
        yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(code, minlength=len(terms)))], names=["term", "df"])


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


@dataclass(frozen=True)
class TfIdf:
    """A fitted vocabulary: term, idf = ln((1 + n) / (1 + df)) + 1. Kept as a table, so that several corpora share it."""

    idf: DataFrame

    @staticmethod
    def tokens(texts: DataFrame, stop: list[str] = STOPWORDS) -> DataFrame:
        """texts: id, text. (id, tokens): all that count, repeats included, a row an id."""
        return _one_row_an_id(texts).select("id", F.filter(vector_tokens(F.col("text")), lambda t: ~t.isin(stop)).alias("tokens"))

    @classmethod
    def fit(cls, texts: DataFrame, stop: list[str] = STOPWORDS) -> TfIdf:
        """The texts that hold a term are counted in the task before anything is shuffled by term; the vocabulary is written, as it is used several times."""
        size = texts.agg(F.countDistinct("id").alias("n"))
        frequency = cls.tokens(texts, stop).mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        return cls(stored.materialize(frequency.crossJoin(F.broadcast(size)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "vocabulary"))

    def vectors(self, texts: DataFrame, stop: list[str] = STOPWORDS) -> DataFrame:
        """(id, terms, weights): unit vectors as two arrays; terms outside the vocabulary do not count, texts without one have no row.

        Terms are counted and weighed in the row, by the HEAD most frequent terms, which each task holds. Only where the vocabulary has more
        are the others looked up by a join on the term, and met by id with what the row has."""
        head = self.idf.orderBy("idf", "term").limit(HEAD + 1).toArrow().combine_chunks()
        whole = head.num_rows <= HEAD
        head = head.slice(0, HEAD)
        model = self.idf.sparkSession.sparkContext.broadcast(head)
        tokens = self.tokens(texts, stop)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = model.value
            terms, idf = table.column("term"), table.column("idf").to_numpy()
            terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
            for part in _slices(batches):
                owner, code, count, found = _pairs(part.column(1))
                n, place = part.num_rows, pc.index_in(found, terms).fill_null(-1).to_numpy(zero_copy_only=False)[code]
                known, other = np.flatnonzero(place >= 0), np.flatnonzero(place < 0) if not whole else np.empty(0, np.int64)
                term = lambda at: found.take(pa.array(code[at]))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(owner[known], n, term(known)), _lists(owner[known], n, pa.array(count[known] * idf[place[known]])), _lists(owner[other], n, term(other)), _lists(owner[other], n, pa.array(count[other]))],
                    names=["id", "terms", "w", "rare", "tf"],
                )

        kind = tokens.schema["id"].dataType.simpleString()
        known = tokens.mapInArrow(run, f"id {kind}, terms array<string>, w array<double>, rare array<string>, tf array<bigint>")
        if not whole:
            known = stored.materialize(known, "weighed-terms")
            rare = known.select("id", F.inline(F.arrays_zip(F.col("rare").alias("term"), F.col("tf").alias("tf")))).join(self.idf, "term")
            listed = rare.groupBy("id").agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))).alias("x"))
            both = known.where("size(rare) > 0").select("id", "terms", "w").join(listed, "id", "left")
            more = lambda name, kind: F.coalesce(F.col(f"x.{name}"), F.array().cast(f"array<{kind}>"))
            known = known.where("size(rare) = 0").select("id", "terms", "w").unionByName(both.select("id", F.concat("terms", more("term", "string")).alias("terms"), F.concat("w", more("w", "double")).alias("w")))
        norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, w: s + w * w))
        told = known.where("size(terms) > 0").withColumn("n", F.array_repeat(norm, F.size("w")))
        return told.select("id", "terms", F.zip_with("w", "n", lambda w, n: w / n).alias("weights"))

    def _weighed(self, texts: DataFrame, kept: pa.Table, stop: list[str] = STOPWORDS) -> DataFrame:
        """id, n, most, total, squares: number, largest, sum and sum of squares of the weights of a text; terms, w: those of the terms of ``kept`` (term, idf).

        The HEAD most frequent terms and those kept are weighed in the row. Of the others only their entries are shuffled, and their sums met by id:
        no text's list of terms is."""
        head = self.idf.orderBy("idf", "term").limit(HEAD + 1).toArrow().combine_chunks()
        whole = head.num_rows <= HEAD
        head = head.slice(0, HEAD)
        more = kept.filter(pc.invert(pc.is_in(kept.column("term"), head.column("term"))))
        held = pa.concat_tables([head, more.select(head.column_names)]).combine_chunks()
        model = self.idf.sparkSession.sparkContext.broadcast((held, pc.is_in(held.column("term"), kept.column("term")).to_numpy()))
        tokens = self.tokens(texts, stop)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, wanted = model.value
            terms, idf = table.column("term").combine_chunks(), table.column("idf").to_numpy()
            for part in _slices(batches):
                owner, code, count, found = _pairs(part.column(1))
                n, place = part.num_rows, pc.index_in(found, terms).fill_null(-1).to_numpy(zero_copy_only=False)[code]
                known, other = np.flatnonzero(place >= 0), np.flatnonzero(place < 0) if not whole else np.empty(0, np.int64)
                of, w = owner[known], count[known] * idf[place[known]]
                most = np.zeros(n)
                np.maximum.at(most, of, w)
                sums = [np.bincount(of, x, minlength=n).astype(float) for x in (w, w * w)]  # without any entry it counts in integers
                mine = np.flatnonzero(wanted[place[known]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.bincount(of, minlength=n)), pa.array(most), *map(pa.array, sums), _lists(of[mine], n, found.take(pa.array(code[known[mine]]))), _lists(of[mine], n, pa.array(w[mine])),
                     _lists(owner[other], n, found.take(pa.array(code[other]))), _lists(owner[other], n, pa.array(count[other]))],
                    names=["id", "n", "most", "total", "squares", "terms", "w", "rare", "tf"],
                )

        kind = tokens.schema["id"].dataType.simpleString()
        told = tokens.mapInArrow(run, f"id {kind}, n bigint, most double, total double, squares double, terms array<string>, w array<double>, rare array<string>, tf array<bigint>")
        told = stored.materialize(told, "weighed-terms")
        if whole:
            return told.drop("rare", "tf")
        rare = told.select("id", F.inline(F.arrays_zip(F.col("rare").alias("term"), F.col("tf").alias("tf")))).join(self.idf, "term").select("id", (F.col("tf") * F.col("idf")).alias("x"))
        sums = stored.materialize(rare.groupBy("id").agg(F.count("*").alias("rn"), F.max("x").alias("rmost"), F.sum("x").alias("rtotal"), F.sum(F.col("x") * F.col("x")).alias("rsquares")), "rare-sums")
        both = told.drop("rare", "tf").join(sums, "id", "left").na.fill(0, ["rn", "rmost", "rtotal", "rsquares"])
        return both.select("id", (F.col("n") + F.col("rn")).alias("n"), F.greatest("most", "rmost").alias("most"), *[(F.col(c) + F.col(f"r{c}")).alias(c) for c in ("total", "squares")], "terms", "w")

    def summary(self, texts: DataFrame, stop: list[str] = STOPWORDS) -> DataFrame:
        """id, terms, largest, total: number, largest and sum of the weights of ``vectors``, without their lists."""
        none = pa.table({"term": pa.array([], pa.string()), "idf": pa.array([], pa.float64())})
        norm = F.sqrt("squares")
        return self._weighed(texts, none, stop).where("n > 0").select("id", F.col("n").alias("terms"), (F.col("most") / norm).alias("largest"), (F.col("total") / norm).alias("total"))

    def among(self, texts: DataFrame, asked: DataFrame, stop: list[str] = STOPWORDS) -> DataFrame:
        """``vectors`` of texts, at the length of the whole ones, of which only the terms of asked (vectors) are kept: all that products with asked need.

        Texts without any have no row. Where asked has more than HEAD terms, all are kept."""
        kept = asked.select(F.explode("terms").alias("term")).distinct().join(self.idf, "term").select("term", "idf").limit(HEAD + 1).toArrow()
        if kept.num_rows > HEAD:
            return self.vectors(texts, stop)
        told = self._weighed(texts, kept, stop).where("size(terms) > 0").select("id", "terms", "w", F.sqrt("squares").alias("norm"))
        return told.select("id", "terms", F.transform("w", lambda w: w / F.col("norm")).alias("weights"))

    def transform(self, texts: DataFrame, stop: list[str] = STOPWORDS) -> DataFrame:
        """The same as rows (id, term, weight)."""
        return self.vectors(texts, stop).select("id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))))


def sparse_cosine(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, entity_id, similarity) of unit vectors that share a term: an equi-join on the term and a partial sum."""
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("wq"))
    c = corpus.select(F.col("id").alias("entity_id"), "term", F.col("weight").alias("wc"))
    return q.join(c, "term").groupBy("query_id", "entity_id").agg(F.sum(F.col("wq") * F.col("wc")).alias("similarity"))


def nearest_texts(model: TfIdf, queries: DataFrame, corpus: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k texts of the corpus (id, text) nearest to each query (id, text): query_id, entity_id, similarity, rank. No pair is shuffled."""
    asked = stored.materialize(model.vectors(queries), "query-vectors")
    return sparse_topk(asked, model.among(corpus, asked), k, digits)


def text_cosine(model: TfIdf, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query, text, similarity) of the different texts of both sides (a column ``text`` each) that share a term: copies are compared once."""
    vector = lambda texts: model.transform(texts.select(F.col("text").alias("id"), "text").distinct())
    return sparse_cosine(vector(queries), vector(corpus)).withColumnsRenamed({"query_id": "query", "entity_id": "text"})


def first_of_each(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """The k smallest ids of rows with the same columns: copies score alike and ties go to the smaller id, so no other copy is among the best k."""
    alike = Window.partitionBy(*columns).orderBy("id")
    return rows.withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= k).drop("__n")
