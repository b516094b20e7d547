"""The corpus pipeline: documents to a training mixture, in five written stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs; all but the last return the
columns of ``documents``.  A lost executor costs at most the stage that runs.

For every stage: rows with a null id and rows that repeat are documents of their
own unless the stage says otherwise; further columns are kept, whatever their names;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import chunk_dedup, decontaminate, langid, mixing, near_copies
from lodestar.llm.storage import cols, materialize, unused

#: A text whose nearest language is further than this is no text of a known language; of a text with fewer letters the cosine says little.
LEAST_COSINE, TELLING_LETTERS = 0.2, 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those of TELLING_LETTERS letters or more that are unlike every language.

    Without a labelled row there is no language to compare with: then documents with a letter stay."""
    languages, prototypes = langid.train(docs.select("doc_id", "text", "lang"))
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = unused(docs.columns, "__lang_pred"), unused(docs.columns, "__lang_score")
    told = langid.predict(docs, languages, prototypes, pred, score)
    few = F.length(F.regexp_replace("text", r"\P{L}+", "")) < TELLING_LETTERS
    return told.where((F.col(pred) != langid.UNKNOWN) & ((F.col(score) >= LEAST_COSINE) | few)).select(*cols(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; of equal rows of one id one stays.

    Texts of one id count as linked and all of them stay if their id does; rows with a null id stay. Texts without words are one group."""
    found = near_copies.near_copies(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*cols(docs.columns))
    again = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    again = mixing.bounded_broadcast(again, again.count())
    # Only rows of repeated ids are compared as rows; Spark keeps one a group before it shuffles.
    digest, place = unused(docs.columns, "__digest"), unused(docs.columns, "__place")
    repeated = kept.join(again, "doc_id", "left_semi").withColumn(digest, F.sha2(F.to_json(F.struct(*cols(docs.columns))), 256))
    first = repeated.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(digest))).where(F.col(place) == 1)
    return kept.join(again, "doc_id", "left_anti").select(*cols(docs.columns)).unionByName(first.select(*cols(docs.columns)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has (a null id comes last); a document that held nothing else goes.

    Null and empty texts stay as they are."""
    return chunk_dedup.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item; null and empty texts overlap with none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mixture with size, source_size, target, taken and copies; documents that it leaves out go.

    A null text has size 0; a null source is a source of its own."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: Vectors, shingle sets and rolling hashes are beyond SQL; tests/llm holds the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
