"""Operator 13: importance resampling towards a target distribution.

A document's features are its words, hashed into ``BUCKETS`` buckets.  A bucket's gain
says how much more frequent it is in the target texts than in the corpus; a document's
weight is the mean gain of its features, and its score the weight plus Gumbel noise
from a hash of its id, so that the highest scores are a draw without replacement.

1. Counting: every task counts its buckets in one array; the arrays are added per
   bucket, and ``BUCKETS`` numbers a side reach the driver.
2. Scoring: the gains are one broadcast array of ``BUCKETS`` numbers.  Texts are read
   a second time rather than written out as features.
3. The cut: a quantile sketch brackets the score at which the drawn documents end.  Exact
   counts of the scores above and inside the bracket validate it; as long as the end is not
   inside, the bracket is widened.  Documents above it are drawn, documents
   below are not, and only the bracket is sorted to find the place where the draw ends.
4. Ranks: the drawn documents are dealt out by ranges of their order, numbered inside
   their range, and moved by the number of documents in the ranges before.

Nothing is sorted in one task.  Rows of one id or score are told apart by further columns
and a number of the written row, so a hot id is split over ranges.

Defined results: a null text has no words; rows that repeat are documents of their own;
the id of a row without one is the empty text in its hash, and it comes last among ties; equal rows have
different ranks; without target texts the gains compare with an even distribution; an empty table
gives an empty result; other columns are ignored by ``resample`` and kept by ``drawn``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cols, materialize, unused

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Half the width of the first bracket, as a share of the documents; it doubles until the bracket holds.
BRACKET = 0.005
#: Rows of one range of the order, and the most ranges of one shuffle.
RANGE_ROWS, MAX_RANGES = 200_000, 20_000
#: Words whose buckets a task remembers.
_REMEMBERED = 1 << 18
#: Digits, letters in lower case and everything beyond ASCII are words, in UTF-8 as well.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class _Buckets(dict):
    """The bucket of a word, remembered for as many words as fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = at = zlib.crc32(word) % BUCKETS
        return at


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, buckets = np.zeros(BUCKETS, np.int64), _Buckets()
        for batch in batches:
            for text in batch.column(0):
                counts = Counter(words(text.as_py()))
                for word, n in counts.items():
                    total[buckets[word]] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    table = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of every bucket."""
    many, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.floor(1000 * np.log((target + 1.0) * many / ((corpus + 1.0) * wanted))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel variate of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """All columns of docs but text, and n_features, weight, score."""
    model = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, buckets = model.value.tolist(), _Buckets()
        for batch in batches:
            features, weights = [], []
            for text in batch.column(batch.num_columns - 1):
                found = words(text.as_py())
                features.append(len(found))
                weights.append(sum(table[buckets[w]] for w in found) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(features, pa.int64()), pa.array(weights, pa.int64())], names=[*kept, "n_features", "weight"])

    read = docs.select(*cols(kept), "text")
    schema = read.select(*cols(kept)).schema.add("n_features", "long").add("weight", "long")
    return read.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]


def numbered(rows: DataFrame, count: int, before: int) -> DataFrame:
    """rows with rank: their place in the order, counted from before + 1; count is how many they are."""
    n = min(MAX_RANGES, max(1, -(-count // RANGE_ROWS)))
    dealt = rows.repartitionByRange(n, *_order()).sortWithinPartitions(*_order())
    # The id counts the rows of a task from 0 and has the task's number above bit 33; writing it makes it fixed.
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "dealt-scores").withColumn("range", F.shiftright("at", 33).cast("int"))
    # One row a range, MAX_RANGES at most.
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect())
    starts, start = [], before
    for at, size in sizes:
        starts.append((at, start))
        start += size
    table = rows.sparkSession.createDataFrame(starts, "range int, start long")
    place = F.col("at") - F.shiftleft(F.col("range").cast("long"), 33)
    return dealt.join(F.broadcast(table), "range").withColumn("rank", F.col("start") + place + 1).drop("at", "range", "start")


def _bracket(eligible: DataFrame, count: int, wanted: int, width: float) -> tuple[int, int, int, int]:
    """Scores low and high, and the exact numbers of scores above high and from low to high; the draw ends inside."""
    while True:
        share = 1 - wanted / count
        ends = [max(0.0, share - width), min(1.0, share + width)]
        low, high = eligible.agg(F.percentile_approx("score", ends, min(1_000_000, int(20 / width)))).first()[0]
        above, inside = eligible.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score").between(low, high), 1))).first()
        if above < wanted <= above + inside or above + inside == count and above == 0:
            return low, high, above, inside
        width *= 2


def ranked(table: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, width: float = BRACKET) -> DataFrame:
    """A written table with row, doc_id, n_features, score: adds rank, null for what is not drawn."""
    chosen = F.col("n_features") >= least_words
    eligible = table.where(chosen)
    count = eligible.count()
    wanted = count * percent // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return table.withColumn("rank", none)
    low, high, above, inside = _bracket(eligible, count, wanted, width)
    over, between = chosen & (F.col("score") > high), chosen & F.col("score").between(low, high)
    middle = numbered(table.where(between), inside, above)
    middle = middle.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return numbered(table.where(over), above, 0).unionByName(middle).unionByName(table.where(~over & ~between).withColumn("rank", none))


def _scored_table(docs: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return materialize(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank (from 1 by descending score; null if not drawn)."""
    return ranked(_scored_table(docs.select("doc_id", "text"), target, seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents of the draw, all columns."""
    key = unused(docs.columns, "__row")
    texts = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "resample-texts")
    told = _scored_table(texts.select("doc_id", "text", F.col(key).alias("key")), target, seed)
    chosen = ranked(told, percent, least_words).where("rank IS NOT NULL").select(F.col("key").alias(key))
    return texts.join(chosen, key, "left_semi").drop(key)


SQL = rf"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) AS t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, FALSE AS target FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, TRUE FROM benchmark
), found AS MATERIALIZED (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS MATERIALIZED (
  SELECT r, target, word, count(*) AS n FROM (SELECT r, target, unnest(words) AS word FROM found) GROUP BY r, target, word
), spelt AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM features)
), coded AS (
  SELECT word, list_transform(generate_series(1, length(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS codes FROM spelt
), hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM coded, crc
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM features JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS s, sum(t) AS t FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln((sums.t + 1) * (totals.s + {BUCKETS}) / ((sums.s + 1) * (totals.t + {BUCKETS}))))::BIGINT AS gain FROM sums, totals
), summed AS (
  SELECT r, sum(n * gain)::BIGINT AS gain, sum(n)::BIGINT AS n FROM features JOIN hashed USING (word) JOIN gain USING (bucket) WHERE NOT target GROUP BY r
), weighed AS (
  SELECT f.doc_id, coalesce(n, 0) AS n_features, coalesce(CASE WHEN gain >= 0 THEN gain // n ELSE -((n - 1 - gain) // n) END, 0) AS weight,
         ('0x' || substr(sha256('{SEED}:' || coalesce(CAST(f.doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM found f LEFT JOIN summed s USING (r) WHERE NOT target
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
