"""Operator 11: quality rules over a document and over the lines that a host repeats.

A document is measured alone first: words, symbols, lines that it repeats and words
in five-word windows that it repeats.  Every line with a word is then normalised
(lower case, white space to one blank, digits to 0) and hashed.  A line's frequency is
the number of different texts of one host that hold it: copies of a text count once,
as finding copies is the work of others and a copied page is not made of boilerplate.
A line is above the limits if more than ``LEAST_TEXTS`` texts and more than
``PERCENT`` in a hundred of the host's different texts hold it.  Such lines are
removed; a document that keeps fewer than ``WORDS_LEFT`` words, or less than
``PERCENT_LEFT`` in a hundred of its words, is depleted and rejected.

Texts are read once, in Arrow batches; what goes on is a row of numbers and the
hashes of its lines.  Counting is a distinct of (host, line, text) and a count of
(host, line), both combined before the shuffle, so a line that every text holds is no
hot key.  Frequent lines are broadcast while they are few; beyond that the frequent lines with
most rows are, and the others are shuffled (``components.join_by_key``).

Defined results: a null text has no words; a null host is a host of its own; rows that
repeat and null ids are documents of their own; an empty table gives an empty result;
other columns are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .components import join_by_key
from .storage import cols, materialize, unused

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Base rules: fewer words, or a larger share of words in repeated windows, fail.
LEAST_WORDS, PERCENT_REPEATED = 10, 20
#: Limits of a line, and what must be left of a document.
LEAST_TEXTS, PERCENT = 10, 2
WORDS_LEFT, PERCENT_LEFT = 10, 30
#: Frequent lines up to this many are broadcast.
BROADCAST_LINES = 200_000
#: Texts and characters measured at once (a longer text is one of its own).
BATCH_TEXTS, BATCH_CHARS = 512, 1 << 20
_SPACE = "\t\n\v\f\r "
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hash(data: bytes) -> int:
    """64 bits, signed."""
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: str) -> int:
    return _hash(b" ".join(line.lower().encode().split()).translate(_DIGITS))


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number a pair of numbers, equal where the pairs are."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]


def repeat_words(texts: list[list[bytes]]) -> np.ndarray:
    """For each list of words how many stand in a window of five that the list holds twice or more."""
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in chain.from_iterable(texts)), np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= WINDOW:
        pairs = _joint(ids[:-1], ids[1:])
        windows = _joint(_joint(pairs[:-2], pairs[2:])[:-1], ids[4:])
        start = np.flatnonzero(owner[4:] == owner[:-4])
        _, which, counts = np.unique(owner[start] * (windows.max() + 1) + windows[start], return_inverse=True, return_counts=True)
        start = start[counts[which] > 1]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + WINDOW, -1)
    return np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=len(texts))


def _lines(text: str) -> tuple[int, dict[int, int]]:
    """Lines with a word that are equal to an earlier one, and the words of every normalised line."""
    seen: set[str] = set()
    again, words = 0, {}
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            again += line in seen
            seen.add(line)
            h = line_hash(line)
            words[h] = words.get(h, 0) + n
    return again, words


def _measured(texts: list[str]) -> list[pa.Array]:
    """The measures, the text's digest, the hashes of its lines and their words."""
    split = [t.encode().split() for t in texts]
    lines = [_lines(t) for t in texts]
    ints = lambda values: pa.array(values, pa.int64())
    lists = pa.list_(pa.int64())
    return [
        ints([len(w) for w in split]),
        ints([len(t) - sum(map(t.count, _SPACE)) for t in texts]),
        ints([sum(map(t.count, SYMBOLS)) for t in texts]),
        ints([again for again, _ in lines]),
        ints(repeat_words(split)),
        ints([_hash(t.encode()) for t in texts]),
        pa.array([list(words) for _, words in lines], lists),
        pa.array([list(words.values()) for _, words in lines], lists),
    ]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    start = chars = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()):
        if i > start and (i - start >= BATCH_TEXTS or chars + n > BATCH_CHARS):
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += n
    yield batch.slice(start)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """A written row a document: row (a number of its own), doc_id, host, the five measures, digest, lines and line_words."""
    names = [*_MEASURES, "digest", "lines", "line_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 3):
                made = _measured([t or "" for t in batch.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["row", "doc_id", "host", *names])

    own = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    read = docs.select(own.alias("row"), "doc_id", F.col(host).alias("host"), "text")
    kinds = ", ".join(f"{n} {'array<long>' if n.startswith('line') else 'long'}" for n in names)
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[:3])
    return materialize(read.mapInArrow(run, f"{carried}, {kinds}"), "line-measures")


def _held(measured: DataFrame) -> DataFrame:
    """A row for each document and different line of it."""
    return measured.select("row", "host", "digest", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))).alias("x")).select("row", "host", "digest", "x.line", "x.words")


def line_frequencies(measured: DataFrame) -> DataFrame:
    """Lines of more than LEAST_TEXTS texts of a host: host, line, n (texts), rows (documents), texts (of the host), frequent."""
    texts = measured.groupBy("host", "digest").count().groupBy(F.col("host").alias("__host")).agg(F.count("*").alias("texts"))
    lines = _held(measured).groupBy("host", "line", "digest").agg(F.count("*").alias("rows"))
    lines = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).where(F.col("n") > LEAST_TEXTS)
    above = F.col("n") * 100 > F.col("texts") * PERCENT
    return lines.join(texts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host").withColumn("frequent", above)


def _frequent_held(measured: DataFrame) -> DataFrame:
    """row, line, words of every frequent line of a document."""
    key = F.xxhash64(F.col("host").isNull(), "host", "line").alias("key")
    frequent = materialize(line_frequencies(measured).where("frequent").select(key, F.col("rows").alias("n")), "frequent-lines")
    held = _held(measured).select("row", "line", "words", key)
    if frequent.count() <= BROADCAST_LINES:
        return held.join(F.broadcast(frequent.select("key")), "key", "left_semi")
    return join_by_key(held, frequent, "key", measured.select(F.sum(F.size("lines"))).first()[0] or 0).drop("key")


def _judged(measured: DataFrame, held: DataFrame) -> DataFrame:
    lost = held.groupBy("row").agg(F.sum("words").alias("__lost"), F.count("*").alias("__cut"))
    told = measured.drop("lines", "line_words", "digest").join(lost, "row", "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * PERCENT_REPEATED)
    told = told.withColumn("words_left", F.col("n_words") - F.coalesce("__lost", F.lit(0)))
    depleted = (F.col("words_left") < WORDS_LEFT) | (F.col("words_left") * 100 < F.col("n_words") * PERCENT_LEFT)
    return told.select("row", "doc_id", *_MEASURES, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "words_left", F.coalesce("__cut", F.lit(0).cast("long")).alias("lines_cut"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept, words_left and lines_cut (different lines above the limits)."""
    measured = measure(docs, host)
    return _judged(measured, _frequent_held(measured)).drop("row")


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, all columns, without their lines above the limits; other columns stay as they are."""
    row, cut = unused(docs.columns, "__row"), unused(docs.columns, "__cut")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-texts")
    measured = measure(numbered.select(F.col(row).alias("__row"), "doc_id", F.col(f"`{host}`").alias("host"), "text"), "host")
    held = materialize(_frequent_held(measured), "lines-cut")
    lines = held.groupBy("row").agg(F.collect_list("line").alias(cut))
    told = _judged(measured, held).where("kept").select(F.col("row").alias(row)).join(lines.withColumnRenamed("row", row), row, "left")
    joined = numbered.join(told, row).select(*cols(docs.columns), cut)
    # Arrow functions take no names with dots in them: the columns are numbered meanwhile.
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                text if not gone else "\n".join(x for x in text.split("\n") if not x.encode().split() or line_hash(x) not in gone)
                for text, gone in zip(batch.column(place).to_pylist(), map(lambda x: set(x or ()), batch.column(batch.num_columns - 1).to_pylist()), strict=True)
            ]
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    return joined.toDF(*names, "cut").mapInArrow(run, schema).toDF(*docs.columns)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), base AS (
  SELECT r, doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, md5(text) AS digest
  FROM w
), lines AS (
  SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
), own AS (
  SELECT r, line, len(words) AS n, regexp_replace(lower(array_to_string(words, ' ')), '[0-9]', '0', 'g') AS norm FROM lines WHERE len(words) > 0
), dup AS (
  SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM own GROUP BY r
), grams AS (
  SELECT r, i, words[i:i + {WINDOW - 1}] AS gram FROM (SELECT r, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w WHERE len(words) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM twice) GROUP BY r
), texts AS (
  SELECT host, count(DISTINCT digest) AS texts FROM base GROUP BY host
), frequent AS (
  SELECT b.host, o.norm FROM own o JOIN base b USING (r) JOIN texts t ON t.host IS NOT DISTINCT FROM b.host
  GROUP BY b.host, o.norm, t.texts HAVING count(DISTINCT b.digest) > {LEAST_TEXTS} AND count(DISTINCT b.digest) * 100 > t.texts * {PERCENT}
), lost AS (
  SELECT o.r, sum(o.n)::BIGINT AS lost, count(DISTINCT o.norm)::BIGINT AS lines_cut
  FROM own o JOIN base b USING (r) JOIN frequent f ON f.norm = o.norm AND f.host IS NOT DISTINCT FROM b.host GROUP BY o.r
), told AS (
  SELECT b.*, coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, b.n_words - coalesce(l.lost, 0) AS words_left, coalesce(l.lines_cut, 0) AS lines_cut
  FROM base b LEFT JOIN dup d USING (r) LEFT JOIN covered c USING (r) LEFT JOIN lost l USING (r)
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {PERCENT_REPEATED} * n_words AS base_failed FROM told
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left >= {WORDS_LEFT} AND words_left * 100 >= n_words * {PERCENT_LEFT} AS kept, words_left, lines_cut
FROM judged
"""
