"""Operator 7: substring dedup by content-defined chunks of a gear rolling hash.

The gear hash rolls over the bytes of the text's lower-cased, space-joined words
(``h = (h << 1) + GEAR[byte]``, of which the last ``WINDOW`` bytes count).  A chunk
ends after a word whose hash is the smallest among the ``REACH`` words on either
side: the cut depends on nearby bytes alone, so an insertion shifts no cut beyond
its neighbourhood, and chunks have ``REACH + 1`` words or more.

Chunks are deduplicated by digest: the smallest doc_id that holds a chunk keeps
it, in every later document it is a repeat.  Repeats that follow each other
without a gap form a passage; passages of ``MIN_WORDS`` words or more are reported
and cut out, so common phrases of one chunk stay.  Cuts need a little context, so
at most a chunk at either end of a shared passage escapes: ``MIN_WORDS`` is far
below the 50 words of a passage that must be found.

Digests are 64 bits; a wrong report needs several neighbouring chunks to collide
at once.  Chunks are combined per digest before the shuffle, and the join back is
an equi-join whose skewed side Spark splits, so a passage in a third of all
documents stays spread.

Runs are built per text: a row's key is its doc_id and a hash of its text, so that the
texts need no copy with numbers to find their spans again.  Rows with one key are
equal and have the same spans; how many there are is counted.  The doc_id alone says
which document keeps a passage.

Defined results: null and empty texts have no chunks; repeats inside one document
(or between rows of one id) are left alone; each row of a repeated id has its own
passages, repeated rows have the same ones, once a row; a null id comes after all
ids; other columns are kept by ``remove_repeats`` and ignored by
``repeated_passages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cols, materialize, unused

WINDOW = 16
REACH = 3
MIN_WORDS = 20
_LAST = (1 << 63) - 1
_SLICE = 1 << 20
#: One random 64-bit number a byte value, from a rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 2016) for b in range(256)], np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def rolling_hashes(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes before each of the sorted ends (fewer at the start)."""
    out = np.empty(len(ends), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, len(raw), _SLICE):
        first = max(0, lo - WINDOW + 1)
        h = GEAR[raw[first : lo + _SLICE]]
        span = 1
        while span < WINDOW:  # the hash of 2n bytes from two of n
            h[span:] = h[span:] + (h[:-span] << np.uint64(span))
            span *= 2
        here = slice(*np.searchsorted(ends, [lo + 1, lo + _SLICE + 1]))
        out[here] = h[ends[here] - 1 - first]
    return out


def cut_points(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Indices of words that end a chunk; the last word always does."""
    n = len(hashes)
    top = np.full(reach, np.iinfo(np.uint64).max, np.uint64)
    padded = np.concatenate((top, hashes, top))
    cut = np.ones(n, bool)
    for k in range(1, reach + 1):
        cut &= hashes < padded[reach - k : reach - k + n]
        cut &= hashes <= padded[reach + k : reach + k + n]
    cut[: min(reach, n)] = False
    cut[max(0, n - reach) :] = False
    cut[n - 1 :] = True
    return np.flatnonzero(cut)


def chunks(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """First word, number of words and digest of each chunk."""
    words = text.lower().split()
    if not words:
        return [], [], []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = cut_points(rolling_hashes(joined, ends))
    first = np.concatenate(([0], last[:-1] + 1))
    starts = np.concatenate(([0], ends[:-1] + 1))[first].tolist()
    digest = xxhash.xxh3_64_intdigest
    return first.tolist(), (last - first + 1).tolist(), [digest(joined[a:b]) for a, b in zip(starts, ends[last].tolist(), strict=True)]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            keys, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            parts: list[tuple[np.ndarray, ...]] = []
            rows = 0
            for i, (row, doc) in enumerate(zip(keys, ids, strict=True)):
                at, n, digest = chunks(texts[i].as_py() or b"")
                same = np.full(len(at), row, np.int64), np.full(len(at), doc, np.int64)
                parts.append((np.array(digest, np.uint64).view(np.int64), *same, np.array(at, np.int32), np.array(n, np.int32)))
                rows += len(at)
                if rows > 100_000 or i == len(ids) - 1:
                    arrays = [pa.array(np.concatenate(column)) for column in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["digest", "row", "doc", "at", "n"])
                    parts, rows = [], 0


def _key() -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")


def _passages(docs: DataFrame, min_words: int) -> DataFrame:
    """row, doc, first_word, n_words, first_doc_id, rows (how many equal rows have it)."""
    keyed = docs.select("doc_id", "text").select(*_key(), "text")
    rows = materialize(keyed.mapInArrow(_chunk_rows, "digest long, row long, doc long, at int, n int"), "chunks")
    shared = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("latest")).where("first < latest").select("digest", "first")
    # Equal rows have equal chunks: they are combined before the shuffle.
    later = rows.join(shared, "digest").where("doc > first").groupBy("row", "doc", "at", "n").agg(F.min("first").alias("first"), F.count("*").alias("rows"))
    along = Window.partitionBy("row", "doc").orderBy("at")
    gap = F.col("at") != F.lag(F.col("at") + F.col("n"), 1, -1).over(along)
    runs = later.withColumn("run", F.sum(gap.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passages = runs.groupBy("row", "doc", "run").agg(F.min("at").alias("first_word"), F.sum("n").cast("int").alias("n_words"), F.min("first").alias("first_doc_id"), F.min("rows").alias("rows"))
    return passages.where(F.col("n_words") >= min_words)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first_word, n_words of passages that an earlier document has, row by row; first_doc_id: that document."""
    passages = _passages(docs, min_words)
    each = passages.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "first_word", "n_words", "first_doc_id")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words (first, count); white space before a cut stays."""
    raw = text.encode()
    space = np.concatenate(([True], _SPACES[np.frombuffer(raw, np.uint8)], [True]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    kept, at = [], 0
    for first, count in sorted(x for x in spans if x[0] + x[1] <= len(starts)):
        kept.append(raw[at : starts[first]])
        at = int(ends[first + count - 1])
        while at < len(raw) and _SPACES[raw[at]]:
            at += 1
    kept.append(raw[at:])
    return b"".join(kept).decode()


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated passages cut out (n_chars follows the text); documents of which nothing but white space is left go.

    All columns are kept.  Documents without a passage stay as they are, whatever their text."""
    row, doc, found, was_cut = (unused(docs.columns, name) for name in ("__row", "__doc", "__spans", "__cut"))
    passages = _passages(docs, min_words)
    spans = passages.groupBy(F.col("row").alias(row), F.col("doc").alias(doc)).agg(F.collect_list(F.struct("first_word", "n_words")).alias(found))
    keys = [k.alias(name) for k, name in zip(_key(), (row, doc), strict=True)]
    joined = docs.select("*", *keys).join(spans, [row, doc], "left").select(*cols(docs.columns), found)
    # Arrow functions take no names with dots in them: the columns are numbered meanwhile.
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            cut = spans.is_valid().to_numpy(zero_copy_only=False)
            if cut.any():
                texts = columns[place].to_pylist()
                for i in np.flatnonzero(cut).tolist():
                    if texts[i] is not None:
                        texts[i] = without_words(texts[i], [(x["first_word"], x["n_words"]) for x in spans[i].as_py()])
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut)], names=[*names, "cut"])

    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)], T.StructField("cut", T.BooleanType())])
    kept = joined.toDF(*names, "spans").mapInArrow(run, schema).toDF(*docs.columns, was_cut).where(~F.col(was_cut) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(was_cut), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*cols(docs.columns))
