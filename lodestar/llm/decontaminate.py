"""Operator 1: benchmark decontamination by spaced-seed hashing.

Texts are ASCII-lower-cased words without ASCII punctuation, each as a 64-bit
hash.  A spaced seed is a fixed mask over neighbouring words that hashes some
positions and ignores the others, so a substituted word at an ignored position
does not break the hit.

1. The seed hashes of every item are a table: hash, item, place.
2. Every document's seed hashes that may be in that table (a bitmap of the hashes'
   low bits, of bounded size) are rows too and are joined with it by hash.  The
   documents are read once for this, whatever the size of the benchmark.
3. Around the hits the item is laid over the document on the hits' diagonal; the
   longest overlap in which at least ``SIMILARITY`` of the words are equal is
   measured.  The document is contaminated by the item if the overlap has
   ``MIN_OVERLAP`` words or more; a shorter item must be there as a whole, with as
   many of its words equal.

The masks leave out no pattern: any overlap of ``MIN_OVERLAP`` words or more at 0.8
has ten words in a row with at most two substituted, or five equal ones, and the
six masks of ``MASKS`` meet both; a whole item of 5 to 9 words with one substituted
word is met by one of three masks that ignore a third of it each.  Items of up to
four words must be equal word by word.

Only documents with a hit are read again, and what is joined to them is dealt into
lists of bounded length.  The seed table and the keys of found documents are
broadcast only where their count shows them to be small.

Defined results: items with fewer than ``min_item`` words (1 as given) never match; null and
empty texts of either table never match; equal items are reported each; null ids
are carried as null; repeated rows are reported each; other columns are ignored by
``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import bounded_broadcast
from .storage import cols, materialize, unused

#: Positions that a seed hashes, relative to its first word (fixed masks).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 6, 7), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3, 8, 9), (0, 1, 6, 7, 8, 9), (0, 1, 4, 5, 8, 9))
#: Items from this length on are met by MASKS at every place, shorter ones by masks of their own length.
SPAN = 10
MIN_OVERLAP = 13
SIMILARITY = 0.8
#: Seeds that are broadcast, and found documents whose keys are; beyond that both are shuffled.
SEED_ROWS, FOUND_ROWS = 2_000_000, 1_000_000
#: The bitmap has 2**BITS[1] bits at most (16 MB), and 2**SPARSE times as many as there are seeds if that is less.
BITS, SPARSE = (16, 27), 10
#: Candidates in one list beside a document's text.
LISTED = 256
_KEPT = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_BASE = 0x100000001B3
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64), dtype=np.uint64)
_SLICE = 1 << 20
#: Bytes of texts that are hashed together, and the documents of one step.
_GROUP, _STEP = 1 << 17, 64


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word; long texts are worked through in slices."""
    out = []
    at = 0
    while at < len(text):
        end = at + _SLICE
        if end < len(text):  # on to the end of the word
            while end < len(text) and _KEPT[text[end]] != 32:
                end += 1
        out.append(_hash_slice(text[at:end].translate(_KEPT)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hash_slice(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    space = np.concatenate(([True], raw == 32, [True]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    inside = np.flatnonzero(raw != 32)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    value = (raw[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & (len(_POWERS) - 1)]
    return _finish(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash for each place where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for place in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[place : place + n]
    return _finish(out)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts together up to a slice's size; a longer one is alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > _GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def _word_counts(group: list[bytes], total: int) -> list[int]:
    if len(group) == 1:
        return [total]
    raw = np.frombuffer(b"\n".join(group).translate(_KEPT), np.uint8) != 32
    starts = np.flatnonzero(raw & ~np.concatenate(([False], raw[:-1])))
    begins = np.cumsum([0, *(len(t) + 1 for t in group)])
    return np.diff(np.searchsorted(starts, begins)).tolist()


def short_masks(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(offset, mask) for a whole item of n < SPAN words: whatever may be substituted, one mask ignores it."""
    parts = 1 if n - math.ceil(SIMILARITY * n - 1e-9) == 0 else 3
    out = []
    for k in range(parts):
        ignored = set(range(n * k // 3, n * (k + 1) // 3)) if parts > 1 else set()
        kept = [i for i in range(n) if i not in ignored]
        out.append((kept[0], tuple(i - kept[0] for i in kept)))
    return out


#: Every mask by its number, which salts its hashes.
ALL_MASKS = sorted({*MASKS, *(mask for n in range(1, SPAN) for _, mask in short_masks(n))})


def item_seeds(words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(mask number, first place, hashes at places from there on) of an item."""
    if len(words) >= SPAN:
        for mask in MASKS:
            number = ALL_MASKS.index(mask)
            yield number, 0, seed_hashes(words, mask, number)
    else:
        for offset, mask in short_masks(len(words)):
            number = ALL_MASKS.index(mask)
            yield number, offset, seed_hashes(words[offset:], mask, number)[:1]


def longest_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(first, length, equal words) of the longest stretch that starts and ends with equal words and has SIMILARITY of them; the first of several."""
    if not equal.any():
        return 0, 0, 0
    # Whole numbers, so that a stretch of exactly the least share counts.
    share = round(SIMILARITY * 1000)
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1000 - share, -share))))
    ends = np.where(equal, score[1:], -(1 << 62))
    best_end = np.maximum.accumulate(ends[::-1])[::-1]  # best score at an end from a place on
    starts = np.flatnonzero(equal)
    # The last place whose best end reaches the start's score: best_end falls, so it is a search.
    last = np.searchsorted(-best_end, -score[starts], "right") - 1
    k = int(np.argmax(last - starts))
    first, n = int(starts[k]), int(last[k] - starts[k] + 1)
    return first, n, int(equal[first : first + n].sum())


def overlap(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first word in the document, words, equal words) on a diagonal: the whole item, or a stretch that is long enough."""
    lo, hi = max(0, diagonal), min(len(words), diagonal + len(item))
    if hi - lo < min(MIN_OVERLAP, len(item)):
        return None
    equal = words[lo:hi] == item[lo - diagonal : hi - diagonal]
    same = int(equal.sum())
    if hi - lo == len(item) and 1000 * same >= round(SIMILARITY * 1000) * len(item):
        return lo, len(item), same
    first, n, same = longest_overlap(equal)
    return (lo + first, n, same) if n >= MIN_OVERLAP else None


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            words = [word_hashes(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary())], names=["item", "words"])


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, first, hashes in item_seeds(np.frombuffer(words, np.uint64)):
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(np.full(n, item)), pa.array(np.arange(first, first + n, dtype=np.int64)), pa.array(np.full(n, number, np.int32))], names=["hash", "item", "place", "mask"]
                    )


def _bitmap(seeds: DataFrame, count: int) -> np.ndarray:
    """One bit a value of the hashes' low bits, as bytes; at most 2**(BITS[1] - 6) numbers reach the driver."""
    bits = min(BITS[1], max(BITS[0], (count or 1).bit_length() + SPARSE))
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    cells = seeds.groupBy(F.shiftright(low, 6).cast("int").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def _key() -> tuple[Column, Column]:
    """Rows with one id and one text are one document for the joins: each gets all that is found for it."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")


def _hits(docs: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """doc_id, text_hash, hash, place: the seeds of documents that may be a benchmark's."""
    numbers = sorted(r.mask for r in seeds.select("mask").distinct().collect())  # at most len(ALL_MASKS)
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        low = np.uint64(8 * len(bitmap) - 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, _STEP):
                    step = batch.slice(at, _STEP)
                    texts = [t or b"" for t in step.column(2).cast(pa.binary()).to_pylist()]
                    words, counts = [], []
                    for group in _groups(texts):
                        joined = word_hashes(b"\n".join(group))
                        words.append(joined)
                        counts += _word_counts(group, len(joined))
                    words = np.concatenate(words)
                    bounds = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
                    for number in numbers:
                        mask = ALL_MASKS[number]
                        h = seed_hashes(words, mask, number)
                        place = h & low
                        hit = np.flatnonzero((bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                        doc = np.searchsorted(bounds, hit, "right") - 1
                        inside = hit + mask[-1] < bounds[doc + 1]  # no seed reaches from one text into the next
                        hit, doc = hit[inside], doc[inside]
                        if len(hit):
                            rows = pa.array(doc)
                            yield pa.RecordBatch.from_arrays([step.column(0).take(rows), step.column(1).take(rows), pa.array(h[hit].view(np.int64)), pa.array(hit - bounds[doc])], names=["doc_id", "text_hash", "hash", "place"])

    return docs.select(*_key(), "text").mapInArrow(run, "doc_id long, text_hash long, hash long, place long")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: row, doc_id, text_hash, text, laid (a list of item, words, diagonal). The overlaps that are long enough."""
    with np.errstate(over="ignore"):
        for batch in batches:
            found = []
            for k, (text, laid) in enumerate(zip(batch.column(3).cast(pa.binary()), batch.column(4), strict=True)):
                words = word_hashes(text.as_py() or b"")
                for x in laid:
                    told = overlap(words, np.frombuffer(x["words"].as_py(), np.uint64), x["diagonal"].as_py())
                    if told:
                        found.append((k, x["item"].as_py(), *told))
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            rows, *rest = (pa.array(c, pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), *rest], names=["row", "doc_id", "text_hash", "item", "first_word", "n_words", "equal_words"])


def _tables(benchmark: DataFrame, min_item: int) -> tuple[DataFrame, DataFrame]:
    """items: item (a number a row), item_id, words; seeds: hash, item, place, mask."""
    told = materialize(benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "benchmark")
    hashed = told.select("item", "text").mapInArrow(_item_rows, "item long, words binary").where(F.length("words") >= 8 * max(1, min_item))
    items = materialize(hashed.join(told.select("item", "item_id"), "item"), "benchmark-items")
    return items, materialize(items.select("item", "words").mapInArrow(_seed_rows, "hash long, item long, place long, mask int"), "benchmark-seeds")


def _same(a: str, b: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("text_hash") == F.col(b))


def _candidates(docs: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """d, t (id and text hash of a document), item, diagonal: where a seed of an item was met."""
    count = seeds.count()
    table = bounded_broadcast(seeds.select("hash", "item", F.col("place").alias("in_item")), count, SEED_ROWS)
    met = _hits(docs, seeds, count).join(table, "hash").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "item", (F.col("place") - F.col("in_item")).alias("diagonal"))
    return materialize(met.distinct(), "met")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_item: int = 1) -> DataFrame:
    """doc_id, item_id, first_word, n_words, equal_words, similarity: the longest overlap of each document and item that has one."""
    items, seeds = _tables(benchmark, min_item)
    best = F.max(F.struct("n_words", "equal_words", (-F.col("first_word")).alias("back"))).alias("best")
    found = _overlaps(docs, items, seeds).groupBy("row", "doc_id", "item").agg(best).join(items.select("item", "item_id"), "item")
    told = found.select("doc_id", "item_id", (-F.col("best.back")).alias("first_word"), "best.n_words", "best.equal_words")
    return told.withColumn("similarity", F.col("equal_words") / F.col("n_words"))


def _overlaps(docs: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, item, first_word, n_words, equal_words; row: a number a row of docs."""
    docs = docs.select("doc_id", "text")
    met = _candidates(docs, items, seeds)
    sizes = materialize(met.groupBy("d", "t").agg(F.count("*").alias("n")), "met-documents")
    part = F.pmod(F.xxhash64("item", "diagonal"), F.ceil(F.col("n") / LISTED))
    dealt = met.join(sizes.select(F.col("d").alias("doc_id"), F.col("t").alias("text_hash"), "n"), _same("d", "t")).select("d", "t", "item", "diagonal", part.alias("part"))
    laid = dealt.join(items.select("item", "words"), "item").groupBy("d", "t", "part").agg(F.collect_list(F.struct("item", "words", "diagonal")).alias("laid"))
    # Few documents go on: those are told by their keys, and only they are shuffled to their lists.
    keys = bounded_broadcast(sizes.select("d", "t"), sizes.count(), FOUND_ROWS)
    again = docs.select(F.monotonically_increasing_id().alias("row"), *_key(), "text").join(keys, _same("d", "t"), "left_semi")
    return materialize(
        again.join(laid, _same("d", "t")).select("row", "doc_id", "text_hash", "text", "laid").mapInArrow(_verified, "row long, doc_id long, text_hash long, item long, first_word long, n_words long, equal_words long"), "overlaps"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_item: int = 1) -> DataFrame:
    """The documents, all columns, without those that overlap with an item; they are not shuffled while the found ones are few."""
    items, seeds = _tables(benchmark, min_item)
    d, t = (unused(docs.columns, name) for name in ("__doc", "__text"))
    found = _overlaps(docs, items, seeds).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct()
    found = bounded_broadcast(found, found.count(), FOUND_ROWS)
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[d]) & (F.xxhash64(docs["text"]) == found[t]), "left_anti").select(*cols(docs.columns))
