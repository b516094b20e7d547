"""Operator 5: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 in ``DIM`` dimensions, drawn from a
seed and its code point.  An n-gram's vector binds (multiplies) the vectors of its
letters, each permuted (rotated) by its place; a text's vector bundles (adds) the
vectors of its n-grams.  A language's prototype bundles the unit vectors of its
training texts.  A text's language is the prototype with the largest cosine.

Texts are lower-cased; every run of other characters is one blank, with one at
either end, so a text with a letter has an n-gram.  A batch's counts are one
matrix (texts by distinct n-grams) and its vectors one product with the n-grams'
vectors.  Prototypes are summed per task, then per language and dimension; only
they (languages by DIM numbers) reach the driver, at most ``_MAX_PROTOTYPES`` of them.
A letter is what Unicode calls one, in every plane.

Training uses a bounded sample of the labelled rows: the ``SAMPLE`` of a seeded
order of hashes at most, spread evenly.  Counting, scoring and judging cover every
row and whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without training rows every text is ``und``; ties go to the language first by code
point; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cols, unused

DIM = 512
GRAM = 3
#: Labelled rows that train the prototypes at most.
SAMPLE = 20_000
UNKNOWN = "und"
#: Texts of one product, and characters of them at most (a longer text is one of its own).
BATCH_TEXTS, BATCH_CHARS = 256, 1 << 19
_BLANK = 32
_MAX_PROTOTYPES = 2_000


@lru_cache(maxsize=50_000)
def _letter(code: int) -> np.ndarray:
    """The letter's random vector; the blank has one as well."""
    return np.random.default_rng((5, code)).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)


_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one blank; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = _LETTER[codes]
    if not known.any():
        return np.empty(0, np.uint32)
    codes = np.concatenate(([_BLANK], np.where(known, codes, _BLANK), [_BLANK])).astype(np.uint32)
    blank = codes == _BLANK
    return codes[~(blank & np.concatenate(([False], blank[:-1])))]


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """grams: (n, GRAM) code points. The bound, permuted letter vectors."""
    points, where = np.unique(grams, return_inverse=True)
    table = np.stack([_letter(int(c)) for c in points])
    where = where.reshape(grams.shape)
    out = np.ones((len(grams), DIM), np.int8)
    for place in range(GRAM):
        out *= np.roll(table, GRAM - 1 - place, axis=1)[where[:, place]]
    return out


def _counts(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, distinct n-grams) counts and the n-grams' code points."""
    joined = np.concatenate(lines)
    points, ids = np.unique(joined, return_inverse=True)
    n = len(points)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    inside = owner[GRAM - 1 :] == owner[: len(owner) - GRAM + 1]
    code = np.zeros(len(joined) - GRAM + 1, np.int64)
    for place in range(GRAM):
        code = code * n + ids[place : place + len(code)]
    code, owner = code[inside], owner[: len(inside)][inside]
    if n**GRAM <= 1 << 22:  # few letters: a table of all n-grams instead of a sort
        there = np.zeros(n**GRAM, bool)
        there[code] = True
        distinct = np.flatnonzero(there)
        column = (np.cumsum(there) - 1)[code]
    else:
        distinct, column = np.unique(code, return_inverse=True)
    counts = np.zeros((len(lines), len(distinct)), np.float32)
    for lo in range(0, len(lines), 32):  # counted for some texts at a time, as bincount counts in 64 bits
        a, b = np.searchsorted(owner, (lo, lo + 32))
        n_rows = len(counts[lo : lo + 32])
        counts[lo : lo + 32] = np.bincount((owner[a:b] - lo) * len(distinct) + column[a:b], minlength=n_rows * len(distinct)).reshape(n_rows, -1)
    places = [distinct // n ** (GRAM - 1 - p) % n for p in range(GRAM)]
    return counts, np.stack([points[p] for p in places], axis=1)


def vectors(texts: list[str | None]) -> np.ndarray:
    """One unit vector a text; zeros for a text without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    lines = [letters(t or "") for t in texts]
    full = [i for i, x in enumerate(lines) if len(x)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and end - at < BATCH_TEXTS and (end == at or size + len(lines[full[end]]) <= BATCH_CHARS):
            size += len(lines[full[end]])
            end += 1
        rows = full[at:end]
        counts, grams = _counts([lines[i] for i in rows])
        total = np.zeros((len(rows), DIM), np.float64)
        for k in range(0, len(grams), 4096):
            total += counts[:, k : k + 4096] @ _gram_vectors(grams[k : k + 4096]).astype(np.float32)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        out[rows] = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
        at = end
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH_TEXTS):
        yield batch.slice(i, BATCH_TEXTS)


def hash_below(sample: int, count: int) -> int:
    """The bound of 64-bit hashes that ``sample`` of ``count`` rows are below, more or less; a row at least for every count below 2**63."""
    return -(1 << 63) + ((sample << 64) // max(sample, count))


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order of code points and their unit prototypes, from columns doc_id, text and lang.

    The hash of a sampled row takes in its id, so that a text with very many copies cannot fill the sample."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = rows.count()
    if count > sample:
        rows = rows.where(F.xxhash64(F.lit(5), "doc_id", "text") < hash_below(sample, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in _slices(whole):
                unit = vectors(batch.column(0).to_pylist())
                names = np.array(batch.column(1).to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + unit[names == name].sum(axis=0, dtype=np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(range(DIM), pa.int32()), pa.array(np.round(total * 2**20).astype(np.int64))], names=["lang", "place", "value"])

    # Whole numbers, so that the order in which tasks end changes nothing. One job: the sums of a language are one row.
    parts = rows.select("text", "lang").mapInArrow(run, "lang string, place int, value long")
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    # DIM rows a language: the limit bounds what the driver takes, and is one above what is allowed.
    table = sums.limit((_MAX_PROTOTYPES + 1) * DIM).toArrow()
    names = np.array(table.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    if count and not languages:
        raise ValueError(f"none of {count} labelled rows was taken: no prototype came out")
    if len(languages) > _MAX_PROTOTYPES:
        raise ValueError(f"more than {_MAX_PROTOTYPES} languages: these labels are not languages")
    out = np.zeros((len(languages), DIM), np.float32)
    order = {name: i for i, name in enumerate(languages)}
    out[[order[n] for n in names], table.column("place").to_numpy()] = table.column("value").to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return languages, np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns and the columns named by pred and score: the language and the cosine with its prototype, 0 to 1.

    Columns of docs with one of these names are replaced; callers that want to keep them choose others."""
    model = docs.sparkSession.sparkContext.broadcast((languages, prototypes))
    keep = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    # Arrow functions take no names with dots in them: the columns are numbered meanwhile. The text goes to tasks once.
    plain = [f"c{i}" for i in range(len(keep))]
    place = next((i for i, c in enumerate(keep) if c.lower() == "text"), len(keep))
    docs = docs.select(*cols(keep), *([F.col("text").alias(unused(keep, "__text"))] if place == len(keep) else []))
    docs = docs.toDF(*plain, *(["text"] if place == len(keep) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for whole in batches:
            for batch in _slices(whole):
                unit = vectors(batch.column(place).to_pylist())
                cosine = unit @ table.T if len(names) else np.zeros((len(unit), 1), np.float32)
                best, known = cosine.argmax(axis=1), unit.any(axis=1) & bool(names)
                told = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                near = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], pa.array(told, pa.string()), pa.array(near)], names=[*plain, "pred", "told"])

    schema = docs.select(*plain).schema.add("pred", "string").add("told", "double")
    return docs.mapInArrow(run, schema).toDF(*keep, pred, score)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; prototypes learn from labelled rows that are not held out."""
    languages, prototypes = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), languages, prototypes).select("doc_id", "held_out", "lang_pred", "score")
