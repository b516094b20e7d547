"""Operator 3: SimHash near-duplicates by pigeonhole blocks.

1. Fingerprints: a bit is one if more than half of the shingle hashes have it.
   Equal fingerprints collapse into one row before anything is joined.
2. Blocks: a fingerprint is cut into blocks and a key is one block, or a choice
   of several.  With ``blocks`` and ``agree`` such that ``blocks - agree`` is the
   largest distance, two fingerprints at that distance must share a key.  Keys
   are ``SPARE`` bits longer than it takes to number the fingerprints, so that
   few share one by chance however many there are.
3. Only keys that two or more fingerprints share go on (a count per key).  Rows
   of a key that more than ``CHUNK`` fingerprints share are dealt into pairs of
   chunks, so that no task holds a whole hot key, and every pair of rows meets.
4. Rows are compared inside sorted runs of a key, in numpy, by Hamming distance;
   a run gives the links of a spanning forest, never all its pairs.
5. Connected components of these links (``components.py``).

Defined results: a null text has no words, and texts without words share the
zero fingerprint; repeated rows and ids are one node per id; rows with a null id
are fingerprinted but belong to no component (null); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_by_key
from .storage import materialize

#: Fingerprints of one key that a task compares at once; larger keys are dealt into chunk pairs.
CHUNK = 1024
#: Rows that a task turns into one numpy block of sorted runs.
BLOCK_ROWS = 50_000
_SEED = 42
#: Bits of each byte value, lowest first, and where a byte column's 256 counters start.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACES = 256 * np.arange(1 << 12)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Feature:
    """Fingerprint of ``bits`` bits over shingles of ``shingle`` words."""

    shingle: int
    bits: int


@dataclass(frozen=True)
class Plan:
    """features: their bits are joined. cuts: (offset, width) of blocks in the joined bits. agree: blocks that make a key.
    within: for each feature the most differing bits of a link."""

    features: tuple[Feature, ...]
    cuts: tuple[tuple[int, int], ...]
    agree: int
    within: tuple[int, ...]


#: Bits of a key beyond those that number the fingerprints: one in 16 shares it by chance at most.
SPARE = 4
def _width(fingerprints: int) -> int:
    return math.ceil(math.log2(fingerprints + 1)) + SPARE


def close_plan(fingerprints: int = 0) -> Plan:
    """64 bits over three words, at most three of them apart. Two of five blocks agree then, three of six, four of seven and so on:
    as many as make a key long enough."""
    agree = next((k for k in range(2, 7) if 64 * k // (k + 3) >= _width(fingerprints)), 7)
    ends = [64 * i // (agree + 3) for i in range(agree + 4)]
    return Plan((Feature(3, 64),), tuple((a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)), agree, (3,))


CLOSE = close_plan()


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of ASCII-lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[-1:] if len(words) < size else ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def rolled_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words from the words' hashes; of all words if they are fewer."""
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out = out * _MIX + words[k : k + len(out)]
    return _scramble(out, np.uint64(size))


def _hashes(text: bytes, features: tuple[Feature, ...]) -> Iterator[np.ndarray]:
    for f in features:
        yield shingle_hashes(text, f.shingle)


def _scramble(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Further hash words from one: the finaliser of splitmix64."""
    x = h + _MIX * salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """Little-endian 64-bit words: a bit is set if more than half of the hashes have it.

    Counted per byte of the hashes: how often each value stands there, times the bits of that value."""
    columns = bits // 8
    counts = np.zeros(columns * 256, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        words = part[:, None] if bits == 64 else np.concatenate((part[:, None], _scramble(part[:, None], np.arange(1, bits // 64, dtype=np.uint64))), axis=1)
        counts += np.bincount((words.astype("<u8").view(np.uint8) + _PLACES[:columns]).ravel(), minlength=columns * 256)
    total = counts.reshape(columns, 256).astype(np.float64) @ _BITS
    return np.packbits(2 * total.ravel() > len(hashes), bitorder="little").tobytes()


def _fingerprints(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(1).cast(pa.binary())
                prints = []
                for i in range(len(texts)):
                    text = texts[i].as_py() or b""
                    prints.append(b"".join(fingerprint(h, f.bits) for h, f in zip(_hashes(text, plan.features), plan.features, strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, plan: Plan = CLOSE) -> DataFrame:
    """doc_id and the fingerprint's bytes, one row a document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(plan), "doc_id long, print binary")


def block_keys(prints: list[bytes], plan: Plan) -> np.ndarray:
    """(n, number of keys) of int64: the number of a choice of blocks and the values of its blocks."""
    matrix = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    planes = np.unpackbits(matrix, axis=1, bitorder="little")
    values = [planes[:, at : at + width].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) for at, width in plan.cuts]
    out = []
    top = 62 - math.comb(len(plan.cuts), plan.agree).bit_length()
    for number, chosen in enumerate(combinations(range(len(plan.cuts)), plan.agree)):
        key, room = np.zeros(len(prints), np.int64), 0
        for c in chosen:
            key |= values[c] << room
            room += plan.cuts[c][1]
        if room > top:
            raise ValueError("a key must fit into 62 bits")
        out.append(key | (number << top))
    return np.stack(out, axis=1)


def _keys(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = block_keys(part.column(1).to_pylist(), plan)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return run


def _forest(prints: np.ndarray, runs: np.ndarray, node: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is close inside each run of equal ``runs`` (sorted); a spanning forest of them.

    Pairs that links join already are not compared, and none are kept: memory follows the rows, not the pairs."""
    bounds = np.cumsum([0, *(f.bits // 64 for f in plan.features)])
    at, label, lag = np.arange(len(runs)), np.arange(len(runs)), 1
    while True:
        at = at[at + lag < len(runs)]
        at = at[runs[at] == runs[at + lag]]
        if not len(at):
            break
        a = at[label[at] != label[at + lag]]
        close = np.ones(len(a), bool)
        for (lo, hi), most in zip(zip(bounds[:-1], bounds[1:], strict=True), plan.within, strict=True):
            close[close] = np.bitwise_count(prints[a[close], lo:hi] ^ prints[a[close] + lag, lo:hi]).sum(axis=1, dtype=np.int64) <= most
        a = a[close]
        while len(a):  # the larger of two roots goes under the smaller
            x, y = label[a], label[a + lag]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]
            a = a[label[a] != label[a + lag]]
        lag += 1
    moved = np.flatnonzero(label != np.arange(len(label)))
    return node[moved], node[label[moved]]


def _links(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by (key, part): run, node, print. A run of at most two chunks is never cut."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                key, part = (table.column(k).to_numpy() for k in ("key", "part"))
                last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield table.slice(0, cut)
                held, rows = table.slice(cut).to_batches(), len(table) - cut
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            if len(table) < 2:
                continue
            key, part, node = (table.column(k).to_numpy() for k in ("key", "part", "node"))
            prints = np.frombuffer(b"".join(table.column("print").to_pylist()), "<u8").reshape(len(table), -1)
            runs = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            a, b = _forest(prints, runs, node, plan)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def close_links(prints: DataFrame, plan: Plan = CLOSE) -> DataFrame:
    """prints: node long, print binary, distinct prints. Links (a, b) that connect whatever is close."""
    keyed = materialize(prints.select("node", "print").mapInArrow(_keys(plan), "key long, node long"), "print-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    member = keyed.join(shared, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # Part (i, j), i <= j, holds chunks i and j; a member of chunk i is in every part that names i.
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    parted = member.withColumn("other", F.explode(other)).select(
        "key", "node", (F.least("mine", "other").cast("long") * F.col("chunks") + F.greatest("mine", "other")).alias("part")
    )
    full = parted.join(prints.select("node", "print"), "node").select("key", "part", "node", "print")
    return full.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_links(plan), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, plan_for: Callable[[int], Plan] = close_plan) -> DataFrame:
    """doc_id, print (binary), component_id: the smallest doc_id that links reach.

    plan_for: the plan for a number of distinct fingerprints; its features are the same for every number."""
    prints = materialize(fingerprints(docs, plan_for(0)), "prints")
    known = prints.where("doc_id is not null")
    classes = materialize(known.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "print-classes")
    reached = connected_components(close_links(classes, plan_for(classes.count()))).select(F.col("node").alias("r"), "component")
    named = classes.join(reached, F.col("node") == F.col("r"), "left").select("print", "n", F.coalesce("component", "node").alias("component_id"))
    # A fingerprint that very many rows have is one key.
    placed = join_by_key(known, materialize(named, "print-components"), "print", known.count())
    unknown = prints.where("doc_id is null").select("doc_id", "print", F.lit(None).cast("long").alias("component_id"))
    return placed.select("doc_id", "print", "component_id").unionByName(unknown)


def hex_digits(print_column: Column) -> Column:
    """16 hex digits of a 64-bit fingerprint, most significant first."""
    return F.lower(F.reverse(F.regexp_replace(F.hex(print_column), "(.)(.)", "$2$1")))
