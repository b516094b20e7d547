"""Near copies: documents that share 0.8 of their five-word shingles (Jaccard).

1. A document is its set of five-word shingles (64-bit hashes of ASCII-lower-cased
   words; all words if they are fewer).  Equal sets collapse into one node.
2. Candidates by SimHash, as in operator 3: a fingerprint over three-word shingles,
   pigeonhole blocks as keys, Hamming distance of three bits or fewer inside a key
   (``simhash.close_links``).  Nodes of one fingerprint are candidates as well.
   The rest, as pairs of 0.8 differ in some 15 % of the bits: ``BANDS`` keys of
   ``ROWS`` minima each (MinHash).  A pair of Jaccard j has no common key with chance
   ``(1 - j**ROWS)**BANDS``: below 6e-6 at 0.8, less above it, whatever the number
   of documents and however their differences lie.
3. Every candidate of SimHash, and every member of a key against the key's smallest
   node (the pivot), is confirmed by the exact Jaccard of both sets.  These pairs
   are told once, not once a key.
4. Keys of three or more whose members are not all joined by then are compared in
   full: all pairs of members that are not joined yet, in pairs of chunks.
5. Connected components of the links (``components.py``).

No link stands on an estimate: each was confirmed by its sets.  Shingles are
compared inside a run of a key, in numpy, one set against all others.

Defined results: texts without words are one group; repeated rows and ids are one
node per id; rows with a null id belong to no component (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_by_key
from .mixing import bounded_broadcast
from .simhash import close_links, close_plan, fingerprint, rolled_hashes, shingle_hashes
from .storage import materialize

SHINGLE = 5
#: Words of a shingle of the fingerprints.
PRINT_SHINGLE = 3
#: Least Jaccard of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 6
#: Members of one key that a task compares at once; larger keys are dealt into chunk pairs.
CHUNK = 512
#: Bytes of sets that a task turns into one block of runs.
BLOCK_BYTES = 16 << 20
_draw = np.random.default_rng(5)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_FOLD = _draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    return np.unique(rolled_hashes(shingle_hashes(text, 1), SHINGLE))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    folded = (((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _FOLD).sum(axis=1, dtype=np.uint64)).view(np.int64)
    return folded


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            nodes, keys, prints = [], [], []
            for i in range(len(texts)):
                words = shingle_hashes(texts[i].as_py() or b"", 1)
                shingles = np.unique(rolled_hashes(words, SHINGLE))
                nodes.append(_node(shingles))
                prints.append(fingerprint(rolled_hashes(words, PRINT_SHINGLE), 64))
                keys.append(band_keys(shingles) if len(shingles) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), listed, pa.array(prints, pa.binary())], names=["doc_id", "node", "keys", "print"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingle_set(x.as_py() or b"") for x in batch.column(0).slice(at, 1000).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])


def run_links(sets: list[np.ndarray], label: np.ndarray, only_first: bool) -> list[tuple[int, int]]:
    """Places (i, j) of pairs of sets that are close; pairs of one label are joined already, and links join labels.

    only_first: the first set is held against the others, and no others against each other."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    num, den = LEAST
    if only_first:
        # The first set is sorted: the others are looked up in it, and no table of all values is made.
        others = np.flatnonzero((label != label[0]) & (sizes > 0))
        if not len(others) or not sizes[0]:
            return []
        flat = np.concatenate([sets[i] for i in others])
        hit = sets[0][np.minimum(np.searchsorted(sets[0], flat), sizes[0] - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        return [(0, j) for j in others[den * common >= num * (sizes[0] + sizes[others] - common)].tolist()]
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, out = label.copy(), []
    for i in range(len(sets) - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            continue
        mark = np.zeros(len(values), np.int32)
        mark[at[starts[i] : starts[i] + sizes[i]]] = 1
        common = np.add.reduceat(mark[at], starts)[others]
        close = others[den * common >= num * (sizes[i] + sizes[others] - common)]
        if len(close):
            out += [(i, j) for j in close.tolist()]
            label[np.isin(label, label[close])] = label[i]
    return out


def _compared(only_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by (key, part, node): key, part, node, label, shingles. A run is never cut."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                table = pa.Table.from_batches(held)
                key, part = (table.column(k).to_numpy() for k in ("key", "part"))
                last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            key, part, node, label = (table.column(k).to_numpy() for k in ("key", "part", "node", "label"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            ends = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(key)]
            a, b = [], []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if hi - lo > 1:
                    for i, j in run_links(sets[lo:hi], label[lo:hi], only_first):
                        a.append(node[lo + i])
                        b.append(node[lo + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _confirmed(dealt: DataFrame, sets: DataFrame, only_first: bool) -> DataFrame:
    """dealt: key, part, node, label. Links (a, b)."""
    full = dealt.join(sets, "node").select("key", "part", "node", "label", "shingles")
    return full.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_compared(only_first), "a long, b long").distinct()


def _chunks(n: str) -> Column:
    return F.ceil(F.col(n) / CHUNK).cast("int")


def _by_pivot(pairs: DataFrame) -> DataFrame:
    """pairs: pivot, node. A pivot's nodes are dealt into chunks, the pivot, which is smaller than all of them, into each."""
    fans = pairs.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("chunks", _chunks("n"))
    nodes = pairs.join(fans, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("long").alias("part"), "node")
    heads = fans.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("part"), F.col("pivot").alias("node"))
    return nodes.union(heads).select(F.col("pivot").alias("key"), "part", "node", F.col("node").alias("label"))


def _by_key(members: DataFrame, joined: DataFrame) -> DataFrame:
    """members: key, node, n. Of keys whose members are not one component, all; keys with the same members count once."""
    labelled = members.where("n > 2").join(joined.withColumnRenamed("component", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = mixed.where("lo <> hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", _chunks("n").alias("chunks"))
    mine = labelled.join(once, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # Part (i, j), i <= j, holds chunks i and j; a member of chunk i is in every part that names i.
    parted = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return parted.select("key", (F.least("mine", "other").cast("long") * F.col("chunks") + F.greatest("mine", "other")).alias("part"), "node", "label")


def _by_prints(classes: DataFrame) -> DataFrame:
    """classes: node, print. Candidates (pivot, node), pivot < node: nodes whose fingerprints are equal or close."""
    prints = materialize(classes.groupBy("print").agg(F.min("node").alias("node"), F.count("*").alias("n")), "near-prints")
    close = close_links(prints, close_plan(prints.count())).select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("node"))
    shared = prints.where("n > 1").select("print", F.col("node").alias("pivot"))
    return close.union(classes.join(shared, "print").where("node <> pivot").select("pivot", "node"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links reach."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(texts.mapInArrow(_signatures, "doc_id long, node long, keys array<long>, print binary"), "near-rows")
    known = rows.where("doc_id is not null")
    classes = materialize(known.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.min("print").alias("print"), F.count("*").alias("n_rows")), "near-classes")
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = materialize(keyed.join(shared, "key").select("key", "node", "n", "pivot"), "near-members")
    pairs = materialize(_by_prints(classes).union(members.where("node <> pivot").select("pivot", "node")).distinct(), "near-pairs")
    need = materialize(pairs.select("node").union(pairs.select("pivot")).distinct().join(classes.select("node", "first"), "node"), "near-need")
    wanted = bounded_broadcast(need.select(F.col("first").alias("doc_id")).distinct(), need.count())
    made = texts.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets, "node long, shingles binary")
    sets = materialize(made.dropDuplicates(["node"]), "near-sets")
    ids = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    links = materialize(_confirmed(_by_pivot(pairs), sets, True).union(known.join(ids, "doc_id").select("a", F.col("node").alias("b")).distinct()), "near-links")
    joined = materialize(connected_components(links), "near-joined")
    rest = materialize(_confirmed(_by_key(members, joined), sets, False), "near-rest")
    if not rest.isEmpty():
        joined = materialize(connected_components(links.union(rest)), "near-joined")
    sized = joined.join(classes.select("node", "first"), "node").groupBy("component")
    least = materialize(sized.agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "near-components")
    named = join_by_key(joined, least, "component", joined.count()).select("node", "component_id")
    told = classes.select("node", "first", F.col("n_rows").alias("n")).join(named, "node", "left").select("node", "n", F.coalesce("component_id", "first").alias("component_id"))
    # A text that very many rows have is one node.
    counted = known.count()
    placed = join_by_key(known.select("doc_id", "node"), materialize(told, "near-named"), "node", counted).select("doc_id", "component_id")
    return placed.unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id")))
