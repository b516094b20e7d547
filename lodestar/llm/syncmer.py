"""Operator 9 (native): document fingerprints from closed syncmers.

A text is a sequence of lower-cased words.  A k-mer of ``K`` words is an anchor if
the smallest hash among its inner runs of ``S`` words stands at either end: this
depends on the k-mer alone, so equal passages give equal anchors wherever they
stand.  A fingerprint is the whole list of a text's anchors in order, each as one
number ``position * 2**32 + hash`` (the position counts words from 0).  A text
with words but without an anchor has one: all its words, at position 0.

Likeness is positional.  Anchors of two texts match if their hashes are equal and
their positions differ by one common shift, the diagonal; the likeness is the
number of matches over the number of anchors in either text, each match counted
once.  The diagonal is the one that most hashes vote for (a hash votes with its last
place in one text and its first in the other); the diagonal without a shift is
tried as well, so a repeated line does not hide that two texts are equal.

Everything is an array expression inside one row: neighbours come from
``arrays_zip`` of a slice with itself, never from an outer column inside a lambda
(which would evaluate it once an element).  The next document comes from a window
inside ranges of doc_id; the first row of a range is copied to the range before
it, so no row moves through one task.  Texts are shuffled once; anchors are made
after the shuffle, once a text, and read from the next row together with it.

Defined results: a null text counts as empty; an empty text has the empty
fingerprint, alike (1) only to another empty one; null ids sort last; equal ids are
ordered by text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 4, 2
#: Documents of one range of doc_id, and the most ranges.
RANGE_ROWS = 1000
MAX_RANGES = 1 << 16
_GRID = 256
_LOW = (1 << 32) - 1
_PLACE = (1 << 31) - 1


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _at_edge(x: Column) -> Column:
    """The smallest inner run of a k-mer (three runs of two words) is its first or last; false past the end."""
    return x["2"].isNotNull() & (F.least(x["__inner"], x["2"]) <= x["1"])


def _anchor(x: Column, i: Column) -> Column:
    """Position and hash; the first and the last inner run cover the four words."""
    return F.shiftleft(i.cast("long"), 32).bitwiseOR(F.xxhash64(x["__inner"], x["2"]).bitwiseAND(F.lit(_LOW)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the anchors of a text column, an array of longs in order of position.

    Each step is a column of its own: an expression that is named twice would be worked out twice."""
    df = df.withColumn("__words", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn("__inner", F.zip_with("__words", _shift(F.col("__words"), 1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    runs = F.arrays_zip("__inner", *[_shift(F.col("__inner"), i).alias(str(i)) for i in (1, 2)])
    df = df.withColumn("__found", F.filter(F.transform(runs, lambda x, i: F.when(_at_edge(x), _anchor(x, i))), lambda x: x.isNotNull()))
    whole = F.array(F.aggregate("__words", F.lit(0).cast("long"), lambda h, w: F.xxhash64(h, w)).bitwiseAND(F.lit(_LOW)))
    found = F.when((F.size("__found") > 0) | (F.size("__words") == 0), F.col("__found")).otherwise(whole)
    return df.withColumn(out, found).drop("__words", "__inner", "__found")


def anchors(docs: DataFrame) -> DataFrame:
    """One row an anchor: doc_id, position (of its first word, from 0) and hash."""
    found = with_anchors(docs.select("doc_id", "text"), "text", "__anchors").select("doc_id", F.explode("__anchors").alias("x"))
    return found.select("doc_id", F.shiftright("x", 32).cast("int").alias("position"), F.col("x").bitwiseAND(F.lit(_LOW)).alias("hash"))


def _by_hash(a: Column, second: int) -> Column:
    """Anchors with the hash in front, then the side, then the position."""
    return F.transform(a, lambda x: F.shiftleft(x, 32).bitwiseOR(F.lit(second << 31)).bitwiseOR(F.shiftright(x, 32)))


def _votes(pairs: Column) -> Column:
    """Shifts between neighbours of one hash that come from either side."""
    meet = lambda p: (F.shiftright(p["0"], 31) + 1 == F.shiftright(p["1"], 31)) & (F.shiftright(p["1"], 31).bitwiseAND(F.lit(1)) == 1)
    return F.transform(F.filter(pairs, lambda p: p["1"].isNotNull() & meet(p)), lambda p: p["1"].bitwiseAND(F.lit(_PLACE)) - p["0"].bitwiseAND(F.lit(_PLACE)))


def _most_frequent(sorted_values: Column) -> Column:
    """Most frequent value of a sorted array (the smallest of several); null if it is empty."""
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("best"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["at"] == x, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("at"), n.alias("n"), F.when(n > s["most"], x).otherwise(s["best"]).alias("best"), F.greatest(n, s["most"]).alias("most"))

    return F.aggregate(sorted_values, start, step, lambda s: s["best"])


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the likeness of two anchor columns; texts without a common hash are not looked at further."""
    hashes = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(_LOW)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__meet", F.arrays_overlap(hashes(F.col(a)), hashes(F.col(b))))
    df = df.withColumn("__sorted", F.when(F.col("__meet"), F.sort_array(F.concat(_by_hash(F.col(a), 0), _by_hash(F.col(b), 1)))).otherwise(none))
    df = df.withColumn("__votes", F.sort_array(_votes(F.arrays_zip(F.col("__sorted").alias("0"), _shift(F.col("__sorted"), 1).alias("1")))))
    df = df.withColumn("__shift", F.coalesce(_most_frequent(F.col("__votes")), F.lit(0).cast("long")))
    moved = F.when(F.col("__shift") == 0, none).otherwise(F.zip_with(b, F.array_repeat(F.shiftleft("__shift", 32), F.size(b)), lambda x, s: x - s))
    straight = F.when(F.col("__meet"), F.size(F.array_intersect(a, b))).otherwise(0)
    df = df.withColumn("__common", F.greatest(straight, F.size(F.array_intersect(F.col(a), moved))))
    both = F.size(a) + F.size(b)
    return df.withColumn(out, F.when(both == 0, F.lit(1.0)).otherwise(F.col("__common") / (both - F.col("__common")))).drop("__meet", "__sorted", "__votes", "__shift", "__common")


def as_string(anchors: Column) -> Column:
    """The anchors as hexadecimal numbers with commas between: the last eight digits are the hash, those before the position."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.hex(x))), ",")


def _ranges(docs: DataFrame) -> tuple[list[int], DataFrame | None]:
    """Bounds of ranges of doc_id; and the smallest id of each range with rows, with the range before it (round the end)."""
    ids = docs.select("doc_id")
    count = ids.count()
    if not count:
        return [], None
    n = min(MAX_RANGES, max(1, -(-count // RANGE_ROWS)))
    quantiles = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(quantiles or []))
    rows = ids.groupBy(_range_of(F.col("doc_id"), bounds).alias("r")).agg(F.min("doc_id").alias("least")).collect()
    there = sorted((row.r, row.least) for row in rows)
    table = [(r, least, there[i - 1][0]) for i, (r, least) in enumerate(there)]
    return bounds, docs.sparkSession.createDataFrame(table, "__range int, __least long, __before int")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, in two steps; null ids fall into the last range. The bounds are one folded literal."""
    if not bounds:
        return F.lit(0)
    fixed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    upto = lambda a: F.size(F.filter(a, lambda x: x <= doc_id))
    coarse = upto(fixed(bounds[_GRID::_GRID])) if len(bounds) > _GRID else F.lit(0)
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(coarse * _GRID + upto(F.slice(fixed(bounds), coarse * _GRID + 1, _GRID)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text: adds anchors, and next: text and anchors of the next row by doc_id, then text; after the last the first."""
    bounds, table = _ranges(docs)
    if table is None:
        told = with_anchors(docs, "text", "anchors")
        return told.withColumn("next", F.struct("text", "anchors"))
    # The table of ranges has MAX_RANGES rows at most.
    placed = docs.withColumn("__range", _range_of(F.col("doc_id"), bounds)).join(F.broadcast(table), "__range")
    own = F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy"))
    ahead = F.struct(F.col("__before").alias("at"), F.lit(1).alias("copy"))
    copies = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("__least")), F.array(own, ahead)).otherwise(F.array(own)))
    dealt = placed.select("doc_id", "text", copies.alias("c")).select("doc_id", "text", F.col("c.at").alias("__at"), F.col("c.copy").alias("__copy"))
    order = ["__copy", F.col("doc_id").asc_nulls_last(), "text"]
    sorted_rows = dealt.repartition("__at").sortWithinPartitions("__at", *order)
    told = with_anchors(sorted_rows, "text", "anchors")
    along = Window.partitionBy("__at").orderBy(*order)
    return told.withColumn("next", F.lead(F.struct("text", "anchors")).over(along)).where("__copy = 0").drop("__at", "__copy")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document, its copy edited at the end, and the likeness of both and of the next document.

    The edit: the last floor(n_chars / 4) code points become the first as many (or all) of the next text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    told = with_next(base)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    told = told.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut)))
    told = with_anchors(told.select("doc_id", "n_chars", "anchors", F.col("next.anchors").alias("next_anchors"), "edited"), "edited", "edited_anchors")
    told = with_likeness(with_likeness(told, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return told.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("anchors")).alias("fingerprint"),
        as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
