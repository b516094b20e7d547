"""Keeping tables in step with a list of names: new and departed names, deletes with counts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import stored
from ..functions.text import strong_key
from .profile import number_rows

# Titles that stay although the list does not name the person.
EXEMPT = r"adjunct|emeritus|visiting|fellow"
#: Sets whose rarest word this many sets have or more are broadcast, while they are no more than that.
HOT_WORD, BROADCAST_SETS = 20_000, 50_000
#: Names of up to so many words are compared by all choices of their words.
SHORT = 6


def name_words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))


def distinct_names(names: DataFrame, key: Column | None = None) -> DataFrame:
    """name, _row: non-blank names, the first row of each key."""
    keyed = names.withColumn("__key", strong_key(F.col("name")) if key is None else key).where("__key <> ''")
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("_row"))).where("__n = 1").drop("__n", "__key")


def new_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that are not stored yet, by key; each once, in file order (_row)."""
    known = existing.select(strong_key(F.col("name")).alias("__k")).distinct()
    return distinct_names(wanted).join(known, strong_key(F.col("name")) == F.col("__k"), "left_anti")


def _contained(inner: DataFrame, outer: DataFrame, frequency: DataFrame) -> DataFrame:
    """The keys (k) of inner sets and outer sets (k, words) where the inner is part of the outer: inner, outer.

    An inner set is looked for by its rarest word only. A word that very many outer sets have is the rarest of a set only if all words of it
    are at least as frequent, so few sets ask for it; those are broadcast after they have been counted, and the outer sets stay where they are."""
    asked = inner.select("k", "words", F.explode("words").alias("w")).join(frequency, "w")
    asked = asked.groupBy("k").agg(F.first("words").alias("words"), F.min(F.struct("n", "w")).alias("least")).select(F.col("k").alias("inner"), F.col("words").alias("has"), "least.w", "least.n")
    held = outer.select(F.col("k").alias("outer"), "words", F.explode("words").alias("w"))
    asked = stored.materialize(asked, "rarest-words")
    hot = asked.where(F.col("n") >= HOT_WORD)
    told = held.join(asked.where(F.col("n") < HOT_WORD), "w")
    if not hot.isEmpty():
        told = told.unionByName(held.join(F.broadcast(hot) if hot.count() <= BROADCAST_SETS else hot, "w"))
    return told.where(F.size(F.array_except("has", "words")) == 0).select("inner", "outer")


def departed_names(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored names (name, title, _row) that the list has in no form: not equal, nor with fewer or more words. Exempt titles stay.

    A name without words is on no list. Names of the same words are one set."""
    kept = existing.where(~F.lower(F.coalesce("title", F.lit(""))).rlike(EXEMPT))
    a = distinct_names(kept).withColumn("__words", F.array_sort(name_words(strong_key(F.col("name"))))).withColumn("__k", F.array_join("__words", " "))
    b = listed.select(F.array_sort(name_words(strong_key(F.col("name")))).alias("words")).where(F.size("words") > 0).select(F.array_join("words", " ").alias("k"), "words").distinct()
    sets = stored.materialize(a.select(F.col("__k").alias("k"), F.col("__words").alias("words"), F.lit(True).alias("own")).distinct().unionByName(b.withColumn("own", F.lit(False))), "name-sets")
    own, other = sets.where("own").drop("own"), sets.where("NOT own").drop("own")
    frequency = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    present = _contained(own, other, frequency).select(F.col("inner").alias("__k")).unionByName(_contained(other, own, frequency).select(F.col("outer").alias("__k")))
    return a.join(present.distinct(), "__k", "left_anti").drop("__k", "__words")


def remove_departed(table: DataFrame, departed: DataFrame) -> DataFrame:
    """The rows of other names; whoever writes them writes to a new place and swaps."""
    gone = departed.select(strong_key(F.col("name")).alias("__k")).distinct()
    return table.join(gone, strong_key(F.col("name")) == F.col("__k"), "left_anti")


def removed_counts(table: DataFrame, departed: DataFrame) -> DataFrame:
    """name, removed: rows of the table that each departed name takes along, 0 without any."""
    counts = table.groupBy(strong_key(F.col("name")).alias("__k")).agg(F.count("*").alias("removed"))
    return departed.select("name").join(counts, strong_key(F.col("name")) == F.col("__k"), "left").select("name", F.coalesce("removed", F.lit(0)).alias("removed"))


def padded_changes(added: DataFrame, deleted: DataFrame) -> DataFrame:
    """Two lists side by side by position (blank where one is shorter), one row at least, as the changes file has them."""
    number = lambda df, c: number_rows(df.select("name", "_row"), "n").select("n", F.col("name").alias(c))
    both = number(added, "newly added professor").join(number(deleted, "deleted professor"), "n", "full")
    one = added.sparkSession.range(1).select(F.lit(1).cast("long").alias("n"))
    return both.join(one, "n", "full").na.fill("", ["newly added professor", "deleted professor"])


def read_changes(padded: DataFrame) -> DataFrame:
    """name, op (add or delete) of a changes file with a _row; blanks dropped, first of each key and op."""
    long = padded.select("_row", F.expr("stack(2, `newly added professor`, 'add', `deleted professor`, 'delete') as (name, op)"))
    keyed = long.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).withColumn("__k", strong_key(F.col("name"))).where("__k <> ''")
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("op", "__k").orderBy("_row"))).where("__n = 1").select("name", "op", "_row")


def _word_parts(df: DataFrame, least: float) -> DataFrame:
    """Adds part and c: every choice of c of the words that is a share of ``least`` of them or more (at most 2**SHORT a name)."""
    masks = f"filter(sequence(1, shiftleft(1, size(words)) - 1), m -> bit_count(m) >= {least!r} * size(words))"
    parts = F.expr(f"transform({masks}, m -> array_join(filter(words, (x, i) -> getbit(m, i) = 1), ' '))")
    return df.withColumn("part", F.explode(parts)).withColumn("c", F.size(F.split("part", " ")))


def resolve(names: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """names: id, name. pages: name, url, _row. The url of the equal name, else of the best overlap of words.

    Overlap: common words by the words of the longer name, ``least`` or more; ties take the first page. Names of up to SHORT words meet over
    the words that they have in common, all of them at once: of the pages with the same choice of words and the same length only the first
    can win, so a page side has one row a choice and length, and no word is hot. Longer names, on either side, meet over their rarest words,
    as many as an overlap cannot do without, and are compared."""
    key = strong_key(F.col("name"))
    listed = pages.groupBy(key.alias("pkey")).agg(F.min("_row").alias("at"), F.max_by("url", "_row").alias("url")).where("pkey <> ''")
    wanted = names.select("id", key.alias("key")).where("key <> ''")
    exact = wanted.join(listed, wanted.key == listed.pkey).select("id", "url", F.lit(1.0).alias("overlap"), F.lit("exact").alias("how"))
    a = wanted.join(exact.select("id"), "id", "left_anti").select("id", F.array_sort(name_words(F.col("key"))).alias("words"))
    b = listed.select("at", "url", F.array_sort(name_words(F.col("pkey"))).alias("words"))
    small = F.size("words") <= SHORT
    first = _word_parts(b.where(small), least).groupBy("part", F.size("words").alias("nb")).agg(F.min(F.struct("at", "url")).alias("page"))
    met = _word_parts(a.where(small), least).select("id", "part", "c", F.size("words").alias("na")).join(first, "part")
    found = met.select("id", (F.col("c") / F.greatest("na", "nb")).alias("overlap"), "page.at", "page.url").unionByName(_long_overlaps(a, b, least))
    best = found.where(F.col("overlap") >= least).groupBy("id").agg(F.max(F.struct("overlap", (-F.col("at")).alias("back"), "url")).alias("x"))
    return exact.unionByName(best.select("id", "x.url", "x.overlap", F.lit("fuzzy").alias("how")))


def _long_overlaps(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """id, overlap, at, url of pairs where one name has more than SHORT words."""
    n = F.size("words")
    frequency = a.select(F.explode("words").alias("w")).unionByName(b.select(F.explode("words").alias("w"))).groupBy("w").agg(F.count("*").alias("f"))

    def rare(df: DataFrame, names: list[str]) -> DataFrame:
        """The rarest words of each name: with any of the others alone too few are common."""
        words = df.withColumn("w", F.explode("words")).join(frequency, "w").groupBy(*names, "words").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
        return words.withColumn("w", F.explode(F.transform(F.slice("o", F.lit(1), F.size("words") - F.ceil(F.lit(least) * F.size("words")).cast("int") + 1), lambda x: x["w"]))).drop("o")

    fits = F.size("words").between(F.ceil(F.size("theirs") * least), F.floor(F.size("theirs") / least))
    out = None
    for left, right in ((a.where(n > SHORT), b), (a.where(n <= SHORT), b.where(n > SHORT))):
        met = rare(left, ["id"]).join(rare(right, ["at", "url"]).withColumnRenamed("words", "theirs"), "w").where(fits).select("id", "words", "at", "url", "theirs").distinct()
        told = met.select("id", (F.size(F.array_intersect("words", "theirs")) / F.greatest(F.size("words"), F.size("theirs"))).alias("overlap"), "at", "url")
        out = told if out is None else out.unionByName(told)
    return out


def report(counts: DataFrame, title: str, heading: str, at: str) -> DataFrame:
    """The lines of a Markdown report of (name, number): part, name, line, to be written in this order; the time is given.

    Lines stay rows, so that a report of very many names is no single text."""
    head = [f"# {title}", "", f"Generated: {at}", "", f"## {heading}", ""]
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(i, "", line) for i, line in enumerate(head)], "part int, name string, line string")
    rows = counts.select(F.lit(len(head)).alias("part"), "name", F.concat(F.lit("- "), "name", F.lit(": "), F.col("number").cast("string")).alias("line"))
    total = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("number"), F.lit(0)).cast("string").alias("t"))
    none = total.where("n = 0").select(F.lit(len(head)).alias("part"), F.lit("").alias("name"), F.lit("- none").alias("line"))
    end = total.select(F.posexplode(F.array(F.lit(""), F.concat(F.lit("Total: "), "t"))).alias("i", "line")).select((F.col("i") + len(head) + 1).alias("part"), F.lit("").alias("name"), "line")
    return fixed.unionByName(rows).unionByName(none).unionByName(end)


def merge_reports(reports: list[DataFrame]) -> DataFrame:
    """report, part, name, line of several reports in order, a rule before each but the first."""
    out = None
    for k, lines in enumerate(reports):
        rule = lines.sparkSession.createDataFrame([(-3, "", ""), (-2, "", "---"), (-1, "", "")] if k else [], "part int, name string, line string")
        told = rule.unionByName(lines).select(F.lit(k).alias("report"), "part", "name", "line")
        out = told if out is None else out.unionByName(told)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """One text a folder, sorted by the report's keys, by ranges; parts of files follow each other by name."""
    keys = [c for c in ("report", "part", "name") if c in lines.columns]
    lines.orderBy(*keys).select("line").write.mode("overwrite").text(path)
