"""Profiles: grouped texts, keep-first rows, weighted documents, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, source_class, title_class, weak_key


def keep_first(df: DataFrame, keys: list[str], order: str = "_row") -> DataFrame:
    """The first row of each combination of keys."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def group_concat(df: DataFrame, key: str, values: list[str], order: str = "_row", separator: str = " | ") -> DataFrame:
    """Values of a key in row order, nulls left out; null keys go; a key of nulls alone gets the empty string."""
    joined = [F.coalesce(_ordered(v, order, separator), F.lit("")).alias(v) for v in values]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*joined)


def _ordered(value: str, order: str, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), separator)


def merge_people(info: DataFrame, projects: DataFrame, papers: DataFrame) -> DataFrame:
    """People with their grouped projects and papers, joined on the exact name; no match is the empty string."""
    grouped = group_concat(projects, "name", ["leading_project", "funding"])
    written = group_concat(papers, "name", ["paper"])
    return info.join(grouped, "name", "left").join(written, "name", "left").na.fill("", ["leading_project", "funding", "paper"])


def clean_people(df: DataFrame) -> DataFrame:
    """Text columns cleaned, first row of each (name, department, title), blank names numbered, years as a number (NaN if unreadable)."""
    for c in ("name", "department", "title", "research_interests", "url"):
        df = df.withColumn(c, clean_text(F.col(c)) if c in df.columns else F.lit(""))
    kinds = dict(df.dtypes)
    if kinds.get("is_engineering", "boolean") != "boolean":
        df = df.withColumn("is_engineering", truthy(F.col("is_engineering")))
    if "years_since_phd" in df.columns:
        df = df.withColumn("years_since_phd", F.coalesce(F.col("years_since_phd").cast("string").try_cast("double"), F.lit(float("nan"))))
    numbered = number_rows(keep_first(df, ["name", "department", "title"]), "__n")
    return numbered.withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("Professor "), F.col("__n"))).otherwise(F.col("name"))).drop("__n")


def number_rows(df: DataFrame, out: str, order: str = "_row", width: int = 100_000) -> DataFrame:
    """Row numbers from 1 in the order of a whole-number column: counted per range of it, so that no task sorts all rows."""
    at = F.floor(F.col(order) / width)
    counts = df.groupBy(at.alias("__at")).agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.sum("__c").over(Window.orderBy("__at")) - F.col("__c")).drop("__c")
    inside = df.withColumn("__at", at).withColumn("__i", F.row_number().over(Window.partitionBy("__at").orderBy(order)))
    return inside.join(before, "__at").withColumn(out, F.col("__before") + F.col("__i")).drop("__at", "__i", "__before")


def truthy(c: Column) -> Column:
    """Any non-empty string counts as true, even ``no``; null is false."""
    return F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))


def attach_projects(people: DataFrame, deeptech: DataFrame) -> DataFrame:
    """Adds ``deeptech``: each person's technology projects as structs in file order; the key ignores case and blanks."""
    fields = [c for c in deeptech.columns if c not in ("pi", "_row")]
    key = weak_key(F.col("pi"))
    lists = deeptech.where(key != "").groupBy(key.alias("__key")).agg(F.array_sort(F.collect_list(F.struct("_row", *fields))).alias("deeptech"))
    joined = people.join(lists, weak_key(F.col("name")) == F.col("__key"), "left").drop("__key")
    return joined.withColumn("deeptech", F.coalesce("deeptech", F.array().cast(lists.schema["deeptech"].dataType)))


def repeats(weight: float) -> int:
    """How often a field of this weight is said: three times the weight, half to even, once at least."""
    return max(1, round(weight * 3))


def weighted_text(fields: dict[str, tuple[Column, float]]) -> Column:
    """``Label: text`` of every non-blank field, as often as its weight says, joined by ``. ``."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.array_repeat(F.concat(F.lit(f"{label}: "), c), repeats(w))).otherwise(F.array().cast("array<string>")) for label, (c, w) in fields.items()]
    return F.array_join(F.flatten(F.array(*parts)), ". ")


def project_text(p: Column) -> Column:
    """Overview, edges, applications and industries of a project; blanks left out."""
    return F.concat_ws(" ", F.nullif(p["overview"], F.lit("")), F.nullif(p["tech_edges"], F.lit("")), F.nullif(F.array_join(p["applications"], " "), F.lit("")), F.nullif(F.array_join(p["industries"], " "), F.lit("")))


# Scores of title classes.
TITLE_SCORES = {"assistant": 1.0, "lecturer": 0.8, "associate": 0.5, "professor": 0.3}


def title_score(c: Column) -> Column:
    kind = title_class(c)
    out = F.lit(TITLE_SCORES["professor"])
    for name, score in TITLE_SCORES.items():
        out = F.when(kind == name, F.lit(score)).otherwise(out)
    return out


def priority(years: Column | None, title: Column, engineering: Column, weights: tuple[float, float, float] = (0.5, 0.5, 0.5), default_years: int = 10, bonus: float = 1.2) -> Column:
    """w_years / (1 + years) + w_title * score + w_eng * bonus. Unreadable years (NaN) count as 0, absent ones as the default."""
    y = F.lit(float(default_years)) if years is None else F.coalesce(years.cast("double"), F.lit(float(default_years)))
    y = F.when(F.isnan(y) | (y < 0), 0.0).otherwise(y)
    return weights[0] / (1.0 + y) + weights[1] * title_score(title) + weights[2] * F.when(engineering, float(bonus)).otherwise(1.0)


def source_order(c: Column) -> Column:
    """Display order of sources: bmh, eas, mes."""
    kind = source_class(c)
    return F.when(kind == "bmh", 0).when(kind == "eas", 1).otherwise(2)


def by_source(projects: DataFrame, parent: str = "id") -> DataFrame:
    """Adds place: the order in which a parent's projects are shown, by source, then title."""
    order = Window.partitionBy(parent).orderBy(source_order(F.col("source")), F.coalesce("technology_title", F.lit("")), "project")
    return projects.withColumn("place", F.row_number().over(order))


def dominant_source(projects: DataFrame, parent: str = "id") -> DataFrame:
    """The most frequent source of each parent; ties in the order eas, bmh, mes."""
    kind = source_class(F.col("source"))
    counts = projects.groupBy(parent).agg(*[F.count_if(kind == k).alias(k) for k in ("eas", "bmh", "mes")])
    return counts.select(parent, F.when((F.col("eas") >= F.col("bmh")) & (F.col("eas") >= F.col("mes")), "eas").when(F.col("bmh") >= F.col("mes"), "bmh").otherwise("mes").alias("source"))
