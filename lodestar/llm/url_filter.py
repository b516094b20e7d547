"""Operator 2: URL filters with link-graph propagation.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and
the longest fitting rule decides.  Urls without a rule are judged by their host's
place in the link graph: personalised PageRank from trusted hosts along the links,
and the same from blocked hosts against them (who links to blocked hosts is
distrusted).  A host is a seed, with the share as weight, if rules allow (block)
more than ``SEED_SHARE`` of its pages.  A host is blocked if its distrust is more
than ``THRESHOLD`` of trust and distrust together; a host that neither reaches is
allowed.

The edges are the pages' links between hosts and, as a host answers for its
subdomains and they for it, an edge each way of weight ``FAMILY`` between a host and
its parent domain (of two labels at least), whether pages of that domain are there
or not.  Domains under which anyone can have a host (``PUBLIC``) are no parents: strangers
do not answer for each other.  Links are resolved first; those inside a host are no edges.

Links are counted per page and pair of hosts before they are shuffled, so a page
or host with very many links is a few rows.  A round is one equi-join of host
scores with host edges and one aggregation with partial sums; ``WRITTEN`` rounds are
one job, whose result is written.  Scores are sums of walks from the seeds, scaled to
sum to 1 at the end, which returns the mass of hosts without outgoing edges to the
seeds.  A step takes at least 1 - ``DAMPING`` of what still walks, so the rounds go
on until less than ``SETTLED`` of the scores can still change: their number has a
bound that follows from both.

Defined results: a null url and one without ``://`` have empty host and path, no
rule and the verdict allow; repeated rows are judged each; null html has no links;
a page whose host no
seed reaches is allowed, with trust and distrust 0; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import BROADCAST_ROWS, bounded_broadcast
from .storage import materialize, release

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SEED_SHARE = 0.5
THRESHOLD = 0.5
DAMPING = 0.85
#: Share of the scores that may still change when the rounds end, and rounds of one written job.
SETTLED = 1e-6
WRITTEN = 16
#: A host is blocked only if its distrust is this share of a host's mean or more.
LEAST_DISTRUST = 0.01
#: Domains under which anyone can have a host (some of the well-known ones; a parameter): their hosts are no family.
PUBLIC = tuple(
    """co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.jp ne.jp or.jp ac.jp com.br com.cn net.cn org.cn com.mx com.tr com.ar co.in co.kr co.nz co.za com.hk com.sg com.tw
    github.io gitlab.io blogspot.com wordpress.com tumblr.com herokuapp.com netlify.app vercel.app pages.dev web.app appspot.com cloudfront.net amazonaws.com azurewebsites.net""".split()
)
#: Weight of the edges between a host and its parent domain, in linking pages.
FAMILY = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. Rules are literals of the plan: a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule tables of any size (host, path, verdict): distinct (host, path) of ``urls`` with rule and verdict.

    Every host suffix is joined with the rules' hosts; the longest fitting rule is a max with partial aggregation."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    told = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.col("verdict").alias("v"))
    fits = wide.join(told, "suffix").where(F.col("path").startswith(F.col("prefix")))
    best = F.max(F.struct(F.length(F.concat("suffix", "prefix")).alias("n"), F.length("suffix").alias("m"), F.concat("suffix", "prefix").alias("rule"), F.col("v").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def parent_of(host: Column) -> Column:
    """The host without its first label if two labels are left and it is not a number of an address; else null."""
    rest = F.regexp_extract(host, r"^[^.]+\.([^.]+\.[^:]*[^.:0-9][^:]*)$", 1)
    return F.when(rest != "", rest)


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of host src that link to host dst; links inside a host are left out.

    Relative links lead to the page's own host, so only those that name a host (with or without a scheme) give edges."""
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1)), lambda u: F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u))
    hosts = F.array_distinct(F.transform(F.filter(links, lambda u: u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")), lambda u: host_of(u)))
    pairs = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def family_edges(hosts: DataFrame, weight: float = FAMILY, public: Sequence[str] = PUBLIC) -> DataFrame:
    """hosts: host. (src, dst, weight) both ways between every host, its parent domain, and so on up, short of the public domains."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.where("host <> ''").select(F.explode(suffixes).alias("src")).distinct().select("src", parent_of(F.col("src")).alias("dst")).where("dst is not null").where(~F.col("dst").isin(*public) if public else F.lit(True))
    return up.select("src", "dst", F.lit(float(weight)).alias("weight")).union(up.select("dst", "src", F.lit(float(weight))))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """hosts: host, trust_seed, distrust_seed (0 or more). Returns host, trust, distrust; each sums to 1 if it has a seed.

    Trust runs from src to dst, distrust from dst to src."""
    edges = materialize(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "host-edges")
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    seeds = hosts.join(ends, "host", "full").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust_seed", "distrust_seed")])
    sums = seeds.agg(F.sum("trust_seed"), F.sum("distrust_seed")).first()
    scale = [1.0 / (x or 1.0) for x in sums]
    out, back = edges.groupBy(F.col("src").alias("giver")).agg(F.sum("weight").alias("total")), edges.groupBy(F.col("dst").alias("giver")).agg(F.sum("weight").alias("total"))
    flows = (
        edges.withColumnRenamed("src", "giver").join(out, "giver").select("giver", F.col("dst").alias("taker"), (F.col("weight") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
        .unionByName(edges.withColumnRenamed("dst", "giver").join(back, "giver").select("giver", F.col("src").alias("taker"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("total")).alias("d")))
    )
    flows = flows.groupBy("giver", "taker").agg((damping * F.sum("t")).alias("t"), (damping * F.sum("d")).alias("d"))
    # A host keeps what has come: an edge to itself, so that a round names the state before it once.
    kept = seeds.select(F.col("host").alias("giver"), F.col("host").alias("taker"), *[F.lit(0.0).alias(c) for c in ("t", "d")], F.lit(1.0).alias("keeps"))
    flows = materialize(flows.withColumn("keeps", F.lit(0.0)).unionByName(kept), "host-flows")
    # What has come so far (trust, distrust) and what walks on (t_on, d_on).
    started = seeds.select("host", *[(F.col(c) * x).alias(name) for names in (("trust", "distrust"), ("t_on", "d_on")) for c, x, name in zip(("trust_seed", "distrust_seed"), scale, names, strict=True)])
    state = materialize(started, "host-scores")
    # A graph that is counted to be small goes to one task whole, which then needs no shuffle between its rounds.
    small = flows.count() <= BROADCAST_ROWS
    if small:
        flows = F.broadcast(flows)
    rounds = 0
    # Walks that are left after a round sum to damping / (1 - damping) of the last round's at most.
    while rounds * math.log(damping) > math.log(settled * (1 - damping)) - WRITTEN * 2:
        before = state
        state = state.coalesce(1) if small else state
        for _ in range(WRITTEN):
            along = state.withColumnRenamed("host", "giver").join(flows, "giver")
            t, d = F.col("t_on") * F.col("t"), F.col("d_on") * F.col("d")
            state = along.groupBy(F.col("taker").alias("host")).agg(
                F.sum(F.col("keeps") * F.col("trust") + t).alias("trust"), F.sum(F.col("keeps") * F.col("distrust") + d).alias("distrust"), F.sum(t).alias("t_on"), F.sum(d).alias("d_on")
            )
        rounds += WRITTEN
        state = materialize(state, "host-scores")
        release(before)
        left = state.agg(F.sum("t_on"), F.sum("d_on")).first()
        if sum(x or 0.0 for x in left) <= settled * (1 - damping):
            break
    else:
        raise RuntimeError("scores of hosts did not settle")
    total = state.agg(F.sum("trust"), F.sum("distrust")).first()
    return state.select("host", *[(F.col(c) / F.lit(x or 1.0)).alias(c) for c, x in zip(("trust", "distrust"), total, strict=True)])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, public: Sequence[str] = PUBLIC) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row a page."""
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.coalesce((F.col("fit.verdict") == verdict).cast("double"), F.lit(0.0)))
    seed = lambda name: F.when(F.col(name) > SEED_SHARE, F.col(name)).otherwise(0.0).alias(name)
    hosts = told.where("host <> ''").groupBy("host").agg(share("allow").alias("trust_seed"), share("block").alias("distrust_seed")).select("host", seed("trust_seed"), seed("distrust_seed"))
    scores = materialize(propagate(hosts, link_edges(pages).unionByName(family_edges(hosts, public=public))), "host-ranks")
    count = scores.count()
    placed = told.join(bounded_broadcast(scores, count), "host", "left")
    blocked = F.coalesce((F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") * count >= LEAST_DISTRUST), F.lit(False))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(blocked, "block").otherwise("allow"))
    return placed.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
