"""URL verdicts by rules, and by trust propagated over the link graph of hosts.

Rules decide the urls they fit.  For the rest, the hosts of allowed pages seed a
personalised PageRank that follows links forward (trust), the hosts of blocked
pages one that follows them backward (distrust: who links to blocked hosts
shares their blame).  A host is blocked where distrust exceeds trust.

DataFrame functions only.  Defined results: a null url, or one without
``://``, has empty host and path, fits no rule and is allowed; so is a host that
neither rank reaches.  Of fitting rules the longest wins, on a tie the blocking
one, then the first in order.  Null html has no links; repeated rows count as
often as they stand there.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, discard, materialize

#: Fixed rules of the filter: verdict and host/path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A longer list is a table that hosts are joined with, a shorter one an expression.
MOST_RULES = 500
#: STEPS is the SQL's; here a step follows until no host's ranks move by more than SETTLED of their own size.
DAMPING, STEPS, SETTLED = 0.85, 30, 1e-4
#: A verdict stands when its margin is so many times what the ranks still move by, or they move by rounding only.
MARGIN, ROUNDING = 10, 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The rule that decides, as text, or null, as one expression."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def join_rules(ruled: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Add ``rule`` and ``said`` to rows with ``host`` and ``path``: each host meets the rules of all domains above it by equality."""
    spark = ruled.sparkSession
    listed = spark.createDataFrame(list(rules), "said string, rule string")
    at, prefix = F.substring_index("rule", "/", 1), F.concat(F.lit("/"), F.expr("substring(rule, instr(rule, '/') + 1)"))
    listed = listed.select("said", "rule", at.alias("domain"), prefix.alias("prefix"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = ruled.select("host", "path").distinct().withColumn("domain", F.explode(domains))
    order = F.struct(-F.length("rule"), F.col("said") != "block", "rule")
    best = places.join(listed, "domain").filter(F.col("path").startswith(F.col("prefix"))).groupBy("host", "path").agg(F.min_by(F.struct("rule", "said"), order).alias("best"))
    return ruled.join(best, ["host", "path"], "left").select(ruled["*"], "best.rule", "best.said")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    links = pages.select(host_of(blank("url")).alias("src"), F.explode(F.regexp_extract_all(blank("html"), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, allowed, blocked)`` and ``edges(src, dst, n)``."""
    total = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    share = [F.col(c) / F.lit(float(t)) if t else F.lit(0.0) for c, t in zip(("allowed", "blocked"), total)]
    seeds = materialize(seeds.select("host", share[0].alias("s"), share[1].alias("b")), "seeds")
    ranks = seeds.select("host", F.col("s").alias("trust"), F.col("b").alias("distrust"))
    edges = materialize(edges, "edges")
    if edges.isEmpty():
        return ranks
    out, into = edges.groupBy("src").agg(F.sum("n").alias("n_out")), edges.groupBy("dst").agg(F.sum("n").alias("n_in"))
    weighted = edges.join(materialize(out, "out"), "src").join(materialize(into, "in"), "dst")
    edges = materialize(weighted.select("src", "dst", (F.col("n") / F.col("n_out")).alias("forward"), (F.col("n") / F.col("n_in")).alias("back")), "edges")
    # ends, as what a step brings falls by DAMPING and at last below the least number
    while True:
        zero = F.lit(0.0)
        ahead = edges.join(ranks, edges.src == ranks.host).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forward")).alias("t"), zero.alias("d"))
        behind = edges.join(ranks, edges.dst == ranks.host).select(F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        base = seeds.select("host", (F.col("s") * (1 - DAMPING) / DAMPING).alias("t"), (F.col("b") * (1 - DAMPING) / DAMPING).alias("d"))
        summed = ahead.unionByName(behind).unionByName(base).groupBy("host")
        now = materialize(summed.agg((F.sum("t") * DAMPING).alias("trust"), (F.sum("d") * DAMPING).alias("distrust")), "ranks")
        was = ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        t, d, t0, d0 = (F.coalesce(c, zero) for c in ("trust", "distrust", "t0", "d0"))
        dt, dd = F.abs(t - t0), F.abs(d - d0)
        # a host that is reached for the first time moves by all of its rank
        moves = (dt > t * SETTLED) | (dd > d * SETTLED)
        unsure = (dt + dd > (t + d) * ROUNDING) & (F.abs(d - t) <= (dt + dd) * MARGIN)
        left = now.join(was, "host", "left").filter(moves | unsure | ((d > t) != (d0 > t0)))
        settled, old, ranks = left.isEmpty(), ranks, now
        discard(old)
        if settled:
            return ranks


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    url = blank("url")
    ruled = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    if len(rules) > MOST_RULES:
        ruled = join_rules(ruled, rules)
    else:
        ruled = ruled.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        said = reduce(lambda out, r: F.when(F.col("rule") == r[1], F.lit(r[0])).otherwise(out), rules, F.lit(None).cast("string"))
        ruled = ruled.withColumn("said", said)
    seeds = ruled.filter("said is not null").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    ranks = propagate(seeds, host_edges(pages))
    judged = ruled.join(ranks, "host", "left")
    suspect = F.coalesce(F.col("distrust"), F.lit(0.0)) > F.coalesce(F.col("trust"), F.lit(0.0))
    verdict = F.coalesce("said", F.when(suspect, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def fits(host: str, path: str, rule: str) -> bool:
    """Whether a rule fits, as plain Python, for tests."""
    at, _, prefix = rule.partition("/")
    return bool(re.fullmatch(rf"(?s)(.*\.)?{re.escape(at)}", host)) and path.startswith(f"/{prefix}")
