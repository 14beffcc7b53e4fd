"""URL filter: host rules, and trust and distrust that spread over links.

Rules are (verdict, host, path): a rule fits its host and all subdomains where
the url's path starts with the rule's, and the longest fitting rule decides.
Pages that no rule fits are judged by their host:

* edges are the distinct pairs of hosts of the hyperlinks (``href`` and ``src``)
  in the pages, weighed by their number; links within a host carry nothing;
* trust is a personalised PageRank from trusted hosts along the links, distrust
  one from blocked hosts against the links, since a host answers for where it
  links to.  A host is a seed if one verdict of the rules fits more than
  :data:`SEED_SHARE` of its urls, and weighs that share: a rule for some of a
  host's pages does not condemn the others;
* scores are in units of a seed, and a host is blocked where its distrust
  exceeds its trust by :data:`MARGIN`.

Mass is counted in whole units of 2**-50 of all and each transfer is rounded
down, so sums do not depend on their order: reruns and lost executors give the
same bits.  The mass that does not arrive anywhere (ends of links, the jump,
what rounding leaves) goes back to the seeds.  The rounds end when nothing
moves, or after :data:`ROUNDS`.  Every round is a join by source host and a sum
by target host, written to the shared folder; only totals and sizes reach the
driver.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed; a null html has no links; equal rows give equal
results, each counted; page ids may be null, repeated and of any type; extra
columns are ignored; an empty table gives an empty result; a rule's path must
be met from its first slash (a url without a path fits none).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satspan.llm.common import lower_ascii, materialize


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

#: Share of a host's mass that follows its links; the rest jumps to the seeds.
FOLLOW = 0.85
ROUNDS = 12
#: A host is a seed from this share of its urls on.
SEED_SHARE = 0.5
#: A quarter of a seed.
MARGIN = 0.25
UNITS = 1 << 50

_URL = r"://([^/?#]*)([^?#]*)"
#: An absolute or protocol-relative address in an attribute; group 1 is the host.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s/?#"'<>]+)"""

#: A table of hosts is broadcast up to this many bytes, counted before.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _by_rule(host: Column, path: Column, rules: tuple[HostRule, ...], value: str) -> Column:
    """``value`` (rule or verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, r.host + r.path if value == "rule" else r.verdict).otherwise(found)
    return found


def _is_small(hosts: DataFrame) -> bool:
    held = hosts.select(F.sum(F.octet_length("host") + 64).alias("x")).first()["x"]
    return (held or 0) <= BROADCAST_BYTES


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n_links) of the links between different hosts."""
    targets = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    links = pages.where(F.contains("html", F.lit("//"))).select(
        host_of(F.col("url")).alias("src"), F.explode(F.transform(targets, lower_ascii)).alias("dst")
    )
    return links.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n_links"))


def seeds(pages: DataFrame, rules: tuple[HostRule, ...] = RULES) -> DataFrame:
    """(host, trusted, blocked): weights of the seeds, else 0."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), _by_rule(host, path, rules, "verdict").alias("verdict")).where("host <> ''")
    share = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)) / F.count("*")
    seed = lambda v: F.when(share(v) > SEED_SHARE, share(v)).otherwise(0.0)
    return judged.groupBy("host").agg(seed("allow").alias("trusted"), seed("block").alias("blocked"))


def propagate(links: DataFrame, start: DataFrame, rounds: int = ROUNDS, follow: float = FOLLOW) -> DataFrame:
    """(host, trust, distrust), in seeds, of every host that has some.

    ``links(src, dst, n_links)`` and ``start(host, trusted, blocked)``.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n_links").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n_links")
    )
    out = both.groupBy("kind", "host").agg(F.sum("n_links").alias("n_out"))
    flow = materialize(
        both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.lit(follow) * (F.col("n_links") / F.col("n_out"))).alias("share")),
        "link-flow",
    )
    weights = start.select("host", F.lit("trust").alias("kind"), F.col("trusted").alias("weight")).union(
        start.select("host", F.lit("distrust"), F.col("blocked"))
    ).where("weight > 0")
    # Weights are rounded to whole millionths of a seed, so that totals are exact.
    weights = materialize(weights.withColumn("weight", F.floor(F.col("weight") * 1e6)).where("weight > 0"), "link-seeds")
    totals = {r["kind"]: r["w"] for r in weights.groupBy("kind").agg(F.sum("weight").alias("w")).collect()}  # two rows
    total = F.when(F.col("kind") == "trust", F.lit(totals.get("trust", 1))).otherwise(F.lit(totals.get("distrust", 1)))
    home = weights.select("kind", "host", (F.col("weight") / total).alias("home"))
    mass = materialize(home.select("kind", "host", F.floor(F.col("home") * UNITS).alias("mass")), "link-mass")
    for _ in range(rounds):
        small = _is_small(mass)
        came = (
            flow.join(F.broadcast(mass) if small else mass, ["kind", "host"])
            .groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.floor(F.col("mass") * F.col("share"))).alias("came"))
        )
        came = materialize(came, "link-came")
        arrived = {r["kind"]: r["c"] for r in came.groupBy("kind").agg(F.sum("came").alias("c")).collect()}  # two rows
        rest = F.when(F.col("kind") == "trust", F.lit(UNITS - arrived.get("trust", 0))).otherwise(F.lit(UNITS - arrived.get("distrust", 0)))
        summed = (
            home.select("kind", "host", F.floor(rest * F.col("home")).alias("mass"), F.lit(0).cast("long").alias("old"))
            .union(came.select("kind", "host", "came", F.lit(0).cast("long")))
            .union(mass.select("kind", "host", F.lit(0).cast("long"), "mass"))
            .groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old"))
        )
        step = materialize(summed, "link-mass")
        mass = step.select("kind", "host", "mass")
        if step.where("mass <> old").isEmpty():
            break
    in_seeds = F.col("mass") * (total / 1e6) / float(UNITS)
    return mass.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", in_seeds)), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", in_seeds)), F.lit(0.0)).alias("distrust"),
    )


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, margin: float = MARGIN) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust
    (of the host; six decimals)."""
    scores = materialize(propagate(edges(pages), seeds(pages, rules)), "link-scores")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(
        "page_id", host.alias("host"), path.alias("path"),
        _by_rule(host, path, rules, "rule").alias("rule"), _by_rule(host, path, rules, "verdict").alias("by_rule"),
    )
    joined = rows.join(F.broadcast(scores) if _is_small(scores) else scores, "host", "left")
    trust, distrust = (F.round(F.coalesce(F.col(x), F.lit(0.0)), 6) for x in ("trust", "distrust"))
    by_host = F.when(distrust - trust >= margin, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce(F.col("by_rule"), by_host).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
