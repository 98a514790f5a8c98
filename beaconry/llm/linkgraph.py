"""URL rules, and trust and distrust propagated over links between hosts.

A url is judged by the longest rule (host suffix and path prefix) that fits. Hosts without a fitting rule get
their verdict from two personalised PageRanks over host edges: trust flows along links from hosts with
allowed pages, distrust flows against links from hosts with blocked pages. A seed is the part of a host's pages by
which allowed ones outnumber blocked ones, or the other way round. Trust is dealt out over the links of the host it
comes from. Distrust reaches a host in proportion to the part of its own links that lead to distrusted hosts, so it is the
damped chance that a walk along the host's links ends at a blocked one. Pages elsewhere change neither. A
host is blocked when its distrust is at least ``threshold`` times (1 + its trust), both divided by 1 - damping: with
the defaults, when about three of seven links (0.3 / 0.7) lead to blocked hosts, or all of them to hosts that link to nothing
but blocked hosts, up to three hops away; a vouched-for host needs more.

Host edges come from absolute links (href, src) in the pages, counted per pair of hosts before anything else,
and, with ``site_edges``, from each host to its parent domain and back when both are hosts of the table. Ranks
live in DataFrames: each round joins them with the edges, sums by target before the shuffle, and is written to
the shared folder. Rounds stop when no host's rank moves by more than the part ``tolerance`` of itself; moves of less
than a thousandth of what blocks a host do not count. Seeds are at most 1 a host and damped, so rounds do not grow with
pages (about 25 with the defaults). Ranks that do not settle are an error.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and the verdict allow; a null
html has no links; hosts without a score are allowed; repeated pages count again as seeds and links; of rules of
equal length with the same host and path the later in the list counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.session import stored

#: (verdict, host, path): the rules of the contract, in its order.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _CAPITALS, _SMALL)


def url_host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    longest_last = sorted(rules, key=lambda r: len(r[1]) + len(r[2]))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in longest_last:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, hosts: DataFrame, site_edges: bool = True) -> DataFrame:
    """src, dst, weight: links between different hosts, each host's weights summing to 1 is left to the caller."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(
        "html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src != '' and src != dst")
    edges = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if site_edges:
        up = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("parent")).where("parent != ''")
        up = up.join(hosts.select(F.col("host").alias("parent")), "parent")
        edges = edges.union(up.select("host", "parent", F.lit(1.0))).union(up.select("parent", "host", F.lit(1.0)))
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, max_rounds: int = 500,
    scaled: bool = True, least: float = 0.0, by_linker: bool = False,
) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust): both ranks in the same rounds.

    Distrust runs against the edges; a host's share of it is its part of the links into the distrusted host, or with
    ``by_linker`` that host's part of its own links. Seeds are scaled to sum 1 each, unless not ``scaled``. A round is rank = (1 - damping) * seed + damping * inflow; mass
    on hosts without outgoing edges is lost alike for both ranks. Moves of a rank up to ``least`` or up to its part
    ``tolerance`` count as none. Only one number per round reaches the driver.
    """
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first() if scaled else (1.0, 1.0)
    start = stored(seeds.groupBy("host").agg(*[
        (F.sum(c) / F.lit(float(t or 0) or 1.0) * (1 - damping)).alias(c) for c, t in zip(("trust", "distrust"), total)]).where(
        "trust > 0 or distrust > 0"), "seeds")
    links = stored(edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "weight", F.lit(True).alias("ahead"))
                   .union(edges.select("dst", "src", "weight", F.lit(False))), "hostlinks")
    links = links.withColumn("of", F.when(F.col("ahead") | F.lit(not by_linker), F.col("host")).otherwise(F.col("to")))
    out = links.groupBy("of", "ahead").agg(F.sum("weight").alias("out"))
    links = stored(links.join(out, ["of", "ahead"]).select(
        "host", "to", "ahead", (damping * F.col("weight") / F.col("out")).alias("share")), "hostshares")
    ranks = start
    if links.isEmpty() or start.isEmpty():
        return ranks

    def moves(rank: str, by: str) -> Column:
        return F.abs(by) > F.greatest(F.lit(least), tolerance * F.col(rank))

    for _ in range(max_rounds):
        inflow = ranks.join(links, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.when(F.col("ahead"), F.col("trust") * F.col("share")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(~F.col("ahead"), F.col("distrust") * F.col("share")).otherwise(0.0)).alias("distrust"))
        new = stored(inflow.union(start).groupBy("host").agg(
            F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
        moving = new.select("host", "trust", "distrust", F.col("trust").alias("t"), F.col("distrust").alias("d")).union(
            ranks.select("host", F.lit(0.0), F.lit(0.0), -F.col("trust"), -F.col("distrust"))).groupBy("host").agg(
            *[F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")]).where(
            moves("trust", "t") | moves("distrust", "d"))
        ranks = new
        if moving.isEmpty():
            return ranks
    raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")


def judge(
    pages: DataFrame, rules=RULES, threshold: float = 0.3, damping: float = 0.7, site_edges: bool = True,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    url = F.col("url")
    located = pages.select("page_id", F.col("html"), url_host(url).alias("host"), url_path(url).alias("path"))
    located = located.select("page_id", "html", F.coalesce("host", F.lit("")).alias("host"),
                             F.coalesce("path", F.lit("")).alias("path"))
    ruled = located.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    thin = stored(ruled.select("page_id", "host", "path", "_rule"), "urls")
    per_host = stored(thin.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("_rule.verdict") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("_rule.verdict") == "block", 1)).alias("blocked")), "hosts")
    # a host vouches or warns by what its judged pages say, weighed by their part of all its pages
    lead = (F.col("allowed") - F.col("blocked")) / F.col("n")
    seeds = per_host.select("host", F.greatest(lead, F.lit(0.0)).alias("trust"), F.greatest(-lead, F.lit(0.0)).alias("distrust"))
    edges = stored(host_edges(located.select("host", "html"), per_host.select("host"), site_edges), "hostedges")
    ranks = propagate(edges, seeds, damping, scaled=False, least=threshold * (1 - damping) / 1000, by_linker=True).select(
        "host", *[(F.col(c) / (1 - damping)).alias(c) for c in ("trust", "distrust")])
    bad = F.col("distrust") >= threshold * (1 + F.col("trust"))
    return thin.join(ranks, "host", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
