"""URL filter: fixed host and path rules first, link-graph propagation for every other host.

Rules decide where one fits (the longest wins).  The rest is judged by its host: personalised
PageRank carries trust forward from hosts most of whose pages are allowed by rule and distrust backward,
over the reversed edges, from hosts most of whose pages are blocked by rule.  Every seed host starts with rank 1 (ranks
are not divided by the number of seeds, so they do not move with the size of the table).  A host is blocked when its distrust
is at least LEAST and at least SHARE of its trust and distrust together.  What flows into a host without out-links ends
there; sending it back to the seeds would only multiply all ranks by one factor, which would depend on the table.

Scale: html is read once; edges are pre-aggregated per (from, to) host before the shuffle, a hot host is
split by AQE's skew join, and each round is a join and a partially aggregated sum of host rows only.
The ranks are written to the shared folder every CUT rounds; there the largest change decides whether to go on
(below TOLERANCE no host can still move by more than TOLERANCE * DAMPING / (1 - DAMPING) a unit of its in-links).

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is
allowed by the method unless other pages put distrust on the empty host (they cannot: links to it are
dropped).  Null html has no links; relative links stay on their host and carry nothing, unless the page
names another host by `<base href>`, which they then lead to; anchors and mailto:, javascript:, data: and tel: links lead nowhere.
Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, staged, table

#: (verdict, host, path); fixed values of the contract.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
CUT, DAMPING = 4, 0.85
#: Ranks are final when no host moves by TOLERANCE in a round; ROUNDS bounds the work where that is never so (0.85 ** 96 is 2e-7).
TOLERANCE, ROUNDS = 1e-6, 96
#: A host is blocked from this distrust on (a host all of whose links lead to one blocked host that nobody else links to has
#: 0.1275), if it is at least SHARE of trust and distrust.
LEAST, SHARE = 1e-4, 0.5


def _host(url):
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def split_url(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        "page_id",
        _host(url).alias("host"),
        F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
        F.col("html").cast("string").alias("html"),
    )


def _rule(rules):
    """The longest fitting rule as struct(rule, verdict), else null."""
    out = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        made = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def host_edges(split: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts and their number."""
    away = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    every = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<(?:a|area|link)\b[^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    base = F.when(F.lower("html").contains("<base"), F.regexp_extract("html", r"(?i)<base\b[^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    based = split.where(F.col("host") != "").withColumn("base", _absolute(F.coalesce(base, F.lit(""))))
    # pages that name another base are rare: only of them all links are read
    found = based.select("host", "base", F.explode(F.when(F.col("base") == "", away).otherwise(every)).alias("link"))
    relative = ~F.col("link").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)")
    full = F.when(relative, F.col("base")).otherwise(_absolute(F.col("link")))
    counted = found.select(F.col("host").alias("src"), _host(full).alias("dst")).where("dst <> '' and src <> dst")
    return counted.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _absolute(link):
    """http and https addresses, with `//host` taken as one; anything else is empty."""
    return F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).when(link.rlike("(?i)^https?://"), link).otherwise(F.lit(""))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of hosts (host, rank): edges (src, dst, n), seeds (host, seed).

    At most `rounds` rounds, fewer where the ranks have settled (looked at every CUT rounds)."""
    out_links = edges.groupBy("src").agg(F.sum("n").alias("_all"))
    weighted = staged(edges.join(out_links, "src").select("src", "dst", (F.col("n") / F.col("_all")).alias("w")), "host-edges")
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    if weighted.isEmpty():
        return ranks
    start = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("rank"))
    for i in range(1, rounds + 1):
        old = ranks
        moved = weighted.join(old, weighted["src"] == old["host"]).select(F.col("dst").alias("host"), (F.col("w") * F.col("rank") * DAMPING).alias("rank"))
        if i % CUT or i == rounds:
            ranks = moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
            continue
        both = [df.withColumn("before", F.lit(0.0)) for df in (moved, start)] + [old.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("before"))]
        both = both[0].unionByName(both[1]).unionByName(both[2])
        ranks = staged(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")), "host-ranks")
        change = ranks.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
        ranks = ranks.select("host", "rank")
        if (change or 0.0) < tolerance:
            break
    return ranks


def _seeds(hosts: DataFrame, verdict: str) -> DataFrame:
    """host, seed: the hosts most of whose pages have this verdict by rule, 1 each."""
    return hosts.where(F.col(verdict) * 2 > F.col("n")).select("host", F.lit(1.0).alias("seed"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    split = split_url(pages)
    edges = staged(host_edges(split), "host-links")
    judged = split.select("page_id", "host", "path", _rule(rules).alias("found"))
    ruled = [F.count_if(F.col("found.verdict") == v).alias(v) for v in ("allow", "block")]
    hosts = staged(judged.groupBy("host").agg(F.count("*").alias("n"), *ruled), "page-hosts")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(edges, _seeds(hosts, "allow"), rounds).withColumnRenamed("rank", "trust")
    doubt = propagate(back, _seeds(hosts, "block"), rounds).withColumnRenamed("rank", "distrust")
    scores = staged(trust.join(doubt, "host", "full"), "host-scores").withColumnRenamed("host", "_host")
    joined = judged.join(scores, judged["host"] == scores["_host"], "left").drop("_host")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust >= LEAST) & (distrust >= SHARE * (trust + distrust)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), method).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )


def op8_url_rank(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op8_url_rank": op8_url_rank}
ORACLE_SQL: dict[str, str] = {}
