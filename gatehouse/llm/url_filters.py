"""URL rules, and a verdict by the company a host keeps where no rule fits.

Hosts are the nodes of a graph: a link on a page leads from its host to the other, and a host and the
nearest host above it with pages (`blog.a.org`, `a.org`) lead to each other. The share of a host's
pages that rules allow is its trust to begin with, the share they block its distrust. Trust is
handed on along the edges (personalised PageRank from the trusted), distrust against them, to those
who link to the blocked: after each round a host has what it began with plus 85 % of what its
neighbours pass on, each dividing its score among its edges. A host is blocked when its distrust reaches the
threshold and exceeds its trust.

Scores are integers, in billionths of a host all of whose pages are decided, so that they
do not depend on the order in which tasks add them. All rounds are joins and sums in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.session import stored

#: One host whose pages are all decided, per cent handed on, rounds, and rounds between two tables.
UNIT, HANDED_ON, ROUNDS, PER_TABLE = 1_000_000_000, 85, 20, 5
#: Distrust from which on a host is blocked, in per cent of a host whose pages are all blocked.
THRESHOLD = 50
#: Longest name a host can have; longer texts in its place have no host above them.
LONGEST_HOST = 253

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOST, PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"
LINK = "[hH][rR][eE][fF]=[\"']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"'<> \\t\\n\\r]+)"


@dataclass(frozen=True)
class Rule:
    """Holds for a host and all its subdomains, on paths that begin with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def lowered(host: Column) -> Column:
    return F.translate(host, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def by_rule(rules: tuple[Rule, ...], value) -> Column:
    """`value` of the longest rule that fits `host` and `path`, null if none does.

    The rules become one expression; of equally long ones a blocking rule goes first.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        here = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        found = F.when(here & F.col("path").startswith(rule.path), value(rule)).otherwise(found)
    return found


def judged(pages: DataFrame, rules: tuple[Rule, ...], id_col: str, url_col: str) -> DataFrame:
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumns({"rule": by_rule(rules, lambda r: F.lit(r.name)), "ruled": by_rule(rules, lambda r: F.lit(r.verdict))})


def seeds(rows: DataFrame) -> DataFrame:
    """(kind, host, score): the trust and distrust that hosts begin with."""
    hosts = rows.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("ruled") == "allow").alias("trust"),
        F.count_if(F.col("ruled") == "block").alias("distrust"),
    )
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f"{UNIT} * {k} div pages").alias("score")) for k in ("trust", "distrust")))
    return hosts.select("host", F.inline(both)).select("kind", "host", "score")


def site_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst): each host and the nearest host above it, both ways."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = hosts.filter((F.char_length("host") <= LONGEST_HOST) & (F.size(labels) > 1))
    pairs = named.select("host", F.explode(above).alias("above")).join(hosts.select(F.col("host").alias("above")), "above")
    nearest = pairs.groupBy("host").agg(F.max_by("above", F.char_length("above")).alias("above"))
    return nearest.select(F.inline(F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst")))))


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst): from the host of a page to the hosts that it links to, once each."""
    links = F.array_distinct(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(LINK), F.lit(1)))
    found = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(links).alias("to"))
    return found.select("src", lowered(F.col("to")).alias("dst"))


def walks(edges: DataFrame) -> DataFrame:
    """(kind, host, to, edges): where a host's trust and distrust go, and among how many they are divided."""
    edges = edges.filter("src <> '' AND dst <> '' AND src <> dst").distinct()
    ways = F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")),
    )
    ways = edges.select(F.inline(ways))
    counts = ways.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("edges"))
    return ways.join(counts, ["kind", "host"])


def propagated(begun: DataFrame, walk: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) after the rounds, or before if nothing moves any more.

    Scores never fall, so an unchanged total means that none of them changed.
    """
    scores, total = begun, None
    if walk.isEmpty():
        return scores
    for number in range(1, rounds + 1):
        passed = walk.join(scores, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"{HANDED_ON} * (score div edges)").alias("score"))
        own = begun.withColumn("score", F.col("score") * 100)
        scores = own.unionByName(passed).groupBy("kind", "host").agg(F.expr("sum(score) div 100").alias("score"))
        if number % PER_TABLE == 0 or number == rounds:
            scores = stored(scores, "scores")
            before, total = total, scores.agg(F.sum("score")).first()[0]
            if before == total:
                break
    return scores


def blocked_hosts(scores: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(host): those whose distrust reaches the threshold and exceeds their trust."""

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)

    return scores.groupBy("host").agg(of("trust"), of("distrust")).filter(f"distrust > trust AND distrust >= {threshold * UNIT // 100}").select("host")


def url_verdicts(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: int = THRESHOLD
) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict (allow or block): one row per page.

    A null url, or one without `://`, has an empty host and path; no rule fits an empty host, it is no
    node of the graph, and its verdict is allow. A null or empty html has no links; relative ones
    stay on their host and count for nothing, repeated ones count once. Repeated pages are rows of their own and count for each. An
    empty table gives an empty one. Other columns are not looked at, whatever their names.
    """
    rows = judged(pages, rules, id_col, url_col)
    begun = stored(seeds(rows), "seeds")
    hosts = begun.filter("kind = 'trust'").select("host")
    walk = stored(walks(link_edges(pages, url_col, html_col).unionByName(site_edges(hosts))), "walks")
    blocked = stored(blocked_hosts(propagated(begun, walk), threshold), "blocked")
    # A page that a rule decides asks for no host: its key fits none and differs from page to page, so
    # that such pages do not meet in one task.
    nobody = F.concat_ws("/", F.lit(""), F.col("page_id").cast("string"), "path")
    asking = rows.withColumn("asked", F.when(F.col("ruled").isNull() & (F.col("host") != ""), F.col("host")).otherwise(nobody))
    joined = asking.join(blocked.select(F.col("host").alias("asked"), F.lit("block").alias("by_host")), "asked", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
