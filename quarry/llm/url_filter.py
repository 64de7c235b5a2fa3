"""URL filter: explicit rules, then Empirical-Bayes host reputation.

Rules name a host and the start of a path; a rule fits its host and all its
subdomains, and the longest fitting rule decides. Pages without a rule are
judged by the reputation of their host: labelled page outcomes (by default the
pages that a rule has judged) are counted per host, and shrunk through
beta-binomial priors from suffix to registered domain to host. At each level
the prior of a node has its parent's posterior mean and a strength fitted by
the method of moments over all siblings of the level; a node with many
outcomes keeps its own rate, one with few takes its parent's. A host is
blocked when the lower bound of its posterior (mean - z * standard deviation)
is above ``BAD_RATE``.

All steps are DataFrame functions. Outcomes are counted per host with map-side
partial sums, so a host with a third of all pages is one row per task, and
only host counts are shuffled. The host table is joined back by host; its hot
rows are split by adaptive execution.

Defined cases: a null url or one without ``://`` has empty host and path and no
outcome; a host without any labelled relative takes the prior of its suffix,
domain or of all pages; without any outcome at all every page is allowed;
repeated rows count as often as they stand; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

BAD_RATE = 0.5
Z = 1.0
# strengths of the priors stay within these bounds (in page outcomes)
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def url_host(url: str) -> Column:
    rest = _rest(url)
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str) -> Column:
    """The url behind its first ``://``; null without one."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))


def rule_host_path(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.lower(), "/" + path


def best_rule(rules: dict[str, str]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null without one.
    ``rules`` maps a rule to ``allow`` or ``block``; host and path are read
    from the columns ``host`` and ``path``."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # a longer rule overrides
        host, path = rule_host_path(rule)
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host))
                & F.col("path").startswith(path))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"),
                                    F.lit(rules[rule]).alias("verdict"))).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def registered_domain(host: Column) -> Column:
    """Last two labels (for hosts under two-part suffixes pass another
    expression to ``reputation``)."""
    return F.substring_index(host, ".", -2)


def _strength(level: DataFrame, n: str, bad: str, mean: str) -> DataFrame:
    """One row: the strength of the beta prior of a level by the method of
    moments. With v the variance of the nodes' rates around their parents'
    means beyond binomial noise, strength = mean (1 - mean) / v - 1."""
    rate = F.col(bad) / F.col(n)
    noise = F.col(mean) * (1 - F.col(mean))
    # sums over nodes, weighted with their outcomes; nodes of one outcome carry no variance
    moments = level.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (rate - F.col(mean)) * (rate - F.col(mean))).alias("ss"),
        F.sum(noise).alias("noise"), F.sum((F.col(n) - 1) * noise).alias("scale"))
    excess = (F.col("ss") - F.col("noise")) / F.col("scale")  # share of between-node variance
    return moments.select(F.when(F.col("scale") > 0, F.greatest(
        F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.when(
            excess > 0, 1 / excess - 1).otherwise(MOST_STRENGTH))))
        .otherwise(LEAST_STRENGTH).alias("strength"))


def reputation(outcomes: DataFrame, bad_rate: float = BAD_RATE, z: float = Z) -> DataFrame:
    """``(host, n, bad)`` per host (n 0 for a host without outcomes) to
    (host, mean, bound, blocked)."""
    hosts = materialize(outcomes.select(
        "host", registered_domain(F.col("host")).alias("domain"),
        suffix(F.col("host")).alias("suffix"), F.col("n").cast("double").alias("n"),
        F.col("bad").cast("double").alias("bad")), "host-outcomes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(domains, "domain-outcomes")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("parent"))

    def shrink(level: DataFrame) -> DataFrame:
        # the strength is one row
        strength = F.broadcast(_strength(level, "n", "bad", "parent"))
        return (level.join(strength)
                .withColumn("a", F.col("strength") * F.col("parent") + F.col("bad"))
                .withColumn("b", F.col("strength") * (1 - F.col("parent"))
                            + F.col("n") - F.col("bad"))
                .withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))

    suffixes = materialize(shrink(suffixes.join(F.broadcast(overall)))
                           .select("suffix", F.col("mean").alias("parent")), "suffix-prior")
    domains = materialize(shrink(domains.join(suffixes, "suffix"))
                          .select("domain", F.col("mean").alias("parent")), "domain-prior")
    total = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return (shrink(hosts.join(domains, "domain"))
            .withColumn("bound", F.col("mean") - z * spread)
            .select("host", "mean", "bound", (F.col("bound") > bad_rate).alias("blocked")))


def url_filter(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id",
               url_col: str = "url", outcomes: DataFrame | None = None,
               bad_rate: float = BAD_RATE, z: float = Z) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, bad_rate (the
    posterior mean of the host, rounded).

    ``outcomes``: labelled pages as (host, bad 0/1); by default the pages that
    a rule decides, bad where it blocks.
    """
    judged = (pages.select(F.col(id_col).alias("id"), url_host(url_col).alias("host"),
                           url_path(url_col).alias("path"))
              .withColumn("best", best_rule(rules))
              .select("id", "host", "path", "best.rule", F.col("best.verdict").alias("ruled")))
    if outcomes is None:
        seen = judged.where("ruled IS NOT NULL").select(
            "host", F.when(F.col("ruled") == "block", 1).otherwise(0).alias("bad"))
    else:
        seen = outcomes.select("host", F.col("bad").cast("int").alias("bad"))
    counted = (seen.select("host", F.lit(1).alias("n"), "bad")
               .unionByName(judged.select("host", F.lit(0).alias("n"), F.lit(0).alias("bad")))
               .groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    known = materialize(reputation(counted, bad_rate, z), "host-reputation")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return (judged.join(known, "host")
            .select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"),
                    F.round("mean", 6).alias("bad_rate")))
