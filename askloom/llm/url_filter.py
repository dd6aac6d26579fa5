"""Operator 9: URL filter by empirical-Bayes host reputation, as DataFrame operations only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's rate is shrunk
towards the level above with a beta prior whose strength comes from the spread of the rates on that level (method of
moments), from host to registered domain to suffix to the whole table. A host is blocked when the lower bound of its
posterior bad rate is above the limit: a fixed one, or that of LIFT times the odds of the whole table, so that verdicts
follow the table's own rate. Explicit rules come first: the longest that fits wins.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged by the prior of the whole
table; names for users and ports count for the host, but not for its domain and suffix; an IP address is its own domain and
suffix; URLs of any length are taken whole; repeated rows each get a verdict; other columns are left out; without labels no
host is blocked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm._shared import materialize

# Suffixes of two labels under which others register names.
SUFFIXES = tuple(
    """
    co.uk org.uk ac.uk gov.uk me.uk net.uk ltd.uk plc.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz ac.nz govt.nz
    co.jp or.jp ne.jp ac.jp go.jp com.br net.br org.br gov.br edu.br co.in net.in org.in gov.in ac.in co.za org.za com.cn net.cn
    org.cn gov.cn edu.cn com.tw org.tw com.hk org.hk com.sg org.sg com.my com.mx com.ar com.tr org.tr com.ua co.kr or.kr co.il
    org.il co.id com.ph com.vn co.th com.pl org.pl com.pt com.gr com.eg com.sa com.pk com.bd com.ng co.ke
    github.io gitlab.io blogspot.com netlify.app vercel.app herokuapp.com web.app firebaseapp.com azurewebsites.net cloudfront.net
    """.split()
)
LIFT = 2.0
#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are a fixed list given by the caller."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rhost, rpath in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        out = F.when(fits, F.struct(F.lit(rhost + rpath).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def name_of(host: Column) -> Column:
    """The host without a user's name and a port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")


def last_labels(name: Column, n: int) -> Column:
    return F.regexp_extract(name, r"(?:[^.]*\.){0,%d}[^.]*$" % (n - 1), 0)


def suffix_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last label, or the last two where others register names under them."""
    two = last_labels(name, 2)
    return F.when(is_address(name), name).when(two.isin(*suffixes), two).otherwise(last_labels(name, 1))


def domain_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it."""
    return F.when(is_address(name), name).when(last_labels(name, 2).isin(*suffixes), last_labels(name, 3)).otherwise(last_labels(name, 2))


def _shrunk(level: DataFrame, key: str, parent: str, priors: DataFrame, least: float) -> DataFrame:
    """level(key, parent, bad, n), priors(parent, rate) -> with the posterior's a and b, and its mean as rate."""
    # Method of moments over all groups of the level: between-group variance of the rates beyond binomial noise.
    with_mean = level.join(priors.select(F.col(parent).alias("_p"), F.col("rate").alias("prior")), F.col(parent) == F.col("_p")).drop("_p")
    noise = F.col("prior") * (1 - F.col("prior"))
    moments = with_mean.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("spread"),
        F.sum(noise).alias("expected"),
        F.sum(noise * (F.col("n") - 1)).alias("room"),
    )
    # E[spread] = sum(noise) + rho * sum(noise * (n - 1)), and the prior's strength is 1 / rho - 1.
    rho = F.least(F.lit(0.5), F.greatest(F.lit(1e-3), F.coalesce(F.try_divide(F.col("spread") - F.col("expected"), F.col("room")), F.lit(1e-3))))
    strength = moments.select(F.greatest(F.lit(least), 1 / rho - 1).alias("strength"))
    return (
        with_mean.crossJoin(F.broadcast(strength))  # one row
        .withColumn("a", F.col("bad") + F.col("strength") * F.col("prior"))
        .withColumn("b", F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior")))
        .withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
        .drop("prior", "strength")
    )


def reputation(outcomes: DataFrame, least: float = 2.0, z: float = 1.645) -> DataFrame:
    """outcomes(host, bad 0/1 or null) -> host, n, bad, rate, lower (the bound of the posterior bad rate) and base (the rate of
    the whole table)."""
    hosts = materialize(
        outcomes.groupBy("host").agg(F.sum(F.coalesce("bad", F.lit(0))).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
        .withColumn("name", name_of(F.col("host"))).withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name"))).withColumn("top", F.lit("")).drop("name"),
        "url-hosts",
    )
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    top = hosts.groupBy("top").agg(*sums).select("top", ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("rate"))
    suffixes = _shrunk(hosts.groupBy("suffix", "top").agg(*sums), "suffix", "top", top, least)
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*sums), "domain", "suffix", suffixes, least)
    out = _shrunk(hosts.drop("suffix", "top"), "host", "domain", domains, least)
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return out.withColumn("lower", F.greatest(F.lit(0.0), F.col("rate") - F.lit(z) * sd)).crossJoin(F.broadcast(top.select(F.col("rate").alias("base")))).select("host", "n", "bad", "rate", "lower", "base")  # one row


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float | None = None, least: float = 2.0, z: float = 1.645, lift: float = LIFT) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad) -> page_id, host, path, rule, verdict, rate, lower. Without a limit, it is
    the rate of `lift` times the table's odds."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    per_page = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = parts.select("page_id", "host").join(per_page, "page_id", "left")
    scores = materialize(reputation(known, least, z), "url-reputation")
    odds = lift * F.col("base") / (1 - F.col("base"))
    bound = F.lit(limit) if limit is not None else odds / (1 + odds)
    return (
        parts.join(scores, "host", "left")
        .withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", F.when(F.col("lower") > bound, "block").otherwise("allow")).alias("verdict"), "rate", "lower",
        )
    )
