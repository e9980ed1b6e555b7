"""URL filters: rules by host and path, and empirical-Bayes reputation of hosts for urls that no rule fits.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. A beta prior at each level has the mean
of the level above, shrunk in turn, and a strength by the method of moments from how far the level's rates spread beyond chance.
A host's posterior is its own counts added to its domain's prior; the verdict is block where the posterior's lower bound of
the bad share exceeds a threshold, so hosts with few labels follow their domain and need a domain that is surely bad.

All is DataFrame functions: counts are pre-aggregated, and urls meet one row a host in a join that splits hot hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host, path) of the query's rules. The list is a parameter of bounded size.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which names are registered.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: A host is blocked if its bad share surely exceeds this, by a normal bound of so many posterior deviations.
THRESHOLD, DEVIATIONS = 0.5, 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://" and for null."""
    u = F.coalesce(url, F.lit(""))
    found = lambda group: F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)([^?#]*)", group)
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and its verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _names(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; of an address or a name of one label, the host and an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    plain = (n < 2) | bare.rlike(r"^[0-9.]*$|^\[")
    two = last(2).isin(*SUFFIXES) & (n > 2)
    return F.when(plain, bare).when(two, last(3)).otherwise(last(2)), F.when(plain, "").when(two, last(2)).otherwise(last(1))


def _strength(children: DataFrame, name: str) -> DataFrame:
    """One row: the strength of the prior under which children (n, bad, mean of the level above) are drawn."""
    p = F.col("bad") / F.col("n")
    spread = F.sum(F.col("n") * (p - F.col("above")) ** 2 / F.greatest(F.col("above") * (1 - F.col("above")), F.lit(1e-6)))
    k, total, squares = F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n"))
    rho = F.try_divide(spread - k, total - squares / total)
    return children.filter("n > 0").agg((1 / F.least(F.greatest(F.coalesce(rho, F.lit(0.02)), F.lit(0.005)), F.lit(0.9)) - 1).alias(name))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, labelled, mean, lower from outcomes (host, bad: 0, 1 or null for pages without a label), for every host there."""
    domain, suffix = _names(F.col("host"))
    hosts = cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    top = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("above"))

    def shrunk(level: DataFrame, name: str) -> DataFrame:
        # the strength is one row, so its broadcast has a proven size
        m = level.join(F.broadcast(_strength(level, "m")))
        return m.withColumn("mean", (F.col("bad") + F.col("above") * F.col("m")) / (F.col("n") + F.col("m"))).select(name, "mean")

    by = lambda *names: hosts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = shrunk(by("suffix").join(F.broadcast(top)), "suffix").withColumnRenamed("mean", "above")
    domains = shrunk(by("suffix", "domain").join(suffixes, "suffix"), "domain").withColumnRenamed("mean", "above")
    ranked = hosts.join(cut(domains, "domains"), "domain")
    ranked = ranked.join(F.broadcast(_strength(ranked, "m")))
    a, b = F.col("bad") + F.col("above") * F.col("m"), F.col("n") - F.col("bad") + (1 - F.col("above")) * F.col("m")
    mean = a / (a + b)
    return ranked.select("host", F.col("n").alias("labelled"), mean.alias("mean"), (mean - DEVIATIONS * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, labelled and bad_share. outcomes: host, bad. A host without outcomes, the empty
    one of null urls included, follows the overall mean."""
    host, path = host_path(F.col(url))
    named = pages.drop("host", "path", "rule", "verdict", "labelled", "bad_share").withColumns({"host": host, "path": path})
    scores = cut(reputations(outcomes.select("host", "bad").unionByName(named.select("host").distinct().withColumn("bad", F.lit(None).cast("int")))), "reputations")
    joined = named.join(scores, "host", "left")
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("lower") > THRESHOLD, "block").otherwise("allow"))
    return joined.select(*named.columns, rule.alias("rule"), verdict.alias("verdict"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.round("mean", 6).alias("bad_share"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad of pages whose article has a label: the number after the path's first part is the article's doc_id, and the
    outcome is bad where its label says low quality or toxic."""
    host, path = host_path(F.col("url"))
    article = F.try_to_number(F.nullif(F.regexp_extract(path, r"^/[^/]+/(\d{1,18})(?!\d)", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select(host.alias("host"), article.alias("doc_id")).filter("doc_id IS NOT NULL").join(bad, "doc_id").select("host", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "labelled")
