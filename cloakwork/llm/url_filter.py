"""URL filter: a rule list, and an empirical-Bayes reputation of hosts for what no rule decides.

Page outcomes (good or bad) are counted per host.  A host's bad rate is shrunk towards
its registered domain's, that towards its suffix's, and that towards the rate of all pages, each
step a beta-binomial prior whose strength is fitted by moments to how much the children differ.  A strength that
``k`` children suggest is no surer than ``k``, so it is cut there: a few suffixes cannot make one sure of another.  A
page is blocked where the lower bound of its host's posterior (mean less ``z`` deviations) is above
``threshold``; a host with few or no outcomes keeps a wide posterior and is allowed, and so is every host
of a suffix without any outcome.

Outcomes are a label column of the caller.  Without one, the rules are the labels: a page that a rule blocks is bad, and every other page
of a host is a trial that is not, since a list of rules names what is bad and is silent on the rest.

Defined cases: a null url, or one without ``://``, has empty host and path; such pages share the
empty host.  Null labels are no outcomes.  Without any outcome the rate of all pages is one half
and nothing is blocked.  Repeated pages count each time.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import LOWER, UPPER, cut, lower_az, table

STRENGTH = (1.0, 1000.0)  # bounds of a prior's strength, in pages


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the query's contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null.  The list is a constant of the plan: for short lists."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame, name: str) -> DataFrame:
    """One row: the strength of the prior above these children, by moments of the beta-binomial."""
    s = children.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    p = F.col("bad") / F.col("n")
    within = p * (1 - p)
    spread = (F.col("q") - p * F.col("bad") - (F.col("k") - 1) * within) / (F.col("n") - F.col("nn") / F.col("n"))
    low, high = F.lit(STRENGTH[0]), F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.col("k").cast("double")))
    fitted = F.when((F.col("n") > F.col("nn") / F.col("n")) & (spread > 0), within / spread - 1).otherwise(high)
    return s.select(F.coalesce(F.least(F.greatest(fitted, low), high), low).alias(name))


def domain_and_suffix(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix: the longest of ``suffixes`` (such as ``co.uk``) that the host ends with, else its last label,
    and one label more.  The list is a constant of the plan: for short lists.
    """
    labels = F.lit(1)
    for suffix in sorted(suffixes, key=lambda x: (x.count("."), x)):
        labels = F.when((host == suffix) | host.endswith("." + suffix), F.lit(suffix.count(".") + 1)).otherwise(labels)
    last = F.element_at(F.split(host, r"\."), -1)
    if not suffixes:
        return F.substring_index(host, ".", -2), last
    parts = F.split(host, r"\.")

    def tail(n: Column) -> Column:
        return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")

    return tail(labels + 1), tail(labels)


def reputations(outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """``outcomes`` (host, bad 0/1/null; every host of interest at least once) to one row per host:
    ``host, n, bad, known, mean, lower`` of the posterior of its bad rate.  ``known``: outcomes in its suffix.
    """
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    # Written once, as every level and strength reads it: a row per host.
    hosts = cut(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = ends.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("rate"))
    # Each of these frames is a single row by construction.
    scalars = (
        every.crossJoin(_strength(ends, "k_suffix")).crossJoin(_strength(domains, "k_domain"))
        .crossJoin(_strength(hosts, "k_host"))
    )
    s = ends.crossJoin(F.broadcast(scalars)).select(
        "suffix", "k_domain", "k_host", F.col("n").alias("known"),
        ((F.col("bad") + F.col("k_suffix") * F.col("rate")) / (F.col("n") + F.col("k_suffix"))).alias("p_suffix"),
    )
    d = domains.join(s, "suffix").select(
        "domain", "suffix", "k_host", "known",
        ((F.col("bad") + F.col("k_domain") * F.col("p_suffix")) / (F.col("n") + F.col("k_domain"))).alias("p_domain"),
    )
    a = F.col("bad") + F.col("k_host") * F.col("p_domain")
    total = F.col("n") + F.col("k_host")
    h = hosts.join(d, ["domain", "suffix"]).select("host", "n", "bad", "known", (a / total).alias("mean"), total.alias("total"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))
    return h.select("host", "n", "bad", "known", "mean", (F.col("mean") - z * sd).alias("lower"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], bad: Column | None = None, id_col: str = "page_id",
               url_col: str = "url", threshold: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """``id_col, host, path, rule, verdict, lower`` per page.

    ``bad``: a 0/1/null column of ``pages`` with the labelled outcomes; by default pages that a rule blocks are bad
    and all others are not.
    """
    label = F.lit(None).cast("int") if bad is None else bad.cast("int")
    urls = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), label.alias("label"))
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("id", "label", host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("id", "label", "host", "path", name.alias("rule"), verdict.alias("by_rule"))
    outcome = F.col("label") if bad is not None else F.coalesce(F.col("by_rule") == "block", F.lit(False)).cast("int")
    found = reputations(ruled.select("host", outcome.alias("bad")), z, suffixes).select("host", "known", "lower")
    by_method = F.when((F.col("known") > 0) & (F.col("lower") > threshold), "block").otherwise("allow")
    return ruled.join(found, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "lower"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged; pages that a rule blocks are the bad outcomes of their host, all others the good ones."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES).drop("lower")


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '" for r in rules]
    name = "CASE " + " ".join(f"{f}{r.name}'" for f, r in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f}{r.verdict}'" for f, r in zip(fits, rules, strict=True)) + " END"
    low = STRENGTH[0]
    high = f"greatest({low}, least({STRENGTH[1]}, k))"

    def strength(level: str) -> str:
        return f"""(SELECT coalesce(CASE WHEN n > nn / n AND (q - p * bad - (k - 1) * p * (1 - p)) / (n - nn / n) > 0
 THEN least(greatest(p * (1 - p) / ((q - p * bad - (k - 1) * p * (1 - p)) / (n - nn / n)) - 1, {low}), {high}) ELSE {high} END, {low})
 FROM (SELECT *, bad / n AS p FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS k,
 sum(bad * bad / n) AS q, sum(n * n)::DOUBLE AS nn FROM {level} WHERE n > 0)))"""

    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
ruled AS (SELECT *, {name} AS rule, {verdict} AS by_rule FROM p),
hosts AS (SELECT host, regexp_extract(host, '[^.]*(\\.[^.]*)?$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
 count(*) AS n, count(*) FILTER (by_rule = 'block') AS bad FROM ruled GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s AS (SELECT suffix, (bad + ks * rate) / (n + ks) AS p_suffix
 FROM suffixes, (SELECT (sum(bad) + 1) / (sum(n) + 2) AS rate, {strength('suffixes')} AS ks FROM suffixes)),
d AS (SELECT domain, (bad + kd * p_suffix) / (n + kd) AS p_domain FROM domains JOIN s USING (suffix), (SELECT {strength('domains')} AS kd)),
h AS (SELECT host, (bad + kh * p_domain) / (n + kh) AS mean, n + kh AS total FROM hosts JOIN d USING (domain), (SELECT {strength('hosts')} AS kh))
SELECT page_id, host, path, rule,
 coalesce(by_rule, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN h USING (host)"""


ORACLE = {"op8_url_filter": _oracle()}
QUERIES = {"op8_url_filter": op8_url_filter}
