"""URL filter: allow/block rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host and rolled up to
registered domain and suffix.  Each level's rate is shrunk towards the level
above by a beta-binomial prior whose strength is fitted by the method of
moments over that level, so a host with few labels inherits its domain's rate
and a host without labels has exactly that rate.  A host is blocked when the
lower posterior (Wilson) bound of its bad rate passes a threshold.

Only DataFrame and SQL expressions.  Pages meet their host's row in one join on
the host (AQE splits a hot host: the host table has one row for it); counting a
hot host is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.base import lower_ascii, table, written

#: production rules: (verdict, host and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: suffixes of more than one label; others are the last label
MULTI_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: block when the lower bound of the bad rate is over this, at this many standard deviations
MAX_BAD_RATE, Z = 0.5, 1.645
#: the fitted correlation within a group is kept inside these bounds
RHO_MIN, RHO_MAX = 0.001, 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule ``host/path`` fits its host and all subdomains when the path starts
    with the rule's.  Of two fitting rules of one length the longer host wins.
    """
    rule = verdict = None
    order = sorted(rules, key=lambda r: (len(r[1]), r[1].index("/")), reverse=True)
    for what, text in order:
        rule_host, rule_path = text[:text.index("/")], text[text.index("/"):]
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_suffix(host: Column, suffixes: Sequence[str] = MULTI_LABEL_SUFFIXES) -> Column:
    out = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(out) if suffixes else out


def host_domain(host: Column, suffixes: Sequence[str] = MULTI_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more (the host itself if it has no more)."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


_SHRINK = """
SELECT g.*, (n_bad + kappa * prior) / (n + kappa) AS {out}, kappa AS {out}_kappa, prior AS {out}_prior
FROM (SELECT g.*, (SELECT 1 / least({hi}D, greatest({lo}D, coalesce(
        (sum(n * pow(n_bad / n - prior, 2)) - sum(prior * (1 - prior)))
        / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {lo}D))) - 1
      FROM {{g}} WHERE n > 0) AS kappa FROM {{g}} g) g"""


def _shrink(spark: SparkSession, groups: DataFrame, out: str) -> DataFrame:
    """Shrink each group's bad rate towards its ``prior`` (strength fitted over all groups).

    The groups are written first: the strength and the groups read the same table,
    not the levels below once more.
    """
    return spark.sql(_SHRINK.format(out=out, lo=RHO_MIN, hi=RHO_MAX), g=written(groups, f"hosts-{out}"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """One row per host of ``outcomes`` (host, bad: boolean or null when not labelled).

    Returns host, domain, suffix, n, n_bad, mean and lower (the posterior mean
    and the lower bound of the host's bad rate).  Empty input gives no rows.
    """
    spark = outcomes.sparkSession
    hosts = (outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("n_bad"))
             .select("host", host_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"), "n", "n_bad"))
    hosts = written(hosts, "host-counts")
    count = [F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*count), "domain-counts")
    suffixes = written(domains.groupBy("suffix").agg(*count), "suffix-counts")
    suffixes = spark.sql("SELECT s.*, (SELECT (sum(n_bad) + 0.5D) / (sum(n) + 1D) FROM {s}) AS prior FROM {s} s", s=suffixes)
    suffixes = _shrink(spark, suffixes, "suffix_mean")
    domains = _shrink(spark, domains.join(suffixes.select("suffix", F.col("suffix_mean").alias("prior")), "suffix"), "domain_mean")
    hosts = _shrink(spark, hosts.join(domains.select("domain", F.col("domain_mean").alias("prior")), "domain"), "mean")
    m, total, z = F.col("mean"), F.col("n") + F.col("mean_kappa"), F.lit(Z)
    lower = (m + z * z / (2 * total) - z * F.sqrt(m * (1 - m) / total + z * z / (4 * total * total))) / (1 + z * z / total)
    return hosts.select("host", "domain", "suffix", "n", "n_bad", "mean", lower.alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule, mean, lower and verdict.

    ``labels`` (page_id, bad) holds the known outcomes; several of a page count
    as bad if one of them is, null outcomes and pages do not count.  A null url,
    or one without ``://``, has an empty host and path and the reputation of the
    empty host.  Repeated pages are judged alike and each kept; columns of
    ``pages`` with the names of results are replaced.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    parsed = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "mean", "lower")],
                          host.alias("host"), path.alias("path"))
    seen = pages.select("page_id", host.alias("host")).join(known, "page_id", "left")
    reputation = host_reputation(seen.select("host", "bad")).select("host", "mean", "lower")
    judged = parsed.join(reputation, "host", "left")
    own = F.when(F.col("lower") > MAX_BAD_RATE, "block").otherwise("allow")
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` url judged by the production rules and the reputation fitted to ``labels``.

    A page's outcome is the label of the same id: bad if toxic or of low quality.
    """
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    order = sorted(RULES, key=lambda r: (len(r[1]), r[1].index("/")), reverse=True)
    case = {"rule": "", "verdict": ""}
    for what, text in order:
        h, p = text[:text.index("/")], text[text.index("/"):]
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        case["rule"] += f" WHEN {fits} THEN '{text}'"
        case["verdict"] += f" WHEN {fits} THEN '{what}'"
    multi = ", ".join(f"'{s}'" for s in MULTI_LABEL_SUFFIXES)
    label = r"regexp_extract(host, '([^.]*)$', 1)"
    two, three = r"regexp_extract(host, '((?:[^.]*\.)?[^.]*)$', 1)", r"regexp_extract(host, '((?:[^.]*\.)?(?:[^.]*\.)?[^.]*)$', 1)"

    def shrink(groups: str, out: str) -> str:
        return f"""SELECT g.*, (n_bad + kappa * prior) / (n + kappa) AS {out}, kappa AS {out}_kappa
FROM (SELECT g.*, (SELECT 1 / least({RHO_MAX}::DOUBLE, greatest({RHO_MIN}::DOUBLE, coalesce(
 (sum(n * pow(n_bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {RHO_MIN}::DOUBLE))) - 1
 FROM {groups} WHERE n > 0) AS kappa FROM {groups} g) g"""

    return rf"""
WITH p AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, CASE WHEN {two} IN ({multi}) THEN {three} ELSE {two} END AS domain, CASE WHEN {two} IN ({multi}) THEN {two} ELSE {label} END AS suffix,
  count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS n_bad FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(n_bad) AS n_bad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(n_bad) AS n_bad FROM d GROUP BY suffix),
s1 AS (SELECT s0.*, (SELECT (sum(n_bad) + 0.5) / (sum(n) + 1) FROM s0)::DOUBLE AS prior FROM s0),
s2 AS ({shrink("s1", "suffix_mean")}),
d1 AS (SELECT d.*, suffix_mean AS prior FROM d JOIN s2 USING (suffix)),
d2 AS ({shrink("d1", "domain_mean")}),
h1 AS (SELECT h.*, domain_mean AS prior FROM h JOIN d2 USING (domain)),
h2 AS ({shrink("h1", "mean")}),
r AS (SELECT host, (mean + {Z * Z} / (2 * t) - {Z} * sqrt(mean * (1 - mean) / t + {Z * Z} / (4 * t * t))) / (1 + {Z * Z} / t) AS lower
  FROM (SELECT host, mean, n + mean_kappa AS t FROM h2))
SELECT page_id, host, path, CASE{case["rule"]} END AS rule,
  coalesce(CASE{case["verdict"]} END, CASE WHEN lower > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r USING (host)"""


ORACLE = _oracle()
