"""URL filter: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled pages are counted by host, registered domain and suffix. At each level the share of bad
pages of a group is shrunk to its parent's by a beta prior whose strength is fitted to all groups of
the level (method of moments for beta-binomial counts: the more groups differ beyond chance, the
weaker the prior). A url that no rule decides is blocked if the lower bound of its host's posterior
exceeds a limit, so a host is blocked on evidence and not on one bad page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch

#: (rule, verdict); a rule is a host, then the beginning of a path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Suffixes of two labels, under which the third label is registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn")
#: Share of bad pages that the posterior's lower bound must exceed, and standard deviations below its mean.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of the fitted correlation of two pages of one group.
LEAST_RHO, MOST_RHO = 1e-4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on, _, start = rule.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """Beta strength from n, bad and the parent's share mu: 1 / rho - 1."""
    chance = F.col("mu") * (1 - F.col("mu"))
    spread = F.pow(F.col("bad") / F.col("n") - F.col("mu"), 2) * F.col("n")
    row = groups.agg(F.sum(spread).alias("s"), F.sum(chance).alias("a"), F.sum(chance * (F.col("n") - 1)).alias("b")).first()
    rho = (row["s"] - row["a"]) / row["b"] if row["b"] else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def reputation(outcomes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """Shrunk shares from ``outcomes`` (host, bad boolean): by host, domain and suffix, all, last strength."""
    n, bad = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    hosts = scratch.save(hosts.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), free=False)
    domains = scratch.save(hosts.groupBy("domain", "suffix").agg(n, bad), free=False)
    suffixes = domains.groupBy("suffix").agg(n, bad)
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    everywhere = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    suffixes = suffixes.withColumn("mu", F.lit(everywhere))
    strength = _strength(suffixes)
    shrunk = (F.lit(strength) * F.col("mu") + F.col("bad")) / (F.lit(strength) + F.col("n"))
    suffixes = scratch.save(suffixes.select("suffix", shrunk.alias("suffix_share")), free=False)
    domains = domains.join(suffixes, "suffix").withColumn("mu", F.col("suffix_share"))
    strength = _strength(domains)
    shrunk = (F.lit(strength) * F.col("mu") + F.col("bad")) / (F.lit(strength) + F.col("n"))
    domains = scratch.save(domains.select("domain", shrunk.alias("domain_share")), free=False)
    hosts = hosts.join(domains, "domain").withColumn("mu", F.col("domain_share"))
    return hosts.select("host", "n", "bad"), domains, suffixes, everywhere, _strength(hosts)


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules=RULES, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """doc (all columns of ``pages``), host, path, rule, verdict, share (posterior mean), bound.

    ``outcomes`` has host and bad (boolean), a row per labelled page; rows with a null are left
    out, and with none at all every share is a half and nothing is blocked but by rule. Null urls
    and urls without ``://`` have an empty host and path. Repeated pages are judged each; an empty
    table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "hosts")
    outcomes = outcomes.where("host IS NOT NULL AND bad IS NOT NULL")
    hosts, domains, suffixes, everywhere, strength = reputation(outcomes, scratch)
    rows = pages.select(F.struct("*").alias("doc"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # One row per host is judged, then met by its pages.
    known = rows.select("host").distinct().select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    known = known.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    parent = F.coalesce("domain_share", "suffix_share", F.lit(everywhere))
    a = F.lit(strength) * parent + F.coalesce("bad", F.lit(0))
    b = F.lit(strength) * (1 - parent) + F.coalesce("n", F.lit(0)) - F.coalesce("bad", F.lit(0))
    known = known.select(F.col("host").alias("h"), a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    known = scratch.save(known.select("h", mean.alias("share"), (mean - deviations * deviation).alias("bound")), free=False)
    rows = rows.join(known, F.col("host") == F.col("h")).withColumn("found", matched(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return rows.select("doc", "host", "path", "found.rule", verdict.alias("verdict"), "share", "bound")


def query(spark, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own: a label counts for the page that has its number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    outcomes = pages.join(labels, pages["page_id"] == labels["doc_id"]).select(host_of(F.col("url")).alias("host"), bad)
    return judge(pages, outcomes).select("doc.page_id", "host", "path", "rule", "verdict")


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _last(n: int, host: str = "host") -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -{n}, NULL), '.')"


def _level(name: str, table: str) -> str:
    return f"""{name} AS (
  SELECT CASE WHEN b IS NULL OR b = 0 THEN 1 / {LEAST_RHO} - 1 ELSE 1 / least(greatest((s - a) / b, {LEAST_RHO}), {MOST_RHO}) - 1 END AS strength
  FROM (SELECT sum(power(bad / n - mu, 2) * n) AS s, sum(mu * (1 - mu)) AS a, sum(mu * (1 - mu) * (n - 1)) AS b FROM {table})
)"""


def _rule_case() -> str:
    lines = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        on, _, start = rule.partition("/")
        lines.append(f"WHEN (host = '{on}' OR host LIKE '%.{on}') AND starts_with(path, '/{start}') THEN ['{rule}', '{verdict}']")
    return "CASE " + " ".join(lines) + " END"


ORACLE = rf"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), q AS (
  SELECT *, CASE WHEN {_last(2)} IN ({_TWO}) THEN {_last(2)} ELSE {_last(1)} END AS suffix,
    CASE WHEN {_last(2)} IN ({_TWO}) THEN {_last(3)} ELSE {_last(2)} END AS domain FROM p
), o AS (
  SELECT q.*, (quality = 0 OR toxic = 1) AS bad FROM q JOIN labels ON page_id = doc_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL
), h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad FROM o GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS mu FROM s),
s0 AS (SELECT s.*, mu FROM s, g), {_level("s1", "s0")},
s2 AS (SELECT suffix, (strength * mu + bad) / (strength + n) AS mu FROM s0, s1),
d0 AS (SELECT d.*, mu FROM d JOIN s2 USING (suffix)), {_level("d1", "d0")},
d2 AS (SELECT domain, (strength * mu + bad) / (strength + n) AS mu FROM d0, d1),
h0 AS (SELECT h.*, mu FROM h JOIN d2 USING (domain)), {_level("h1", "h0")},
k AS (
  SELECT page_id, q.host, path, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(d2.mu, s2.mu, g.mu) AS mu, strength
  FROM q LEFT JOIN h ON h.host = q.host LEFT JOIN d2 ON d2.domain = q.domain LEFT JOIN s2 ON s2.suffix = q.suffix, g, h1
), m AS (
  SELECT *, strength * mu + bad AS a, strength * (1 - mu) + n - bad AS b FROM k
), r AS (
  SELECT *, {_rule_case()} AS found, a / (a + b) AS mean FROM m
)
SELECT page_id, host, path, found[1] AS rule,
  coalesce(found[2], CASE WHEN mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (a + b + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""
