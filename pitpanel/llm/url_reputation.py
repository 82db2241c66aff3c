"""URL filter by empirical-Bayes host reputation (operator 7); DataFrame functions only.

Labelled page outcomes (good or bad) are counted by host, registered domain and
suffix. Each level's beta prior has its parent's posterior mean as mean; how
firm it is, is estimated from the level itself: the method of moments for the
beta-binomial gives the correlation within a group, and 1/correlation - 1 is the
prior's weight in pages; a level without two outcomes in a group says nothing of
its correlation and has the weakest prior. A host is blocked when even the upper
posterior bound of its share of good pages lies below the threshold. The bound is
taken on the log-odds, where a beta posterior (a, b) has a variance of about
1/a + 1/b, so it lies between 0 and 1.

The suffix is the last label of a host, or the last two where a country code
follows one of ``SECOND``; the registered domain is one label more. The list of
public suffixes is not at hand, so other shared suffixes count as domains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

#: (host, path, verdict) of the contract (fixed values).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels under which countries register domains (fixed values).
SECOND = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
#: The weight of a prior in pages is kept within these bounds.
WEIGHT = (1.0, 1000.0)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null; of equals the first in order of name."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _weight(groups: DataFrame) -> float:
    """The weight of a level's prior from its groups (n, k, q): one number, computed over all of them."""
    var = F.col("q") * (1 - F.col("q"))
    excess = F.sum(F.pow(F.col("k") - F.col("n") * F.col("q"), 2) - F.col("n") * var)
    room = F.sum(F.col("n") * (F.col("n") - 1) * var)
    excess, room = groups.agg(excess, room).first()  # one row
    weakest, firmest = WEIGHT
    rho = excess / room if room else 1.0
    return 1 / max(min(rho, 1 / (1 + weakest)), 1 / (1 + firmest)) - 1


def reputation(pages: DataFrame, space: Workspace, z: float = 1.645) -> DataFrame:
    """host, n, good, prior, mean, upper from rows (host, good) where ``good`` is 1, 0 or null (no label)."""
    hosts = pages.groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
    parts = F.split("host", r"\.")
    country = (F.size(parts) > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND)
    labels = F.when(country, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(parts, -F.least(F.size(parts), k), k), ".")
    hosts = space.save(hosts.withColumns({"domain": last(labels + 1), "suffix": last(labels)}), "hosts")
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = space.save(total(hosts, "suffix", "domain"), "domains")
    suffixes = space.save(total(domains, "suffix"), "suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()  # one row
    level = suffixes.withColumn("q", F.lit(((k or 0) + 0.5) / ((n or 0) + 1.0)))

    def posterior(groups: DataFrame) -> tuple[Column, Column]:
        """Pages for and against, prior included."""
        weight = F.lit(_weight(groups))
        return F.col("k") + weight * F.col("q"), F.col("n") - F.col("k") + weight * (1 - F.col("q"))

    for key, below in (("suffix", domains), ("domain", hosts)):
        a, b = posterior(level)
        # a domain lies under one suffix
        level = space.save(below.join(level.select(key, (a / (a + b)).alias("q")), key), f"below-{key}")
    a, b = posterior(level)
    odds = F.log(a / b) + z * F.sqrt(1 / a + 1 / b)
    return level.select("host", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("good"), F.col("q").alias("prior"), (a / (a + b)).alias("mean"), (1 / (1 + F.exp(-odds))).alias("upper"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    least: float = 0.75,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict, n_labelled, good_mean, good_upper for each row of ``pages``.

    ``outcomes`` is (doc_id, good): the outcome of the page whose URL's last
    number is doc_id; several rows of a document count as good if all are, null
    ones not at all. Hosts without outcomes have their domain's prior alone. A
    null URL has an empty host, which is judged as a host of its own. Repeated
    rows are judged each; columns beside id and url are not looked at.
    """
    host, path = host_path(F.col("u"))
    rows = pages.select(pages[id_col].alias("__id"), pages[url_col].alias("u"))
    rows = rows.select("__id", host.alias("host"), path.alias("path")).withColumn("number", F.regexp_extract("path", r"(\d{1,18})\D*$", 1))
    rows = rows.withColumn("number", F.expr("try_cast(nullif(number, '') as long)"))
    known = outcomes.select(F.col("doc_id").cast("long").alias("number"), "good").filter("number is not null").groupBy("number").agg(F.min("good").alias("good"))
    labelled = rows.select("host", "number").join(known, "number", "left").select("host", "good")
    hosts = reputation(labelled, Workspace(pages.sparkSession, "url-reputation"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(hosts, "host", "left").withColumns({"rule": name, "ruled": verdict})
    own = F.when(F.col("upper") < least, "block").otherwise("allow")
    return out.select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", own).alias("verdict"),
        F.col("n").alias("n_labelled"),
        F.round("mean", 6).alias("good_mean"),
        F.round("upper", 6).alias("good_upper"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Every URL of ``pages``; a page is good if its document is labelled of quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select("doc_id", good.alias("good")))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), r AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), num AS (
  SELECT *, try_cast(nullif(regexp_extract(path, '(\d{1,18})\D*$', 1), '') AS BIGINT) AS number FROM r
), lab AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS good FROM labels GROUP BY doc_id
), h AS (
  SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k, string_split(host, '.') AS parts,
         CASE WHEN len(parts) > 2 AND length(parts[-1]) = 2 AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'ne', 'net', 'or', 'org') THEN 2 ELSE 1 END AS labels,
         array_to_string(list_slice(parts, -labels - 1, -1), '.') AS domain, array_to_string(list_slice(parts, -labels, -1), '.') AS suffix
  FROM num LEFT JOIN lab ON number = doc_id GROUP BY host
), d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
sq AS (SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM s) AS q FROM s),
sw AS (SELECT CASE WHEN coalesce(sum(n*(n-1)*q*(1-q)), 0) = 0 THEN 1.0 ELSE 1 / greatest(least(sum((k - n*q)**2 - n*q*(1-q)) / sum(n*(n-1)*q*(1-q)), 1/2.0), 1/1001.0) - 1 END AS w FROM sq),
sp AS (SELECT suffix, (k + w*q) / (n + w) AS q FROM sq, sw),
dq AS (SELECT d.*, q FROM d JOIN sp USING (suffix)),
dw AS (SELECT CASE WHEN coalesce(sum(n*(n-1)*q*(1-q)), 0) = 0 THEN 1.0 ELSE 1 / greatest(least(sum((k - n*q)**2 - n*q*(1-q)) / sum(n*(n-1)*q*(1-q)), 1/2.0), 1/1001.0) - 1 END AS w FROM dq),
dp AS (SELECT suffix, domain, (k + w*q) / (n + w) AS q FROM dq, dw),
hq AS (SELECT h.*, q FROM h JOIN dp USING (suffix, domain)),
hw AS (SELECT CASE WHEN coalesce(sum(n*(n-1)*q*(1-q)), 0) = 0 THEN 1.0 ELSE 1 / greatest(least(sum((k - n*q)**2 - n*q*(1-q)) / sum(n*(n-1)*q*(1-q)), 1/2.0), 1/1001.0) - 1 END AS w FROM hq),
hp AS (
  SELECT host, n, (k + w*q) / (n + w) AS m, 1 / (1 + exp(-(ln((k + w*q) / (n - k + w*(1-q))) + 1.645 * sqrt(1 / (k + w*q) + 1 / (n - k + w*(1-q)))))) AS upper FROM hq, hw
),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM r) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT page_id, r.host, r.path, rule, coalesce(v, CASE WHEN upper < 0.75 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS n_labelled, round(m, 6) AS good_mean, round(upper, 6) AS good_upper
FROM r LEFT JOIN hp USING (host) LEFT JOIN fit ON fit.host = r.host AND fit.path = r.path
"""
