"""URL filter by empirical-Bayes host reputation, under allow and block rules.

Labelled page outcomes (bad or not) are counted per host. A host's rate is
shrunk towards its registered domain's, that one towards its suffix's, and the
suffix's towards the rate of all, each by a beta-binomial prior. How strongly a
level is shrunk comes from the counts themselves (moments of the spread that
binomial noise does not explain). A host is blocked when the lower posterior
bound of its bad rate reaches ``limit``; an unlabelled host has its domain's
prior, so it is blocked only when its domain is known to be bad.

Only expressions, joins and sums: a host that holds a third of all pages is
counted in every map task first, and the joins to pages go through plain
exchanges whose large parts Spark splits.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule and is allowed; repeated labels of a page count once (bad if any is);
pages repeated under one url count each; empty tables give no rows or, without
labels, allow.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hosts import registrable
from .catalogue import query
from .common import checkpointed, read

#: (verdict, rule): a host with its subdomains, and the beginning of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Lower posterior bound of the bad rate from which a host is blocked, and its standard deviations below the mean.
LIMIT, DEVIATIONS = 0.25, 1.645


def split_url(pages: DataFrame) -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (pages.withColumn("_after", F.coalesce(after, F.lit("")))
            .withColumn("host", F.translate(F.regexp_extract("_after", r"^[^/?#]*", 0), upper, upper.lower()))
            .withColumn("path", F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1)).drop("_after"))


def matched(rules=RULES, what: int = 1):
    """The longest rule that fits host and path (what 1), or its verdict (what 0)."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit((verdict, rule)[what])).otherwise(out)
    return out


def strength(level: DataFrame, parent_mean: str):
    """One row: prior strength k of a level (n, x, parent_mean), by the moments of x around its parent's mean."""
    m = F.col(parent_mean)
    noise = F.col("n") * m * (1 - m)
    spread = F.sum(F.pow(F.col("x") - F.col("n") * m, 2) - noise)
    room = F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    rho = F.when(room > 0, spread / room).otherwise(0.0)
    return level.agg(F.greatest(F.least(rho, F.lit(0.99)), F.lit(0.001)).alias("_rho")).select((1 / F.col("_rho") - 1).alias("k"))


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, n, bad_mean, bad_low) for every row of hosts(host), from outcomes(host, bad int).

    hosts has one row a host; the three strengths and the overall rate are
    one-row tables.
    """
    labelled = hosts.join(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("x")), "host", "left")
    named = checkpointed(labelled.selectExpr("host", "coalesce(n, 0) AS n", "coalesce(x, 0) AS x", f"{registrable('host')} AS domain")
                         .selectExpr("*", "substring_index(domain, '.', -1) AS suffix"))
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    overall = suffixes.agg((F.sum("x") / F.greatest(F.sum("n"), F.lit(1))).alias("m0"))  # one row

    def shrunk(level: DataFrame, parent: str, mean: str) -> DataFrame:
        k = strength(level, parent)
        return (level.join(F.broadcast(k)).withColumn("k_" + mean, F.col("k")).drop("k")
                .withColumn(mean, (F.col("x") + F.col("k_" + mean) * F.col(parent)) / (F.col("n") + F.col("k_" + mean))))

    by_suffix = shrunk(suffixes.join(F.broadcast(overall)), "m0", "m1")
    by_domain = shrunk(domains.join(by_suffix.select("suffix", "m1"), "suffix"), "m1", "m2")
    by_host = shrunk(named.join(by_domain.select("domain", "m2"), "domain"), "m2", "m3")
    a = F.col("n") + F.col("k_m3")
    sd = F.sqrt(F.col("m3") * (1 - F.col("m3")) / (a + 1))
    return by_host.select("host", "n", F.col("m3").alias("bad_mean"), (F.col("m3") - DEVIATIONS * sd).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_low) for every row of pages(page_id, url).

    outcomes(page_id, bad int 0/1) covers some pages; several for one page
    count once.
    """
    parts = checkpointed(split_url(pages.select("page_id", "url")).select("page_id", "host", "path"))
    known = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("bigint").alias("bad"))
    seen = parts.where("host <> ''").join(known, "page_id").select("host", "bad")
    rates = reputation(seen, parts.where("host <> ''").select("host").distinct())
    low = F.coalesce("bad_low", F.lit(0.0))
    return parts.join(rates, "host", "left").select(
        "page_id", "host", "path", matched(rules).alias("rule"),
        F.coalesce(matched(rules, 0), F.when(low >= limit, "block").otherwise("allow")).alias("verdict"),
        F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_low", 6).alias("bad_low"))


def outcomes_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page ends in the number of the document it shows; it is bad when that document is labelled toxic or of low quality."""
    shown = split_url(pages.select("page_id", "url")).select("page_id", F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html|/)?$", 1).alias("d"))
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("bigint")
    judged = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return shown.where("d <> ''").select("page_id", F.col("d").cast("bigint").alias("doc_id")).join(judged, "doc_id").select("page_id", "bad")


SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
known AS (SELECT p.page_id, max(j.bad) AS bad FROM parts p
  JOIN judged j ON j.doc_id = TRY_CAST(regexp_extract(p.path, '/([0-9]{1,18})(\.html|/)?$', 1) AS BIGINT) GROUP BY p.page_id),
counted AS (SELECT host, count(*) AS n, sum(bad) AS x FROM parts JOIN known USING (page_id) WHERE host <> '' GROUP BY host),
hosts AS (SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(x, 0)::DOUBLE AS x, regexp_extract(host, '[^.]*\.?[^.]*$') AS domain,
  regexp_extract(host, '[^.]*$') AS suffix FROM (SELECT DISTINCT host FROM parts WHERE host <> '') LEFT JOIN counted USING (host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL),
top AS (SELECT sum(x) / greatest(sum(n), 1) AS m0 FROM suffixes),
k1 AS (SELECT 1 / greatest(least(CASE WHEN sum(n * (n - 1) * m0 * (1 - m0)) > 0 THEN sum((x - n * m0) ** 2 - n * m0 * (1 - m0))
  / sum(n * (n - 1) * m0 * (1 - m0)) ELSE 0 END, 0.99), 0.001) - 1 AS k FROM suffixes, top),
s2 AS (SELECT suffix, (x + k * m0) / (n + k) AS m1 FROM suffixes, top, k1),
d1 AS (SELECT * FROM domains JOIN s2 USING (suffix)),
k2 AS (SELECT 1 / greatest(least(CASE WHEN sum(n * (n - 1) * m1 * (1 - m1)) > 0 THEN sum((x - n * m1) ** 2 - n * m1 * (1 - m1))
  / sum(n * (n - 1) * m1 * (1 - m1)) ELSE 0 END, 0.99), 0.001) - 1 AS k FROM d1),
d2 AS (SELECT domain, (x + k * m1) / (n + k) AS m2 FROM d1, k2),
h1 AS (SELECT * FROM hosts JOIN d2 USING (domain)),
k3 AS (SELECT 1 / greatest(least(CASE WHEN sum(n * (n - 1) * m2 * (1 - m2)) > 0 THEN sum((x - n * m2) ** 2 - n * m2 * (1 - m2))
  / sum(n * (n - 1) * m2 * (1 - m2)) ELSE 0 END, 0.99), 0.001) - 1 AS k FROM h1),
h2 AS (SELECT host, (x + k * m2) / (n + k) AS m3, n + k AS a FROM h1, k3),
rates AS (SELECT host, m3, m3 - 1.645 * sqrt(m3 * (1 - m3) / (a + 1)) AS low FROM h2),
ruled AS (SELECT p.*, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts p)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN coalesce(low, 0) >= 0.25 THEN 'block' ELSE 'allow' END AS verdict, round(m3, 6) AS bad_mean, round(low, 6) AS bad_low
FROM ruled r LEFT JOIN rates t ON t.host = r.host
"""


@query("op6_judge_urls", SQL)
def op6_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, outcomes_of_pages(pages, read(spark, sf_dir, "labels")))
