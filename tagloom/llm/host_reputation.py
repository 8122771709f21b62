"""URL filtering by empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted by host. Each level's rate is shrunk towards its parent's through a
beta-binomial prior: host to registered domain to suffix to all pages. A prior's mean is the parent's posterior mean;
its strength is estimated from how much the groups of that level differ beyond chance (moments of the beta-binomial).
A host passes if the lower posterior bound of its good rate reaches a threshold. Fixed rules go before the method.

Counts are combined before each shuffle, so a host with a third of all pages is one row in the tables that are joined;
the join back to pages is one that Spark can split by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialise

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels that are common on the web; a parameter where a full list is at hand. Addresses in figures.
SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.au edu.au gov.au net.au org.au co.nz govt.nz net.nz org.nz ac.jp co.jp go.jp ne.jp or.jp ac.kr co.kr go.kr or.kr "
    "com.br gov.br net.br org.br com.ar com.mx com.co com.pe com.ve com.cn edu.cn gov.cn net.cn org.cn com.hk com.tw com.sg com.my com.ph com.vn co.id co.th ac.in co.in gov.in net.in org.in "
    "ac.za co.za gov.za org.za co.ke com.ng com.eg co.il ac.il org.il com.tr gov.tr com.ua com.pl com.ru"
).split()
ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"
#: Lower bound = mean - Z standard deviations; hosts whose bound is THRESHOLD or more pass.
Z, THRESHOLD = 1.645, 0.7
#: Prior strength where the groups of a level cannot tell, and its limits.
STRENGTH, LEAST, MOST = 10.0, 1.0, 10_000.0


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain of a host and the public suffix under it, without user and port. The suffix is the last label, or the last two where `suffixes` has them. An address in figures is its own domain, under the empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last = lambda n: F.regexp_extract(bare, r"([^.]*" + r"\.[^.]*" * (n - 1) + ")$", 1)
    address, two = bare.rlike(ADDRESS), last(2).isin(list(suffixes))
    domain = F.when(address, bare).when(two & (last(3) != ""), last(3)).otherwise(last(2))
    return domain, F.when(address, "").when(two, last(2)).otherwise(last(1))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule that fits a url; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later, longer ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, n: str, k: str, parent: str, out: str) -> DataFrame:
    """One row: strength of the beta prior of groups with n outcomes, k of them good, and parent's mean."""
    p = F.col(parent)
    spread = F.sum(F.when((p > 0) & (p < 1), (F.col(k) - F.col(n) * p) * (F.col(k) - F.col(n) * p) / (F.col(n) * p * (1 - p))))
    some = F.col(n) > 0
    one = groups.where(some).agg(F.count(F.lit(1)).cast("double").alias("g"), F.sum(n).cast("double").alias("s"), spread.alias("chi"))
    rho = (F.col("chi") - F.col("g")) / F.nullif(F.col("s") - F.col("g"), F.lit(0.0))
    fitted = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), 1 / rho - 1))
    return one.select(F.when(rho.isNull(), STRENGTH).when(rho <= 0, MOST).otherwise(fitted).alias(out))


def host_bounds(pages: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, mean, bound) for each host of pages (host, outcome): labelled pages, posterior mean and lower bound."""
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k"))
    hosts = materialise(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    every = suffixes.agg(((F.sum("sk") + 1.0) / (F.sum("sn") + 2.0)).alias("p0"))
    # The tables of strengths and of the overall rate have one row each.
    suffixes = suffixes.join(F.broadcast(every))
    suffixes = suffixes.join(F.broadcast(_strength(suffixes, "sn", "sk", "p0", "m")))
    suffixes = suffixes.select("suffix", ((F.col("m") * F.col("p0") + F.col("sk")) / (F.col("m") + F.col("sn"))).alias("ps"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.join(F.broadcast(_strength(domains, "dn", "dk", "ps", "m")))
    domains = materialise(domains.select("domain", "suffix", ((F.col("m") * F.col("ps") + F.col("dk")) / (F.col("m") + F.col("dn"))).alias("pd")), "domains")
    hosts = hosts.join(domains, ["domain", "suffix"])
    hosts = hosts.join(F.broadcast(_strength(hosts, "n", "k", "pd", "m")))
    a, b = F.col("m") * F.col("pd") + F.col("k"), F.col("m") * (1 - F.col("pd")) + F.col("n") - F.col("k")
    hosts = hosts.select("host", "n", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return hosts.select("host", "n", mean.alias("mean"), (mean - Z * deviation).alias("bound"))


def judge_urls(pages: DataFrame, threshold: float = THRESHOLD, rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, outcome 1, 0 or null).

    A null url, or one without "://", has an empty host and path and is judged by the empty host's own reputation.
    Null outcomes count nowhere; without any the overall rate is 1/2. Rows repeat as they are; an empty table gives an
    empty one. Other columns are ignored, whatever their names; very long urls are read whole; equal bounds need no
    order. suffixes: public suffixes of two labels.
    """
    slim = pages.select("page_id", F.col("outcome").cast("int").alias("outcome"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = slim.join(host_bounds(slim, suffixes).select(F.col("host").alias("h"), "bound"), F.col("host") == F.col("h"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (page_id, url) with an outcome: that of the document whose id the path names (/lang/id), good if its quality is 1 and it is not toxic."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((1 - bad).alias("outcome"))
    named = F.regexp_extract(url_path(F.col("url")), "^/[^/]*/([0-9]+)", 1).try_cast("long")
    return pages.select("page_id", "url", named.alias("named")).join(known, F.col("named") == F.col("doc_id"), "left").select("page_id", "url", "outcome")


def url_query(spark, sf_dir: str) -> DataFrame:
    """op5: the verdict on every page's url."""
    return judge_urls(labelled_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _strength_sql(table: str, n: str, k: str, p: str) -> str:
    return f"""(SELECT CASE WHEN rho IS NULL THEN {STRENGTH} WHEN rho <= 0 THEN {MOST}
      ELSE greatest({LEAST}, least({MOST}, 1 / rho - 1)) END AS m FROM (
      SELECT (sum(CASE WHEN {p} > 0 AND {p} < 1 THEN ({k} - {n} * {p}) * ({k} - {n} * {p}) / ({n} * {p} * (1 - {p})) END) - count(*))
        / nullif(CAST(sum({n}) AS DOUBLE) - count(*), 0) AS rho FROM {table} WHERE {n} > 0))"""


URL_SQL = f"""
WITH known AS (
  SELECT doc_id, 1 - max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS outcome
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), o AS (
  SELECT p.*, known.outcome FROM p LEFT JOIN known ON known.doc_id = TRY_CAST(regexp_extract(p.path, '^/[^/]*/([0-9]+)', 1) AS BIGINT)
), h AS (
  SELECT host, CASE WHEN address THEN bare WHEN two <> '' AND l3 <> '' THEN l3 ELSE l2 END AS domain,
    CASE WHEN address THEN '' WHEN two <> '' THEN l2 ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix, count(outcome) AS n, coalesce(sum(outcome), 0) AS k
  FROM (SELECT *, regexp_matches(bare, '{ADDRESS}') AS address, CASE WHEN l2 IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN l2 ELSE '' END AS two
    FROM (SELECT *, regexp_extract(bare, '([^.]*\\.[^.]*)$', 1) AS l2, regexp_extract(bare, '([^.]*\\.[^.]*\\.[^.]*)$', 1) AS l3
    FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM o)))
  GROUP BY 1, 2, 3
), d AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY 1, 2
), s AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY 1
), s0 AS (SELECT s.*, p0 FROM s, (SELECT (sum(sk) + 1.0::DOUBLE) / (sum(sn) + 2.0::DOUBLE) AS p0 FROM s)
), s1 AS (SELECT suffix, (m * p0 + sk) / (m + sn) AS ps FROM s0, {_strength_sql("s0", "sn", "sk", "p0")}
), d0 AS (SELECT * FROM d JOIN s1 USING (suffix)
), d1 AS (SELECT domain, suffix, (m * ps + dk) / (m + dn) AS pd FROM d0, {_strength_sql("d0", "dn", "dk", "ps")}
), h0 AS (SELECT * FROM h JOIN d1 USING (domain, suffix)
), h1 AS (SELECT host, m * pd + k AS a, m * (1 - pd) + n - k AS b FROM h0, {_strength_sql("h0", "n", "k", "pd")}
), h2 AS (SELECT host, a / (a + b) - {Z} * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h1
), r AS (
  SELECT page_id, p.host, path, bound, CASE
    WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN h2 ON p.host = h2.host
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound >= {THRESHOLD} THEN 'allow' ELSE 'block' END AS verdict FROM r
"""
