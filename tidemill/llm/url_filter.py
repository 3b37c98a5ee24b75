"""URL filters: empirical-Bayes host reputation with a rule list before it. DataFrame functions only.

Labelled outcomes (bad or not) of pages are counted by host, registered domain and suffix. Each level's
rate is a beta posterior whose prior mean is its parent's posterior mean: suffixes shrink to the overall
rate, domains to their suffix, hosts to their domain. A prior's strength comes from the spread of the
rates among the level's units (a beta-binomial moment estimate), between LEAST and MOST pseudo-counts. A
host is blocked when the lower bound of its posterior (mean - Z standard deviations) exceeds THRESHOLD;
a host without labels has its domain's posterior, then its suffix's.

The suffix is the last label of a host, or its last two where they are one of SUFFIXES, under which unrelated owners
register; the registered domain is the suffix and the label before it. A caller may give a longer list. Null urls and urls without
`://` have empty host and path and are judged by the overall rate. Repeated pages stay; with no labels
all pages that no rule fits are allowed; an empty table gives an empty result. Very long urls are cut at their marks like
any other. Labels are aggregated by page before they are joined, so that
clashing names and repeated labels do no harm (a page is bad if any of its labels says so).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: host, path, verdict. Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Public suffixes of two labels. Fixed values, the most used ones.
SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "net.nz", "org.nz", "co.za", "org.za",
    "ac.in", "co.in", "net.in", "org.in", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "or.kr",
    "com.ar", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.co", "com.hk", "co.id", "co.il", "org.il", "com.mx", "org.mx", "com.my", "com.pe", "com.ph", "com.pl",
    "com.sg", "co.th", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn",
    "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com",
]
Z = 1.645
THRESHOLD = 0.5
LEAST, MOST = 1.0, 200.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased A-Z, and path; empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(authority, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a longer rule is put before all shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def levels(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain."""
    two = F.substring_index(host, ".", -2)
    wide = two.isin(suffixes)
    return F.when(wide, two).otherwise(F.substring_index(host, ".", -1)), F.when(wide, F.substring_index(host, ".", -3)).otherwise(two)


def strength(units: DataFrame, mean: Column) -> float:
    """Pseudo-counts of a beta prior whose spread is that of the units' rates (columns bad, n) around `mean`."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2))
    noise = F.sum(mean * (1 - mean))
    inner = F.sum((F.col("n") - 1) * mean * (1 - mean))
    over, inner = units.agg((spread - noise).alias("over"), inner.alias("inner")).first()
    return min(MOST, max(LEAST, inner / over)) if over is not None and over > 0 else MOST


def reputation(pages: DataFrame, labels: DataFrame, page: str = "page_id", bad: str = "bad", suffixes: list[str] = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posteriors (mean m, pseudo-counts s) by host, domain and suffix, and the overall rate. pages: page, host; labels: page, bad."""
    outcome = labels.filter(F.col(bad).isNotNull() & F.col(page).isNotNull()).groupBy(F.col(page).alias("_page")).agg(F.max(F.col(bad).cast("int")).alias("_bad"))
    seen = pages.select(F.col(page).alias("_page"), "host").join(outcome, "_page")
    hosts = seen.groupBy("host").agg(F.sum("_bad").alias("bad"), F.count("*").alias("n"))
    suffix, domain = levels(F.col("host"), suffixes)
    hosts = settle(hosts.withColumns({"suffix": suffix, "domain": domain}))  # read by several small jobs
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    tops = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    b, n = tops.agg(F.sum("bad"), F.sum("n")).first()
    overall = (b + 1) / (n + 2) if n else 0.0

    def shrunk(units: DataFrame, parent: Column) -> DataFrame:
        k = strength(units, parent)
        s = F.col("n") + k
        return units.withColumns({"m": (F.col("bad") + k * parent) / s, "s": s})

    tops = shrunk(tops, F.lit(overall)).select("suffix", F.col("m").alias("m1"), F.col("s").alias("s1"))
    domains = shrunk(domains.join(tops, "suffix"), F.col("m1")).select("domain", F.col("m").alias("m2"), F.col("s").alias("s2"))
    hosts = shrunk(hosts.join(domains, "domain"), F.col("m2")).select("host", F.col("m").alias("m3"), F.col("s").alias("s3"))
    return hosts, domains, tops, overall


def judge(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", bad: str = "bad", rules=RULES, threshold: float = THRESHOLD, z: float = Z, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """page, host, path, rule, verdict, bad_rate (posterior mean) and bad_bound (its lower bound) of each page.

    Reputation is worked out once for each host, from a table of hosts that has been aggregated; pages then meet
    their host's verdict in one join, whose hot hosts adaptive execution splits.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page), F.col(url)).withColumns({"host": host, "path": path}).drop(url)
    known, domains, tops, overall = reputation(rows, labels, page, bad, suffixes)
    suffix, domain = levels(F.col("host"), suffixes)
    every = rows.select("host").distinct().withColumns({"suffix": suffix, "domain": domain})
    at = every.join(known, "host", "left").join(domains, "domain", "left").join(tops, "suffix", "left")
    mean, weight = F.coalesce("m3", "m2", "m1", F.lit(overall)), F.coalesce("s3", "s2", "s1", F.lit(2.0))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))
    hosts = at.select("host", mean.alias("bad_rate"), bound.alias("bad_bound"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(hosts, "host", "left").select(page, "host", "path", name.alias("rule"), F.coalesce(said, method).alias("verdict"), "bad_rate", "bad_bound")


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Page outcomes from the labels table: bad if the quality is 0 or the text is toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def _strength(units: str, mean: str) -> str:
    over = f"sum(n * power(bad / n - {mean}, 2)) - sum({mean} * (1 - {mean}))"
    return f"(SELECT CASE WHEN {over} > 0 THEN least({MOST}, greatest({LEAST}, sum((n - 1) * {mean} * (1 - {mean})) / ({over}))) ELSE {MOST} END FROM {units})"


def oracle(rules=RULES, threshold: float = THRESHOLD, z: float = Z, suffixes: list[str] = SUFFIXES) -> str:
    wide = f"array_to_string(string_split(host, '.')[-2:], '.') IN ({', '.join(map(repr, suffixes))})"
    suffix = f"CASE WHEN {wide} THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END"
    domain = f"CASE WHEN {wide} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"
    fits = [(h + p, v, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for name, _, test in fits)
    said = " ".join(f"WHEN {test} THEN '{v}'" for _, v, test in fits)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h3 AS (SELECT host, {suffix} AS suffix, {domain} AS domain, sum(bad) AS bad, count(*) AS n FROM h JOIN o USING (page_id) GROUP BY host),
h2 AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM h3 GROUP BY suffix, domain), h1 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM h2 GROUP BY suffix),
g AS (SELECT coalesce((sum(bad) + 1) / (sum(n) + 2), 0) AS m0 FROM h1),
i1 AS (SELECT h1.*, m0 FROM h1, g), k1 AS (SELECT {_strength('i1', 'm0')} AS k), p1 AS (SELECT suffix, (bad + k * m0) / (n + k) AS m1, n + k AS s1 FROM i1, k1),
i2 AS (SELECT h2.*, m1 FROM h2 JOIN p1 USING (suffix)), k2 AS (SELECT {_strength('i2', 'm1')} AS k), p2 AS (SELECT domain, (bad + k * m1) / (n + k) AS m2, n + k AS s2 FROM i2, k2),
i3 AS (SELECT h3.*, m2 FROM h3 JOIN p2 USING (domain)), k3 AS (SELECT {_strength('i3', 'm2')} AS k), p3 AS (SELECT host, (bad + k * m2) / (n + k) AS m3, n + k AS s3 FROM i3, k3),
l AS (SELECT *, {suffix} AS suffix, {domain} AS domain FROM h),
a AS (SELECT l.*, coalesce(m3, m2, m1, m0) AS m, coalesce(s3, s2, s1, 2) AS s FROM l LEFT JOIN p3 USING (host) LEFT JOIN p2 USING (domain) LEFT JOIN p1 USING (suffix), g)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} WHEN m - {z} * sqrt(m * (1 - m) / (s + 1)) > {threshold} THEN 'block' ELSE 'allow' END AS verdict FROM a
"""
