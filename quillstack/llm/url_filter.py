"""URL filtering by explicit rules and, where none fits, by empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Common public suffixes of two labels, where no table of suffixes is given; every other suffix is the last label.
SECOND_LEVEL = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg",
    "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.in", "gov.au", "gov.br",
    "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za",
)
#: Rows of host statistics (some 100 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` (one row a ``host``) with ``suffix``, the longest of ``suffixes`` that a host ends with (else its last label), and ``domain``, one label more."""
    labels = F.split("host", r"\.")
    tail = lambda n: F.array_join(F.slice("__l", -n, n), ".")
    tails = hosts.select("host", labels.alias("__l")).select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("__l")), lambda n: F.struct(n.alias("n"), tail(n).alias("t")))).alias("e"))
    known = cut(suffixes.select(F.lower(F.col("suffix").cast("string")).alias("__t")).filter("__t is not null").distinct())
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    found = tails.join(known, F.col("e.t") == F.col("__t")).groupBy("host").agg(F.max("e.n").alias("__n"))
    n = F.coalesce("__n", F.lit(1))
    parted = hosts.join(found, "host", "left").withColumn("__l", labels)
    return parted.withColumns({"suffix": F.array_join(F.slice("__l", -n, n), "."), "domain": F.array_join(F.slice("__l", -F.least(n + 1, F.size("__l")), n + 1), ".")}).drop("__l", "__n")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in by_length]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def shrunk(level: DataFrame, key: str) -> DataFrame:
    """Posterior of each unit (``key, n, x, prior``) under Beta(s * prior, s * (1 - prior)): adds ``a, b``.

    s = 1/rho - 1, where rho is the overdispersion of all units of the level by the method of moments:
    E[n (x/n - prior)^2] = prior (1 - prior) (1 + (n - 1) rho).
    """
    v = F.col("prior") * (1 - F.col("prior"))
    seen = F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("prior"), 2) - v)
    rho = F.coalesce(F.sum(seen) / F.nullif(F.sum(F.when(F.col("n") > 0, (F.col("n") - 1) * v)), F.lit(0.0)), F.lit(0.1))
    strength = level.agg(F.greatest(F.lit(0.001), F.least(F.lit(0.999), rho)).alias("rho")).select((1 / F.col("rho") - 1).alias("s"))
    return level.crossJoin(F.broadcast(strength)).select(key, "n", "x", (F.col("s") * F.col("prior") + F.col("x")).alias("a"), (F.col("s") * (1 - F.col("prior")) + F.col("n") - F.col("x")).alias("b"))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host, n, x, a, b``: labelled pages, bad ones and the Beta posterior of the bad rate, for every host of ``pages``.

    ``pages`` has ``page_id, host``; ``outcomes`` has ``page_id, bad`` (0 or 1; several labels of a page: bad if one
    is). Counts are pre-aggregated by host before anything else is shuffled; domains and suffixes are sums of hosts.
    """
    label = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    seen = pages.filter("page_id is not null").join(label, "page_id").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("x"))
    counted = cut(pages.select("host").distinct().join(seen, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0)).alias("x")))
    hosts = cut(registered(counted, suffixes))
    total = F.sum("n").alias("n"), F.sum("x").alias("x")
    whole = hosts.agg(((F.coalesce(F.sum("x"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    suffix_rates = cut(shrunk(cut(hosts.groupBy("suffix").agg(*total).crossJoin(F.broadcast(whole))), "suffix"))
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    domain_rates = cut(shrunk(cut(hosts.groupBy("domain", "suffix").agg(*total).join(suffix_rates.select("suffix", mean), "suffix")), "domain"))
    return shrunk(cut(hosts.join(domain_rates.select("domain", mean), "domain")), "host")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, bad_rate: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, n_labelled, n_bad, bad_rate_lower``.

    Without a rule, a page is blocked if the lower bound of its host's posterior bad rate (mean less ``z`` standard
    deviations) is over ``bad_rate``. A host without labels inherits its registered domain's rate, that its suffix's,
    that the overall rate. ``suffixes`` (a table with ``suffix``, of any number of labels) says where registered domains
    begin; without it, ``SECOND_LEVEL`` does. Defined cases: a null url or one without ``://`` has empty host and path and is judged by
    the reputation of the empty host; repeated pages count and are reported once each; null page ids have no label;
    empty tables give an empty result, and without any outcome nothing is blocked.
    """
    url = F.col("url").cast("string")
    slim = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    suffixes = pages.sparkSession.createDataFrame([(s,) for s in SECOND_LEVEL], "suffix string") if suffixes is None else suffixes
    posterior = cut(reputation(slim.select("page_id", "host"), outcomes, suffixes))
    a, b = F.col("a"), F.col("b")
    m = a / (a + b)
    bound = posterior.select("host", F.col("n").alias("n_labelled"), F.col("x").alias("n_bad"), F.round(m - z * F.sqrt(m * (1 - m) / (a + b + 1)), 6).alias("bad_rate_lower"))
    bound = F.broadcast(bound) if posterior.count() <= BROADCAST_ROWS else bound
    judged = slim.join(bound, "host", "left").withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("bad_rate_lower") > bad_rate, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "n_bad", "bad_rate_lower")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labels of the shared id space as page outcomes: bad is low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))


def _level(name: str, key: str, source: str) -> str:
    v = "prior * (1 - prior)"
    return f"""
{name}_rho AS (SELECT greatest(0.001, least(0.999, coalesce(sum(CASE WHEN n > 0 THEN n * pow(x / n - prior, 2) - {v} END)
        / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * {v} END), 0.0), 0.1))) AS rho FROM {source}),
{name} AS (SELECT {key}, n, x, (1 / rho - 1) * prior + x AS a, (1 / rho - 1) * (1 - prior) + n - x AS b FROM {source}, {name}_rho)"""


_FITS = reduce(lambda acc, r: acc + f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{r[0]} {r[1]}{r[2]}' ", sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)), "CASE ") + "END"

SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, CAST(max(greatest(1 - quality, toxic)) AS DOUBLE) AS bad FROM labels GROUP BY 1),
c AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, coalesce(sum(bad), 0.0) AS x, string_split(host, '.') AS parts FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h AS (SELECT host, n, x, array_to_string(parts[-2:], '.') AS l2, array_to_string(parts[-3:], '.') AS l3, parts[-1] AS l1 FROM c),
hosts AS (SELECT host, n, x, CASE WHEN l2 IN {SECOND_LEVEL} THEN l3 ELSE l2 END AS domain, CASE WHEN l2 IN {SECOND_LEVEL} THEN l2 ELSE l1 END AS suffix FROM h),
g AS (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior FROM hosts),
s0 AS (SELECT suffix, n, x, prior FROM (SELECT suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY 1), g),{_level("s1", "suffix", "s0")},
d0 AS (SELECT d.*, a / (a + b) AS prior FROM (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY 1, 2) d JOIN s1 USING (suffix)),{_level("d1", "domain", "d0")},
h0 AS (SELECT hosts.host, hosts.n, hosts.x, a / (a + b) AS prior FROM hosts JOIN d1 USING (domain)),{_level("h1", "host", "h0")},
r AS (SELECT host, n, x, round(a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 6) AS bound FROM h1),
j AS (SELECT p.*, n, x, bound, {_FITS} AS fit FROM p JOIN r USING (host))
SELECT page_id, host, path, string_split(fit, ' ')[2] AS rule, coalesce(string_split(fit, ' ')[1], CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(x AS BIGINT) AS n_bad, bound AS bad_rate_lower FROM j
"""
