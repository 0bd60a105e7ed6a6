"""URL filter by empirical-Bayes host reputation, under explicit rules.

Labelled page outcomes are shrunk through beta-binomial priors: a suffix towards all pages, a registered domain towards its
suffix, a host towards its domain. At each level the prior's weight (a number of pages) is estimated from the spread of the
children's rates around their parents beyond binomial noise. A host is blocked where its posterior share of good pages is
surely low: its upper bound is under `least_good`. A url rule overrides it.

For the domain and the suffix, a user name before `@` and a port are left out of the host, and an address is a domain and a suffix
of its own. Counts per host are written once, so all levels read that narrow table and pages are read twice: to count and to judge.

Defined results: a null url, or one without `://`, has empty host and path, matches no rule, and is judged by the prior of all
pages; hosts without labels take their domain's estimate; repeated rows are judged one by one, and each counts every label of its
page_id (or of the document it shows) once, for its own host only; a row with a null page_id has the labels of its document and
none by page_id; texts of any length are read whole; other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import written


class UrlRule(NamedTuple):
    text: str  # host, then the path's beginning
    verdict: str


RULES = (UrlRule("org/", "allow"), UrlRule("example.org/es/", "block"), UrlRule("example.org/en/1", "block"),
         UrlRule("com/fr/", "allow"), UrlRule("com/de/", "block"))
#: Public suffixes of several labels, of any number; any other suffix is the last label. A full public list may be passed instead.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "com.cn")
Z, LEAST_GOOD = 2.0, 0.5
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    has = F.coalesce(F.position(F.lit("://"), url) > 0, F.lit(False))
    rest = F.when(has, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return lower, path


ADDRESS = r"^(\[|[0-9]+([.][0-9]+){3}\z)"


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r":[0-9]*\z", "")


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix: the longest suffix known, and one label more. An address is both."""
    bare = bare_host(host)
    domain, suffix = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    sizes: dict[int, list[str]] = {}
    for s in suffixes:
        sizes.setdefault(s.count(".") + 1, []).append(s)
    for labels, known in sorted(sizes.items()):
        tail = F.substring_index(bare, ".", -labels)
        domain, suffix = F.when(tail.isin(known), F.substring_index(bare, ".", -labels - 1)).otherwise(domain), F.when(tail.isin(known), tail).otherwise(suffix)
    address = bare.rlike(ADDRESS)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        h, slash, p = r.text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _level(children: DataFrame, child: str, parent: str | None, parents: DataFrame | None) -> DataFrame:
    """(child, rate, weight): posterior of every child. `children` has (child, parent, n, k); `parents` (parent, rate).

    Moments: sum over children of n (p - m)^2 is, in mean, sum of m (1 - m) (1 + (n - 1) rho) around the parents' rates m;
    rho = 1 / (weight + 1).
    """
    joined = children.join(parents.select(parent, F.col("rate").alias("m")), parent)
    p, m, n = F.col("k") / F.col("n"), F.col("m"), F.col("n")
    labelled = joined.filter(n > 0)
    moments = labelled.agg(F.sum(n * (p - m) * (p - m)).alias("s"), F.sum(m * (1 - m)).alias("b"), F.sum(m * (1 - m) * (n - 1)).alias("c"))
    rho = F.try_divide(F.col("s") - F.col("b"), F.col("c"))
    weight = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT))).otherwise(F.lit(MAX_WEIGHT))
    w = F.col("w")
    return (joined.join(F.broadcast(moments.select(weight.alias("w"))))  # one row
            .select(child, ((F.col("k") + w * m) / (n + w)).alias("rate"), (n + w).alias("weight")))


def reputation(counts: DataFrame, suffixes_known: Sequence[str] = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors (name, rate, weight) of hosts, domains, suffixes and all pages from rows (host, n, k): k of n outcomes are good.
    A row with n = 0 names a host without counting. Rows are summed per host before anything else, so a hot host is one row."""
    domain, suffix = domain_and_suffix(F.col("host"), suffixes_known)
    hosts = written(counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    every = suffixes.groupBy("all").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("rate"), (F.sum("n") + 2).cast("double").alias("weight"))
    s = written(_level(suffixes, "suffix", "all", every), "suffix-rates")
    d = written(_level(domains, "domain", "suffix", s), "domain-rates")
    return _level(hosts, "host", "domain", d), d, s, every


def upper_bound(rate: Column, weight: Column, z: float = Z) -> Column:
    """Normal bound of the beta posterior with this mean and total weight."""
    return F.least(rate + z * F.sqrt(rate * (1 - rate) / (weight + 1)), F.lit(1.0))


def _counted(shown: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(host, n, k) from rows (host, key) and labels (key, good). Both sides are counted per key first, so neither a repeated
    row nor a repeated label is paired one by one; a null key has no label."""
    known = (labels.filter(F.col(key).isNotNull()).groupBy(key)
             .agg(F.count("good").alias("_n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("_k")))
    times = shown.groupBy("host", key).agg(F.count(F.lit(1)).alias("_rows"))
    return (times.join(known, key, "left").fillna(0, ["_n", "_k"])
            .select("host", (F.col("_rows") * F.col("_n")).alias("n"), (F.col("_rows") * F.col("_k")).alias("k")))


def _rows(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES, z: float = Z, least_good: float = LEAST_GOOD,
          suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_rate, good_upper) of every page; `labels`: (page_id, good boolean)."""
    rows = _rows(pages)
    return _judged(rows, _counted(rows, labels, "page_id"), rules, z, least_good, suffixes)


def judge_documents(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES, z: float = Z, least_good: float = LEAST_GOOD,
                    suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """As `judge`, with `labels` (doc_id, quality): the first number in a page's path names the document that it shows."""
    rows = _rows(pages)
    shown = rows.select("host", F.regexp_extract("path", "([0-9]+)", 1).try_cast("long").alias("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    return _judged(rows, _counted(shown, known, "doc_id"), rules, z, least_good, suffixes)


def _judged(rows: DataFrame, counts: DataFrame, rules: tuple[UrlRule, ...], z: float, least_good: float, suffixes: Sequence[str]) -> DataFrame:
    hosts = reputation(counts, suffixes)[0]
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    upper = upper_bound(F.col("rate"), F.col("weight"), z)
    own = F.when(upper < least_good, F.lit("block")).otherwise(F.lit("allow"))
    # a hot host's pages are split by Spark's skew join; reputations are one narrow row per host
    return (rows.join(hosts, "host").withColumns({"rule": rule, "good_upper": upper})
            .select("page_id", "host", "path", "rule", F.coalesce(ruled, own).alias("verdict"),
                    F.round("rate", 9).alias("good_rate"), F.round("good_upper", 9).alias("good_upper")))


def _level_sql(children: str, child: str, parent: str, parents: str) -> str:
    w = f"CASE WHEN (s - b) / nullif(c, 0) > 0 THEN least(greatest(1 / ((s - b) / c) - 1, {MIN_WEIGHT}), {MAX_WEIGHT}) ELSE {MAX_WEIGHT} END"
    return (f"(WITH j AS (SELECT x.*, y.rate AS m, k / n AS p FROM {children} x JOIN {parents} y ON x.{parent} = y.{parent}), "
            f"o AS (SELECT {w} AS w FROM (SELECT sum(n * (p - m) * (p - m)) AS s, sum(m * (1 - m)) AS b, sum(m * (1 - m) * (n - 1)) AS c "
            f"FROM j WHERE n > 0)) SELECT {child}, (k + w * m) / (n + w) AS rate, n + w AS weight FROM j, o)")


_TWO = "array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.')"
_THREE = "array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.')"
_LIST = ", ".join(f"'{s}'" for s in SUFFIXES)


def _fits_sql(r: UrlRule) -> str:
    h, slash, p = r.text.partition("/")
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')"


_ORDER = sorted(RULES, key=lambda r: -len(r.text))
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT try_cast(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS doc_id, host FROM r),
c AS (SELECT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\\z', '') AS bare, count(quality)::DOUBLE AS n, coalesce(sum((quality = 1)::INT), 0)::DOUBLE AS k
  FROM g LEFT JOIN labels USING (doc_id) GROUP BY host),
hosts AS (SELECT host, n, k,
  CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN {_TWO} IN ({_LIST}) THEN {_THREE} ELSE {_TWO} END AS domain,
  CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN {_TWO} IN ({_LIST}) THEN {_TWO} ELSE string_split(bare, '.')[-1] END AS suffix FROM c),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS a, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
every AS (SELECT 1 AS a, (sum(k) + 1) / (sum(n) + 2) AS rate FROM suffixes),
ps AS {_level_sql('suffixes', 'suffix', 'a', 'every')},
pd AS {_level_sql('domains', 'domain', 'suffix', 'ps')},
ph AS {_level_sql('hosts', 'host', 'domain', 'pd')},
v AS (SELECT page_id, host, path, rate, least(rate + {Z} * sqrt(rate * (1 - rate) / (weight + 1)), 1.0) AS up,
  CASE {' '.join(f"WHEN {_fits_sql(r)} THEN '{r.text}'" for r in _ORDER)} END AS rule,
  CASE {' '.join(f"WHEN {_fits_sql(r)} THEN '{r.verdict}'" for r in _ORDER)} END AS ruled FROM r JOIN ph USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN up < {LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(rate, 9) AS good_rate, round(up, 9) AS good_upper FROM v
"""
