"""URL filter: explicit rules, then empirical-Bayes reputations of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Registry suffixes of two labels, as a pattern: generic second levels under country codes.
SUFFIX = r"((?:^|\.)(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}|[^.]*)$"

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.ltrim(F.regexp_extract(F.regexp_replace(host, ":[0-9]*$", ""), SUFFIX, 1), F.lit("."))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    label = F.regexp_extract(F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0))), "[^.]*$", 0)
    return F.when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix))


def strength(groups: DataFrame) -> DataFrame:
    """(kappa, mean) of one level: the beta-binomial's prior size by the method of moments.

    groups: n outcomes and k bad ones per group. The intraclass correlation is the part of the groups' spread
    beyond the binomial one; kappa = (1 - rho) / rho, kept within 1 and 1000.
    """
    total = groups.agg(
        F.sum("n").alias("t"), F.sum("k").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    )
    mean = total.withColumn("mean", F.expr("(coalesce(b, 0) + 1) / (coalesce(t, 0) + 2)"))
    rho = mean.withColumn(
        "rho",
        F.expr("try_divide(kk - 2 * mean * b + mean * mean * t - (g - 1) * mean * (1 - mean), mean * (1 - mean) * (t - nn / t - (g - 1)))"),
    )
    return rho.select(F.expr("least(greatest(coalesce(try_divide(1 - rho, if(rho > 0, rho, 0)), 1000), 1), 1000)").alias("kappa"), "mean")


def reputations(seen: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host and bad_bound, the lower posterior bound of its rate of bad pages, for all hosts of ``seen``.

    outcomes: host and bad (0 or 1) of labelled pages. A suffix is shrunk to the rate of all, a registered domain to its
    suffix, a host to its domain, each without the host's own outcomes, which so count once; each level has its own prior strength. The bound is the posterior mean less z
    posterior standard deviations. Hosts without outcomes stand where their domain does.
    """
    part = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = seen.select("host").distinct().join(part, "host", "left").fillna(0, ["n", "k"])
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    known = hosts.filter("n > 0")
    domains = known.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    level = lambda df, n, k, name: strength(df.select(F.col(n).alias("n"), F.col(k).alias("k"))).select(F.col("kappa").alias(name), F.col("mean").alias(f"{name}_mean"))
    # Three tables of one row each.
    one = F.broadcast(level(suffixes, "sn", "sk", "ks").join(F.broadcast(level(domains, "dn", "dk", "kd"))).join(F.broadcast(level(known, "n", "k", "kh"))))
    return (
        hosts.join(suffixes, "suffix", "left").join(domains, ["suffix", "domain"], "left").join(one)
        .withColumn("ps", F.expr("(coalesce(sk, 0) - k + ks * ks_mean) / (coalesce(sn, 0) - n + ks)"))
        .withColumn("pd", F.expr("(coalesce(dk, 0) - k + kd * ps) / (coalesce(dn, 0) - n + kd)"))
        .withColumn("a", F.expr("k + kh * pd")).withColumn("s", F.expr("n + kh"))
        .select("host", F.expr(f"a / s - {z} * sqrt(a * (s - a) / (s * s * (s + 1)))").alias("bad_bound"))
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    limit: float = 0.2,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules: (verdict, host/path); one fits its host and all subdomains where the path starts with its own; the longest
    that fits decides. Else a host is blocked whose bad_bound is over ``limit``. labels: (doc_id, quality 1 good / 0 bad)
    are the outcomes of the pages of that id; of several the lowest counts, null ones don't.

    A null url, or one without ``://``, has empty host and path and is judged as the host ''. Null ids
    have no outcome; repeated rows are judged alike; an empty table gives no rows.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    truth = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).cast("long").alias("bad"))
    outcomes = rows.join(truth, F.col("page_id") == F.col("doc_id")).select("host", "bad")
    bounds = reputations(rows, outcomes).withColumn("worse", F.col("bad_bound") > limit).select("host", "worse")
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, says = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(says)
    return rows.join(bounds, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("worse"), "block").otherwise("allow")).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.2, z: float = 1.645) -> str:
    """The same in DuckDB."""
    when = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')", v, f"{h}/{p}") for v, (h, _, p) in ((v, r.partition("/")) for v, r in sorted(rules, key=lambda r: -len(r[1])))]
    case = lambda k: "case " + " ".join(f"when {w[0]} then '{w[k]}'" for w in when) + " end"

    def level(table: str, n: str, k: str) -> str:
        return f"""(select least(greatest(coalesce(case when rho > 0 then (1 - rho) / rho end, 1000), 1), 1000) as kappa, mean from (
            select *, (kk - 2 * mean * b + mean * mean * t - (g - 1) * mean * (1 - mean)) / nullif(mean * (1 - mean) * (t - nn / nullif(t, 0) - (g - 1)), 0) as rho from (
            select *, (coalesce(b, 0) + 1) / (coalesce(t, 0) + 2) as mean from (
            select sum({n})::double as t, sum({k})::double as b, sum({n} * {n})::double as nn, count(*) as g, sum({k} * {k} / {n}::double) as kk from {table}))))"""

    return rf"""
    with rows as (select page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '{PARTS}', 2), '') as path from pages),
    truth as (select doc_id, 1 - min(quality) as bad from labels where doc_id is not null and quality in (0, 1) group by doc_id),
    part as (select host, count(*) as n, sum(bad) as k from rows join truth on page_id = doc_id group by host),
    named as (select h.host, coalesce(n, 0) as n, coalesce(k, 0) as k, regexp_replace(h.host, ':[0-9]*$', '') as name,
        ltrim(regexp_extract(regexp_replace(h.host, ':[0-9]*$', ''), '{SUFFIX}', 1), '.') as suffix from (select distinct host from rows) h left join part using (host)),
    labelled as (select *, regexp_extract(substring(name, 1, greatest(length(name) - length(suffix) - 1, 0)), '[^.]*$', 0) as label from named),
    hosts as (select *, case when label = '' then suffix else label || '.' || suffix end as domain from labelled),
    known as (select * from hosts where n > 0),
    domains as (select suffix, domain, sum(n) as dn, sum(k) as dk from known group by suffix, domain),
    suffixes as (select suffix, sum(dn) as sn, sum(dk) as sk from domains group by suffix),
    ps as (select h.*, (coalesce(sk, 0) - k + s.kappa * s.mean) / (coalesce(sn, 0) - n + s.kappa) as ps from hosts h left join suffixes using (suffix), {level("suffixes", "sn", "sk")} s),
    pd as (select p.*, (coalesce(dk, 0) - k + d.kappa * ps) / (coalesce(dn, 0) - n + d.kappa) as pd from ps p left join domains using (suffix, domain), {level("domains", "dn", "dk")} d),
    post as (select p.host, k + h.kappa * pd as a, n + h.kappa as s from pd p, {level("known", "n", "k")} h),
    bounds as (select host, a / s - {z} * sqrt(a * (s - a) / (s * s * (s + 1))) > {limit} as worse from post)
    select page_id, host, path, {case(2)} as rule, coalesce({case(1)}, case when worse then 'block' else 'allow' end) as verdict
    from rows join bounds using (host)"""
