"""URL filter: empirical-Bayes host reputation. DataFrame operations only.

A labelled page is a trial, a bad label a hit. Hits are counted for each
host, registered domain and suffix. Each level's rate is a beta posterior
whose prior is the posterior mean of the level above, with a strength that
the method of moments estimates from the spread of that level's rates: a host
seen twice stays near its domain, one seen a thousand times stands on its
own. A url is blocked if the lower posterior bound (mean less `z` standard
deviations) of its host's bad rate is over `lift` times the rate of all
labelled pages (at most `most`); a host without labels has its domain's
posterior, or its suffix's, or the overall one.

The suffix is the last label, or the last two where the one before a
two-letter label is one of SECOND (``co.uk``); the domain is the suffix and
one label more. An address in numbers or brackets is its own domain and suffix.

Explicit rules come first: a rule fits its host and all subdomains if the
path starts with the rule's; the longest rule wins, of equally long ones the
first in alphabetical order.

Null urls and urls without ``://`` have an empty host and path, no rule, and
the overall posterior. Urls of any length are judged whole. Repeated pages
each count and each have a row; further columns are not kept. Without labels
nothing is blocked but by rules; an empty table of pages gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Least and greatest strength, in pages, of a prior.
STRENGTH = (2.0, 1000.0)
#: Standard deviations of the bound; how many times the overall rate it may be, and the greatest limit.
Z, LIFT, MOST = 1.645, 2.0, 0.9
#: Labels that with a two-letter label after them are a suffix.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org")
#: A lookup table of at most so many bytes is broadcast; a larger one is joined with its hot keys spread.
BROADCAST_BYTES, SALTS = 32 << 20, 64
LEVELS = ("host", "domain", "suffix")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as they stand in the url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return ascii_lower(host), path


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port."""
    bare = F.regexp_replace(host, r":\d*$", "")
    address = bare.rlike(r"^\d+(\.\d+){3}$") | bare.startswith("[")
    double = bare.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z]{{2}}$")
    domain = F.when(address, bare).when(double, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return domain, F.when(address, bare).when(double, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r), reverse=True):  # a longer one replaces a shorter
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lookup(rows: DataFrame, table: DataFrame, key: str, size: int, how: str = "left") -> DataFrame:
    """`rows` with the columns of `table`, which has one row a `key` and about `size` bytes. A key may hold any share of the rows."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def host_counts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages and bad ones of each host. `pages`: host, domain, suffix, key; `labels`: key, bad (one row a key)."""
    return (
        pages.where("key is not null and host <> ''")
        .groupBy("host", "domain", "suffix", "key")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(labels, "key")
        .groupBy("host", "domain", "suffix")
        .agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("bad")).cast("double").alias("bad"))
    )


def strength(m: float, q: float, k: float, t: float) -> float:
    """The strength of a prior of mean m: m(1-m)/var - 1, var being the variance of k rates of t trials beyond what sampling explains."""
    return min(max(m * (1 - m) / max(q - m * m - k * m * (1 - m) / t, 1e-6) - 1, STRENGTH[0]), STRENGTH[1])


def posteriors(counts: DataFrame) -> tuple[DataFrame, dict[str, int], float, float]:
    """Rows (level, name, mean, k) of every posterior, bytes of each level's names, and the overall mean and strength.

    `counts` (host, domain, suffix, n, bad) is written already; the driver reads three rows of moments.
    """
    named = lambda level, as_: level.select(F.lit(as_).alias("level"), F.col(as_).alias("name"), "n", "bad")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = named(counts, "host").unionByName(named(domains, "domain")).unionByName(named(suffixes, "suffix"))
    moments = {r["level"]: r for r in every.groupBy("level").agg(F.sum("n").alias("t"), F.sum("bad").alias("b"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("name") + 32).alias("bytes")).collect()}
    mean, own = 0.5, dict.fromkeys(LEVELS, STRENGTH[0])
    for level, r in moments.items():
        mean = (r["b"] + 0.5) / (r["t"] + 1.0)  # the same at every level
        own[level] = strength(mean, r["q"] / r["t"], r["k"], r["t"])
    size = {level: moments[level]["bytes"] if level in moments else 0 for level in LEVELS}
    rate = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    s = suffixes.select("suffix", rate(F.lit(mean), own["suffix"]).alias("s_mean"), (F.col("n") + own["suffix"]).alias("s_k"))
    d = lookup(domains, s.drop("s_k"), "suffix", size["suffix"], "inner").select("domain", rate(F.col("s_mean"), own["domain"]).alias("d_mean"), (F.col("n") + own["domain"]).alias("d_k"))
    h = lookup(counts, d.drop("d_k"), "domain", size["domain"], "inner").select("host", rate(F.col("d_mean"), own["host"]).alias("h_mean"), (F.col("n") + own["host"]).alias("h_k"))
    out = [x.select(F.lit(level).alias("level"), F.col(level).alias("name"), F.col(f"{level[0]}_mean").alias("mean"), F.col(f"{level[0]}_k").alias("k")) for x, level in ((h, "host"), (d, "domain"), (s, "suffix"))]
    return durable(out[0].unionByName(out[1]).unionByName(out[2])), size, mean, own["suffix"]


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, lift: float = LIFT, most: float = MOST) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bound of every url.

    `pages` has page_id and url; `labels` has doc_id, quality and toxic. A page is labelled by the document
    that the last number of its path names; it is bad if the label says low quality or toxic. Several labels
    of one id count as bad if any is.
    """
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = levels(F.col("host"))
    seen = seen.withColumns({"domain": domain, "suffix": suffix})
    key = F.regexp_extract("path", r"/(\d{1,18})(?:\.html)?/?$", 1)
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    counts = durable(host_counts(seen.withColumn("key", F.when(key != "", key).cast("long")), bad))
    posterior, size, mean, k = posteriors(counts)
    rows = seen
    for level in LEVELS:
        own = posterior.where(F.col("level") == level).select(F.col("name").alias(level), F.col("mean").alias(f"{level}_mean"), F.col("k").alias(f"{level}_k"))
        rows = lookup(rows, own, level, size[level])
    rate = F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(mean))
    weight = F.coalesce("host_k", "domain_k", "suffix_k", F.lit(k))
    rows = rows.select("page_id", "host", "path", rate.alias("bad_rate"), (rate - z * F.sqrt(rate * (1 - rate) / (weight + 1))).alias("bound"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > min(most, lift * mean), "block").otherwise("allow")).alias("verdict"), "bad_rate", "bound")
