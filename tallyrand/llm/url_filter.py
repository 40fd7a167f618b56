"""URL filtering by host reputation: rules first, then a beta-binomial posterior.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's
good rate is shrunk towards its parent's with a strength that is estimated from the spread
of the rates at that level (moments of the beta-binomial), and a url is blocked when even the upper
bound of its host's posterior good rate lies below ``min_good``. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed, met

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered, where no other list is given; any other suffix is the last label. A full list of public suffixes is the caller's to give.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) rules that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def levels(host: Column, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host; a host of one label is its own domain. Suffixes of the last two labels are those listed."""
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    wide = two.isin(*two_label_suffixes)
    return F.when(wide, two).otherwise(last), F.when(wide, F.substring_index(host, ".", -3)).otherwise(two)


def shrunk(rates: DataFrame, key: str, parent: str, top: DataFrame, weakest: float, strongest: float) -> DataFrame:
    """Rates (key, parent, good, n) with prior mean ``above`` from top(parent, mean) and the strength of this level.

    The strength k comes from rho = 1 / (k + 1), the correlation of outcomes within a key, by moments;
    it is kept within [weakest, strongest], which also settles levels of one key.
    """
    moments = rates.agg(
        F.sum("good").alias("g"), F.sum("n").alias("t"), F.count("*").alias("keys"), F.sum(F.col("n") * F.col("n")).alias("sq"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"),
    )
    m = F.try_divide(F.col("g"), F.col("t"))
    spread = F.col("gg") - m * F.col("g")  # sum of n * (rate - m)^2
    rho = F.try_divide(F.try_divide(spread, m * (1 - m)) - (F.col("keys") - 1), F.col("t") - F.try_divide(F.col("sq"), F.col("t")) - (F.col("keys") - 1))
    strength = moments.select(F.coalesce(F.least(F.lit(strongest), F.greatest(F.lit(weakest), F.try_divide(F.lit(1.0), rho) - 1)), F.lit(strongest)).alias("k"), (rho > 0).alias("spreads"))
    strength = strength.select(F.when(F.col("spreads"), F.col("k")).otherwise(strongest).alias("k"))
    joined = rates.join(top, parent, "left").crossJoin(F.broadcast(strength))  # strength: one row
    return joined.select(key, parent, "k", F.col("mean").alias("above"), "good", "n", ((F.col("good") + F.col("k") * F.col("mean")) / (F.col("n") + F.col("k"))).alias("own"))


def reputation(outcomes: DataFrame, *, weakest: float = 1.0, strongest: float = 200.0, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior tables of outcomes(host, good boolean): by host, domain and suffix, and the overall rate (one row).

    Null outcomes count for nothing. A rate is Beta(k * above + good, k * (1 - above) + bad). The overall rate starts
    from one good and one bad page, so it is defined without any outcome.
    """
    suffix, domain = levels(F.col("host"), two_label_suffixes)
    # All levels come from the counts of the hosts, which are far fewer than the outcomes.
    hosts = checkpointed(outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.sum(F.col("good").cast("double")).alias("good"), F.count("*").cast("double").alias("n")).withColumns({"suffix": suffix, "domain": domain}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("everything", F.lit(1))
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mean")).select(F.lit(1).alias("everything"), "mean")
    s = checkpointed(shrunk(suffixes, "suffix", "everything", overall, weakest, strongest))
    d = checkpointed(shrunk(domains, "domain", "suffix", s.select("suffix", F.col("own").alias("mean")), weakest, strongest))
    h = shrunk(hosts.drop("suffix"), "host", "domain", d.select("domain", F.col("own").alias("mean")), weakest, strongest)
    return h, d, s, overall


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", min_good: float = 0.5, z: float = 1.645, unseen_strength: float = 2.0, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, good_mean, good_upper) of every row of pages.

    outcomes: (host, good), each of which counts once, so a page that is labelled twice counts twice. A host without outcomes takes its domain's rate, else its suffix's, else the overall one,
    with ``unseen_strength`` pages behind it. Verdict: the longest fitting rule's, else block where mean + z sd of the posterior
    is below ``min_good``. Null urls and urls without ``://`` have an empty host, which is judged as any other;
    repeated rows are judged one by one; an empty table gives an empty result; further columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    h, d, s, overall = reputation(outcomes, two_label_suffixes=two_label_suffixes)
    suffix, domain = levels(F.col("host"), two_label_suffixes)
    # Judge each distinct host once; the pages then need one join, on the host.
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages")).withColumns({"suffix": suffix, "domain": domain})
    hosts = (
        hosts.join(h.select("host", F.col("own").alias("hm"), F.col("k").alias("hk"), F.col("n").alias("hn")), "host", "left")
        .join(d.select("domain", F.col("own").alias("dm")), "domain", "left")
        .join(s.select("suffix", F.col("own").alias("sm")), "suffix", "left")
        .crossJoin(F.broadcast(overall.select(F.col("mean").alias("om"))))  # one row
    )
    mean = F.coalesce("hm", "dm", "sm", "om")
    weight = F.coalesce(F.col("hk") + F.col("hn"), F.lit(unseen_strength))
    upper = F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (weight + 1)))
    judged = checkpointed(hosts.select("host", F.col("pages").alias("n"), mean.alias("good_mean"), upper.alias("good_upper")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return met(rows, judged, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.round("good_upper", 9) < min_good, "block").otherwise("allow")).alias("verdict"), "good_mean", "good_upper"
    )
