"""URL lists that change with time: every capture is judged by the entries active when it was fetched.

Dated additions and removals of a rule become validity intervals [from, until). A
capture is asked about its host, the host's parent domains and its URL's path
prefixes; an as-of join on (rule, day block) finds the rule's interval at the fetch
time: intervals are dealt to blocks of days, so a hot host meets only the few
intervals of a block, and no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Days of a block of the as-of join.
BLOCK_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL, without user, port or closing dot; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an http(s) URL without query and fragment; empty if it has none."""
    return F.regexp_extract(url, r"^(?i:https?)://[^/?#]*(/[^?#]*)", 1)


def rules_of(url: Column) -> Column:
    """array<struct(rule, precision)>: the host's domains and the path prefixes that list entries may name.

    A domain rule is `example.com`, for itself and all below it; a prefix rule is
    `host/path/`, up to a slash. The precision orders them: longer is more precise.
    """
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("rule"), (F.size(parts) - i + 1).alias("precision")))
    steps = F.split(path_of(url), "/")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: i < F.size(steps)),
        lambda i: F.struct(F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")).alias("rule"), (F.size(parts) + i).alias("precision")),
    )
    return F.when(host.isNotNull(), F.concat(domains, prefixes))


def intervals(entries: DataFrame, *, rule: str = "rule", at: str = "at", listed: str = "listed", category: str = "category") -> DataFrame:
    """(rule, category, valid_from, valid_until): from each addition to the next change of the rule.

    entries: dated changes; `listed` tells an addition (with its category) from a removal.
    Changes with a null rule, date or `listed` are skipped; of several changes of a rule
    on one day an addition stands over a removal, then the first category. An interval without
    a later change is open (null).
    """
    changes = entries.where(F.col(rule).isNotNull() & F.col(at).isNotNull() & F.col(listed).isNotNull()).select(F.lower(F.col(rule)).alias("rule"), F.col(at).cast("date").alias("valid_from"), F.col(listed).alias("_listed"), F.col(category).alias("category"))
    daily = changes.groupBy("rule", "valid_from").agg(F.min(F.struct((~F.col("_listed")).alias("gone"), "category")).alias("_c")).select("rule", "valid_from", "_c.gone", "_c.category")
    until = F.lead("valid_from").over(W.partitionBy("rule").orderBy("valid_from"))
    return daily.withColumn("valid_until", until).where("NOT gone").select("rule", "category", "valid_from", "valid_until")


def judged(captures: DataFrame, periods: DataFrame, *, key: str = "page_id", url: str = "url", fetched: str = "fetched_on", allow: str = "allow") -> DataFrame:
    """(key, host, fetched, verdict, rule, category, valid_from, n_active): one row per capture row.

    Of the entries active at the fetch time the most precise decides (ties: the smaller
    rule); category `allow` gives verdict `allow`, any other `block`, none `none`. A capture
    without a host or a fetch time has verdict `none`. Rows that repeat a key, URL and
    time are judged alike and keep one row each.
    """
    block = lambda day: F.floor(F.unix_date(day) / BLOCK_DAYS)
    rows = captures.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("_host"), F.col(fetched).cast("date").alias("_day"), rules_of(F.col(url)).alias("_rules"), F.col(url).alias("_url"))
    rows = rows.groupBy("_key", "_url", "_day").agg(F.first("_host").alias("_host"), F.first("_rules").alias("_rules"), F.count("*").alias("_copies"))
    span = captures.agg(F.min(F.col(fetched).cast("date")).alias("low"), F.max(F.col(fetched).cast("date")).alias("high"))
    dealt = periods.join(F.broadcast(span)).where((F.col("valid_from") <= F.col("high")) & (F.coalesce("valid_until", F.date_add("high", 1)) > F.col("low")))  # one row
    dealt = dealt.withColumn("_block", F.explode(F.sequence(block(F.greatest("valid_from", "low")), block(F.least(F.date_sub(F.coalesce("valid_until", F.date_add("high", 1)), 1), F.col("high"))))))
    dealt = dealt.select(F.col("rule").alias("_named"), "category", "valid_from", "valid_until", "_block")
    asked = rows.select("_key", "_url", "_day", "_host", "_copies", F.explode_outer("_rules").alias("_r")).select("*", F.col("_r.rule").alias("_rule"), F.col("_r.precision").alias("_precision"), block(F.col("_day")).alias("_at")).drop("_r")
    active = (F.col("_rule") == F.col("_named")) & (F.col("_at") == F.col("_block")) & (F.col("valid_from") <= F.col("_day")) & (F.col("valid_until").isNull() | (F.col("_day") < F.col("valid_until")))
    met = asked.join(dealt, active, "left")
    best = F.min(F.when(F.col("_named").isNotNull(), F.struct((-F.col("_precision")).alias("p"), F.col("_named").alias("rule"), "category", "valid_from"))).alias("_best")
    out = met.groupBy("_key", "_url", "_day", "_host", "_copies").agg(best, F.count("_named").alias("n_active"))
    out = out.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    verdict = F.when(F.col("_best").isNull(), "none").when(F.col("_best.category") == allow, "allow").otherwise("block")
    return out.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_day").alias(fetched), verdict.alias("verdict"), F.col("_best.rule").alias("rule"), F.col("_best.category").alias("category"), F.col("_best.valid_from").alias("valid_from"), "n_active")
