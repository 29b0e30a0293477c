"""URL filters by a temporal list join.

Dated list entries (``rule, action, from_time``) become validity intervals: an
``add`` holds until the rule's next entry. Each capture is joined, as of its fetch
time, with the intervals of the host rules that cover its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port, user and final dot; null if it has none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$|\.+$", "")
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def suffixes(host: Column) -> Column:
    """The host and every parent domain; a name has at most 127 labels by the DNS's rules."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``rule, reason, valid_from, valid_to`` from dated ``rule, action, reason, from_time`` entries.

    Entries of one rule follow one another in time; of several at one time a removal
    wins, then the smallest reason. ``valid_to`` is null for an entry still in force.
    Null rules and times are dropped. An interval includes its start, not its end.
    """
    clean = entries.where(F.col("rule").isNotNull() & F.col("from_time").isNotNull()).select(F.lower("rule").alias("rule"), "action", "reason", "from_time")
    once = clean.groupBy("rule", "from_time").agg(F.min_by(F.struct("action", "reason"), F.struct((F.col("action") != "remove"), F.col("reason"))).alias("e"))
    following = F.lead("from_time").over(Window.partitionBy("rule").orderBy("from_time"))
    return once.withColumn("valid_to", following).where(F.col("e.action") == "add").select("rule", F.col("e.reason").alias("reason"), F.col("from_time").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, capture_id: str, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row for each distinct capture: ``capture_id, host, blocked, rule, reason``.

    The rule is the most specific one in force at the fetch time (ties: smallest
    reason). Captures with no host or no time match nothing. The join's key is the rule,
    and a capture meets one row per parent domain and entry, never another capture; AQE
    splits a host that holds many captures. Repeated capture ids are one capture if they agree in
    host and time.
    """
    rows = captures.select(F.col(capture_id).alias("capture_id"), host_of(F.col(url)).alias("host"), F.col(fetched).alias("fetched"))
    asked = rows.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select("host", "fetched").distinct()
    asked = asked.select("*", F.explode(suffixes(F.col("host"))).alias("suffix"))
    rules = intervals(entries)
    met = asked.join(rules, (F.col("suffix") == F.col("rule")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = met.groupBy("host", "fetched").agg(F.min(F.struct((-F.length("rule")).alias("l"), "reason", "rule")).alias("m"))
    out = rows.distinct().join(best, ["host", "fetched"], "left")
    return out.select("capture_id", "host", F.col("m").isNotNull().alias("blocked"), F.col("m.rule").alias("rule"), F.col("m.reason").alias("reason"))
