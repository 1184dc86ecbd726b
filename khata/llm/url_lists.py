"""Dated allow and block lists over URLs: each capture is judged by the entries active when it was fetched.

List events (entry, action ``block``, ``allow`` or ``remove``, day) become validity intervals: an event of an entry holds from its
day until the entry's next event; of several events of one entry on one day the last by action name counts. An entry is a host
or parent domain, with an optional first path segment. A capture's keys are all of these that cover it, at most
two per label of its host; its keys meet the intervals by key, and the interval that holds the fetch day is the as-of match. The most specific
active entry decides: more labels first, then with a path segment.

Captures are first reduced to distinct (keys, day) pairs with map-side combining, and a hot host's pairs are spread by day: the
join runs on (key, month), with intervals repeated for the months they touch within the captures' span.

Cases: null or host-less URLs match nothing and have verdict ``none``; a null fetch day likewise; events with a null field are left
out; repeated captures are returned as often as they occur; empty tables on either side give verdict ``none`` or no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.lineage import cut


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.nullif(found, F.lit(""))


def segment(url: Column) -> Column:
    """First path segment, empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def keys(name: Column, first: Column) -> Column:
    """Keys that cover a host and path segment: the host's own and its parents' names, each alone and with the segment."""
    labels = F.split(name, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    both = F.transform(names, lambda n: F.array(n, F.concat(n, F.lit("/"), first)))
    return F.when(name.isNotNull(), F.when(F.length(first) > 0, F.flatten(both)).otherwise(names))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, action, valid_from, valid_to) with valid_to null while open; removed spans are left out."""
    known = events.select("entry", "action", "day").filter("entry IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL")
    daily = known.groupBy("entry", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("entry").orderBy("day"))
    return daily.select("entry", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).filter("action <> 'remove'")


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, host, fetched, verdict, matched entry and number of active entries of each capture (page_id, url, fetched)."""
    rows = captures.select("page_id", "url", "fetched").withColumns({"host": host(F.col("url")), "segment": segment(F.col("url"))})
    rows = cut(rows.select("page_id", "fetched", "host", F.when(F.length("segment") > 0, F.col("segment")).alias("segment")), "url-captures")
    wanted = rows.filter("host IS NOT NULL AND fetched IS NOT NULL").select("host", "segment", "fetched").distinct()
    spread = wanted.withColumn("key", F.explode(keys(F.col("host"), F.coalesce("segment", F.lit("")))))
    months = F.expr("CAST(months_between(trunc(fetched, 'MM'), DATE'1970-01-01') AS INT)")
    pairs = spread.select("host", "segment", "fetched", "key", months.alias("month"))

    first, last = rows.agg(F.min("fetched"), F.max("fetched")).first()
    spans = intervals(events).filter((F.col("valid_from") <= F.lit(last)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(first))))
    begin = F.greatest(F.col("valid_from"), F.lit(first).cast("date"))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    spans = spans.withColumns({"b": begin, "e": end}).withColumn(
        "month", F.explode(F.expr("sequence(CAST(months_between(trunc(b, 'MM'), DATE'1970-01-01') AS INT), CAST(months_between(trunc(e, 'MM'), DATE'1970-01-01') AS INT))"))
    )
    active = pairs.join(spans.withColumnRenamed("entry", "key"), ["key", "month"]).filter("fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)")
    rank = F.struct(F.size(F.split(F.substring_index("key", "/", 1), r"\.")).alias("labels"), F.contains("key", F.lit("/")).alias("path"), "key", "action")
    best = active.groupBy("host", "segment", "fetched").agg(F.max(rank).alias("best"), F.count("*").alias("n_active"))
    verdicts = cut(best.select("host", F.coalesce("segment", F.lit("")).alias("s"), "fetched", F.col("best.key").alias("matched"), F.col("best.action").alias("verdict"), "n_active"), "url-verdicts")
    return rows.withColumn("s", F.coalesce("segment", F.lit(""))).join(verdicts, ["host", "s", "fetched"], "left").select(
        "page_id", "host", "fetched", F.coalesce("verdict", F.lit("none")).alias("verdict"), "matched", F.coalesce("n_active", F.lit(0)).alias("n_active")
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day worked out from page_id, two years long."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")).alias("fetched"))


def sample_events(pages: DataFrame) -> DataFrame:
    """Dated list entries drawn from the pages' own hosts, parent domains and first path segments."""
    seen = pages.select(host(F.col("url")).alias("h"), segment(F.col("url")).alias("s")).filter("h IS NOT NULL")
    entries = seen.select(F.explode(F.array(F.col("h"), F.substring_index("h", ".", -2), F.concat("h", F.lit("/"), "s"))).alias("entry")).filter("NOT endswith(entry, '/')").distinct()
    n = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 7), 16, 10).cast("bigint")
    steps = F.explode(F.sequence(F.lit(0), F.pmod(n, F.lit(4)).cast("int"))).alias("k")
    event = entries.filter(F.pmod(n, F.lit(3)) != 0).select("entry", n.alias("n"), steps)
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (F.pmod(F.col("n") + F.col("k"), F.lit(3)) + 1).cast("int"))
    day = F.date_add(F.lit("2022-10-01").cast("date"), F.pmod(F.col("n") * (F.col("k") + 1), F.lit(900)).cast("int"))
    return event.select("entry", action.alias("action"), day.alias("day"))
