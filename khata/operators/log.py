"""The append-only log: content digests, repeated facts, sequence numbers and the hash chain.

A chain over single records can only be built one record after the other, so facts are
chained in batches: what one delivery recorded on one day has one root over its facts and
their sequence numbers, and the roots of a merchant form the chain. A later delivery goes on
from the stored heads and reads none of the facts before it. Roots are built in two steps
by the leading digits of the digests, so a huge day is split into many small groups.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.operators.ranking import parts_for, rank_in_group, rank_placed
from khata.schemas import EVENTS

GENESIS = "0" * 64
# Leading hex digits that split one root's facts into groups.
SPLIT_DIGITS = 4


def canonical(columns: list[str] | None = None) -> Column:
    """One spelling per fact: its fields by name, NULLs kept apart from blanks; never the sequence number."""
    names = sorted(columns or EVENTS.names)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def with_digest(events: DataFrame) -> DataFrame:
    return events.withColumn("digest", F.sha2(canonical([c for c in events.columns if c in EVENTS.names]), 256))


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Each fact once. Copies are equal, so which of them stays makes no difference."""
    return facts.dropDuplicates(["merchant_id", "digest"])


def new_facts(batch: DataFrame, log: DataFrame | None) -> DataFrame:
    """What a delivery adds to the log; corrections differ in content, so they are kept."""
    facts = distinct_facts(batch)
    if log is None:
        return facts
    return facts.join(log.select("merchant_id", "digest"), ["merchant_id", "digest"], "left_anti")


def ingestion(batch: DataFrame, log: DataFrame | None) -> DataFrame:
    """Per merchant: rows delivered, recorded, and skipped because they were already there."""
    came = batch.groupBy("merchant_id").agg(F.count("*").alias("delivered"))
    kept = new_facts(batch, log).groupBy("merchant_id").agg(F.count("*").alias("recorded"))
    out = came.join(kept, "merchant_id", "left").withColumn("recorded", F.coalesce("recorded", F.lit(0)))
    return out.withColumn("skipped", F.col("delivered") - F.col("recorded"))


ORDER = ["merchant_id", "recorded_at", "occurred_at", "event_id", "digest"]


def assign_sequence(facts: DataFrame, since: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Numbers new facts of each merchant on from where the heads in ``since`` stand, or from 1."""
    out = rank_in_group(facts, ["merchant_id"], [F.col(c) for c in ORDER[1:]], "seq", parts)
    if since is None:
        return out
    last = since.select("merchant_id", F.col("facts").alias("_last"))
    return out.join(last, "merchant_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")


def once(events: DataFrame) -> DataFrame:
    """Each fact once, with its digest and the number of its ``copies``, range partitioned and sorted in the log's order.

    Copies of a fact are neighbours in that order, so one shuffle brings them together; digests are taken behind it.
    """
    placed = events.repartitionByRange(parts_for(events.count(), events.sparkSession), *ORDER[:-1])
    facts = with_digest(placed)
    rest = [c for c in facts.columns if c not in ORDER]
    held = facts.groupBy(*ORDER).agg(*[F.first(c).alias(c) for c in rest], F.count("*").alias("copies"))
    return held.select(*facts.columns, "copies").sortWithinPartitions(*ORDER)


def record(events: DataFrame) -> DataFrame:
    """Each fact once, with its digest and sequence number from 1: ``assign_sequence`` of ``distinct_facts``, from one shuffle."""
    return rank_placed(once(events).drop("copies"), ["merchant_id"], "seq")


def fresh(batch: DataFrame, held: DataFrame | None, parts: int) -> DataFrame:
    """Facts of ``batch`` that ``held`` lacks, each once, with its digest and the month recorded, placed by month and the log's order.

    What the log holds goes through the same shuffle by its order and digest alone, so that copies of it are neighbours too.
    """
    rows = batch.select(*EVENTS.names, F.lit(None).cast("binary").alias("_held"))
    if held is not None:
        # a fact of no merchant is never taken for one that is there
        there = held.select(*ORDER[:-1], F.unhex("digest").alias("_held")).filter("merchant_id IS NOT NULL AND _held IS NOT NULL")
        rows = rows.unionByName(there, allowMissingColumns=True)
    month = F.trunc("recorded_at", "MM").alias("recorded_in")
    placed = rows.select("*", month).repartitionByRange(parts, "recorded_in", *ORDER[:-1])
    facts = with_digest(placed).withColumn("digest", F.coalesce(F.lower(F.hex("_held")), "digest"))
    rest = [c for c in EVENTS.names if c not in ORDER]
    met = facts.groupBy("recorded_in", *ORDER).agg(*[F.first(c).alias(c) for c in rest], F.count("_held").alias("_there"))
    new = met.filter("_there = 0").select("recorded_in", *EVENTS.names, "digest")
    return new.sortWithinPartitions("recorded_in", *ORDER)


def roots(
    rows: DataFrame, keys: list[str], digest: str = "digest", digits: int = SPLIT_DIGITS, parts: int | None = None, hexed: bool = False,
) -> DataFrame:
    """One hash per key over all its digests, whatever order they come in.

    With ``parts``, the digests are dealt by key and first digit, so that the digests of a key meet in at most 16 tasks and
    all steps but the last need no further shuffle. Digests of hex digits, ``hexed``, go there in half their bytes.
    """
    spelled = F.lower(F.hex("_digest")) if hexed else F.col("_digest")
    rows = rows.select(*keys, F.left(digest, F.lit(1)).alias("_shard"), (F.unhex(digest) if hexed else F.col(digest)).alias("_digest"))
    if parts:
        rows = rows.repartition(parts, *keys, "_shard")
    rows = rows.withColumn("_digest", spelled).withColumn("_head", F.left("_digest", F.lit(digits)))
    # most leaves hold few digests: a sort makes them cheaper than an aggregate with a buffer for each
    leaf = Window.partitionBy(*keys, "_shard", "_head").orderBy("_digest")
    whole = leaf.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaves = rows.select(
        *keys, "_shard", "_head", F.row_number().over(leaf).alias("_place"), F.count("*").over(whole).alias("_n"),
        F.collect_list("_digest").over(whole).alias("_digests")).filter("_place = 1")
    # half as many bytes on the way, spelled out again behind it
    leaves = leaves.withColumn("_leaf", F.unhex(F.sha2(F.concat_ws("", "_digests"), 256)))
    # at most 16 ** digits leaves per key
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_head", "_leaf"))), lambda x: F.lower(F.hex(x["_leaf"])))
    return leaves.groupBy(*keys).agg(F.sha2(F.concat_ws("", ordered), 256).alias("root"), F.sum("_n").alias("facts"))


def _delivered(rows: DataFrame) -> DataFrame:
    return rows if "delivery" in rows.columns else rows.withColumn("delivery", F.lit(1).cast("bigint"))


def log_roots(log: DataFrame, parts: int | None = None) -> DataFrame:
    """One root per merchant, delivery and day recorded, over its facts and the places they have in the sequence."""
    leaf = F.sha2(F.concat_ws(":", "seq", "digest"), 256)
    parts = parts or parts_for(log.count(), log.sparkSession)
    return roots(_delivered(log).withColumn("_fact", leaf), ["merchant_id", "delivery", "recorded_at"], "_fact", parts=parts, hexed=True)


HEAD = "merchant_id string, batch bigint, facts bigint, log_head string"
CHAIN = "merchant_id string, recorded_at date, delivery bigint, batch bigint, facts bigint, root string, prev_hash string, hash string"


def chain(log: DataFrame, since: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Batches of each merchant in order, each hashed together with the one before.

    A batch is what one delivery recorded on one day. With ``since``, the heads of a log, the chain goes on from there:
    only the new facts are read. One row per batch and merchant goes through the sequential step, never the facts.
    """
    days = log_roots(log, parts)
    if since is None:
        days = days.withColumns({"_from": F.lit(0).cast("bigint"), "_head": F.lit(GENESIS)})
    else:
        held = since.select("merchant_id", F.col("batch").alias("_from"), F.col("log_head").alias("_head"))
        days = days.join(held, "merchant_id", "left").withColumns(
            {"_from": F.coalesce("_from", F.lit(0).cast("bigint")), "_head": F.coalesce("_head", F.lit(GENESIS))})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["delivery", "recorded_at"]).reset_index(drop=True)
        before, out = pdf["_head"].iloc[0], []
        for root in pdf["root"]:
            now = hashlib.sha256((before + root).encode()).hexdigest()
            out.append((before, now))
            before = now
        pdf["batch"] = range(int(pdf["_from"].iloc[0]) + 1, int(pdf["_from"].iloc[0]) + len(pdf) + 1)
        pdf["prev_hash"] = [p for p, _ in out]
        pdf["hash"] = [h for _, h in out]
        return pdf[["merchant_id", "recorded_at", "delivery", "batch", "facts", "root", "prev_hash", "hash"]]

    return days.groupBy("merchant_id").applyInPandas(fold, CHAIN)


def heads(links: DataFrame) -> DataFrame:
    """Where the chain of each merchant stands: last batch, number of facts (the last sequence number), last hash."""
    return links.groupBy("merchant_id").agg(
        F.max("batch").alias("batch"), F.sum("facts").alias("facts"), F.max_by("hash", "batch").alias("log_head")
    )


def broken_links(links: DataFrame, content: str = "root", position: str = "batch", since: int = 0) -> DataFrame:
    """Links whose previous hash is not their predecessor's, or whose own hash is not that of their content.

    Works on day batches and on chains over single records alike; a self-join on the
    position, so no merchant is walked in one task.
    """
    before = links.select(
        "merchant_id", (F.col(position) + 1).alias(position), F.col("hash").alias("_before")
    )
    seen = links.filter(F.col(position) > since).join(before, ["merchant_id", position], "left")
    expected = F.when(F.col(position) == 1, F.lit(GENESIS)).otherwise(F.col("_before"))
    own = F.sha2(F.concat("prev_hash", content), 256)
    why = F.when(~F.coalesce(F.col("prev_hash") == expected, F.lit(False)), "does not follow its predecessor").when(
        F.col("hash") != own, "content was altered"
    )
    return seen.withColumn("reason", why).filter("reason IS NOT NULL").select("merchant_id", position, "reason")


def altered_batches(log: DataFrame, links: DataFrame) -> DataFrame:
    """Batches whose facts, or whose order, no longer give the root the chain was built on."""
    linked = links.agg(F.sum("facts")).first()[0] or 0
    now = log_roots(log, parts_for(linked, log.sparkSession)).select(
        "merchant_id", "delivery", "recorded_at", F.col("root").alias("_now"), F.col("facts").alias("_facts")
    )
    both = _delivered(links).join(now, ["merchant_id", "delivery", "recorded_at"], "full_outer")
    return both.filter(~F.col("root").eqNullSafe(F.col("_now"))).select(
        "merchant_id", "delivery", "recorded_at", F.col("facts").alias("facts_then"), F.col("_facts").alias("facts_now")
    )
