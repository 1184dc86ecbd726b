"""Links as they stood when less was known, over the whole history.

Whether a payout is linked depends on few facts. By reference: the credits and payouts that its reference connects it with, over any
number of steps (its group). By amount: credits and payouts of its own amount within ``NEAR_DAYS`` of it, and what reference
decided about them. The latest of these facts to be recorded is when the payout is settled: from that day on the final
links hold for it. Before, its facts are linked again as far as they were known, and only they.

So a fact that comes in late, however late, has exactly the payouts linked again that it can touch, and a chain of contested
references is followed back as far as it reaches. Groups are found once over all facts; no history is repeated per window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.operators.components import components
from khata.operators.linkage import FORWARD_DAYS, LOOKBACK_DAYS, UNPLACED_DAYS, link_credits, payouts_not_linked, reference_evidence, reference_nodes

# A credit that could be the payout lies within UNPLACED_DAYS of it; whether that credit is placed rests on payouts in its reach
# and on the credits that reach these.
NEAR_DAYS = UNPLACED_DAYS + LOOKBACK_DAYS + FORWARD_DAYS
KEY = ["merchant_id"]


def _vertex(kind: str, *parts: str) -> Column:
    return F.concat_ws("\u0001", F.lit(kind), "merchant_id", *[F.col(p).cast("string") for p in parts])


def reference_groups(credits: DataFrame, paid: DataFrame) -> DataFrame:
    """(merchant_id, kind, id, grp) of every credit and payout that a reference connects with another."""
    evidence = reference_evidence(credits, paid, KEY)
    to_payout = evidence.edges.select(_vertex("c", "bank_txn_id").alias("a"), _vertex("p", "settlement_id").alias("b"))
    edges = to_payout
    for cells in evidence.cells:
        # everything that meets in a cell is one group: the cell is a node of its own
        edges = edges.unionByName(cells.naming.select(_vertex("c", "bank_txn_id").alias("a"), _vertex("x", *cells.by).alias("b")))
        edges = edges.unionByName(cells.nodes.select(_vertex("p", "settlement_id").alias("a"), _vertex("x", *cells.by).alias("b")))
    found = components(edges)
    named = credits.select("merchant_id", F.lit("c").alias("kind"), F.col("bank_txn_id").alias("id"), _vertex("c", "bank_txn_id").alias("node"))
    # payouts that agree in reference, day and amount stand for each other
    twins = reference_nodes(paid, KEY).select("merchant_id", "utr", F.col("day").alias("occurred_at"), F.col("paid_paise").alias("amount_paise"), F.col("settlement_id").alias("first"))
    shown = paid.join(twins, ["merchant_id", "utr", "occurred_at", "amount_paise"]).select(
        "merchant_id", F.lit("p").alias("kind"), F.col("settlement_id").alias("id"), _vertex("p", "first").alias("node"))
    return named.unionByName(shown).join(found, "node").select("merchant_id", "kind", "id", F.col("component").alias("grp"))


@dataclass
class History:
    """All credits and payouts ever recorded, and their final links."""

    credits: DataFrame
    paid: DataFrame
    links: DataFrame

    @cached_property
    def facts(self) -> DataFrame:
        """(merchant_id, kind, id, amount_paise, day, known, grp, group_known): what links are made of, and since when."""
        known = F.greatest("occurred_at", "recorded_at").alias("known")
        common = ["amount_paise", F.col("occurred_at").alias("day"), known]
        rows = self.credits.select("merchant_id", F.lit("c").alias("kind"), F.col("bank_txn_id").alias("id"), *common).unionByName(
            self.paid.select("merchant_id", F.lit("p").alias("kind"), F.col("settlement_id").alias("id"), *common))
        rows = rows.join(reference_groups(self.credits, self.paid), ["merchant_id", "kind", "id"], "left")
        last = rows.filter("grp IS NOT NULL").groupBy("merchant_id", "grp").agg(F.max("known").alias("group_known"))
        rows = rows.join(last, ["merchant_id", "grp"], "left").withColumn("group_known", F.coalesce("group_known", "known"))
        return cut(rows, "facts")

    @cached_property
    def settled(self) -> DataFrame:
        """(merchant_id, settlement_id, settled): the day from which the final links hold for a payout."""
        # one row per amount and day, so an amount that is paid all the time is a row a day
        cells = self.facts.groupBy("merchant_id", "amount_paise", "day").agg(F.max("group_known").alias("last"))
        near = Window.partitionBy("merchant_id", "amount_paise").orderBy(F.unix_date("day")).rangeBetween(-NEAR_DAYS, NEAR_DAYS)
        cells = cells.withColumn("settled", F.max("last").over(near)).drop("last")
        paid = self.facts.filter("kind = 'p'").join(cells, ["merchant_id", "amount_paise", "day"])
        return cut(paid.select("merchant_id", F.col("id").alias("settlement_id"), F.greatest("settled", "group_known").alias("settled")), "settled")

    def relinked(self, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(links, credits, payouts) of what decides about the asked payouts (keys, settlement_id, amount_paise, occurred_at, known_by), as known by then."""
        ask = [*keys, "known_by"]
        cells = asked.select(*ask, "amount_paise", F.explode(F.sequence(
            F.date_sub("occurred_at", NEAR_DAYS), F.date_add("occurred_at", NEAR_DAYS))).alias("day")).distinct()
        near = self.facts.join(cells, ["merchant_id", "amount_paise", "day"]).select(*ask, "kind", "id", "known", "grp")
        groups = near.filter("grp IS NOT NULL").select(*ask, "grp").distinct()
        wide = self.facts.join(groups, ["merchant_id", "grp"]).select(*ask, "kind", "id", "known", "grp")
        members = cut(near.unionByName(wide).filter("known <= known_by").select(*keys, "kind", "id").distinct(), "members")
        credits = self.credits.join(members.filter("kind = 'c'").select(*keys, F.col("id").alias("bank_txn_id")), ["merchant_id", "bank_txn_id"])
        paid = self.paid.join(members.filter("kind = 'p'").select(*keys, F.col("id").alias("settlement_id")), ["merchant_id", "settlement_id"])
        credits, paid = cut(credits, "credits-then"), cut(paid, "paid-then")
        return cut(link_credits(credits, paid, keys), "links-then"), credits, paid

    @cached_property
    def unlinked(self) -> DataFrame:
        """Payouts the final links leave open, with the day from which they are."""
        return payouts_not_linked(self.paid, self.links).join(self.settled, ["merchant_id", "settlement_id"])
