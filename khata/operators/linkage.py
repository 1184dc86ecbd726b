"""Bank credits to gateway payouts that share no key, without guessing.

A credit may belong to a payout executed from six days before to one day after it.
Evidence is tried in tiers: the payout reference in the narration; the reference after
folding punctuation; a cut-off reference plus the exact amount; the amount alone where
it is unique on both sides. Anything else is left open.

Pairs are never built from a whole merchant. On ordinary days a credit meets the few
payouts of its eight days; on crowded days it meets payouts only through a piece of
text they share, and where many payouts carry the same reference it meets that
reference once and, of its payouts, only those of its own amount. The claim order of the references (earlier credits first) is kept by
deciding, in each round, every credit that no earlier one competes with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.text import reference_key
from khata.lineage import cut, kept, passage
from khata.operators.ranking import parts_for, rank_in_group, running_sum

# Confidence of each rule, and what is needed to accept a link.
CONFIDENCE = {
    "exact_utr": 1.00,
    "normalised_utr": 0.97,
    "truncated_prefix": 0.90,
    "amount_date_unique": 0.80,
    "abstain_ambiguous": 0.35,
    "abstain_no_candidate": 0.00,
}
THRESHOLD = 0.75
LOOKBACK_DAYS = 6
FORWARD_DAYS = 1
# A credit of the amount within this many days could be the payout.
UNPLACED_DAYS = 6
HEAD = 8
# Payouts per key and day beyond which pairs go through shared text.
CROWDED = 64


def bank_credits(events: DataFrame) -> DataFrame:
    return events.filter("type = 'bank_credit_received'").select(
        "merchant_id", F.col("entity_id").alias("bank_txn_id"), "amount_paise", "occurred_at",
        "recorded_at", F.coalesce("narration", F.lit("")).alias("narration"),
    )


def payouts(events: DataFrame) -> DataFrame:
    return events.filter("type = 'settlement_executed'").select(
        "merchant_id", F.col("entity_id").alias("settlement_id"), "utr", "amount_paise",
        "occurred_at", "recorded_at", "fee_paise",
    )


def _pieces(text: Column, size: Column) -> Column:
    """Every run of ``size`` characters in ``text``."""
    last = F.length(text) - size + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size))
    ).otherwise(F.array().cast("array<string>"))


def _near(credit_day: Column, lookback: int, forward: int) -> Column:
    return F.explode(F.sequence(F.date_sub(credit_day, lookback), F.date_add(credit_day, forward)))


def candidate_pairs(
    credits: DataFrame, paid: DataFrame, keys: list[str],
    lookback: int = LOOKBACK_DAYS, forward: int = FORWARD_DAYS,
) -> DataFrame:
    """How many payouts lie in reach of each credit, from counts per day."""
    per_day = paid.groupBy(*keys, F.col("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    credit_days = credits.groupBy(*keys, "occurred_at").agg(F.count("*").alias("credits"))
    reach = credit_days.withColumn("day", _near(F.col("occurred_at"), lookback, forward))
    return (
        reach.join(per_day, [*keys, "day"], "left")
        .groupBy(*keys, "occurred_at")
        .agg(F.first("credits").alias("credits"), F.coalesce(F.sum("n"), F.lit(0)).alias("in_reach"))
    )


def _evidence(narration: Column, folded: Column, utr: Column, same_amount: Column) -> list[Column]:
    return [
        F.contains(narration, utr).alias("exact"),
        F.contains(folded, utr).alias("norm"),
        (same_amount & F.contains(folded, F.left(utr, F.lit(HEAD)))).alias("stub"),
    ]


def reference_nodes(paid: DataFrame, keys: list[str]) -> DataFrame:
    """Payouts a reference can point to. Those that agree in reference, day and amount can never
    be told apart by a reference, so they enter once with their number ``n``."""
    return (
        paid.filter(F.trim("utr") != "")
        .groupBy(*keys, "utr", F.col("occurred_at").alias("day"), F.col("amount_paise").alias("paid_paise"))
        .agg(F.count("*").alias("n"), F.min("settlement_id").alias("settlement_id"))
    )


def _edge_columns(keys: list[str]) -> list[str]:
    return [*keys, "bank_txn_id", "occurred_at", "settlement_id", "utr", "day", "paid_paise", "n", "exact", "norm", "stub"]


@dataclass
class Cells:
    """Payouts that credits meet as a group: those of one day with the same reference, or with
    the same start of a reference and the same amount. ``by`` names the columns of a cell."""

    by: list[str]
    naming: DataFrame
    nodes: DataFrame


@dataclass
class Evidence:
    """What narrations say about payouts: single credit-payout edges, and cells."""

    edges: DataFrame
    cells: list[Cells] = field(default_factory=list)


def _head() -> Column:
    return F.left("utr", F.lit(HEAD))


def _sign(kind: str, keys: list[str], text: Column, amount: Column | None = None) -> Column:
    """Five bytes that stand for a text of a key, and an amount: equal for equal ones, and hardly ever for others."""
    parts = [F.lit(kind), *[F.col(k).cast("string") for k in keys], text]
    return F.shiftrightunsigned(F.xxhash64(*parts, *([] if amount is None else [amount.cast("bigint")])), 24)


def _meeting(seen: DataFrame, nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pieces, heads): credits with each piece of their text that is a payout's reference, or the head of one of their amount.

    A narration has far more pieces than references in it. So what is dealt and compared first is a piece's sign and its credit's
    number; the credit itself follows only to the pieces whose signs were found among the payouts. A sign may be found by chance,
    so what the pieces are joined with is still compared in full.
    """
    # lengths of references, few for each key
    sizes = cut(nodes.groupBy(*keys).agg(F.collect_set(F.length("utr")).alias("sizes")), "sizes")
    seen = cut(seen.join(sizes, keys).withColumn("_credit", F.monotonically_increasing_id()), "narrations")
    seen = seen.withColumn("folded", reference_key(F.col("narration")))
    amount = F.col("amount_paise")
    named = F.flatten(F.transform("sizes", lambda n: F.array_union(_pieces(F.col("narration"), n), _pieces(F.col("folded"), n))))
    starts = F.array_distinct(F.flatten(F.transform("sizes", lambda n: _pieces(F.col("folded"), F.least(n, F.lit(HEAD))))))
    # about three pieces a character, and a sign is small
    letters = seen.agg(F.sum(F.length("narration"))).first()[0] or 0
    parts = parts_for(letters // 4, seen.sparkSession)
    asked = seen.select("_credit", F.explode(F.concat(
        F.transform(named, lambda p: _sign("name", keys, p)), F.transform(starts, lambda p: _sign("head", keys, p, amount)))).alias("_sign"))
    there = nodes.select(F.explode(F.array(
        _sign("name", keys, F.col("utr")), _sign("head", keys, F.col("head"), F.col("paid_paise")))).alias("_sign"))
    found = asked.repartition(parts, "_sign").join(there.repartition(parts, "_sign"), "_sign", "left_semi")
    met = cut(seen.drop("sizes").join(found, "_credit").join(sizes, keys).drop("folded"), "met").withColumn(
        "folded", reference_key(F.col("narration")))
    pieces = met.withColumn("utr", F.explode(F.filter(named, lambda p: _sign("name", keys, p) == F.col("_sign"))))
    heads = met.withColumn("head", F.explode(F.filter(starts, lambda p: _sign("head", keys, p, amount) == F.col("_sign"))))
    away = ("_credit", "_sign", "sizes")
    return pieces.drop(*away), heads.withColumn("paid_paise", amount).drop(*away)


def reference_evidence(
    credits: DataFrame, paid: DataFrame, keys: list[str],
    lookback: int = LOOKBACK_DAYS, forward: int = FORWARD_DAYS, crowded: int = CROWDED,
) -> Evidence:
    """Credit-payout pairs with some reference evidence, never all pairs of a day, reference or amount."""
    columns = _edge_columns(keys)
    seen = credits.select(
        *keys, "bank_txn_id", "occurred_at", "amount_paise", "narration",
        reference_key(F.col("narration")).alias("folded"),
    )
    same = F.col("amount_paise") == F.col("paid_paise")
    judged = _evidence(F.col("narration"), F.col("folded"), F.col("utr"), same)
    told = F.col("exact") | F.col("norm") | F.col("stub")

    nodes = cut(reference_nodes(paid, keys).withColumn("head", _head()), "nodes")
    busy = nodes.groupBy(*keys, "day").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded).drop("_n")
    # the few busy days are written down, and ordinary books have none of them
    busy = cut(busy, "busy-days")

    def met_by_day(some: DataFrame) -> DataFrame:
        # payouts go to the days of the credits that can see them: they are fewer bytes than narrations
        near = some.withColumn("occurred_at", _near(F.col("day"), forward, lookback))
        return seen.join(near, [*keys, "occurred_at"]).select("*", *judged).filter(told).select(*columns)

    if busy.isEmpty():
        return Evidence(met_by_day(nodes))

    sparse = nodes.join(busy, [*keys, "day"], "left_anti")
    dense = cut(nodes.join(busy, [*keys, "day"], "left_semi"), "busy-nodes")

    def crowd(rows: DataFrame, by: list[str]) -> DataFrame:
        # nearly all cells are small, which the hashes of their columns tell; only the others are counted by the columns themselves
        sign = F.xxhash64(*keys, *by)
        many = rows.groupBy(sign.alias("_sign")).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded).select("_sign")
        rows = rows.withColumn("_sign", sign).join(cut(many, "crowds"), "_sign", "left_semi")
        return rows.groupBy(*keys, *by).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded).drop("_n")

    by_amount, by_reference = ["head", "paid_paise", "day"], ["utr", "day"]
    amount_cells = cut(crowd(dense, by_amount), "amount-cells")
    same_amount = dense.join(amount_cells, [*keys, *by_amount], "left_semi")
    others = dense.join(amount_cells, [*keys, *by_amount], "left_anti")
    reference_cells = cut(crowd(others, by_reference), "reference-cells")
    same_reference = others.join(reference_cells, [*keys, *by_reference], "left_semi")
    single = others.join(reference_cells, [*keys, *by_reference], "left_anti")

    in_reach = F.col("day").between(
        F.date_sub(F.col("occurred_at"), lookback), F.date_add(F.col("occurred_at"), forward)
    )
    no, yes = F.lit(False), F.lit(True)
    pieces, heads = _meeting(seen.drop("folded"), dense, keys)
    exact, norm = F.contains("narration", F.col("utr")).alias("exact"), F.contains("folded", F.col("utr")).alias("norm")

    by_day = met_by_day(sparse)
    named = pieces.join(single, [*keys, "utr"]).filter(in_reach).select("*", *judged).select(*columns)
    # a reference that is there in full was met as a piece
    cut_off = heads.join(single, [*keys, "head", "paid_paise"]).filter(in_reach).select("*", *judged).filter(
        ~F.col("exact") & ~F.col("norm")).select(*columns)
    # a cell judges what its payouts share, so single edges into it carry only the rest
    named_there = pieces.join(same_amount, [*keys, "utr"]).filter(in_reach).select("*", exact, norm, no.alias("stub")).select(*columns)
    paid_there = heads.join(same_reference, [*keys, "head", "paid_paise"]).filter(in_reach).select(
        "*", no.alias("exact"), no.alias("norm"), yes.alias("stub")).select(*columns)
    edges = by_day.unionByName(named.unionByName(cut_off).unionByName(named_there).unionByName(paid_there).distinct())

    credit = [*keys, "bank_txn_id", "occurred_at"]
    naming_amount = heads.join(amount_cells, [*keys, "head", "paid_paise"]).filter(in_reach).select(
        *credit, *by_amount, F.col("head").alias("as_utr"), no.alias("exact"), no.alias("norm"), yes.alias("stub")).distinct()
    naming_reference = pieces.join(reference_cells, [*keys, "utr"]).filter(in_reach).select(
        *credit, *by_reference, F.col("utr").alias("as_utr"), exact, norm, no.alias("stub")).distinct()
    return Evidence(edges, [
        Cells(by_amount, naming_amount, same_amount), Cells(by_reference, naming_reference, same_reference)])


def _rules(hits: DataFrame) -> DataFrame:
    at_longest = F.col("longest_n")
    return (
        hits.withColumn(
            "rule",
            F.when((F.col("exact_n") > 0) & (at_longest == 1), "exact_utr")
            .when(F.col("norm_n") == 1, "normalised_utr")
            .when(F.col("stub_n") == 1, "truncated_prefix"),
        )
        .withColumn(
            "settlement_id",
            F.when(F.col("rule") == "exact_utr", F.col("exact_id"))
            .when(F.col("rule") == "normalised_utr", F.col("norm_id"))
            .when(F.col("rule") == "truncated_prefix", F.col("stub_id")),
        )
        .withColumn(
            "candidates",
            F.when(F.col("rule") == "exact_utr", F.col("exact_n")).when(F.col("rule").isNotNull(), F.lit(1)),
        )
    )


def _decide_all(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Tier rules over the live edges of each credit, with bounded aggregates only."""
    credit = [*keys, "bank_txn_id", "occurred_at"]
    n, exact, norm, stub = F.col("n"), F.col("exact"), F.col("norm"), F.col("stub")
    # first per reference length, so that the count at the longest needs no list
    per_size = edges.groupBy(*credit, F.length("utr").alias("size")).agg(
        F.coalesce(F.sum(F.when(exact, n)), F.lit(0)).alias("exact_n"),
        F.min(F.when(exact, F.col("settlement_id"))).alias("exact_id"),
        F.coalesce(F.sum(F.when(norm, n)), F.lit(0)).alias("norm_n"),
        F.min(F.when(norm, F.col("settlement_id"))).alias("norm_id"),
        F.coalesce(F.sum(F.when(stub, n)), F.lit(0)).alias("stub_n"),
        F.min(F.when(stub, F.col("settlement_id"))).alias("stub_id"),
    )
    hit_size = F.when(F.col("exact_n") > 0, F.col("size"))
    hits = per_size.groupBy(*credit).agg(
        F.sum("exact_n").alias("exact_n"),
        F.max_by("exact_n", hit_size).alias("longest_n"),
        F.max_by("exact_id", hit_size).alias("exact_id"),
        F.sum("norm_n").alias("norm_n"),
        F.min("norm_id").alias("norm_id"),
        F.sum("stub_n").alias("stub_n"),
        F.min("stub_id").alias("stub_id"),
    )
    return _rules(hits).select(*credit, "rule", "settlement_id", "candidates")


def _look_at_cells(live: DataFrame, cells: Cells, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A cell as edges of this round, and the credits that have to wait for a later one.

    While two payouts of a cell are sure to be left when a credit's turn comes, what they
    share cannot decide for that credit, whoever went first. Payouts leave a cell only
    through single edges, so counting the earlier such edges settles that for nearly all
    credits at once; the rest wait for the ones before them.
    """
    cell, credit = [*keys, *cells.by], [*keys, "bank_txn_id"]
    turn = F.struct("occurred_at", "bank_txn_id")
    left = cells.nodes.groupBy(*cell).agg(F.sum("n").alias("left"), F.min("settlement_id").alias("settlement_id"))
    named = cells.naming.join(left, cell)
    into = live.withColumn("head", _head()).join(left.select(*cell), cell, "left_semi")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    steps = named.select(*cell, "occurred_at", "bank_txn_id", zero.alias("step"), F.lit("").alias("which")).unionByName(
        into.select(*cell, "occurred_at", "bank_txn_id", one.alias("step"), F.col("settlement_id").alias("which")))
    order = [F.col(c) for c in ("occurred_at", "bank_txn_id", "step", "which")]
    ahead = cut(running_sum(steps, cell, order, "step", "ahead").filter("step = 0").drop("step", "which"), "ahead")
    named = named.join(ahead, [*cell, "occurred_at", "bank_txn_id"])
    unsure = named.filter(F.col("left") - F.col("ahead") < 2)
    # whoever is first in a cell sees it as it is
    first = steps.groupBy(*cell).agg(F.min(turn).alias("first_turn"))
    late = unsure.join(first, cell).filter(F.col("first_turn") < turn).select(*credit)
    as_edges = named.select(
        *keys, "bank_txn_id", "occurred_at", "settlement_id", F.col("as_utr").alias("utr"), "day",
        F.lit(None).cast("bigint").alias("paid_paise"), F.col("left").alias("n"), "exact", "norm", "stub")
    return as_edges, late


# Passes over the foreseen decisions before only the undisputed ones are taken.
PASSES = 6


def _named_payouts(naming: DataFrame, cells: Cells, keys: list[str]) -> DataFrame:
    """Every payout of a cell with the earliest turn at which one of the given credits names the cell."""
    cell = [*keys, *cells.by]
    first = naming.groupBy(*cell).agg(F.min(F.struct("occurred_at", "bank_txn_id")).alias("turn"))
    return cells.nodes.join(first, cell).select(*keys, "settlement_id", "turn")


def _foresee(edges: DataFrame, waiting: DataFrame | None, cells: list[Cells], keys: list[str]) -> DataFrame:
    """Decisions that hold whatever the undecided credits outside them do.

    Every credit is decided on what is free now. Such a decision stands if the payouts
    it rests on cannot be gone when its turn comes: none is foreseen for an earlier
    credit, and no earlier credit outside the foreseen ones has an edge to it or names
    its cell. Credits whose decision may fall are put outside, until nothing changes. Only the earliest
    turn at which a payout may go is kept, so no two credits are ever compared.
    """
    credit, payout = [*keys, "bank_txn_id"], [*keys, "settlement_id"]
    turn = F.struct("occurred_at", "bank_txn_id")
    edges = cut(edges, "round")
    foreseen = _decide_all(edges, keys)
    if waiting is not None:
        foreseen = foreseen.join(waiting.distinct(), credit, "left_anti")
    foreseen = cut(foreseen, "foreseen")
    inside, held = foreseen, foreseen.count()
    for _ in range(PASSES):
        takes = inside.filter("settlement_id IS NOT NULL").select(*payout, turn.alias("turn"))
        outside = edges.filter("n = 1").join(inside.select(*credit), credit, "left_anti").select(*payout, turn.alias("turn"))
        for group in cells:
            strangers = group.naming.join(inside.select(*credit), credit, "left_anti")
            outside = outside.unionByName(_named_payouts(strangers, group, keys))
        gone = takes.unionByName(outside).groupBy(*payout).agg(F.min("turn").alias("gone_at"))
        # a payout with an equal twin never goes
        stays = F.col("gone_at").isNull() | (F.col("gone_at") >= turn) | (F.col("n") > 1)
        pick = foreseen.select(*credit, "rule", F.col("settlement_id").alias("picked"))
        judged = edges.join(gone, payout, "left").withColumn("stays", stays).join(pick, credit)
        safe = F.when(F.col("stays"), F.col("n")).otherwise(0)
        size = F.length("utr")
        sized = judged.groupBy(*credit, "occurred_at", "rule", size.alias("size")).agg(
            F.max(F.col("exact").cast("int")).alias("exact"),
            F.sum(F.when(F.col("exact"), safe).otherwise(0)).alias("exact_safe"),
            F.max(F.col("norm").cast("int")).alias("norm"),
            F.sum(F.when(F.col("norm"), safe).otherwise(0)).alias("norm_safe"),
            F.max(F.col("stub").cast("int")).alias("stub"),
            F.sum(F.when(F.col("stub"), safe).otherwise(0)).alias("stub_safe"),
            F.max((F.col("stays") & (F.col("n") == 1) & F.coalesce(F.col("settlement_id") == F.col("picked"), F.lit(False))).cast("int")).alias("pick_safe"),
        )
        tiers = sized.groupBy(*credit, "occurred_at", "rule").agg(
            F.max("exact").alias("exact"), F.max_by("exact_safe", F.when(F.col("exact") == 1, F.col("size"))).alias("exact_safe"),
            F.max("norm").alias("norm"), F.sum("norm_safe").alias("norm_safe"),
            F.max("stub").alias("stub"), F.sum("stub_safe").alias("stub_safe"), F.max("pick_safe").alias("pick_safe"),
        )
        exact_tied = (F.col("exact") == 0) | (F.col("exact_safe") >= 2)
        norm_tied = (F.col("norm") == 0) | (F.col("norm_safe") >= 2)
        stub_tied = (F.col("stub") == 0) | (F.col("stub_safe") >= 2)
        picked = F.col("pick_safe") == 1
        stands = (
            F.when(F.col("rule") == "exact_utr", picked)
            .when(F.col("rule") == "normalised_utr", picked & exact_tied)
            .when(F.col("rule") == "truncated_prefix", picked & exact_tied & norm_tied)
            .otherwise(exact_tied & norm_tied & stub_tied)
        )
        kept = cut(inside.join(tiers.filter(stands).select(*credit), credit, "left_semi"), "foreseen")
        now = kept.count()
        if now == held:
            return kept
        inside, held = kept, now
    # not settled yet: the credits nobody earlier competes with are always decided
    free = edges.filter("n = 1")
    first = free.select(*payout, turn.alias("turn"))
    for group in cells:
        first = first.unionByName(_named_payouts(group.naming, group, keys))
    first = first.groupBy(*payout).agg(F.min("turn").alias("first_turn"))
    contested = free.join(first, payout).filter(F.col("first_turn") < turn).select(*credit).distinct()
    return foreseen.join(contested, credit, "left_anti")


def _count_hits(made: DataFrame, edges: DataFrame, cells: list[Cells], keys: list[str], threshold: float) -> DataFrame:
    """For credits with several payouts named in full: how many were still free at their turn."""
    credit, payout = [*keys, "bank_txn_id"], [*keys, "settlement_id"]
    turn = F.struct("occurred_at", "bank_txn_id")
    several = cut(made.filter("rule = 'exact_utr' AND candidates > 1").select(*credit, "occurred_at"), "several")
    if several.isEmpty():
        return made
    taken = _accepted(made, threshold).select(*payout, turn.alias("gone_at"))
    hits = (
        edges.filter("exact").join(several.select(*credit), credit, "left_semi").join(taken, payout, "left")
        .filter(F.col("gone_at").isNull() | (F.col("gone_at") >= turn)).select(*credit, "n")
    )
    for group in cells:
        cell = [*keys, *group.by]
        total = group.nodes.groupBy(*cell).agg(F.sum("n").alias("all"))
        gone = group.nodes.select(*cell, "settlement_id").join(taken, payout)
        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        asks = group.naming.filter("exact").join(several.select(*credit), credit, "left_semi")
        steps = asks.select(*cell, "occurred_at", "bank_txn_id", zero.alias("step")).unionByName(
            gone.select(*cell, "gone_at.occurred_at", "gone_at.bank_txn_id", one.alias("step")))
        order = [F.col(c) for c in ("occurred_at", "bank_txn_id", "step")]
        seen = running_sum(steps, cell, order, "step", "ahead").filter("step = 0").join(total, cell)
        hits = hits.unionByName(seen.select(*credit, (F.col("all") - F.col("ahead")).alias("n")))
    counted = hits.groupBy(*credit).agg(F.sum("n").alias("_hits"))
    return made.join(counted, credit, "left").withColumn("candidates", F.coalesce("_hits", "candidates")).drop("_hits")


def _contested(edges: DataFrame, cells: list[Cells], keys: list[str]) -> DataFrame:
    """Credits that point to a payout which another credit, or a cell, points to as well.

    All others can be decided at once: nobody else can have taken what they point to when their turn comes.
    """
    credit, payout = [*keys, "bank_txn_id"], [*keys, "settlement_id"]
    shared = edges.filter("n = 1").groupBy(*payout).agg(
        F.min("bank_txn_id").alias("_lo"), F.max("bank_txn_id").alias("_hi")).filter("_lo <> _hi").select(*payout)
    for group in cells:
        shared = shared.unionByName(group.nodes.select(*payout))
    out = edges.join(shared, payout, "left_semi").select(*credit)
    for group in cells:
        out = out.unionByName(group.naming.select(*credit))
    return out.distinct()


def claim_by_reference(evidence: Evidence, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Decide every credit that has reference evidence, earlier credits first.

    Returns (keys, bank_txn_id, occurred_at, rule, settlement_id, candidates); ``rule`` is
    NULL where the references did not settle it.
    """
    credit, payout = [*keys, "bank_txn_id"], [*keys, "settlement_id"]
    edges = cut(evidence.edges, "edges")
    cells = [Cells(c.by, cut(c.naming, "naming"), cut(c.nodes, "cell-nodes")) for c in evidence.cells]
    contested = cut(_contested(edges, cells, keys), "contested")
    decided = _decide_all(edges.join(contested, credit, "left_anti"), keys)
    if contested.isEmpty():
        return decided
    live = cut(edges.join(contested, credit, "left_semi"), "edges")
    start, start_cells = live, [Cells(c.by, c.naming, c.nodes) for c in cells]
    settled: DataFrame | None = None
    while True:
        edges, waiting = live, None
        for group in cells:
            more, later = _look_at_cells(live, group, keys)
            edges = edges.unionByName(more)
            waiting = later if waiting is None else waiting.unionByName(later)
        # decisions are final: written once, then used several times
        made = cut(_foresee(edges, waiting, cells, keys), "claims")
        settled = made if settled is None else settled.unionByName(made)
        accepted = _accepted(made, threshold).select(*payout)
        live = cut(live.join(made.select(*credit), credit, "left_anti").join(accepted, payout, "left_anti"), "edges")
        done = live.isEmpty()
        for group in cells:
            group.nodes = cut(group.nodes.join(accepted, payout, "left_anti"), "cell-nodes")
            there = group.nodes.select(*keys, *group.by).distinct()
            left = group.naming.join(made.select(*credit), credit, "left_anti").join(there, [*keys, *group.by], "left_semi")
            group.naming = cut(left, "naming")
            done = done and group.naming.isEmpty()
        if done:
            return decided.unionByName(_count_hits(settled, start, start_cells, keys, threshold))


def _confidence(rule: Column) -> Column:
    out = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        out = F.when(rule == name, F.lit(value)).otherwise(out)
    return out


def _accepted(made: DataFrame, threshold: float) -> DataFrame:
    return made.filter(F.col("rule").isNotNull() & (_confidence(F.col("rule")) >= threshold))


def _match_by_amount(
    open_credits: DataFrame, free: DataFrame, keys: list[str], lookback: int, forward: int
) -> DataFrame:
    """Amount and date alone, per (key, amount, credit day): all credits of one cell share a fate."""
    cells = open_credits.groupBy(*keys, "amount_paise", F.col("occurred_at").alias("credit_day")).agg(
        F.count("*").alias("credits")
    )
    paid = free.groupBy(*keys, "amount_paise", F.col("occurred_at").alias("day")).agg(
        F.count("*").alias("paid_n"), F.min("settlement_id").alias("settlement_id")
    )
    reach = cells.withColumn("day", _near(F.col("credit_day"), lookback, forward)).join(
        paid, [*keys, "amount_paise", "day"]
    )
    exact = reach.groupBy(*keys, "amount_paise", "credit_day").agg(
        F.sum("paid_n").alias("exact_n"), F.min("settlement_id").alias("exact_id")
    )
    # credit days that can see the same payout day: at most eight per payout day
    rivals = (
        reach.select(*keys, "amount_paise", "day", "credit_day")
        .join(
            reach.select(*keys, "amount_paise", "day", F.col("credit_day").alias("other_day"),
                         F.col("credits").alias("other_n")),
            [*keys, "amount_paise", "day"],
        )
        .select(*keys, "amount_paise", "credit_day", "other_day", "other_n")
        .distinct()
        .groupBy(*keys, "amount_paise", "credit_day")
        .agg(F.sum("other_n").alias("sharing"))
    )
    return exact.join(rivals, [*keys, "amount_paise", "credit_day"])


def link_credits(
    credits: DataFrame, paid: DataFrame, keys: list[str] | None = None, *,
    threshold: float = THRESHOLD, lookback: int = LOOKBACK_DAYS, forward: int = FORWARD_DAYS,
    crowded: int = CROWDED, greedy: bool = False,
) -> DataFrame:
    """One row per credit: the payout it is, by which rule and how sure, or why it stays open. Written once."""
    keys = keys or ["merchant_id"]
    with passage(credits.sparkSession, "links"):
        return kept(_linked(credits, paid, keys, threshold, lookback, forward, crowded, greedy), "linked")


def _linked(
    credits: DataFrame, paid: DataFrame, keys: list[str], threshold: float, lookback: int, forward: int, crowded: int, greedy: bool,
) -> DataFrame:
    credits = cut(credits, "credits")
    paid = cut(paid, "paid")
    # read several times below
    made = cut(claim_by_reference(
        reference_evidence(credits, paid, keys, lookback, forward, crowded), keys, threshold), "made")
    by_reference = made.filter(F.col("rule").isNotNull())
    accepted = _accepted(made, threshold)

    open_credits = cut(credits.join(by_reference.select(*keys, "bank_txn_id"), [*keys, "bank_txn_id"], "left_anti"), "open")
    free = paid.join(accepted.select(*keys, "settlement_id"), [*keys, "settlement_id"], "left_anti")

    # Was there anything left in reach when the credit's turn came? Per payout day keep
    # the latest turn at which one of its payouts was still free.
    never = F.struct(F.lit("9999-12-31").cast("date").alias("occurred_at"), F.lit("").alias("bank_txn_id"))
    turns = accepted.select(
        *keys, "settlement_id", F.struct("occurred_at", "bank_txn_id").alias("claimed_at")
    )
    per_day = (
        paid.join(turns, [*keys, "settlement_id"], "left")
        .groupBy(*keys, F.col("occurred_at").alias("day"))
        .agg(
            F.max(F.coalesce("claimed_at", never)).alias("free_until"),
            F.sum(F.col("claimed_at").isNull().cast("bigint")).alias("free_n"),
        )
    )
    reach = (
        open_credits.select(*keys, "occurred_at").distinct()
        .withColumn("day", _near(F.col("occurred_at"), lookback, forward))
        .join(per_day, [*keys, "day"], "left")
        .groupBy(*keys, "occurred_at")
        .agg(F.max("free_until").alias("free_until"), F.coalesce(F.sum("free_n"), F.lit(0)).alias("free_n"))
    )
    if greedy:
        amounts = _first_come(open_credits, free, keys, lookback, forward)
        joined = open_credits.join(amounts, [*keys, "bank_txn_id"], "left")
        unique = F.col("exact_id").isNotNull()
        shared = F.lit(False)
    else:
        amounts = _match_by_amount(open_credits, free, keys, lookback, forward)
        joined = open_credits.withColumn("credit_day", F.col("occurred_at")).join(
            amounts, [*keys, "amount_paise", "credit_day"], "left"
        )
        unique = (F.col("exact_n") == 1) & (F.col("sharing") == 1)
        shared = F.col("exact_n").isNotNull()
    joined = joined.join(reach, [*keys, "occurred_at"], "left")
    turn = F.struct("occurred_at", "bank_txn_id")
    empty = F.col("free_until").isNull() | (F.col("free_until") < turn)
    by_amount = joined.select(
        *keys, "bank_txn_id",
        F.when(unique, F.col("exact_id")).alias("settlement_id"),
        F.when(unique, "amount_date_unique").when(shared, "abstain_ambiguous").otherwise("abstain_no_candidate").alias("rule"),
        F.when(F.coalesce("exact_n", F.lit(0)) > 0, F.col("exact_n")).when(empty, F.lit(0)).otherwise(F.col("free_n"))
        .cast("bigint").alias("candidates"),
        F.when(unique, F.lit("amount is unique in the date window" if not greedy else "first payout of this amount in the window"))
        .when(shared, F.concat(F.col("exact_n").cast("string"), F.lit(" payout(s) and "), F.col("sharing").cast("string"),
                               F.lit(" credit(s) share this amount and window")))
        .when(empty, F.lit("no payout in the date window"))
        .otherwise(F.lit("no payout matches on reference or amount")).alias("reason"),
    )
    told = {
        "exact_utr": "reference found in narration",
        "normalised_utr": "reference found after folding punctuation",
        "truncated_prefix": "start of the reference and the exact amount",
    }
    why = F.lit("")
    for name, text in told.items():
        why = F.when(F.col("rule") == name, F.lit(text)).otherwise(why)
    by_text = by_reference.select(
        *keys, "bank_txn_id", "settlement_id", "rule", F.col("candidates").cast("bigint").alias("candidates"),
        why.alias("reason"),
    )
    every = by_text.unionByName(by_amount).withColumn("confidence", _confidence(F.col("rule")))
    weak = (F.col("confidence") < threshold) & F.col("settlement_id").isNotNull()
    return every.select(
        *keys, "bank_txn_id",
        F.when(~weak, F.col("settlement_id")).alias("settlement_id"),
        "rule", "confidence", "candidates",
        F.when(weak, F.concat("reason", F.lit(f" (below threshold {threshold})"))).otherwise(F.col("reason")).alias("reason"),
    )


def _first_come(open_credits: DataFrame, free: DataFrame, keys: list[str], lookback: int, forward: int) -> DataFrame:
    """The variant that guesses: each credit in turn takes the first payout of its amount.

    Only days and their counts go to the sequential step, which hands out ranges of
    ranks; credits and payouts then meet on their rank within the day.
    """
    import pandas as pd

    cell = [*keys, "amount_paise", "day"]
    ranked_credits = rank_in_group(
        open_credits.select(*keys, "amount_paise", F.col("occurred_at").alias("day"), "bank_txn_id"),
        cell, [F.col("bank_txn_id")], "turn",
    )
    ranked_paid = rank_in_group(
        free.select(*keys, "amount_paise", F.col("occurred_at").alias("day"), "settlement_id"),
        cell, [F.col("settlement_id")], "turn",
    )
    days = (
        ranked_credits.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("side", F.lit("credit"))
        .unionByName(ranked_paid.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("side", F.lit("paid")))
    )
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in open_credits.select(*keys, "amount_paise").schema]
        + ["credit_day date", "credit_from bigint", "paid_day date", "paid_from bigint", "n bigint"]
    )
    group = [*keys, "amount_paise"]

    def hand_out(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = [[d, 1, int(n)] for d, n in pdf[pdf.side == "paid"].sort_values("day")[["day", "n"]].values]
        out, at = [], 0
        for day, count in pdf[pdf.side == "credit"].sort_values("day")[["day", "n"]].values:
            start, left = 1, int(count)
            while left and at < len(waiting):
                paid_day, paid_from, size = waiting[at]
                age = (day - paid_day).days
                if age > lookback or not size:
                    at += 1
                    continue
                if age < -forward:
                    break
                took = min(left, size)
                out.append((*name, day, start, paid_day, paid_from, took))
                waiting[at][1] += took
                waiting[at][2] -= took
                start += took
                left -= took
        return pd.DataFrame(out, columns=[*group, "credit_day", "credit_from", "paid_day", "paid_from", "n"])

    ranges = days.groupBy(*group).applyInPandas(hand_out, schema)
    slots = ranges.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select(
        *group, "credit_day", (F.col("credit_from") + F.col("i")).alias("credit_turn"),
        "paid_day", (F.col("paid_from") + F.col("i")).alias("paid_turn"),
    )
    left = ranked_credits.select(*group, F.col("day").alias("credit_day"), F.col("turn").alias("credit_turn"), "bank_txn_id")
    right = ranked_paid.select(
        *group, F.col("day").alias("paid_day"), F.col("turn").alias("paid_turn"), F.col("settlement_id").alias("exact_id")
    )
    return (
        slots.join(left, [*group, "credit_day", "credit_turn"])
        .join(right, [*group, "paid_day", "paid_turn"])
        .select(*keys, "bank_txn_id", "exact_id", F.lit(1).cast("bigint").alias("exact_n"), F.lit(1).cast("bigint").alias("sharing"))
    )


def payouts_without_reference(credits: DataFrame, paid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The naive reading: payouts whose reference stands in no narration at all, whenever.

    Containment is found by hashing the pieces of each narration that have the length
    of one of the key's references.
    """
    keys = keys or ["merchant_id"]
    sizes = paid.select(*keys, F.length("utr").alias("size")).distinct()
    texts = credits.select(*keys, "narration").distinct()
    printed = texts.join(sizes, keys).select(
        *keys, F.explode(F.array_distinct(_pieces(F.col("narration"), F.col("size")))).alias("utr")
    )
    return paid.join(printed, [*keys, "utr"], "left_anti")


def payouts_not_linked(paid: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["merchant_id"]
    linked = links.filter("settlement_id IS NOT NULL").select(*keys, "settlement_id")
    return paid.join(linked, [*keys, "settlement_id"], "left_anti")


def no_unplaced_credit(
    paid: DataFrame, credits: DataFrame, links: DataFrame, keys: list[str] | None = None, days: int = UNPLACED_DAYS
) -> DataFrame:
    """Payouts that no unplaced credit of equal amount within ``days`` days could be."""
    keys = keys or ["merchant_id"]
    unplaced = credits.join(links.filter("settlement_id IS NULL").select(*keys, "bank_txn_id"), [*keys, "bank_txn_id"], "left_semi")
    possible = (
        unplaced.select(*keys, "amount_paise", F.col("occurred_at").alias("day"))
        .distinct()
        .select(*keys, "amount_paise", _near(F.col("day"), days, days).alias("occurred_at"))
    )
    return paid.join(possible, [*keys, "amount_paise", "occurred_at"], "left_anti")


def unattributed_credits(credits: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["merchant_id"]
    return credits.join(links.filter("settlement_id IS NULL").select(*keys, "bank_txn_id", "rule", "reason"), [*keys, "bank_txn_id"])
