"""Finding the slice of the books that explains an open remainder, and judging claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.operators.movements import WINDOW, movement_slices, variance
from khata.plans import causes
from khata.plans.books import Books
from khata.plans.close import coverage

PARENTS = tuple(c.refines for c in causes.CAUSES if c.refines)
CASE = [*WINDOW, "cause"]


def slices(books: Books) -> DataFrame:
    """Everything a search may propose: accounts, accounts by event type, and three readings of the fees."""
    part = movement_slices(books.moves)
    key = F.when(F.col("event_type").isNull(), F.col("account")).otherwise(F.concat_ws("|", "account", "event_type"))
    out = part.select(*WINDOW, key.alias("slice"), "account", "amount_paise")
    fees = (
        causes.window_fees(books)
        .join(books.contracts.select("merchant_id").distinct(), "merchant_id", "left_semi")
        .groupBy(*WINDOW)
        .agg(F.sum("contract_paise").alias("contract"), F.sum("fee_paise").alias("billed"))
    )
    named = F.array(
        F.struct(F.lit("fee_at_contracted_rate").alias("slice"), F.col("contract").alias("amount_paise")),
        F.struct(F.lit("fee_as_billed").alias("slice"), F.col("billed").alias("amount_paise")),
        F.struct(F.lit("fee_billed_above_contract").alias("slice"), (F.col("billed") - F.col("contract")).alias("amount_paise")),
    )
    fee_rows = fees.select(*WINDOW, F.explode(named).alias("s")).select(
        *WINDOW, "s.slice", F.lit("fee_expense").alias("account"), "s.amount_paise")
    return out.unionByName(fee_rows)


def propose(open_cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each open remainder the slice that equals it, if all that do are on one account; the finer one wins.

    ``open_cases`` has the case keys and remainder_paise. A window has a few dozen slices.
    """
    keys = [c for c in open_cases.columns if c != "remainder_paise"]
    hits = open_cases.filter("remainder_paise <> 0").join(
        candidates.withColumnRenamed("amount_paise", "remainder_paise"), [*WINDOW, "remainder_paise"])
    whole = (~F.contains("slice", F.lit("|"))).cast("int")
    return (
        hits.groupBy(*keys, "remainder_paise")
        .agg(
            F.min(F.struct(whole.alias("whole"), F.length("slice").alias("size"), "slice")).alias("best"),
            F.countDistinct("account").alias("accounts"),
            F.min("account").alias("account"),
            F.count("*").alias("matching"),
        )
        .filter("accounts = 1")
        .select(*keys, "remainder_paise", F.col("best.slice").alias("slice"), "account",
                F.col("remainder_paise").alias("claim_paise"), "matching")
    )


def hold_out(books: Books) -> DataFrame:
    """Every finding of every window taken away once: what is left open then."""
    amounts = causes.refined(books.measured)
    found = amounts.filter(causes.supported(amounts)).filter("amount_paise <> 0")
    explained = found.groupBy(*WINDOW).agg(F.sum("amount_paise").alias("explained"))
    base = variance(books.moves, books.windows).select(*WINDOW, "gap_paise").join(explained, WINDOW, "left")
    base = base.select(*WINDOW, (F.col("gap_paise") - F.coalesce("explained", F.lit(0))).alias("left_open"))
    # without its child a parent is whole again, if it was supported at all
    parent = amounts.select(*WINDOW, F.col("cause").alias("parent"), (F.col("raw_paise") != 0).alias("stands"))
    cases = (
        found.withColumn("parent", causes.lookup(F.col("cause"), "refines"))
        .join(parent, [*WINDOW, "parent"], "left")
        .join(base, WINDOW)
    )
    given_back = F.when(F.coalesce("stands", F.lit(False)), F.col("raw_paise")).otherwise(0)
    return cases.select(
        *CASE, "amount_paise", (F.col("left_open") + F.col("amount_paise") - given_back).alias("remainder_paise"),
        F.col("cause").isin(*PARENTS).alias("refined_by_other"),
    )


def adjudicate(books: Books, claims: DataFrame) -> DataFrame:
    """A claim stands when it equals the remainder and every account then balances.

    ``claims`` has the case keys, the held-out ``amount_paise``, remainder_paise, account and claim_paise.
    """
    proof = coverage(books).select(*WINDOW, F.col("account").alias("of"), "claimed_paise", "actual_paise")
    home = causes.lookup(F.col("cause"), "account")
    judged = claims.join(proof, WINDOW).withColumn(
        "_claimed",
        F.col("claimed_paise") - F.when(home == F.col("of"), F.col("amount_paise")).otherwise(0)
        + F.when(F.col("account") == F.col("of"), F.col("claim_paise")).otherwise(0),
    )
    return (
        judged.groupBy(*CASE, "amount_paise", "remainder_paise", "slice", "account", "claim_paise")
        .agg(F.count_if(F.col("_claimed") != F.col("actual_paise")).alias("accounts_open"))
        .withColumn("accepted", (F.col("claim_paise") == F.col("remainder_paise")) & (F.col("accounts_open") == 0))
    )


def rediscover(books: Books) -> DataFrame:
    """The hold-out sweep: each removable finding, the slice proposed for it, and the verdict."""
    cases = hold_out(books).filter("remainder_paise <> 0 AND NOT refined_by_other").drop("refined_by_other")
    proposals = propose(cases, slices(books))
    verdict = adjudicate(books, proposals).select(*CASE, "slice", "account", "accepted")
    return cases.join(verdict, CASE, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def largest_account(books: Books) -> DataFrame:
    """The baseline that always blames the account that moved most."""
    sums = books.moves.filter("account <> 'bank'").groupBy(*WINDOW, "account").agg(F.sum("amount_paise").alias("claim_paise"))
    biggest = Window.partitionBy(*WINDOW).orderBy(F.abs("claim_paise").desc(), "account")
    return sums.withColumn("_at", F.row_number().over(biggest)).filter("_at = 1").drop("_at")


def blame_largest(books: Books) -> DataFrame:
    cases = hold_out(books).filter("remainder_paise <> 0 AND NOT refined_by_other").drop("refined_by_other")
    claims = cases.join(largest_account(books), WINDOW).withColumn("slice", F.lit("largest_account"))
    return adjudicate(books, claims)


def second_opinion(books: Books) -> DataFrame:
    """The finding of each window most worth checking, alarming ones first, and what the search says of it."""
    swept = rediscover(books).withColumn("alarming", causes.lookup(F.col("cause"), "alarming"))
    first = Window.partitionBy(*WINDOW).orderBy(F.col("alarming").desc(), F.abs("amount_paise").desc(), "cause")
    return swept.withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at")


def short_accounts(proof: DataFrame) -> DataFrame:
    """Accounts whose claims fall short of what moved."""
    return proof.filter("NOT ok").withColumn("short_paise", F.col("actual_paise") - F.col("claimed_paise"))
