"""Do the figures in a text trace back to verified amounts?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions.money import money_text
from khata.functions.text import quoted_figures
from khata.operators.movements import WINDOW
from khata.operators.ranking import carry_both_ways
from khata.plans import causes
from khata.plans.books import Books
from khata.plans.close import close_summary, exceptions, findings


def citations(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Every figure a text quotes, with its place in the text. Whole texts are read."""
    return texts.select(*keys, F.posexplode(quoted_figures(F.col("text"))).alias("place", "f")).select(
        *keys, "place", "f.quote", "f.paise"
    )


def check(texts: DataFrame, permitted: DataFrame, keys: list[str], tolerance_paise: int = 0) -> DataFrame:
    """Each quoted figure: whether it equals a permitted amount (sign aside), and if not the nearest one.

    Exact hits are one equi-join. Nearest amounts come from one pass over the sorted figures that
    carries the permitted amounts both ways, so a text never meets all its amounts in pairs.
    """
    cited = citations(texts, keys).withColumn("size", F.abs("paise"))
    allowed = permitted.select(*keys, F.abs("amount_paise").alias("size")).distinct()
    exact = cited.join(allowed.withColumn("_hit", F.lit(True)), [*keys, "size"], "left")
    done = exact.filter("_hit").drop("_hit").withColumn("grounded", F.lit(True)).withColumn("nearest_paise", F.lit(None).cast("bigint"))
    rest = exact.filter("_hit IS NULL").drop("_hit")
    # permitted amounts sort before figures of the same size
    both = rest.withColumn("allowed", F.lit(None).cast("bigint")).unionByName(
        allowed.join(rest.select(*keys).distinct(), keys, "left_semi").withColumn("allowed", F.col("size")),
        allowMissingColumns=True,
    )
    tie = F.coalesce("place", F.lit(-1))
    near = carry_both_ways(both, keys, [F.col("size"), tie], "allowed", "below", "above")
    below, above, size = F.col("below"), F.col("above"), F.col("size")
    nearer = F.when(above.isNull() | ((size - below) <= (above - size)), below).otherwise(above)
    judged = near.filter("place IS NOT NULL").withColumn("_nearest", F.coalesce(nearer, below, above))
    grounded = F.coalesce(F.abs(F.col("_nearest") - size) <= tolerance_paise, F.lit(False))
    open_ = judged.withColumn("grounded", grounded).withColumn(
        "nearest_paise", F.when(~grounded, F.col("_nearest"))
    )
    columns = [*keys, "place", "quote", "paise", "grounded", "nearest_paise"]
    return done.select(*columns).unionByName(open_.select(*columns))


def grounding_rate(checked: DataFrame, keys: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Figures, grounded ones and their share per text; of ``texts``, those without any figure have nothing unfounded: 1."""
    rates = checked.groupBy(*keys).agg(
        F.count("*").alias("figures"), F.count_if("grounded").alias("grounded"),
        F.round(F.avg(F.col("grounded").cast("double")), 6).alias("rate"),
    )
    if texts is None:
        return rates
    every = texts.select(*keys).distinct().join(rates, keys, "left")
    return every.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("figures", "grounded")], F.coalesce("rate", F.lit(1.0)).alias("rate"))


def permitted_figures(books: Books) -> DataFrame:
    """Amounts a text about a window may quote: findings raw and refined, exceptions and their sum, headline figures."""
    amounts = causes.refined(books.measured)
    stands = amounts.filter(causes.supported(amounts))
    out = stands.select(*WINDOW, F.explode(F.array("raw_paise", "amount_paise")).alias("amount_paise"))
    out = out.unionByName(exceptions(books).select(*WINDOW, "amount_paise"))
    headline = close_summary(books).select(*WINDOW, F.explode(F.array(
        "gross_paise", "landed_paise", "gap_paise", "explained_paise", "remainder_paise", "unresolved_paise")).alias("amount_paise"))
    return out.unionByName(headline).distinct()


def lost_identifiers(texts: DataFrame, identifiers: DataFrame, keys: list[str]) -> DataFrame:
    """Identifiers the source cited that the rewritten text dropped.

    ``texts`` has ``source`` and ``text``; only identifiers longer than six characters count.
    """
    named = identifiers.filter(F.length("identifier") > 6).join(texts, keys)
    return named.filter(
        F.contains("source", F.col("identifier")) & ~F.contains("text", F.col("identifier"))
    ).select(*keys, "identifier")


def without_identifiers(texts: DataFrame, identifiers: DataFrame, keys: list[str]) -> DataFrame:
    """Texts with their known identifiers taken out, longest first, so that digits inside them are not figures."""
    # only what stands in a text is gathered for it, so a list is never longer than its text
    standing = identifiers.join(texts, keys).filter(F.contains("text", F.col("identifier")))
    known = standing.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct((-F.length("identifier")).alias("order"), "identifier"))).alias("_ids"))
    scrub = F.aggregate(
        F.coalesce("_ids", F.array().cast("array<struct<order:int,identifier:string>>")), F.col("text"),
        lambda text, one: F.replace(text, one["identifier"], F.lit("")))
    return texts.join(known, keys, "left").withColumn("text", scrub).drop("_ids")


def memos(books: Books) -> DataFrame:
    """A short text per window written from its close."""
    top = findings(books).filter("position = 1").select(*WINDOW, "title", F.col("amount_paise").alias("_top"))
    body = close_summary(books).join(top, WINDOW, "left")
    said = F.concat(
        F.lit("Sold "), money_text(F.col("gross_paise")), F.lit(", in the bank "), money_text(F.col("landed_paise")),
        F.lit("; still out "), money_text(F.col("gap_paise")), F.lit("."),
        F.coalesce(F.concat(F.lit(" First cause: "), F.col("title"), F.lit(", "), money_text(F.col("_top")), F.lit(".")), F.lit("")),
    )
    return body.select(*WINDOW, said.alias("text"))
