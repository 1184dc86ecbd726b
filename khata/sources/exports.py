"""Result tables as files, for whatever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from khata.operators.movements import balances
from khata.plans import close, insights
from khata.plans.books import Books


def result_tables(books: Books) -> dict[str, DataFrame]:
    """Weekly series, summaries, findings, account proof, exceptions and balances."""
    found = close.findings(books)
    return {
        "weeks": insights.weeks(books),
        "summary": close.close_summary(books),
        "findings": found,
        "actions": insights.actions(found, books.windows),
        "coverage": close.coverage(books),
        "exceptions": close.exceptions(books),
        "balances": balances(books.daily),
    }


def write_results(books: Books, path: str, form: str = "parquet") -> None:
    for name, table in result_tables(books).items():
        table.write.mode("overwrite").format(form).save(f"{path}/{name}")


def write_packs(heads: DataFrame, lines: DataFrame, path: str) -> None:
    """Sealed closes as JSON lines, one folder for the heads and one for their lines."""
    heads.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/heads")
    lines.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/lines")
