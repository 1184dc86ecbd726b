"""A ledger with everything a close reads, each shared table built once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from khata.lineage import cut
from khata.operators import fees, linkage, movements
from khata.operators.as_known import History
from khata.operators.postings import daily_sums, project


@dataclass
class Books:
    """Events of any number of merchants, their calendar and contracts, and the windows to close."""

    events: DataFrame
    calendar: DataFrame
    contracts: DataFrame
    windows: DataFrame

    @cached_property
    def postings(self) -> DataFrame:
        return project(self.events)

    @cached_property
    def daily(self) -> DataFrame:
        """Written once: most causes, balances and checks read these few rows per day."""
        return cut(daily_sums(self.events), "daily")

    @cached_property
    def moves(self) -> DataFrame:
        """Sums per window, account and event type: at most a few dozen rows per window."""
        return cut(movements.window_movements(self.daily, self.windows), "moves")

    @cached_property
    def measured(self) -> DataFrame:
        """Raw amount of every cause per window; findings, proof, packs and searches all read it."""
        from khata.plans.causes import measure

        return cut(measure(self), "measured")

    @cached_property
    def priced(self) -> DataFrame:
        return fees.price_captures(fees.captures(self.events), self.contracts)

    @cached_property
    def daily_fees(self) -> DataFrame:
        return cut(fees.daily_fees(self.priced), "daily-fees")

    @cached_property
    def credits(self) -> DataFrame:
        """Written once, like payouts: linkage and its history read them many times."""
        return cut(linkage.bank_credits(self.events), "bank-credits")

    @cached_property
    def payouts(self) -> DataFrame:
        return cut(linkage.payouts(self.events), "payouts")

    @cached_property
    def links(self) -> DataFrame:
        return cut(linkage.link_credits(self.credits, self.payouts), "links")

    @cached_property
    def history(self) -> History:
        """What links were before all was known."""
        return History(self.credits, self.payouts, self.links)

    def over(self, windows: DataFrame) -> Books:
        """The same books closed over other windows; tables that do not depend on them are shared."""
        other = Books(self.events, self.calendar, self.contracts, windows)
        for name in ("daily", "daily_fees", "credits", "payouts", "links", "history"):
            if name in self.__dict__:
                other.__dict__[name] = self.__dict__[name]
        return other
