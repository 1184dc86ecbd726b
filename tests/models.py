"""Small sequential models that the distributed operators are compared with."""

from __future__ import annotations

import datetime
import math

DAY = datetime.timedelta(days=1)
SURE = {"exact_utr": 1.0, "normalised_utr": 0.97, "truncated_prefix": 0.9, "amount_date_unique": 0.8}


def fold_text(text):
    return "".join(c for c in text.upper() if c.isalnum())


def link(credits, payouts, threshold=0.75, greedy=False):
    """credits: (id, amount, day, narration); payouts: (id, utr, amount, day) -> {id: (payout, rule)}."""
    credits = sorted(credits, key=lambda c: (c[2], c[0]))
    free = {p[0]: p for p in payouts}
    out, later = {}, []

    def reach(day, pool):
        return sorted((p for p in pool.values() if day - 6 * DAY <= p[3] <= day + DAY), key=lambda p: (p[3], p[0]))

    for ident, amount, day, said in credits:
        near = reach(day, free)
        if not near:
            out[ident] = (None, "abstain_no_candidate", 0)
            continue
        folded = fold_text(said)
        usable = [p for p in near if p[1].strip()]
        exact = sorted((p for p in usable if p[1] in said), key=lambda p: -len(p[1]))
        norm = [p for p in usable if p[1] in folded]
        stub = [p for p in usable if p[2] == amount and p[1][:8] in folded]
        if exact and (len(exact) == 1 or len(exact[0][1]) > len(exact[1][1])):
            pick, rule, n = exact[0], "exact_utr", len(exact)
        elif len(norm) == 1:
            pick, rule, n = norm[0], "normalised_utr", 1
        elif len(stub) == 1:
            pick, rule, n = stub[0], "truncated_prefix", 1
        else:
            later.append((ident, amount, day))
            continue
        if SURE[rule] >= threshold:
            out[ident] = (pick[0], rule, n)
            del free[pick[0]]
        else:
            out[ident] = (None, rule, n)
    for ident, amount, day in later:
        same = [p for p in reach(day, free) if p[2] == amount]
        if greedy and same:
            out[ident] = (same[0][0], "amount_date_unique", len(same))
            del free[same[0][0]]
            continue
        rivals = [c for c in later if c[0] != ident and c[1] == amount and any(p in same for p in reach(c[2], free))]
        if not same:
            out[ident] = (None, "abstain_no_candidate", None)
        elif len(same) > 1 or rivals:
            out[ident] = (None, "abstain_ambiguous", len(same))
        elif SURE["amount_date_unique"] >= threshold:
            out[ident] = (same[0][0], "amount_date_unique", 1)
            del free[same[0][0]]
        else:
            out[ident] = (None, "amount_date_unique", 1)
    return out


def allocate(amount, weights):
    total = sum(weights)
    if not total:
        return [0] * len(weights)
    size = abs(amount)
    shares = [size * w // total for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (size * weights[i] % total, i), reverse=True)
    for i in order[: size - sum(shares)]:
        shares[i] += 1
    return [-s for s in shares] if amount < 0 else shares


def balance_check(lines):
    """lines: (line, debit, credit, balance); None amounts mean a balance-only line -> broken lines, checked count."""
    previous, pending, broken, checked = None, 0, [], 0
    for line, debit, credit, balance in lines:
        if debit is None and credit is None:
            if balance is not None and previous is None:
                previous = balance
            continue
        pending += (credit or 0) - (debit or 0)
        if balance is not None:
            if previous is not None:
                checked += 1
                if previous + pending != balance:
                    broken.append(line)
            previous, pending = balance, 0
    return broken, checked


def add_bank_days(day, n, open_days):
    for _ in range(n):
        day += DAY
        while not open_days(day):
            day += DAY
    return day


def conformal_floor(scores, forecast, alpha):
    ordered = sorted(scores)
    if not ordered:
        q = 0.0
    else:
        rank = math.ceil((len(ordered) + 1) * (1 - alpha))
        q = ordered[-1] if rank > len(ordered) else ordered[rank - 1]
    return max(0, int(forecast * (1 - q)))
