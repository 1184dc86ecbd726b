"""Personal numbers, dates, addresses and secrets replaced by keyed pseudonyms of the same format.

A candidate is found by ``PATTERN``, then validated: card numbers by check digit and length, dates by the calendar, network
addresses by their octets, phone numbers by their digit count. What fails is left as it is. A valid value is permuted by a
keyed Feistel network over its own domain, so equal values get equal pseudonyms in every document and different values of one
format get different ones:

* card (13 to 19 digits, check digit valid): the digits before the check digit; a new check digit is worked out.
* phone: all digits after the country or area prefix; national numbers ``ddd-dd-dddd`` and
  ``ddd-ddd-dddd``, the latter also with blanks or dots: all digits.
* date (``YYYY-MM-DD``, ``DD/MM/YYYY``, ``DD.MM.YYYY``): the day, among the 73,440 days from 1900-01-01 on.
* IPv4 address: its 32 bits.
* mail address (letters of the local part) and hexadecimal secret (32 to 128 digits, with letters and figures): keyed digest
  characters in the same places, as these have no numeric domain; equal values still stay linked.

Punctuation, spacing and case class stay. Only SQL functions run. Cases: null text stays null; a text without candidates is
returned unchanged; repeated rows are treated alike; all other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of candidates, tried in this order at every place.
SHAPES = (
    r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    r"[0-9A-Fa-f]{32,}",
    # international numbers by layout, so that none runs on into the next value; the last shape takes all other layouts
    r"\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{2,5}[ .-][0-9]{3,4}[ .-][0-9]{3,}",
    r"\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{2,5}[ .-][0-9]{4,}",
    r"\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{6,}",
    r"\+[0-9]{1,3}[ .-][0-9](?: [0-9]{2}){3} [0-9]{2,}",
    r"\+[0-9]{1,3}[ .-][0-9] [0-9]{3} [0-9]{4,}",
    r"\+[0-9]{1,3}[ .-][0-9]{5} [0-9]{5,}",
    r"\+[0-9]{1,3}[ .-][0-9]{2} [0-9]{5} [0-9]{4,}",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,}(?:-[0-9]{2,}){1,3}",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,}(?:\.[0-9]{2,}){1,3}",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{5,}",
    r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4} [0-9]{4,}",
    r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{2,3} [0-9]{2} [0-9]{2,}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{2,4} [0-9]{2,}(?:-[0-9]{2,}){1,2}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{2,4} [0-9]{5,}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{3} [0-9]{3} [0-9]{4,}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{2,4} [0-9]{4} [0-9]{4,}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{2,4} [0-9]{3} [0-9]{3,}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{2,3} [0-9]{2,3} [0-9]{2} [0-9]{2,}",
    r"\+[0-9]{1,3}[ .-][0-9]{4} [0-9]{4,}",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}",
    r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}",
    r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}",
    r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}",
    r"[0-9]{3}-[0-9]{2,3}-[0-9]{4}",
    r"[0-9]{3} [0-9]{3} [0-9]{4,}",
    r"[0-9]{3}\.[0-9]{3}\.[0-9]{4,}",
    r"[0-9]+",
)
PATTERN = "|".join(SHAPES)
#: National numbers among the candidates: one kind of separator in each.
NATIONAL = "^([0-9]{3}-[0-9]{2,3}-[0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{3}[.][0-9]{3}[.][0-9]{4})$"
#: The key of the sample queries and tests alone. Callers bring a secret of their own; there is no default.
KEY = "set-a-secret-of-your-own"
ROUNDS = 8
#: The days of the date domain, 272 * 270 from the first on.
FIRST_DAY, DAYS = "1900-01-01", (272, 270)


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _feistel(key: str, kind: str, a: str, b: str, p: str, q: str) -> str:
    """(a, b) permuted among all pairs with a < p, b < q."""
    drawn = f"CAST(conv(substr(sha2(concat_ws('|', {_lit(key)}, {kind}, i, s.b), 256), 1, 15), 16, 10) AS BIGINT)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, CAST({p} AS BIGINT) AS p, CAST({q} AS BIGINT) AS q), "
        f"(s, i) -> struct(s.b AS a, (s.a + {drawn}) % s.p AS b, s.q AS p, s.p AS q))"
    )


def _permuted(key: str, kind: str, digits: str) -> str:
    """A digit string permuted among those of its length (two at least)."""
    u, v = f"(length({digits}) DIV 2)", f"(length({digits}) - length({digits}) DIV 2)"
    mixed = _feistel(key, f"concat({kind}, length({digits}))", f"left({digits}, {u})", f"right({digits}, {v})", f"power(10, {u})", f"power(10, {v})")
    return _let(mixed, "r", f"concat(lpad(CAST(r.a AS STRING), {u}, '0'), lpad(CAST(r.b AS STRING), {v}, '0'))")


def _refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    place = f"length(regexp_replace(substr({shape}, 1, k + 1), '[^0-9]', ''))"
    return f"array_join(transform(split({shape}, ''), (c, k) -> CASE WHEN c RLIKE '[0-9]' THEN substr({digits}, {place}, 1) ELSE c END), '')"


def _luhn(digits: str, doubled: int) -> str:
    """Check sum; from the right, every second digit is doubled, beginning with place ``doubled``."""
    d = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    return (f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + CASE WHEN i % 2 = {doubled} THEN "
            f"2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)")


def _card(key: str, m: str) -> str:
    body = _permuted(key, "'card'", "substr(d, 1, length(d) - 1)")
    whole = _let(body, "n", f"concat(n, CAST((10 - {_luhn('n', 0)} % 10) % 10 AS STRING))")
    return _let(_digits(m), "d", f"CASE WHEN length(d) BETWEEN 13 AND 19 AND {_luhn('d', 1)} % 10 = 0 THEN {_let(whole, 'w', _refilled(m, 'w'))} END")


def _date(key: str, m: str, pattern: str) -> str:
    mixed = _feistel(key, "'date'", f"t DIV {DAYS[1]}", f"t % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]))
    return _let(
        f"datediff(try_to_timestamp({m}, '{pattern}'), DATE'{FIRST_DAY}')", "t",
        f"CASE WHEN t >= 0 AND t < {DAYS[0] * DAYS[1]} THEN {_let(mixed, 'r', f'''date_format(date_add(DATE'{FIRST_DAY}', CAST(r.a * {DAYS[1]} + r.b AS INT)), '{pattern}')''')} END",
    )


def _address(key: str, m: str) -> str:
    half = "CAST(o[{0}] AS INT) * 256 + CAST(o[{1}] AS INT)"
    mixed = _feistel(key, "'ipv4'", half.format(0, 1), half.format(2, 3), "65536", "65536")
    return _let(f"split({m}, '[.]')", "o", "CASE WHEN forall(o, x -> CAST(x AS INT) < 256) THEN "
                + _let(mixed, "r", "concat_ws('.', r.a DIV 256, r.a % 256, r.b DIV 256, r.b % 256)") + " END")


def _phone(key: str, m: str) -> str:
    head = f"CASE WHEN {m} RLIKE '^[+][0-9]{{1,3}}[ .(-]' THEN regexp_extract({m}, '^[+][0-9]+', 0) ELSE left({m}, 2) END"
    rest = _let(f"substr({m}, length(h) + 1)", "g", _let(_permuted(key, "concat('phone', h)", _digits("g")), "w", f"concat(h, {_refilled('g', 'w')})"))
    return f"CASE WHEN length({_digits(m)}) BETWEEN 7 AND 15 THEN {_let(head, 'h', rest)} END"


def _secret(key: str, m: str) -> str:
    drawn = ", ".join(f"sha2(concat_ws('|', {_lit(key)}, 'hex', {k}, lower({m})), 256)" for k in range(2))
    text = f"left(concat({drawn}), length({m}))"
    return (f"CASE WHEN length({m}) <= 128 AND {m} RLIKE '[0-9]' AND {m} RLIKE '[A-Fa-f]' THEN "
            f"CASE WHEN {m} RLIKE '[A-F]' THEN upper({text}) ELSE {text} END END")


def _mail(key: str, m: str) -> str:
    drawn = f"sha2(concat_ws('|', {_lit(key)}, 'mail', lower({m})), 256)"
    return (f"concat(translate(left({drawn}, instr({m}, '@') - 1), '0123456789abcdef', 'ghijklmnopqrstuv'), "
            f"substr({m}, instr({m}, '@')))")


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of a candidate; null where it is not valid."""
    return f"""CASE
        WHEN instr({m}, '@') > 0 THEN {_mail(key, m)}
        WHEN length({m}) >= 32 THEN {_secret(key, m)}
        WHEN {m} RLIKE '^[+(]' THEN {_phone(key, m)}
        WHEN {m} RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' THEN {_address(key, m)}
        WHEN {m} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {_date(key, m, 'yyyy-MM-dd')}
        WHEN {m} RLIKE '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$' THEN {_date(key, m, 'dd/MM/yyyy')}
        WHEN {m} RLIKE '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' THEN {_date(key, m, 'dd.MM.yyyy')}
        WHEN {m} RLIKE '{NATIONAL}' THEN {_let(_permuted(key, "'national'", _digits(m)), 'w', _refilled(m, 'w'))}
        WHEN length({m}) >= 13 THEN {_card(key, m)} END"""


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the values in ``column`` replaced; all columns stay as they are otherwise."""
    found = f"regexp_extract_all(t, {_lit(PATTERN)}, 0)"
    parts = f"split(t, {_lit(PATTERN)}, -1)"
    swapped = f"transform({found}, m -> coalesce({pseudonym('m', key)}, m))"
    whole = f"array_join(zip_with({parts}, {swapped}, (x, y) -> concat(x, coalesce(y, ''))), '')"
    name = column.replace("`", "``")
    return docs.withColumn(column, F.expr(f"CASE WHEN `{name}` RLIKE '[0-9@]' THEN {_let(f'`{name}`', 't', whole)} ELSE `{name}` END"))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the new text, and how many candidates changed in it."""
    bare = docs.select("doc_id", F.col("text").alias("was"), "text")
    return pseudonymise(bare, key).select("doc_id", "text", F.coalesce(F.col("was") != F.col("text"), F.lit(False)).alias("changed"))
