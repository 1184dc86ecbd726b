"""The pseudonyms in DuckDB SQL: candidates as rows, one subquery per Feistel round."""

from __future__ import annotations

from khata.llm import pii

_PATTERN = pii.PATTERN.replace("'", "''")
_KEY = pii.KEY


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(d: str, doubled: int) -> str:
    x = f"CAST({d}[len({d}) - i] AS INT)"
    return f"list_sum(list_transform(range(0, len({d})), lambda i: CASE WHEN i % 2 = {doubled} THEN 2 * {x} - CASE WHEN {x} > 4 THEN 9 ELSE 0 END ELSE {x} END))"


def _refill(shape: str, d: str) -> str:
    place = f"len(regexp_replace({shape}[1:i], '[^0-9]', '', 'g'))"
    return f"array_to_string(list_transform(range(1, len({shape}) + 1), lambda i: CASE WHEN {shape}[i] BETWEEN '0' AND '9' THEN {d}[{place}] ELSE {shape}[i] END), '')"


def _date(layout: str) -> str:
    return f"date_diff('day', DATE '{pii.FIRST_DAY}', CAST(try_strptime(m, '{layout}') AS DATE))"


def sql() -> str:
    days = pii.DAYS[0] * pii.DAYS[1]
    rounds = "SELECT *, a0 AS a, b0 AS b, p0 AS p, q0 AS q FROM start"
    for i in range(1, pii.ROUNDS + 1):
        drawn = f"CAST('0x' || substr(sha256('{_KEY}|' || tweak || '|{i}|' || b), 1, 15) AS BIGINT)"
        rounds = f"SELECT * REPLACE (b AS a, (a + {drawn}) % p AS b, q AS p, p AS q) FROM ({rounds})"
    secret = "left(" + " || ".join(f"sha256('{_KEY}|hex|{k}|' || lower(m))" for k in range(2)) + ", len(m))"
    day = f"DATE '{pii.FIRST_DAY}' + CAST(a * {pii.DAYS[1]} + b AS INT)"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(regexp_matches(text, '[0-9@]'), false) AS open FROM documents),
found AS MATERIALIZED (SELECT r, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (SELECT r, regexp_extract_all(text, '{_PATTERN}') AS ms FROM doc WHERE open)),
kind AS (SELECT *, {_digits('m')} AS d, CASE
    WHEN contains(m, '@') THEN 'mail' WHEN len(m) >= 32 THEN 'hex' WHEN regexp_matches(m, '^[+(]') THEN 'phone'
    WHEN regexp_matches(m, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN 'ipv4'
    WHEN regexp_matches(m, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '%Y-%m-%d' WHEN regexp_matches(m, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN '%d/%m/%Y'
    WHEN regexp_matches(m, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$') THEN '%d.%m.%Y' WHEN regexp_matches(m, '{pii.NATIONAL}') THEN 'national'
    WHEN len(m) >= 13 THEN 'card' END AS kind FROM found),
part AS (SELECT *, CASE WHEN kind <> 'phone' THEN '' WHEN regexp_matches(m, '^[+][0-9]{{1,3}}[ .(-]') THEN regexp_extract(m, '^[+][0-9]+') ELSE left(m, 2) END AS head,
    CASE kind WHEN '%Y-%m-%d' THEN {_date('%Y-%m-%d')} WHEN '%d/%m/%Y' THEN {_date('%d/%m/%Y')} WHEN '%d.%m.%Y' THEN {_date('%d.%m.%Y')} END AS t,
    CASE WHEN kind = 'ipv4' THEN list_transform(string_split(m, '.'), lambda x: CAST(x AS BIGINT)) END AS o FROM kind),
body AS (SELECT *, CASE kind WHEN 'card' THEN d[1:len(d) - 1] WHEN 'phone' THEN {_digits('m[len(head) + 1:]')} WHEN 'national' THEN d END AS n FROM part
  WHERE CASE WHEN kind = 'card' THEN len(d) BETWEEN 13 AND 19 AND {_luhn('d', 1)} % 10 = 0 WHEN kind = 'phone' THEN len(d) BETWEEN 7 AND 15 WHEN kind = 'national' THEN true
    WHEN kind = 'ipv4' THEN list_max(o) < 256 WHEN t IS NOT NULL THEN t >= 0 AND t < {days} ELSE false END),
start AS (SELECT *, len(n) // 2 AS u, CASE WHEN n IS NOT NULL THEN replace(kind, '%', '') || head || len(n) WHEN t IS NOT NULL THEN 'date' ELSE kind END AS tweak,
    CAST(CASE WHEN n IS NOT NULL THEN CAST(n[1:len(n) // 2] AS BIGINT) WHEN t IS NOT NULL THEN t // {pii.DAYS[1]} ELSE o[1] * 256 + o[2] END AS BIGINT) AS a0,
    CAST(CASE WHEN n IS NOT NULL THEN CAST(n[len(n) // 2 + 1:] AS BIGINT) WHEN t IS NOT NULL THEN t % {pii.DAYS[1]} ELSE o[3] * 256 + o[4] END AS BIGINT) AS b0,
    CAST(CASE WHEN n IS NOT NULL THEN power(10, len(n) // 2) WHEN t IS NOT NULL THEN {pii.DAYS[0]} ELSE 65536 END AS BIGINT) AS p0,
    CAST(CASE WHEN n IS NOT NULL THEN power(10, len(n) - len(n) // 2) WHEN t IS NOT NULL THEN {pii.DAYS[1]} ELSE 65536 END AS BIGINT) AS q0 FROM body),
mixed AS MATERIALIZED (SELECT *, CASE WHEN n IS NOT NULL THEN lpad(CAST(a AS VARCHAR), CAST(u AS INT), '0') || lpad(CAST(b AS VARCHAR), CAST(len(n) - u AS INT), '0') END AS w FROM ({rounds})),
swapped AS (
  SELECT r, i, CASE WHEN kind = 'card' THEN {_refill('m', "(w || CAST((10 - " + _luhn('w', 0) + " % 10) % 10 AS VARCHAR))")}
    WHEN kind = 'phone' THEN head || {_refill('m[len(head) + 1:]', 'w')} WHEN kind = 'national' THEN {_refill('m', 'w')}
    WHEN kind = 'ipv4' THEN (a // 256) || '.' || (a % 256) || '.' || (b // 256) || '.' || (b % 256)
    WHEN kind = '%Y-%m-%d' THEN strftime({day}, '%Y-%m-%d') WHEN kind = '%d/%m/%Y' THEN strftime({day}, '%d/%m/%Y') ELSE strftime({day}, '%d.%m.%Y') END AS s FROM mixed
  UNION ALL SELECT r, i, CASE WHEN regexp_matches(m, '[A-F]') THEN upper({secret}) ELSE {secret} END FROM kind WHERE kind = 'hex' AND len(m) <= 128 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]')
  UNION ALL SELECT r, i, translate(left(sha256('{_KEY}|mail|' || lower(m)), strpos(m, '@') - 1), '0123456789abcdef', 'ghijklmnopqrstuv') || substr(m, strpos(m, '@')) FROM kind WHERE kind = 'mail'),
gaps AS (SELECT r, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g FROM (SELECT r, string_split_regex(text, '{_PATTERN}') AS gs FROM doc WHERE open)),
made AS (SELECT r, string_agg(g || coalesce(s, m, ''), '' ORDER BY i) AS made FROM gaps LEFT JOIN found USING (r, i) LEFT JOIN swapped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(made, text) AS text, coalesce(coalesce(made, text) <> text, false) AS changed FROM doc LEFT JOIN made USING (r)"""
