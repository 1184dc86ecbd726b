"""The outlier rules in DuckDB SQL, worked out by explicit joins over words and windows."""

from __future__ import annotations

from khata.llm import quality_rules as q

_P = range(q.P)
_XS = ", ".join(f"x{k}" for k in _P)


def _plain(sql: str) -> str:
    """Spark's double literals without their suffix."""
    return sql.replace(".0D", ".0").replace("0.5D", "0.5")


_BASE = r"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS g, coalesce(source, '') AS s, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
line_counts AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, (sum(n) - count(*))::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id),
grams AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, gram FROM grams GROUP BY ALL HAVING count(*) > 1),
reached AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS pos FROM grams g JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
stats AS MATERIALIZED (SELECT doc_id, g, s, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN line_counts USING (doc_id) LEFT JOIN reached USING (doc_id))"""


def _nearest(name: str, rows: str) -> str:
    return f""",
{name} AS MATERIALIZED (SELECT g, s, min(bin) AS edge FROM (SELECT g, s, bin, sum(n) OVER (PARTITION BY g, s ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY g, s) AS n
  FROM (SELECT g, s, bin, count(*) AS n FROM {rows} GROUP BY ALL)) WHERE 100 * upto >= {q.SHARE_PERCENT} * n GROUP BY g, s)"""


def _step(i: int) -> str:
    """Moments of the nearest rows of ``p{i}``, and ``p{i + 1}``: the rows placed by them."""
    names = [f"t{k}" for k in _P] + [f"q_{j}_{k}" for j, k in q.PAIRS]
    sums = ", ".join([f"sum(x{k})::DOUBLE AS t{k}" for k in _P] + [f"sum(x{j} * x{k})::DOUBLE AS q_{j}_{k}" for j, k in q.PAIRS])
    blend = ", ".join(f"(e.{c} + {q.PRIOR} * (l.{c} / l.n)) / (e.n + {q.PRIOR}.0) AS {c.replace('t', 'm').replace('q', 'r')}" for c in names)
    cov = ", ".join(f"(r_{j}_{k} - m{j} * m{k}) / {q.UNIT * q.UNIT}.0" + (f" + {q.RIDGE}::DOUBLE" if j == k else "") + f" AS c_{j}_{k}" for j, k in q.PAIRS)
    factor = ", ".join(f"{q.cholesky_sql(j, k)} AS l_{j}_{k}" for j, k in q.PAIRS)
    z = ", ".join(f"{q.forward_sql(j)} AS z{j}" for j in _P)
    return _nearest(f"e{i}", f"p{i}") + f""",
near{i} AS (SELECT g, s, count(*) AS n, {sums} FROM p{i} JOIN e{i} USING (g, s) WHERE bin <= edge GROUP BY g, s),
lang{i} AS (SELECT g, sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM near{i} GROUP BY g),
mix{i} AS (SELECT e.g, e.s, {blend} FROM near{i} e JOIN lang{i} l USING (g)),
cov{i} AS (SELECT g, s, {', '.join(f'm{k}' for k in _P)}, {cov} FROM mix{i}),
chol{i} AS MATERIALIZED (SELECT *, {factor} FROM cov{i}),
p{i + 1} AS MATERIALIZED (SELECT *, CAST(floor(sqrt(d2) * {q.BINS}) AS BIGINT) AS bin FROM (SELECT doc_id, g, s, {_XS}, {' + '.join(f'z{j} * z{j}' for j in _P)} AS d2
  FROM (SELECT x.*, m0, m1, m2, m3, m4, {', '.join(f'l_{j}_{k}' for j, k in q.PAIRS)}, {z} FROM x JOIN chol{i} USING (g, s))))"""


def sql() -> str:
    axes = ", ".join(f"CAST(floor({_plain(a)} * {q.UNIT} + 0.5) AS BIGINT) AS x{k}" for k, a in enumerate(q.AXES))
    far = " + ".join(f"abs(x{k} - m{k}) / (d{k} + {q.UNIT // 20}.0)" for k in _P)
    out = _BASE + f""",
x AS MATERIALIZED (SELECT *, {axes} FROM stats),
long AS (SELECT g, s, unnest(range({q.P})) AS axis, unnest([{_XS}]) AS v FROM x),
med AS (SELECT g, s, axis, list_sort(list(v))[(count(*) + 1) // 2] AS m FROM long GROUP BY ALL),
dev AS (SELECT g, s, axis, m, list_sort(list(abs(v - m)))[(count(*) + 1) // 2] AS d FROM long JOIN med USING (g, s, axis) GROUP BY ALL),
start AS (SELECT g, s, {', '.join(f'max(m) FILTER (axis = {k}) AS m{k}, max(d) FILTER (axis = {k}) AS d{k}' for k in _P)} FROM dev GROUP BY g, s),
p0 AS MATERIALIZED (SELECT x.*, CAST(floor(({far}) * {q.BINS}) AS BIGINT) AS bin FROM x JOIN start USING (g, s))"""
    for i in range(q.STEPS):
        out += _step(i)
    out += _nearest("last", f"p{q.STEPS}")
    reach = f"((edge + 1.0) / {q.BINS})"
    return out + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND d2 * least(1.0, {q.CHI_SQUARE}::DOUBLE / ({reach} * {reach})) <= {q.CUTOFF} AS kept
FROM stats JOIN (SELECT doc_id, d2, edge FROM p{q.STEPS} JOIN last USING (g, s)) USING (doc_id)"""
