"""Document statistics, base rules, and multivariate outliers by minimum covariance determinant.

Statistics become a vector of five variance-stabilised numbers (``AXES``), kept as whole 1/1024ths so that sums are exact
and do not depend on the order of tasks. Per language and source, the estimate starts from coordinate medians and median
deviations and is improved by concentration steps: keep the ``share`` of rows nearest to the current centre, take their mean
and covariance, repeat. The moments of small groups are blended with those of their language (``prior`` rows' worth). A
document is rejected when its squared Mahalanobis distance, scaled to the chi-square law, exceeds ``cutoff``.

A concentration step is one aggregate per group with map-side sums; distances enter as counts per 1/64th of a distance, so
no group is ever sorted or held by one task. Only DataFrame functions are used. Vectors and each step's moments are written
below ``spark.checkpoint.dir``.

Cases: null text is empty text; a null language or source is the group of the empty name; repeated rows count and are
returned as often as they occur; ties at the edge of the nearest share are all inside; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.llm.base import BLANK, UPPER, words

#: Vector entries as SQL arithmetic over the statistics; the constants added shrink ratios of short texts.
AXES = (
    "sqrt((word_chars + 250) / (n_words + 50.0D))",
    "sqrt(n_symbols / (word_chars + 200.0D))",
    "sqrt(n_dup_lines / (n_lines + 30.0D))",
    "sqrt(n_repeat_words / (n_words + 200.0D))",
    "sqrt(n_upper / (word_chars + 200.0D))",
)
UNIT, BINS = 1024, 64
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SHARE_PERCENT, STEPS, PRIOR, RIDGE, CUTOFF = 75, 4, 64, 0.0025, 50.0
#: 75 % point of the chi-square law with five degrees of freedom.
CHI_SQUARE = 6.625679763829248


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeats(hashes: str) -> str:
    """Words covered by windows that occur twice or more: sort (hash, place), keep equal neighbours, add up their reach."""
    return f"""
        CASE WHEN {hashes} IS NULL OR size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE
          aggregate(
            array_sort(filter(transform(array(array_sort(transform({hashes}, (x, i) -> struct(x, i)))), s ->
              transform(s, (e, k) -> CASE WHEN (k > 0 AND try_element_at(s, k).x = e.x)
                                        OR (k + 1 < size(s) AND try_element_at(s, k + 2).x = e.x) THEN e.i END))[0], p -> p IS NOT NULL)),
            struct(0L AS n, -{WINDOW} AS last),
            (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last),
            a -> a.n)
        END"""


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and ``STATS`` of every document, from its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    window = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return (
        docs.select("doc_id", "lang", "source", text.alias("text"), words(text).alias("w"), lines.alias("ls"))
        .select(
            "doc_id", "lang", "source",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
            _without(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
            (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
            F.expr(f"CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({window})) END").alias("hs"),
            F.size("ls").cast("long").alias("n_lines"),
            _without(F.col("text"), UPPER).cast("long").alias("n_upper"),
        )
        .select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                F.expr(_repeats("hs")).alias("n_repeat_words"), "n_lines", "n_upper")
    )


def vectors(stats: DataFrame) -> DataFrame:
    """The statistics with the group (g, s) and the vector x0.. in whole ``1 / UNIT``ths."""
    return stats.withColumns(
        {"g": F.coalesce("lang", F.lit("")), "s": F.coalesce("source", F.lit(""))}
        | {f"x{k}": F.expr(f"CAST(floor({axis} * {UNIT} + 0.5D) AS BIGINT)") for k, axis in enumerate(AXES)}
    )


P = len(AXES)
PAIRS = [(j, k) for j in range(P) for k in range(j + 1)]


def cholesky_sql(j: int, k: int) -> str:
    """Entry (j, k) of the factor, from the covariance columns c_j_k and earlier entries."""
    rest = "".join(f" - l_{j}_{i} * l_{k}_{i}" for i in range(k))
    return f"sqrt(c_{j}_{k}{rest})" if j == k else f"(c_{j}_{k}{rest}) / l_{k}_{k}"


def forward_sql(j: int) -> str:
    """Entry j of the whitened vector, from earlier ones."""
    rest = "".join(f" - l_{j}_{i} * z{i}" for i in range(j))
    return f"((x{j} - m{j}) / {UNIT}.0{rest}) / l_{j}_{j}"


def _medians(rows: DataFrame, value: str) -> DataFrame:
    """Lower median of ``value`` per (g, s, axis) from counts per value."""
    counts = rows.groupBy("g", "s", "axis", F.col(value).alias("v")).count()
    part = "PARTITION BY g, s, axis"
    return (
        counts.select("g", "s", "axis", "v", F.expr(f"sum(count) OVER ({part} ORDER BY v)").alias("upto"), F.expr(f"sum(count) OVER ({part})").alias("n"))
        .filter("2 * upto >= n").groupBy("g", "s", "axis").agg(F.min("v").alias("mid"))
    )


def _spread(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per group, a column for each axis and name."""
    return rows.groupBy("g", "s").agg(*[F.max(F.when(F.col("axis") == k, F.col(c))).alias(f"{n}{k}") for c, n in names.items() for k in range(P)])


def _start(x: DataFrame) -> DataFrame:
    """Medians m and median deviations d, per group."""
    long = x.select("g", "s", F.posexplode(F.array(*[f"x{k}" for k in range(P)])).alias("axis", "v"))
    mid = cut(_medians(long, "v"), "mcd-mid")
    off = _medians(long.join(mid, ["g", "s", "axis"]).select("g", "s", "axis", F.abs(F.col("v") - F.col("mid")).alias("off")), "off")
    both = mid.join(off.withColumnRenamed("mid", "dev"), ["g", "s", "axis"])
    return cut(_spread(both, {"mid": "m", "dev": "d"}), "mcd-start")


def _nearest(placed: DataFrame, share: int) -> DataFrame:
    """Per group the smallest bin that, with those below, holds ``share`` percent of the rows."""
    counts = placed.groupBy("g", "s", "bin").count()
    return (
        counts.select("g", "s", "bin", F.expr("sum(count) OVER (PARTITION BY g, s ORDER BY bin)").alias("upto"), F.expr("sum(count) OVER (PARTITION BY g, s)").alias("n"))
        .filter(f"100 * upto >= {share} * n").groupBy("g", "s").agg(F.min("bin").alias("edge"))
    )


def _moments(placed: DataFrame, share: int, prior: int, ridge: float) -> DataFrame:
    """Mean and Cholesky factor of the nearest rows of each group, blended with their language's."""
    edge = cut(_nearest(placed, share), "mcd-edge")
    sums = [F.count("*").alias("n")] + [F.sum(f"x{k}").alias(f"t{k}") for k in range(P)]
    sums += [F.sum(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"q_{j}_{k}") for j, k in PAIRS]
    near = placed.join(edge, ["g", "s"]).filter("bin <= edge").groupBy("g", "s").agg(*sums)
    names = ["n"] + [f"t{k}" for k in range(P)] + [f"q_{j}_{k}" for j, k in PAIRS]
    lang = near.groupBy("g").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    out = near.join(lang, "g").select("g", "s", *[
        F.expr(f"({c} + {prior} * (all_{c} / CAST(all_n AS DOUBLE))) / (n + {prior}.0D)").alias(c.replace("t", "m").replace("q", "c")) for c in names[1:]
    ])
    for j, k in PAIRS:
        out = out.withColumn(f"c_{j}_{k}", F.expr(f"(c_{j}_{k} - m{j} * m{k}) / {UNIT * UNIT}.0D" + (f" + {ridge}D" if j == k else "")))
    for j, k in PAIRS:
        out = out.withColumn(f"l_{j}_{k}", F.expr(cholesky_sql(j, k)))
    return cut(out.select("g", "s", *[f"m{k}" for k in range(P)], *[f"l_{j}_{k}" for j, k in PAIRS]), "mcd-moments")


def _distances(x: DataFrame, moments: DataFrame) -> DataFrame:
    out = x.join(moments, ["g", "s"])
    for j in range(P):
        out = out.withColumn(f"z{j}", F.expr(forward_sql(j)))
    return out.withColumn("d2", F.expr(" + ".join(f"z{j} * z{j}" for j in range(P)))).withColumn("bin", F.expr(f"CAST(floor(sqrt(d2) * {BINS}) AS BIGINT)"))


def outliers(docs: DataFrame, share: int = SHARE_PERCENT, steps: int = STEPS, prior: int = PRIOR, ridge: float = RIDGE, cutoff: float = CUTOFF) -> DataFrame:
    """Every document with its statistics, ``base_failed``, the scaled squared ``distance`` and ``kept``."""
    x = cut(vectors(statistics(docs)), "mcd-vectors")
    bare = x.select("g", "s", *[f"x{k}" for k in range(P)])
    far = " + ".join(f"abs(x{k} - m{k}) / (d{k} + {UNIT // 20}.0D)" for k in range(P))
    placed = bare.join(_start(bare), ["g", "s"]).withColumn("bin", F.expr(f"CAST(floor(({far}) * {BINS}) AS BIGINT)"))
    for _ in range(steps):
        moments = _moments(placed, share, prior, ridge)
        placed = _distances(bare, moments)
    edge = cut(_nearest(placed, share), "mcd-last")
    reach = f"(edge + 1.0D) / {BINS}"
    failed = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    return (
        _distances(x, moments).join(edge, ["g", "s"])
        .withColumn("distance", F.expr(f"d2 * least(1.0D, {CHI_SQUARE}D / (({reach}) * ({reach})))"))
        .select("doc_id", *STATS, "distance", F.expr(failed).alias("base_failed"), F.expr(f"NOT ({failed}) AND distance <= {cutoff}D").alias("kept"))
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Rows of one doc_id stay if all of them pass."""
    bad = outliers(docs.select("doc_id", "text", "lang", "source")).filter("NOT kept").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
