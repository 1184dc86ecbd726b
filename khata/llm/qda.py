"""Quality scores by regularised quadratic discriminant analysis of document statistics.

The axes are variance-stabilised statistics of the whole text. Per class, mean and covariance come from sums over labelled rows
outside the held-out fold; the covariance is drawn towards the pooled one (``POOL``) and towards a multiple of the identity
(``ROUND``). The sums are one row per class, so only those reach the driver, which keeps each class's Cholesky factor. A
document's score is the logistic of the difference of the two log densities (whitened squared distances and log determinants)
plus the log odds of the classes, written as column arithmetic over the cached factors.

Cases: null and empty texts have the statistics of an empty text and a score like any other; labels that are null or not 0 or 1
are left out; repeated labels count as often as they occur; with one class only, every score is 1 or 0 as that class says, with
none 0.5; repeated rows are returned as often as they occur; an empty table gives no rows; other columns, among them lang, source
and n_chars, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.llm.base import fold
from khata.llm.quality_rules import AXES as RULE_AXES
from khata.llm.quality_rules import statistics

AXES = (*RULE_AXES, "ln(n_words + 20.0D)", "ln((n_words + 20.0D) / (n_lines + 4.0D))")
FOLDS, HELD_OUT = 4, 2
POOL, ROUND = 0.1, 0.01
THRESHOLD = 0.7
P = len(AXES)
PAIRS = [(j, k) for j in range(P) for k in range(j + 1)]


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the axes x0.. of every document."""
    stats = statistics(docs.select("doc_id", "text").withColumns({"lang": F.lit(""), "source": F.lit("")}))
    return stats.select("doc_id", *[F.expr(a).alias(f"x{k}") for k, a in enumerate(AXES)])


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each class of ``quality``."""
    sums = [F.avg(f"x{k}").alias(f"m{k}") for k in range(P)] + [F.covar_pop(f"x{j}", f"x{k}").alias(f"c_{j}_{k}") for j, k in PAIRS]
    out = {}
    for r in labelled.groupBy("quality").agg(F.count("*").alias("n"), *sums).collect():
        cov = np.zeros((P, P))
        for j, k in PAIRS:
            cov[j, k] = cov[k, j] = r[f"c_{j}_{k}"]
        out[int(r["quality"])] = (r["n"], np.array([r[f"m{k}"] for k in range(P)]), cov)
    return out


def factors(classes: dict, pool: float = POOL, round_: float = ROUND) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log prior minus half the log determinant, mean, and inverse Cholesky factor of each class."""
    total = sum(n for n, _, _ in classes.values())
    shared = sum(n * cov for n, _, cov in classes.values()) / total
    out = {}
    for c, (n, mean, cov) in classes.items():
        mixed = (1 - pool) * cov + pool * shared
        mixed = (1 - round_) * mixed + round_ * max(np.trace(mixed) / P, 1e-6) * np.eye(P)
        lower = np.linalg.cholesky(mixed)
        out[c] = (math.log(n / total) - float(np.log(np.diag(lower)).sum()), mean, np.linalg.inv(lower))
    return out


def _log_density(own: tuple[float, np.ndarray, np.ndarray]):
    """The class's log density and prior, up to what all classes share."""
    base, mean, inverse = own
    out = F.lit(base)
    for j in range(P):
        z = sum(((F.col(f"x{k}") - float(mean[k])) * float(inverse[j, k]) for k in range(j + 1)), F.lit(0.0))
        out = out - z * z / 2
    return out


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    x = cut(vectors(docs), "qda-vectors")
    known = labels.select("doc_id", "quality").filter("quality IN (0, 1)").filter(~held)
    classes = moments(x.join(known, "doc_id"))
    if len(classes) == 2:
        classes = factors(classes)
        gap = _log_density(classes[1]) - _log_density(classes[0])
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), gap))))
    else:
        value = F.lit(float(next(iter(classes), 0.5)))
    return x.select("doc_id", held.alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
