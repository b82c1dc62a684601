"""Scores and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import as_column

# Weights and floors of the two-stage score.
VECTOR_WEIGHT, MODEL_WEIGHT = 0.35, 0.65
SIMILARITY_FLOOR, COMBINED_FLOOR, AUTO_REJECT = 0.89, 0.5, 0.75


def clamp01(c: Column | str) -> Column:
    v = as_column(c).cast("double")
    return F.when(F.isnan(v), F.lit(0.0)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def combine_confidence(similarity: Column | str, verdict: Column | str, confidence: Column | str) -> Column:
    """Weighted mean of similarity and the model's confidence that both are the same."""
    c = clamp01(confidence)
    return F.lit(VECTOR_WEIGHT) * clamp01(similarity) + F.lit(MODEL_WEIGHT) * F.when(as_column(verdict), c).otherwise(F.lit(1.0) - c)


def percent(c: Column | str) -> Column:
    return (as_column(c) * 100 + 0.5).cast("int")


def score_band(c: Column | str) -> Column:
    p = percent(c)
    return F.when(p >= 80, "high").when(p >= 60, "medium").otherwise("low")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null for a zero vector or vectors of different length."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(as_column(a)) == F.size(as_column(b))), dot(a, b) / n)


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays."""
    v = as_column(a)
    return F.transform(v, lambda x: F.when(norm(v) > 0, x.cast("double") / norm(v)).otherwise(x.cast("double")))


def checked_vector(a: Column | str, dim: int) -> Column:
    """The vector, with an error if it hasn't the wanted length."""
    v = as_column(a)
    return F.when(F.assert_true(v.isNull() | (F.size(v) == dim), F.lit("wrong vector length")).isNull(), v)
