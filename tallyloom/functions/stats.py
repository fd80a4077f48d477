"""Column builders for rates, intervals and discovery statistics. Null stands for what can't be told."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(part, whole) -> Column:
    """part / whole; null if whole is 0."""
    return F.try_divide(_c(part).cast("double"), _c(whole))


def wilson(successes, total, z: float = Z95) -> Column:
    """struct(estimate, lower, upper, n) of the score interval, within 0 and 1; null bounds without trials."""
    s, n = _c(successes).cast("double"), _c(total).cast("double")
    p = F.try_divide(s, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    middle = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    radius = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    some = n > 0
    fits = F.when(some & ((s < 0) | (s > n)), F.raise_error(F.lit("successes must be within 0 and the total")).cast("double"))
    return F.struct(
        F.coalesce(fits, F.when(some, p)).alias("estimate"),
        F.when(some, F.greatest(F.lit(0.0), middle - radius)).alias("lower"),
        F.when(some, F.least(F.lit(1.0), middle + radius)).alias("upper"),
        _c(total).alias("n"),
    )


def draw_without(n, hit, k) -> Column:
    """The chance that k drawn of n, without replacement, are all outside of `hit` ones."""
    n, hit, k = _c(n), _c(hit), _c(k)
    steps = F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0)))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - hit - i) / F.greatest(n - i, F.lit(1)))
    return F.when(n - hit < k, 0.0).otherwise(product)


def pass_at_k(n, correct, k) -> Column:
    """The chance that one of k drawn of n is correct; null unless 0 < k <= n."""
    n, k = _c(n), F.lit(k) if isinstance(k, int) else _c(k)
    return F.when((n > 0) & (k > 0) & (k <= n), 1 - draw_without(n, correct, k))


def finite_mean(x) -> Column:
    """Mean of the finite numbers."""
    x = _c(x)
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def five_numbers(x, prefix: str = "") -> list[Column]:
    x = _c(x)
    return [F.count(x).alias(f"{prefix}n"), F.sum(x).alias(f"{prefix}total"), F.avg(x).alias(f"{prefix}mean"), F.median(x).alias(f"{prefix}median"), F.max(x).alias(f"{prefix}max")]


def six_numbers(x, prefix: str = "") -> list[Column]:
    x = _c(x)
    return [F.count(x).alias(f"{prefix}n"), F.avg(x).alias(f"{prefix}mean"), F.median(x).alias(f"{prefix}median"), F.stddev_samp(x).alias(f"{prefix}sample_sd"), F.min(x).alias(f"{prefix}min"), F.max(x).alias(f"{prefix}max")]


def jaccard(a, b) -> Column:
    """Jaccard similarity of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def register(spark: SparkSession) -> None:
    """The scalar functions under SQL names, as SQL functions that Catalyst inlines."""
    z2 = f"({Z95} * {Z95})"
    for name, args, body in (
        ("wilson_lower", "s DOUBLE, n DOUBLE", f"CASE WHEN n > 0 THEN greatest(0d, (s / n + {z2} / (2 * n) - {Z95} * sqrt(s / n * (1 - s / n) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)) END"),
        ("wilson_upper", "s DOUBLE, n DOUBLE", f"CASE WHEN n > 0 THEN least(1d, (s / n + {z2} / (2 * n) + {Z95} * sqrt(s / n * (1 - s / n) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)) END"),
        ("pass_at_k", "n INT, c INT, k INT", "CASE WHEN n > 0 AND k > 0 AND k <= n THEN CASE WHEN n - c < k THEN 1d ELSE 1d - aggregate(sequence(0, greatest(k - 1, 0)), 1d, (acc, i) -> acc * (n - c - i) / greatest(n - i, 1)) END END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
