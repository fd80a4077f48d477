"""Statistics of families (labels of a partition): sizes, entropy, discovery, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import draw_without, rate


def sizes(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    return labels.groupBy(*by, label).agg(F.count("*").alias("size"))


def family_stats(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    """raw_count, n, entropy in nats and bits, effective count, dominant share, and singletons over n."""
    total = sizes(labels, by, label).groupBy(*by).agg(
        F.count("*").alias("raw_count"), F.sum("size").alias("n"), F.sum(F.col("size") * F.ln("size")).alias("_s"), F.max("size").alias("_top"), F.count_if(F.col("size") == 1).alias("_ones"),
    )
    nats = F.ln("n") - F.col("_s") / F.col("n")
    return total.select(*by, "raw_count", "n", nats.alias("entropy_nats"), (nats / F.ln(F.lit(2.0))).alias("entropy_bits"), F.exp(nats).alias("effective_count"), (F.col("_top") / F.col("n")).alias("dominant_share"), (F.col("_ones") / F.col("n")).alias("singleton_rate"))


def discovery_curve(labels: DataFrame, by: list[str], label: str, k_max: int | None = None) -> DataFrame:
    """k, df: the families that k runs drawn without replacement show on average, for k from 1 to n (or k_max).

    Families of one size count together, so the work is (distinct sizes) x (points of the curve), not families x points.
    """
    grouped = sizes(labels, by, label).groupBy(*by, "size").agg(F.count("*").alias("_f"))
    n = grouped.groupBy(*by).agg(F.sum(F.col("size") * F.col("_f")).alias("n"))
    top = F.col("n") if k_max is None else F.least("n", F.lit(k_max))
    pairs = (grouped.join(n, by) if by else grouped.join(n, F.lit(True))).withColumn("k", F.explode(F.sequence(F.lit(1), top.cast("int"))))
    return pairs.groupBy(*by, "k").agg(F.sum(F.col("_f") * (1 - draw_without("n", "size", "k"))).alias("df"))


def expected_families(labels: DataFrame, by: list[str], label: str, k: int) -> DataFrame:
    """The curve's value at k; null where there are fewer than k runs."""
    n = sizes(labels, by, label).withColumn("n", F.sum("size").over(Window.partitionBy(*by)))
    return n.groupBy(*by).agg(F.when(F.max("n") >= k, F.sum(1 - draw_without("n", "size", F.lit(k)))).alias(f"df_at_{k}"))


def discovery_auc(curve: DataFrame, by: list[str], k_max: int | None = None) -> DataFrame:
    """auc (trapezoids over the width; the value itself at width 0), k_used, and a reason where it can't be told."""
    order = Window.partitionBy(*by).orderBy("k")
    used = curve if k_max is None else curve.filter(F.col("k") <= k_max)
    steps = used.withColumn("_area", (F.col("df") + F.lag("df").over(order)) / 2)
    out = steps.groupBy(*by).agg(F.max("k").alias("k_used"), F.sum("_area").alias("_sum"), F.max("df").alias("_one"))
    value = F.when(F.col("k_used") == 1, F.col("_one")).otherwise(F.col("_sum") / (F.col("k_used") - 1))
    short = F.lit(False) if k_max is None else F.col("k_used") < k_max
    reason = F.when(short, F.concat(F.lit("population N="), F.col("k_used").cast("string"), F.lit(f" is smaller than requested K={k_max}")))
    return out.select(*by, F.when(~short, value).alias("auc"), "k_used", reason.alias("reason"))


def adjusted_rand(labels: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n, ari of two labelings of the same rows (rows without either label don't count); ari is null with fewer than two rows.

    1 where the labelings agree by necessity (both all in one, or all apart).
    """
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    shared = labels.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = shared.groupBy(*by, a, b).agg(F.count("*").alias("c"))
    pair = cells.groupBy(*by).agg(F.sum(two("c")).alias("_ij"), F.sum("c").alias("n"))
    for side in (a, b):
        one = cells.groupBy(*by, side).agg(F.sum("c").alias("c")).groupBy(*by).agg(F.sum(two("c")).alias(f"_{side}"), F.count("*").alias(f"n_{side}"))
        pair = pair.join(one, by) if by else pair.crossJoin(one)  # one row each
    expected = F.col(f"_{a}") * F.col(f"_{b}") / two("n")
    most = (F.col(f"_{a}") + F.col(f"_{b}")) / 2
    ari = F.when(F.col("n") >= 2, F.when(most == expected, 1.0).otherwise((F.col("_ij") - expected) / (most - expected)))
    return pair.select(*by, "n", f"n_{a}", f"n_{b}", ari.alias("ari"))


def agreement(labels: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """ARI of a behavior report: null with a reason where a side has one label only or each row its own."""
    out = adjusted_rand(labels, by, a, b)
    trivial = lambda c: (F.col(c) == 1) | (F.col(c) == F.col("n"))
    reason = F.when(F.col("n") < 2, "fewer than two shared runs").when(trivial(f"n_{a}"), f"{a} is a trivial partition").when(trivial(f"n_{b}"), f"{b} is a trivial partition")
    return out.withColumn("reason", reason).withColumn("ari", F.when(F.col("reason").isNull(), F.col("ari")))


def exact_repetition(rows: DataFrame, by: list[str], digest: str, run: str) -> DataFrame:
    """n, distinct, unique_rate, modal_share by group; the rates are null if any digest is missing."""
    groups = rows.groupBy(*by, digest).agg(F.count("*").alias("size"))
    out = groups.groupBy(*by).agg(F.sum("size").alias("n"), F.count(digest).alias("distinct_hashes"), F.max("size").alias("_top"), F.bool_or(F.col(digest).isNull()).alias("_gap"))
    whole = ~F.col("_gap")
    return out.select(*by, "n", "distinct_hashes", F.when(whole, rate("distinct_hashes", "n")).alias("unique_rate"), F.when(whole, rate("_top", "n")).alias("modal_share"))


def repetition_groups(rows: DataFrame, by: list[str], digest: str, run: str, least: int = 2) -> DataFrame:
    """digest, count and first run of each group of at least `least` equal digests; members come by joining back on the digest."""
    return rows.filter(F.col(digest).isNotNull()).groupBy(*by, digest).agg(F.count("*").alias("count"), F.min(run).alias("first_run")).filter(F.col("count") >= least)


def stable_labels(labels: DataFrame, by: list[str], label: str, run: str) -> DataFrame:
    """Labels renumbered from 0 by descending size, then smallest run."""
    groups = labels.groupBy(*by, label).agg(F.count("*").alias("_n"), F.min(run).alias("_m"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_m")) - 1
    return labels.join(groups.withColumn("family_id", nth).select(*by, label, "family_id"), [*by, label])
