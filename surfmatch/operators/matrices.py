"""Features of land-by-land matrices in long form: pair_id, i, j, ccf, lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagonals(cells: DataFrame) -> DataFrame:
    """cells with mm (lands of B) and k, the cyclic offset of j against i."""
    sizes = cells.groupBy("pair_id").agg((F.max("j") + 1).alias("mm"))
    return cells.join(sizes, "pair_id").withColumn("k", F.pmod(F.col("j") - F.col("i"), F.col("mm")))


def diagonal_means(cells: DataFrame) -> DataFrame:
    """pair_id, k, mean ccf along each offset."""
    return diagonals(cells).groupBy("pair_id", "k").agg(F.avg("ccf").alias("mean"))


def best_offset(cells: DataFrame) -> DataFrame:
    """pair_id, k, mean of the best offset (the first of equals) and offset_margin over the runner-up.

    Means are compared to 12 digits, so that equal sums in another order stay equal.
    """
    means = diagonal_means(cells).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("mean", 12)).alias("order"), "k", "mean"))).alias("m"))
    first, second = F.col("m")[0], F.try_element_at("m", F.lit(2))
    return means.select("pair_id", first["k"].alias("k"), first["mean"].alias("diag_mean"), F.when(second.isNull(), first["mean"]).otherwise(first["mean"] - second["mean"]).alias("offset_margin"))


def features(cells: DataFrame) -> DataFrame:
    """One row a pair: offset, diag_mean, diag_min, diag_contrast, offset_margin, lag_coherence; higher is more alike."""
    best = best_offset(cells)
    rows = diagonals(cells).join(best.select("pair_id", F.col("k").alias("best")), "pair_id")
    on, off = F.col("k") == F.col("best"), F.col("k") != F.col("best")
    per_pair = rows.groupBy("pair_id").agg(
        F.min(F.when(on, F.col("ccf"))).alias("diag_min"), F.coalesce(F.avg(F.when(off, F.col("ccf"))), F.lit(0.0)).alias("off_mean"), F.stddev_pop(F.when(on, F.col("lag"))).alias("lag_sd")
    )
    return best.join(per_pair, "pair_id").select(
        "pair_id", F.col("k").alias("offset"), "diag_mean", "diag_min", (F.col("diag_mean") - F.col("off_mean")).alias("diag_contrast"), "offset_margin", (1 / (1 + F.col("lag_sd"))).alias("lag_coherence")
    )


def best_diagonal(cells: DataFrame) -> DataFrame:
    """The cells of each pair's best offset: land pairs that match."""
    best = best_offset(cells).select("pair_id", "k")
    return diagonals(cells).join(best, ["pair_id", "k"]).select(*cells.columns)


def training_pairs(cells: DataFrame, pairs: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Positives along the best diagonals of same-source pairs; of the other pairs' cells, ratio times as many, the first by a seeded digest."""
    from surfmatch.operators.browsing import first_by_digest
    from surfmatch.operators.pairs import sampling_order

    good = best_diagonal(cells.join(pairs.where("label = 1").select("pair_id"), "pair_id", "left_semi"))
    most = int(ratio * good.count())
    other = cells.join(pairs.where("label = 0").select("pair_id"), "pair_id", "left_semi")
    chosen = first_by_digest(other, sampling_order(seed, F.col("pair_id"), F.col("i"), F.col("j")), most)
    return good.withColumn("label", F.lit(1)).union(chosen.withColumn("label", F.lit(0)))


def fused_evidence(cells: DataFrame, lr: str = "lr") -> DataFrame:
    """pair_id, fused: sum of log10 LR of single lands over the winning diagonal."""
    return best_diagonal(cells).groupBy("pair_id").agg(F.sum(F.log10(lr)).alias("fused"), F.count("*").alias("n_lands"))
