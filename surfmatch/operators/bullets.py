"""Bullets, each a set of lands: compared by the matrix of all their lands' alignments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.functions.helpers import lag_matrix
from surfmatch.functions.reuse import reused
from surfmatch.operators import calibration, consensus, matrices, signals
from surfmatch.operators.pairs import score_pairs


def packed(lands: DataFrame) -> DataFrame:
    """bullet and its signatures in the order of land, of lands(bullet, land, signature). A bullet has few lands."""
    rows = lands.groupBy("bullet").agg(F.array_sort(F.collect_list(F.struct("land", "signature"))).alias("lands"))
    return rows.select("bullet", F.transform("lands", lambda x: x["signature"]).alias("lands"))


def land_matrix(pairs: DataFrame, lands: DataFrame) -> DataFrame:
    """pair_id, i, j, ccf, lag, error of every land of A against every land of B, of pairs(pair_id, bullet_a, bullet_b).

    Lands are numbered from 0. A bullet travels with all its lands to the blocks of pairs
    that ask for it, and all cells of a pair come from one batch of transforms. Cells of a
    missing or empty signature are null; a pair that fails is one row of nulls and its error.
    """

    def one(a: dict, b: dict) -> list[tuple]:
        lag, ccf = lag_matrix(*([None if x is None else np.asarray(x, float) for x in bullet["lands"]] for bullet in (a, b)))
        return [(i, j, None if np.isnan(c) else float(c), None if np.isnan(at) else float(at)) for (i, j), c, at in zip(np.ndindex(ccf.shape), ccf.ravel(), lag.ravel())]

    asked = pairs.select("pair_id", F.col("bullet_a").alias("mark_a"), F.col("bullet_b").alias("mark_b"))
    return score_pairs(asked, packed(lands).withColumnRenamed("bullet", "mark"), one, "i int, j int, ccf double, lag double").drop("mark_a", "mark_b")


def best_lands(cells: DataFrame) -> DataFrame:
    """The strongest land of A on each pair's winning diagonal (the first of equals to 12 digits), its partner, ccf and lag."""
    first = F.min(F.struct((-F.round("ccf", 12)).alias("order"), "i", "j", "ccf", "lag")).alias("x")
    best = matrices.best_diagonal(cells.where("ccf is not null")).groupBy("pair_id").agg(first)
    return best.select("pair_id", F.col("x.i").alias("best_land_a"), F.col("x.j").alias("best_land_b"), F.col("x.ccf").alias("best_land_ccf"), F.col("x.lag").alias("best_land_lag"))


def compare(pairs: DataFrame, lands: DataFrame, kind: str = "diag_contrast") -> DataFrame:
    """A row a pair: its score (a feature of the matrix), all features, numbers of lands and the best land pair; nulls where nothing could be aligned."""
    cells = reused(land_matrix(pairs, lands))
    sizes = cells.groupBy("pair_id").agg((F.max("i") + 1).alias("n_lands_a"), (F.max("j") + 1).alias("n_lands_b"))
    out = pairs.select("pair_id", "bullet_a", "bullet_b")
    for part in (sizes, matrices.features(cells.where("ccf is not null")), best_lands(cells)):
        out = out.join(part, "pair_id", "left")
    return out.withColumn("score", F.col(kind))


def attribution(compared: DataFrame, lands: DataFrame, least: float, tolerance: float, window: int = 0, step: int = 0) -> DataFrame:
    """The windows of each pair's best lands that agree on one lag, as stretches of either land; compared is what compare returns."""
    of = packed(lands).select("bullet", F.posexplode("lands").alias("at", "signature"))
    marks = of.select(F.concat_ws("/", "bullet", "at").alias("mark"), "signature", F.size("signature").cast("double").alias("length"))
    names = [F.concat_ws("/", f"bullet_{s}", f"best_land_{s}").alias(f"mark_{s}") for s in "ab"]
    chosen = compared.where("best_land_a is not null").select("pair_id", *names)
    votes = signals.vote_pairs(chosen.select("mark_a", "mark_b"), marks, window, step).where("error is null").drop("error").join(chosen, ["mark_a", "mark_b"])
    sizes = chosen.join(marks.select(F.col("mark").alias("mark_a"), F.col("length").alias("length_a")), "mark_a").join(marks.select(F.col("mark").alias("mark_b"), F.col("length").alias("length_b")), "mark_b")
    found = consensus.members(votes, least, {"lag": tolerance})
    return consensus.bands(found.join(sizes.select("pair_id", "length_a", "length_b"), "pair_id"))


def labelled_lands(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """score and label of the lands on the winning diagonals, each with its pair's label."""
    return matrices.best_diagonal(cells).join(pairs.select("pair_id", "label"), "pair_id").select(F.col("ccf").alias("score"), "label")


def land_evidence(cells: DataFrame, train: DataFrame, method: str = "logistic") -> DataFrame:
    """pair_id, i, j, ccf, lag, lr of the lands on the winning diagonals, calibrated on train(score, label) of single lands.

    Lands of a bullet are not independent: their LRs show where the evidence lies.
    """
    rows = matrices.best_diagonal(cells).withColumn("score", F.col("ccf"))
    if method == "isotonic":
        scored = calibration.apply_isotonic(rows, train)
    else:
        scored = calibration.apply_logistic(rows, calibration.fit_logistic(train))
    return scored.select("pair_id", "i", "j", "ccf", "lag", "lr")


def fused_lands(cells: DataFrame, train: DataFrame, method: str = "logistic") -> DataFrame:
    """pair_id, fused (sum of the lands' log10 LR) and n_lands, calibrated on train(score, label) of single lands."""
    return land_evidence(cells, train, method).groupBy("pair_id").agg(F.sum(F.log10("lr")).alias("fused"), F.count("*").alias("n_lands"))
