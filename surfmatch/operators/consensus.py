"""Congruent matching regions from votes: one row a vote, of any number of transform parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def congruent(votes: DataFrame, corr_least: float, tolerance: dict[str, float]) -> DataFrame:
    """pair_id, region_id (anchor), member: strong votes of a pair whose parameters all lie within the tolerances of the anchor's.

    votes(pair_id, region_id, corr, parameters). Votes of a pair are few (regions of one mark).
    """
    strong = votes.where(F.col("corr") >= corr_least).select("pair_id", "region_id", *tolerance)
    a, b = (strong.select("pair_id", *[F.col(c).alias(f"{c}_{s}") for c in ("region_id", *tolerance)]) for s in "ab")
    near = F.lit(True)
    for name, most in tolerance.items():
        near = near & (F.abs(F.col(f"{name}_b") - F.col(f"{name}_a")) <= most)
    return a.join(b, "pair_id").where(near).select("pair_id", F.col("region_id_a").alias("region_id"), F.col("region_id_b").alias("member"))


def consensus(votes: DataFrame, corr_least: float, tolerance: dict[str, float]) -> DataFrame:
    """pair_id, anchor, n: the largest congruent cluster; the first anchor of equals."""
    counts = congruent(votes, corr_least, tolerance).groupBy("pair_id", "region_id").agg(F.count("*").alias("n"))
    best = counts.groupBy("pair_id").agg(F.max(F.struct("n", (-F.col("region_id")).alias("order"))).alias("best"))
    return best.select("pair_id", (-F.col("best.order")).alias("anchor"), F.col("best.n").alias("n"))


def members(votes: DataFrame, corr_least: float, tolerance: dict[str, float]) -> DataFrame:
    """The votes of each pair's consensus."""
    best = consensus(votes, corr_least, tolerance).select("pair_id", F.col("anchor").alias("region_id"))
    chosen = congruent(votes, corr_least, tolerance).join(best, ["pair_id", "region_id"]).select("pair_id", F.col("member").alias("region_id"))
    return votes.join(chosen, ["pair_id", "region_id"], "left_semi")


def cmr_scores(pairs: DataFrame, votes: DataFrame, corr_least: float, tolerance: dict[str, float]) -> DataFrame:
    """pairs with cmr: the size of the consensus, 0 where no vote is strong."""
    best = consensus(votes, corr_least, tolerance).select("pair_id", F.col("n").alias("cmr"))
    return pairs.join(best, "pair_id", "left").withColumn("cmr", F.coalesce("cmr", F.lit(0)))


def bands(found: DataFrame, length_a: str = "length_a", length_b: str = "length_b") -> DataFrame:
    """Attribution of one-dimensional members(pair_id, region_id, home, window, lag, corr, lengths): where each lies on A and on B."""
    at_b = F.col("home") + F.col("lag")
    return found.select(
        "pair_id", "region_id", "corr",
        F.col("home").alias("x_a"), (F.col("home") / F.col(length_a)).alias("x_frac_a"), (F.col("window") / F.col(length_a)).alias("w_frac_a"),
        F.bround(at_b).cast("long").alias("x_b"), (at_b / F.col(length_b)).alias("x_frac_b"), (F.col("window") / F.col(length_b)).alias("w_frac_b"),
    )


def boxes(found: DataFrame, on_b: bool = False) -> DataFrame:
    """Attribution of two-dimensional members(pair_id, region_id, y, x, h, w, dy, dx, corr, ny, nx): the box of each and its shares of the map.

    Boxes lie where they are on A, or with ``on_b`` where they match on B, kept inside the
    map; ny and nx are the map's own size. Places are rounded half to even, shares are not.
    """

    def place(at: str, shift: str, size: str, limit: str) -> Column:
        if not on_b:
            return F.col(at).cast("double")
        room = F.greatest(F.col(limit) - F.col(size), F.lit(0)).cast("double")
        return F.least(F.greatest(F.col(at) + F.col(shift), F.lit(0.0)), room)

    y, x = place("y", "dy", "h", "ny"), place("x", "dx", "w", "nx")
    share = lambda value, limit: F.try_divide(value, F.col(limit))
    return found.select(
        "pair_id", "region_id", F.bround(y).cast("int").alias("y"), F.bround(x).cast("int").alias("x"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "corr",
        share(y, "ny").alias("y_frac"), share(x, "nx").alias("x_frac"), share(F.col("h"), "ny").alias("h_frac"), share(F.col("w"), "nx").alias("w_frac"),
    )
