"""Calibration of scores into likelihood ratios, for every group of ``by`` in one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.functions.columns import POSTERIOR_FLOOR, logistic_lr, verbal_weight
from surfmatch.functions.helpers import balanced_logistic
from surfmatch.operators import newton
from surfmatch.operators.metrics import pav_blocks

LEAST_TRAIN = 3


def score_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n of each (score, label): all that a one-dimensional fit needs; of rows, or of counts in a column n."""
    return df.groupBy(*by, "score", "label").agg((F.sum("n") if "n" in df.columns else F.count("*")).alias("n"))


def fit_counts(counts: DataFrame, by: tuple[str, ...], least: int = 1) -> DataFrame:
    """Models of counts(by, score, label, n) from grouped sums; groups with fewer than ``least`` of a class are left out."""
    return newton.fit_groups(counts, by, least)


def fit_logistic(df: DataFrame, by: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """Slope, intercept and bound of a class-balanced logistic fit of label on score."""
    return fit_counts(score_counts(df, by), by, least)


def apply_logistic(df: DataFrame, models: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """df with lr and bound_hit. One model row for each group; the single row of no groups is broadcast, groups are joined as their number demands."""
    small = models.select(*by, "coef", "intercept", "log_bound")
    joined = df.join(small, list(by), "left") if by else df.join(F.broadcast(small.limit(1)))
    lr, hit = logistic_lr(F.col("score"), F.col("coef"), F.col("intercept"), F.col("log_bound"))
    return joined.select(*df.columns, lr.alias("lr"), hit.alias("bound_hit"))


def apply_isotonic(df: DataFrame, train: DataFrame) -> DataFrame:
    """df with the lr of an isotonic fit on train: linear between knots, constant beyond, prior odds divided out.

    Knots are the ends of the fitted blocks. Their number is that of blocks, so a
    query score meets only the two knots around it.
    """
    blocks = pav_blocks(train)
    p = F.least(F.greatest(F.col("pos") / F.col("n"), F.lit(POSTERIOR_FLOOR)), F.lit(1 - POSTERIOR_FLOOR))
    knots = blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), p.alias("p"))
    odds = train.agg((F.sum("label") / F.sum(1 - F.col("label"))).alias("odds"))
    table = knots.agg(F.array_sort(F.collect_list(F.struct("x", "p"))).alias("knots")).join(odds)
    rows = df.join(F.broadcast(table))
    at = F.size(F.filter("knots", lambda k: k["x"] <= F.col("score")))
    left, right = F.element_at("knots", F.greatest(at, F.lit(1))), F.element_at("knots", F.least(at + 1, F.size("knots")))
    share = F.when(right["x"] > left["x"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - left["x"]) / (right["x"] - left["x"])))).otherwise(F.lit(0.0))
    post = left["p"] + share * (right["p"] - left["p"])
    return rows.select(*df.columns, (post / (1 - post) / F.col("odds")).alias("lr"))


def report(df: DataFrame) -> DataFrame:
    """df(lr, ...) with log10_lr, direction and wording."""
    value = F.log10("lr")
    return df.withColumns({"log10_lr": value, "direction": F.when(F.col("lr") > 1, F.lit("same source")).otherwise(F.lit("different sources")), "verbal": verbal_weight(value)})


def leave_sources_out(pairs: DataFrame, least: int = LEAST_TRAIN) -> DataFrame:
    """Models for every set {a, b} of sources that some pair of pairs(source_a, source_b, score, label[, n]) has, fitted without both."""
    return newton.fit_without(pairs, least)


def leave_sources_out_lrs(pairs: DataFrame) -> DataFrame:
    """pairs with the lr of the model that saw neither of their sources; null where too little was left to fit."""
    models = leave_sources_out(pairs)
    keyed = pairs.withColumns({"a": F.least("source_a", "source_b"), "b": F.greatest("source_a", "source_b")})
    return apply_logistic(keyed, models, ("a", "b")).drop("a", "b")


def fit_fusion(df: DataFrame, features: tuple[str, ...], by: tuple[str, ...] = (), ridge: float = 1.0) -> DataFrame:
    """Standardized logistic fit of label on several features: means, deviations, coefficients, intercept, bound; of rows, or of counts in a column n."""
    df = df if "n" in df.columns else df.withColumn("n", F.lit(1))
    df, own = (df, by) if by else (df.withColumn("all", F.lit(0)), ("all",))
    kinds, k = dict(df.dtypes), len(features)
    moments = [f"{m}_{f}" for m in ("mean", "sd") for f in features]
    counts = df.groupBy(*own, "label", *features).agg(F.sum("n").alias("n"))
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in own), "coef array<double>, intercept double, log_bound double", *(f"{m} double" for m in moments)])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, label, n = part[list(features)].to_numpy(float), part["label"].to_numpy(float), part["n"].to_numpy(float)
        mean = n @ x / n.sum()
        sd = np.sqrt(n @ (x - mean) ** 2 / n.sum())
        z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1.0), 0.0)
        beta = balanced_logistic(z, label, n, ridge)
        few = min(n[label == y].sum() for y in (0, 1))
        found = {"coef": [beta[:k].tolist()], "intercept": [beta[k]], "log_bound": [np.log10(max(few, 10))]}
        return pd.DataFrame({**{b: [part[b].iloc[0]] for b in own}, **found, **dict(zip(moments, [[v] for v in (*mean, *sd)]))})

    models = counts.groupBy(*own).applyInPandas(fit, schema)
    return models if by else models.drop("all")


def coefficients(models: DataFrame, features: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, feature, coef, mean, sd, intercept: what a fusion makes of each feature, by name."""
    terms = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("coef")[i].alias("coef"), F.col(f"mean_{f}").alias("mean"), F.col(f"sd_{f}").alias("sd")) for i, f in enumerate(features)])
    return models.select(*by, F.explode(terms).alias("t"), "intercept").select(*by, "t.*", "intercept")


def decision_values(df: DataFrame, models: DataFrame, features: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """df with the fused decision value, without a bound: standardized features times their coefficients, and the intercept."""
    moments = [f"{m}_{f}" for m in ("mean", "sd") for f in features]
    found = models.select(*by, "coef", "intercept", "log_bound", *moments)
    rows = df.join(found, list(by)) if by else df.join(F.broadcast(found.limit(1)))
    terms = [F.when(F.col(f"sd_{f}") > 0, (F.col(f) - F.col(f"mean_{f}")) / F.col(f"sd_{f}")).otherwise(F.lit(0.0)) * F.col("coef")[i] for i, f in enumerate(features)]
    return rows.select(*df.columns, (sum(terms[1:], terms[0]) + F.col("intercept")).alias("fused"), "log_bound")


def apply_fusion(df: DataFrame, models: DataFrame, features: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """df with the fused decision value and its lr."""
    rows = decision_values(df, models, features, by)
    lr, _ = logistic_lr(F.col("fused"), F.lit(1.0), F.lit(0.0), F.col("log_bound"))
    return rows.withColumn("lr", lr).drop("log_bound")
