"""Measures of scores and likelihood ratios, each for every group of ``by`` in one plan.

Inputs hold label (1 same source, 0 different) and score or lr; a column n, where
there is one, says how many pairs a row stands for. Scores
are counted per distinct value first, so running sums meet distinct scores, not pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.functions.reuse import reused

from surfmatch.functions.columns import POSTERIOR_FLOOR
from surfmatch.functions.helpers import pool


def of_class(label: int, value: Column) -> Column:
    return F.when(F.col("label") == label, value)


def count_of(df: DataFrame) -> Column:
    """How many pairs a row stands for."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def cllr_columns(n: Column) -> list[Column]:
    mean = lambda y, cost: F.try_divide(F.sum(of_class(y, cost * n)), F.sum(of_class(y, n)))
    return [(0.5 * (mean(1, F.log2(1 + 1 / F.col("lr"))) + mean(0, F.log2(1 + F.col("lr"))))).alias("cllr")]


def cllr(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Log-likelihood-ratio cost."""
    return df.groupBy(*by).agg(*cllr_columns(count_of(df)))


def histogram_by_score(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pos and neg counts of each distinct score."""
    n = count_of(df)
    return df.groupBy(*by, "score").agg(F.sum(F.col("label") * n).cast("long").alias("pos"), F.sum((1 - F.col("label")) * n).cast("long").alias("neg"))


def with_running(hist: DataFrame, by: tuple[str, ...] = (), cuts: int = 64) -> DataFrame:
    """Adds pos_below and neg_below: sums over smaller scores of the group, in two levels so that no task gets a whole group."""
    marks = sorted(set(hist.approxQuantile("score", [i / cuts for i in range(1, cuts)], 0.01)))
    bucket = F.size(F.filter(F.array(*[F.lit(m) for m in marks]).cast("array<double>"), lambda m: m < F.col("score"))) if marks else F.lit(0)
    rows = hist.withColumn("bucket", bucket)
    totals = rows.groupBy(*by, "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "bucket", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    own = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"pos_in": F.coalesce(F.sum("pos").over(own), F.lit(0)), "neg_in": F.coalesce(F.sum("neg").over(own), F.lit(0))})
    rows = rows.join(totals, [*by, "bucket"])
    return rows.select(*by, "score", "pos", "neg", (F.col("p") + F.col("pos_in")).alias("pos_below"), (F.col("n") + F.col("neg_in")).alias("neg_below"))


def auc(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    rows = with_running(histogram_by_score(df, by), by)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return rows.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Corners of the ROC curve: threshold, fpr, tpr; points on a straight line between their neighbours are left out."""
    rows = with_running(histogram_by_score(df, by), by)
    group = Window.partitionBy(*by)
    down = group.orderBy(F.desc("score"))
    rows = rows.withColumns({"n1": F.sum("pos").over(group), "n0": F.sum("neg").over(group), "next_pos": F.lead("pos").over(down), "next_neg": F.lead("neg").over(down), "k": F.row_number().over(down)})
    corner = (F.col("k") == 1) | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = rows.where(corner).select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(F.col("n0") - F.col("neg_below"), "n0").alias("fpr"), F.try_divide(F.col("n1") - F.col("pos_below"), "n1").alias("tpr"),
    )
    origin = points.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")) if by else df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.union(points)


def eer(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal error rate: at the first corner where both rates are nearest, their mean."""
    points = roc_points(df, by).withColumn("fnr", 1 - F.col("tpr"))
    near = F.round(F.abs(F.col("fnr") - F.col("fpr")), 12)
    best = points.groupBy(*by).agg(F.min(F.struct(near.alias("gap"), (-F.col("threshold")).alias("order"), ((F.col("fpr") + F.col("fnr")) / 2).alias("eer"))).alias("best"))
    return best.select(*by, F.col("best.eer").alias("eer"))


def calibration_bins(df: DataFrame, by: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """Mean posterior and same-source share of equal bins of the posterior at even odds, the last one closed."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, bins + 1)[1:-1]])
    p = F.col("lr") / (1 + F.col("lr"))
    rows = df.select(*by, "label", p.alias("p"), count_of(df).alias("n")).withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("p"))))
    return rows.groupBy(*by, "bin").agg(F.sum("n").cast("long").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"), (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("share"))


def ece(df: DataFrame, by: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error."""
    rows = calibration_bins(df, by, bins)
    return rows.groupBy(*by).agg((F.sum(F.abs(F.col("mean_p") - F.col("share")) * F.col("n")) / F.sum("n")).alias("ece"))


def tippett(df: DataFrame, n: int = 100) -> DataFrame:
    """i, threshold, km and knm: shares of lr at or above n thresholds, evenly spaced in log10 from least to most."""
    # pairs are read once, for the count of each lr
    times = F.col("n") if "n" in df.columns else F.lit(1)
    df = reused(df.groupBy("lr").agg(F.sum(F.col("label") * times).alias("km"), F.sum((1 - F.col("label")) * times).alias("knm")))
    ends = df.agg(F.log10(F.min("lr") + 1e-12).alias("lo"), F.log10(F.max("lr") + 1e-12).alias("hi"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.pow(F.lit(10.0), F.col("lo") + (F.col("hi") - F.col("lo")) * i / (n - 1)).alias("t")))).alias("g")).select("g.*")
    # each lr is counted at the last threshold that it reaches; sums from above give the shares
    thresholds = grid.agg(F.array_sort(F.collect_list("t")).alias("ts"))
    reached = df.join(F.broadcast(thresholds)).select("km", "knm", F.size(F.filter("ts", lambda t: t <= F.col("lr"))).alias("reach")).groupBy("reach").agg(F.sum("km").alias("km"), F.sum("knm").alias("knm"))
    total = Window.orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, 0)
    spine = grid.select("i", "t", (F.col("i") + 1).alias("reach")).join(reached, "reach", "full_outer")
    rows = spine.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(total) for c in ("km", "knm")})
    size = df.agg(F.sum("km").alias("n1"), F.sum("knm").alias("n0"))
    return rows.where(F.col("i").isNotNull()).join(F.broadcast(size)).select("i", F.col("t").alias("threshold"), (F.col("km") / F.col("n1")).alias("km"), (F.col("knm") / F.col("n0")).alias("knm"))


def mean_of(label: int, value: Column, n: Column) -> Column:
    """Mean of a class, each row standing for n pairs; null values do not count."""
    known = F.when(value.isNotNull(), n)
    return F.try_divide(F.sum(of_class(label, value * n)), F.sum(of_class(label, known)).cast("double"))


def margin(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's d with pooled sample variance, and the gap between the 5th percentile of KM and the 95th of KNM; of rows, or of counts in a column n."""
    score = F.col("score")
    if "n" in df.columns:
        # squares are summed about a mean of the group, so that no large numbers cancel
        df = df.join(df.groupBy(*by).agg(mean_of(1, score, F.col("n")).alias("mean_1"), mean_of(0, score, F.col("n")).alias("mean_0")), list(by)) if by else df.join(F.broadcast(df.agg(mean_of(1, score, F.col("n")).alias("mean_1"), mean_of(0, score, F.col("n")).alias("mean_0"))))
        size = lambda y: F.coalesce(F.sum(of_class(y, F.col("n"))), F.lit(0))
        mean = {y: F.first(f"mean_{y}") for y in (0, 1)}
        squares = lambda y: F.coalesce(F.sum(of_class(y, F.pow(score - F.col(f"mean_{y}"), F.lit(2.0)) * F.col("n"))), F.lit(0.0))
        at = lambda y, p: F.percentile(of_class(y, score), F.lit(p), F.col("n"))
    else:
        size = lambda y: F.count(of_class(y, score))
        mean = {y: F.avg(of_class(y, score)) for y in (0, 1)}
        squares = lambda y: F.coalesce((F.count(of_class(y, score)) - 1) * F.var_samp(of_class(y, score)), F.lit(0.0))
        at = lambda y, p: F.percentile(of_class(y, score), F.lit(p))
    pooled = (squares(1) + squares(0)) / F.greatest(size(1) + size(0) - 2, F.lit(1))
    d = F.when(pooled > 0, (mean[1] - mean[0]) / F.sqrt(pooled)).otherwise(F.lit(0.0))
    both = (size(1) > 0) & (size(0) > 0)
    return df.groupBy(*by).agg(F.when(both, d).alias("cohens_d"), F.when(both, at(1, 0.05) - at(0, 0.95)).alias("pct_gap"))


def lr_separation(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean log10 LR of KM less that of KNM."""
    n, value = count_of(df), F.log10("lr")
    return df.groupBy(*by).agg((mean_of(1, value, n) - mean_of(0, value, n)).alias("lr_separation"))


def misleading_rates(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, cllr, shares of misleading evidence and of LRs at their bound."""
    n = count_of(df)
    hit = F.col("bound_hit").cast("double")
    return df.groupBy(*by).agg(
        F.sum(F.col("label") * n).alias("n_km"), F.sum((1 - F.col("label")) * n).alias("n_knm"), *cllr_columns(n),
        mean_of(1, (F.col("lr") < 1).cast("double"), n).alias("rmed"), mean_of(0, (F.col("lr") > 1).cast("double"), n).alias("rmep"),
        F.try_divide(F.sum(hit * n), F.sum(F.when(hit.isNotNull(), n)).cast("double")).alias("bound_limited"),
    )


def pav_blocks(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The isotonic fit of label on score: blocks lo, hi, pos, n of ever larger means.

    Distinct scores are range-partitioned and pooled locally; only surviving blocks
    meet in the last pooling, which gives the same as pooling all at once.
    """
    hist = histogram_by_score(df, by).withColumn("n", F.col("pos") + F.col("neg")).select(*by, F.col("score").alias("lo"), F.col("score").alias("hi"), "pos", "n")
    kinds = dict(hist.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "lo double, hi double, pos double, n double"])
    names = [*by, "lo", "hi", "pos", "n"]

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, part in rows.groupby(list(by), sort=False, dropna=False) if by else [((), rows)]:
            part = part.sort_values("lo")
            out += [(*key, a, b, p, n) for p, n, a, b in pool(part["pos"].to_numpy(float), part["n"].to_numpy(float), part["lo"].to_numpy(float), part["hi"].to_numpy(float))]
        return pd.DataFrame(out, columns=names)

    def part(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield local(pd.concat(held))

    pooled = hist.repartitionByRange(*by, "lo").mapInPandas(part, schema)
    return pooled.groupBy(*by).applyInPandas(local, schema)


def cllr_min(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cllr after isotonic calibration, posteriors clipped and prior odds divided out."""
    group = Window.partitionBy(*by)
    rows = pav_blocks(df, by).withColumns({"n1": F.sum("pos").over(group), "n0": F.sum(F.col("n") - F.col("pos")).over(group)})
    p = F.least(F.greatest(F.col("pos") / F.col("n"), F.lit(POSTERIOR_FLOOR)), F.lit(1 - POSTERIOR_FLOOR))
    lr = F.try_divide(p / (1 - p), F.try_divide(F.col("n1"), F.col("n0")))
    cost = F.sum(F.col("pos") * F.log2(1 + 1 / lr) / F.col("n1") + (F.col("n") - F.col("pos")) * F.log2(1 + lr) / F.col("n0"))
    return rows.where("n1 > 0 and n0 > 0").groupBy(*by).agg((0.5 * cost).alias("cllr_min"))


def score_histogram(df: DataFrame, bins: int = 24) -> DataFrame:
    """Counts of KM and KNM in equal bins from the least to the largest score, the last one closed."""
    ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    rows = df.join(F.broadcast(ends)).select("label", count_of(df).alias("n"), F.when(F.col("hi") > F.col("lo"), at).otherwise(F.lit(0)).cast("int").alias("bin"))
    return rows.groupBy("bin").agg(F.sum(F.col("label") * F.col("n")).alias("km"), F.sum((1 - F.col("label")) * F.col("n")).alias("knm"))


def histogram_markers(df: DataFrame, queries: DataFrame, bins: int = 24) -> DataFrame:
    """queries(query_id, score) with the bin of score_histogram(df) that each falls in, the nearest one if it lies outside, and whether it lies inside; null scores and empty histograms give nulls."""
    ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    s, lo, hi = F.col("score"), F.col("lo"), F.col("hi")
    at = F.when(hi > lo, F.least(F.greatest(F.floor((s - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))).when(s.isNotNull() & lo.isNotNull(), 0)
    return queries.join(F.broadcast(ends)).select("query_id", "score", F.when(s.isNotNull(), at).cast("int").alias("bin"), s.between(lo, hi).alias("inside"))


def km_knm_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number, mean and extremes of KM and KNM scores, and the difference of means."""
    s, n = F.col("score"), count_of(df)
    size = lambda y: F.coalesce(F.sum(of_class(y, F.when(s.isNotNull(), n))), F.lit(0)).cast("long")
    return df.groupBy(*by).agg(
        size(1).alias("n_km"), size(0).alias("n_knm"), mean_of(1, s, n).alias("mean_km"), mean_of(0, s, n).alias("mean_knm"),
        F.min(of_class(1, s)).alias("min_km"), F.max(of_class(0, s)).alias("max_knm"), (mean_of(1, s, n) - mean_of(0, s, n)).alias("separation"),
    )
