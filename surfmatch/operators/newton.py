"""Class-balanced logistic fits from grouped sums: no task ever holds the scores of a group.

The loss of a group, as a function of its two coefficients, is expanded about an anchor:
every term up to ORDER is a sum over pairs, taken by one aggregation, and Newton's steps
then run on the expansion. About an anchor not further off than RADIUS in log odds, over
the whole range of scores, the expansion leaves an error below 1e-9.

Sums add up, which gives leave-sources-out fits for every set {a, b} at once: all pairs,
less those touching a, less those touching b, plus those of both. Sets lie close to the
fit of all pairs when sources are many, so they share a few anchors, whatever their number;
those that do not start from bins of their own, which add up likewise.
"""

from __future__ import annotations

from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmatch.functions.helpers import balanced_logistic
from surfmatch.functions.reuse import reused

RIDGE = 1e-6
#: Terms kept of the expansion, how far it is trusted in the end, how far one step may go, and the distance of shared anchors.
ORDER, RADIUS, STRIDE, SPACING = 6, 0.1, 2.0, 0.15
#: Bins of the first, rough fit, and anchors that one reading of the pairs serves.
BINS, ANCHORS = 1024, 512
ROUNDS = 100
TERMS = [(k, i) for k in range(1, ORDER + 1) for i in range(k + 1)]


def ranged(counts: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """n_km, n_knm, and middle and half of the range of scores, of every group."""
    n = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).cast("long")
    half = (F.max("score") - F.min("score")) / 2
    return counts.groupBy(*own).agg(n(1).alias("n_km"), n(0).alias("n_knm"), ((F.max("score") + F.min("score")) / 2).cast("double").alias("mid"), F.when(half > 0, half).otherwise(1.0).cast("double").alias("half"))


def scaled(counts: DataFrame, ranges: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """counts with u, the score brought to -1 .. 1."""
    u = (F.col("score") - F.col("mid")) / F.col("half")
    return counts.join(ranges.select(*own, "mid", "half"), list(own)).select(*[c for c in counts.columns if c != "score"], u.alias("u"))


def expansions(rows: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """own and terms, the sums of the expansion about (slope, level) of rows(own, u, label, n, slope, level), same-source pairs before different-source ones.

    Sums are taken batch by batch first, so few rows move, whatever the group.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in own), "terms array<double>"])

    def run(batches):
        for part in batches:
            if len(part):
                code, first = np.unique(part.groupby(list(own), dropna=False, sort=False).ngroup().to_numpy(), return_index=True)
                group = np.searchsorted(code, part.groupby(list(own), dropna=False, sort=False).ngroup().to_numpy())
                u, n, label = (part[c].to_numpy(float) for c in ("u", "n", "label"))
                p = 0.5 * (1 + np.tanh((part["slope"].to_numpy(float) * u + part["level"].to_numpy(float)) / 2))
                d, q = p * (1 - p), 1 - 2 * p
                derivatives = [None, d, d * q, d * (1 - 6 * d), d * q * (1 - 12 * d), d * (1 - 30 * d + 120 * d * d)]
                sums = np.empty((len(code), 2 * len(TERMS)))
                for half, y in enumerate((1, 0)):
                    weight = n * (label == y)
                    for at, (k, i) in enumerate(TERMS):
                        value = p - y if k == 1 else derivatives[k - 1]
                        sums[:, half * len(TERMS) + at] = np.bincount(group, weight * value * u**i, len(code))
                yield part.iloc[first][list(own)].assign(terms=list(sums))

    part = rows.select(*own, "u", "label", "n", "slope", "level").mapInPandas(run, schema)
    return part.groupBy(*own).agg(added("terms"))


def added(terms: str) -> Column:
    return F.array(*[F.sum(F.get(terms, F.lit(i))) for i in range(2 * len(TERMS))]).alias(terms)


def step(terms: np.ndarray, n_km: np.ndarray, n_knm: np.ndarray, slope: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Newton's steps on the expansions of many groups at once: what to add to slope and level, at most STRIDE in log odds."""
    n = n_km + n_knm
    km, knm = terms[:, : len(TERMS)], terms[:, len(TERMS) :]
    c = (n / (2 * n_km))[:, None] * km + (n / (2 * n_knm))[:, None] * knm
    c = c * np.array([comb(k, i) / factorial(k) for k, i in TERMS])
    ridge = RIDGE / half**2
    at = np.zeros((len(n), 2))

    def part(da: int, db: int) -> np.ndarray:
        """The derivative, da times by slope and db times by level, at ``at``."""
        total = np.zeros(len(n))
        for column, (k, i) in enumerate(TERMS):
            j = k - i
            if i >= da and j >= db:
                total += c[:, column] * factorial(i) / factorial(i - da) * factorial(j) / factorial(j - db) * at[:, 0] ** (i - da) * at[:, 1] ** (j - db)
        return total

    for _ in range(25):
        ga, gb = part(1, 0) + ridge * (slope + at[:, 0]), part(0, 1)
        haa, hab, hbb = part(2, 0) + ridge, part(1, 1), part(0, 2) + 1e-12
        det = haa * hbb - hab * hab
        fine = (det > 0) & (haa > 0)
        det = np.where(fine, det, 1.0)
        move = np.column_stack([np.where(fine, (hbb * ga - hab * gb) / det, np.sign(ga)), np.where(fine, (haa * gb - hab * ga) / det, np.sign(gb))])
        at = at - move
        far = np.abs(at).sum(1)
        at = np.where((far > STRIDE)[:, None], at * (STRIDE / np.maximum(far, STRIDE))[:, None], at)
        if np.abs(move).max(initial=0.0) < 1e-13:
            break
    return at


def stepped(held: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """held(own, terms, n_km, n_knm, mid, half, slope, level) with slope and level moved and how far in log odds."""
    kinds = dict(held.dtypes)
    names = [*own, "n_km", "n_knm", "mid", "half"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "slope double, level double, moved double"])

    def run(batches):
        for rows in batches:
            if len(rows):
                move = step(np.stack(rows["terms"].to_numpy()), *(rows[c].to_numpy(float) for c in ("n_km", "n_knm", "slope", "half")))
                out = rows[names].copy()
                out["slope"], out["level"], out["moved"] = rows["slope"] + move[:, 0], rows["level"] + move[:, 1], np.abs(move).sum(1)
                yield out

    return held.select(*names, "terms", "slope", "level").mapInPandas(run, schema)


def finished(models: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """Coefficients on the scores as they are, and the bound of the log LR."""
    coef = F.col("slope") / F.col("half")
    bound = F.log10(F.greatest(F.least("n_km", "n_knm"), F.lit(10)).cast("double"))
    return models.select(*own, coef.alias("coef"), (F.col("level") - coef * F.col("mid")).alias("intercept"), bound.alias("log_bound"), "n_km", "n_knm")


def binned(rows: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """n and nu, the number of pairs and the sum of their u, of every bin of a class and group."""
    bin_ = F.least(F.floor((F.col("u") + 1) / 2 * BINS), F.lit(BINS - 1))
    return rows.groupBy(*own, "label", bin_.alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("u")).alias("nu"))


def rough(bins: DataFrame, sizes: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """slope and level of each group from the means of its bins, BINS a class at most; sizes(own, half)."""
    kinds = dict(bins.dtypes)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        n = part["n"].to_numpy(float)
        slope, level = balanced_logistic(part["nu"].to_numpy(float) / n, part["label"].to_numpy(float), n, RIDGE / float(part["half"].iloc[0]) ** 2)
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in own}, "slope": [slope], "level": [level]})

    return bins.join(sizes.select(*own, "half"), list(own)).groupBy(*own).applyInPandas(fit, ", ".join([*(f"{c} {kinds[c]}" for c in own), "slope double, level double"]))


def rough_without(joining: DataFrame, sets: DataFrame) -> DataFrame:
    """slope and level of sets(a, b, half, ...) from bins of all pairs that touch neither: bins add up as the terms do."""
    cells = reused(binned(joining, ("a", "b")))
    total = cells.groupBy("label", "bin").agg(F.sum("n").alias("n"), F.sum("nu").alias("nu"))
    touching = cells.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("s"), "label", "bin", "n", "nu").groupBy("s", "label", "bin").agg(F.sum("n").alias("n"), F.sum("nu").alias("nu"))
    asked = sets.select("a", "b")
    two = asked.where("a <> b")
    gone = [part.select("a", "b", "label", "bin", (-F.col("n")).alias("n"), (-F.col("nu")).alias("nu")) for part in (asked.join(touching.withColumnRenamed("s", "a"), "a"), two.join(touching.withColumnRenamed("s", "b"), "b"))]
    counts = asked.join(F.broadcast(total)).union(gone[0]).union(gone[1]).union(two.join(cells, ["a", "b"]).select("a", "b", "label", "bin", "n", "nu"))
    counts = counts.groupBy("a", "b", "label", "bin").agg(F.sum("n").alias("n"), F.sum("nu").alias("nu")).where("n > 0")
    return rough(counts, sets, ("a", "b"))


def fitted(counts: DataFrame, own: tuple[str, ...], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Settled models (own, n_km, n_knm, mid, half, slope, level, moved) of counts(own, score, label, n), and the ranges they rest on."""
    counts = counts.where("n > 0")
    ranges = reused(ranged(counts, own).where((F.col("n_km") >= max(least, 1)) & (F.col("n_knm") >= max(least, 1))))
    rows = scaled(counts, ranges, own)
    models = rough(binned(rows, own), ranges, own)
    for _ in range(ROUNDS):
        terms = expansions(rows.join(models.select(*own, "slope", "level"), list(own)), own)
        models = reused(stepped(terms.join(ranges, list(own)).join(models.select(*own, "slope", "level"), list(own)), own))
        if not models.where(F.col("moved") > RADIUS).take(1):
            break
    return models, ranges


def fit_groups(counts: DataFrame, by: tuple[str, ...], least: int = 1) -> DataFrame:
    """Models of counts(by, score, label, n); groups with fewer than ``least`` of a class are left out."""
    own = by or ("all",)
    models, _ = fitted(counts if by else counts.withColumn("all", F.lit(0)), own, least)
    out = finished(models, own)
    return out if by else out.drop("all")


def less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def without(joining: DataFrame, sets: DataFrame, anchors: DataFrame) -> DataFrame:
    """sets(a, b, anchor) with the terms of all pairs that touch neither a nor b, about their anchor."""
    own = reused(expansions(joining.join(F.broadcast(anchors)), ("anchor", "a", "b")))
    total = own.groupBy("anchor").agg(added("terms"))
    touching = own.select("anchor", F.explode(F.array_distinct(F.array("a", "b"))).alias("s"), "terms").groupBy("anchor", "s").agg(added("terms"))
    out = sets.join(F.broadcast(total), "anchor")
    for side in "ab":
        out = out.join(touching.select("anchor", F.col("s").alias(side), F.col("terms").alias(f"terms_{side}")), ["anchor", side])
    out = out.join(own.select("anchor", "a", "b", F.col("terms").alias("both")), ["anchor", "a", "b"])
    one, two = less(F.col("terms"), F.col("terms_a")), less(F.col("terms_b"), F.col("both"))
    return out.select(*sets.columns, F.when(F.col("a") == F.col("b"), one).otherwise(less(one, two)).alias("terms"))


def fit_without(pairs: DataFrame, least: int) -> DataFrame:
    """Models for every set {a, b} of sources that some pair of pairs(source_a, source_b, score, label) has, fitted without both.

    Pairs are read once for each round of anchors: one where every set lies near the fit
    of all pairs, and one more for each ANCHORS anchors that sets further off need.
    """
    low, high = F.least("source_a", "source_b"), F.greatest("source_a", "source_b")
    n = F.sum("n") if "n" in pairs.columns else F.count("*")
    joining = reused(pairs.groupBy(low.alias("a"), high.alias("b"), "score", "label").agg(n.cast("long").alias("n")))
    start, ranges = fitted(joining.groupBy("score", "label").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)), ("all",))
    joining = reused(scaled(joining.withColumn("all", F.lit(0)), ranges, ("all",)))
    kind = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    held = joining.groupBy("a", "b").agg(F.array(kind(1), kind(0)).alias("m"))
    touched = held.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("s"), "m").groupBy("s").agg(F.array(F.sum(F.col("m")[0]), F.sum(F.col("m")[1])).alias("m"))
    size = ranges.select("mid", "half", F.array("n_km", "n_knm").alias("every"))
    sets = held.join(touched.toDF("a", "ma"), "a").join(touched.toDF("b", "mb"), "b").join(F.broadcast(size))
    left = F.when(F.col("a") == F.col("b"), less(F.col("every"), F.col("ma"))).otherwise(less(less(F.col("every"), F.col("ma")), less(F.col("mb"), F.col("m"))))
    sets = sets.select("a", "b", left[0].alias("n_km"), left[1].alias("n_knm"), "mid", "half").where((F.col("n_km") >= least) & (F.col("n_knm") >= least))
    pending, done = reused(sets.join(F.broadcast(start.select(F.col("slope").alias("x"), F.col("level").alias("y"))))), []
    for _ in range(ROUNDS):
        anchors = reused(pending.select("x", "y").distinct().orderBy("x", "y").limit(ANCHORS).withColumn("anchor", F.monotonically_increasing_id()))
        now = pending.join(F.broadcast(anchors), ["x", "y"])
        found = without(joining, now, anchors.select("anchor", F.col("x").alias("slope"), F.col("y").alias("level")))
        moved = reused(stepped(found.withColumns({"slope": F.col("x"), "level": F.col("y")}), ("a", "b")))
        done.append(moved.where(F.col("moved") <= RADIUS))
        # ends of the range of scores, on a lattice: sets that need nearly the same anchor share it
        low, high = (F.round((F.col("level") + e * F.col("slope")) / SPACING) * SPACING for e in (-1, 1))
        far = moved.where(F.col("moved") > RADIUS)
        if len(done) == 1 and far.take(1):  # few steps lead far: sets away from the fit of all pairs start anew from their own bins
            far = reused(far.drop("slope", "level").join(rough_without(joining, far), ["a", "b"]))
        far = far.withColumns({"x": (high - low) / 2, "y": (high + low) / 2})
        waiting = pending.join(F.broadcast(anchors), ["x", "y"], "left_anti")
        pending = reused(far.select(*pending.columns).union(waiting.select(*pending.columns)))
        if not pending.take(1):
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return finished(out, ("a", "b"))
