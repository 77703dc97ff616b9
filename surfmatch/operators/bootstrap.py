"""Bootstrap of calibrations and of Cllr, on counts instead of resampled rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.functions.columns import logistic_lr
from surfmatch.functions.reuse import reused
from surfmatch.operators.calibration import fit_counts, score_counts


def drawn(units: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """replicate, unit, w: how often each unit is drawn when as many are drawn as there are.

    units(unit) is a list of sources or clusters. Draws are seeded by digests of
    (seed, replicate, draw), so they are the same however data are partitioned.
    """
    parts = units.where(F.col("unit").isNotNull()).distinct().repartitionByRange("unit").withColumn("part", F.spark_partition_id())
    # the ranges are sampled, so they are drawn once for numbers and sizes
    parts = reused(parts.select("unit", "part"))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("unit")))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = parts.join(F.broadcast(before), "part").select("unit", (F.col("before") + F.col("rank")).cast("long").alias("place"))
    rows = units.sparkSession.range(replicates * n).select(F.expr(f"cast(id div {max(n, 1)} as int)").alias("replicate"), (F.col("id") % max(n, 1) + 1).alias("draw"))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("long")
    places = rows.select("replicate", (F.pmod(number, F.lit(max(n, 1))) + 1).alias("place")).groupBy("replicate", "place").agg(F.count("*").alias("w"))
    return places.join(numbered, "place").select("replicate", "unit", "w")


def source_sums(pairs: DataFrame) -> DataFrame:
    """s, t and the number and summed cost of scored pairs by their sources, s <= t: all that a replicate needs of its pairs, or of their counts in a column n."""
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    cost = lambda km: F.log2(1 + 1 / F.col("lr")) if km else F.log2(1 + F.col("lr"))
    ok = F.col("lr").isNotNull() & ~F.isnan("lr") & (F.abs("lr") < float("inf"))
    rows = pairs.where(ok).select(F.least("source_a", "source_b").alias("s"), F.greatest("source_a", "source_b").alias("t"), F.when(F.col("source_a") == F.col("source_b"), cost(True)).otherwise(cost(False)).alias("cost"), n.cast("long").alias("n"))
    return rows.groupBy("s", "t").agg(F.sum("n").alias("n"), F.sum(F.col("cost") * F.col("n")).alias("cost"))


def cllr_replicates(pairs: DataFrame, draws: DataFrame) -> DataFrame:
    """replicate, cllr (null where a class is missing): sources s and t drawn w and v times make w v copies of each of their
    pairs, one source drawn w times makes w w copies of each pair within it, all same-source."""
    sums = source_sums(pairs)
    a, b = draws.toDF("replicate", "s", "w"), draws.toDF("replicate", "t", "v")
    rows = sums.join(a, "s").join(b, ["replicate", "t"]).withColumn("copies", F.col("w") * F.col("v"))
    side = lambda same, x: F.sum(F.when((F.col("s") == F.col("t")) == same, F.col("copies") * F.col(x)))
    out = rows.groupBy("replicate").agg((0.5 * (F.try_divide(side(True, "cost"), side(True, "n")) + F.try_divide(side(False, "cost"), side(False, "n")))).alias("cllr"))
    return out


def interval(values: DataFrame, column: str, by: tuple[str, ...] = (), lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Linear percentiles of the replicates that have a value, and how many have none."""
    return values.groupBy(*by).agg(F.percentile(column, F.lit(lo)).alias("lo"), F.percentile(column, F.lit(hi)).alias("hi"), F.count(column).alias("n_used"), F.sum(F.col(column).isNull().cast("long")).alias("n_one_class"))


def calibration_ensemble(pairs: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """replicate and its model: whole pair clusters of pairs(cluster_id, score, label[, n]) drawn with replacement; one-class replicates left out."""
    draws = drawn(pairs.select(F.col("cluster_id").alias("unit")), replicates, seed)
    counts = score_counts(pairs, ("cluster_id",)).withColumnRenamed("n", "c")
    weighted = counts.join(draws, F.col("cluster_id") == F.col("unit")).groupBy("replicate", "score", "label").agg(F.sum(F.col("c") * F.col("w")).alias("n"))
    return fit_counts(weighted, ("replicate",))


def stratified_ensemble(pairs: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """replicate and its model: rows of either class of pairs(score, label) drawn with replacement, so that class sizes, and the bound with them, stay.

    Drawing rows is drawing counts of distinct scores from a multinomial distribution, seeded
    by (seed, replicate) over scores in order: the same however data are partitioned.
    A population without one of the classes gives no models.
    """
    counts = score_counts(pairs.where("score is not null")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    kinds = dict(counts.dtypes)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "score"], ignore_index=True)
        rng = np.random.default_rng([seed, int(rows["replicate"].iloc[0])])
        for label in (0, 1):
            own = (rows["label"] == label).to_numpy()
            n = rows.loc[own, "n"].to_numpy()
            if len(n):
                rows.loc[own, "n"] = rng.multinomial(n.sum(), n / n.sum())
        return rows

    drawn_counts = counts.groupBy("replicate").applyInPandas(draw, f"score {kinds['score']}, label {kinds['label']}, n long, replicate int")
    return fit_counts(drawn_counts, ("replicate",))


def lr_intervals(queries: DataFrame, ensemble: DataFrame, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """queries(query_id, score) with the percentiles of log10 LR over the ensemble and whether they straddle 0."""
    models = F.broadcast(ensemble.agg(F.collect_list(F.struct("coef", "intercept", "log_bound")).alias("models")))
    rows = queries.join(models).select(*queries.columns, F.explode("models").alias("m"))
    lr, _ = logistic_lr(F.col("score"), F.col("m.coef"), F.col("m.intercept"), F.col("m.log_bound"))
    out = rows.withColumn("v", F.log10(lr)).groupBy(*queries.columns).agg(F.percentile("v", F.lit(lo)).alias("lo"), F.percentile("v", F.lit(hi)).alias("hi"))
    return out.withColumn("straddles", (F.col("lo") < 0) & (F.col("hi") > 0))


def numpy_draws(sources: list[str], replicates: int, seed: int) -> list[tuple[int, str, int]]:
    """Draws as ``default_rng(seed).integers`` makes them, for parity with published intervals."""
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(replicates):
        own, n = np.unique(rng.integers(0, len(sources), size=len(sources)), return_counts=True)
        rows += [(r, sources[i], int(c)) for i, c in zip(own, n)]
    return rows


def ensemble_key(pairs: DataFrame, replicates: int, seed: int) -> str:
    """Identity of an ensemble: what its reference holds, in any row order, and its parameters."""
    content = pairs.groupBy("cluster_id", "score", "label").agg(F.count("*").alias("n")).agg(F.count("*"), F.bit_xor(F.xxhash64("cluster_id", "score", "label", "n")), F.sum(F.pmod(F.xxhash64("n", "label", "score", "cluster_id"), F.lit(1 << 40)))).first()
    return hashlib.sha256(repr((tuple(content), replicates, seed)).encode()).hexdigest()


def cached_ensemble(pairs: DataFrame, path: str, replicates: int, seed: int = 0) -> DataFrame:
    """The ensemble stored under its key below path; fitted and stored first where it is not there."""
    spark = pairs.sparkSession
    place = f"{path.rstrip('/')}/key={ensemble_key(pairs, replicates, seed)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        calibration_ensemble(pairs, replicates, seed).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
