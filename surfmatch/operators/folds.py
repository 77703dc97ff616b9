"""Source-disjoint folds, submissions scored on them, and what guards both."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.functions.columns import bad_lr, pair_id
from surfmatch.functions.reuse import reused
from surfmatch.operators import calibration, metrics
from surfmatch.operators.pairs import aligned, first_of, sampling_order

SPLITS, TEST_SHARE, SEED = 10, 0.4, 0
LEAST_TRAIN_KM, LEAST_TEST_KM = 3, 1
#: Sources below which no folds are made. Fixed value.
LEAST_SOURCES = 4


def sources_of(pairs: DataFrame) -> DataFrame:
    """Every source on either side, once."""
    return pairs.select(F.col("source_a").alias("source")).union(pairs.select("source_b")).distinct()


def held_out(pairs: DataFrame, splits: int = SPLITS, share: float = TEST_SHARE, seed: int = SEED, rng: str = "numpy") -> DataFrame:
    """fold, source: the sources that each candidate fold holds out.

    rng="numpy" permutes the sorted source names as the published splits do; their
    list is small (sources, not marks). rng="hash" takes the first in an order of
    digests and needs no driver list.
    """
    spark = pairs.sparkSession
    sources = sources_of(pairs).select(F.col("source").cast("string").alias("source"))
    if rng == "hash":
        n = sources.count()
        size = max(2, round(n * share))
        rows = sources.select(F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold"), "source")
        rank = F.row_number().over(Window.partitionBy("fold").orderBy(sampling_order(seed, F.col("fold"), F.col("source"))))
        return rows.withColumn("rank", rank).where(F.col("rank") <= size).select("fold", "source")
    names = sorted(r[0] for r in sources.toLocalIterator())
    draw = np.random.default_rng(seed)
    size = max(2, round(len(names) * share))
    rows = [(f, str(s)) for f in range(splits) for s in draw.permutation(names)[:size]]
    return spark.createDataFrame(rows, "fold int, source string")


def pair_counts(pairs: DataFrame, *values: str) -> DataFrame:
    """n of each (source_a, source_b, values, label): all that folds, fits and metrics need of pairs, and far fewer rows."""
    return reused(pairs.groupBy("source_a", "source_b", *values, "label").agg(F.sum(times(pairs)).alias("n")))


def times(df: DataFrame) -> Column:
    """How many pairs a row stands for: n where there is one."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def memberships(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """pairs once for each fold they take part in: side 'test' if both sources are held out, 'train' if neither is.

    Folds are broadcast as one list of folds a source; sources are few.
    """
    of = F.broadcast(folds.groupBy("source").agg(F.collect_set("fold").alias("in_folds")))
    every = F.broadcast(folds.agg(F.array_sort(F.collect_set("fold")).alias("all_folds")))
    rows = pairs
    for side in "ab":
        own = of.toDF("s", f"folds_{side}")
        rows = rows.join(own, F.col(f"source_{side}").cast("string") == F.col("s"), "left").drop("s")
    rows = rows.join(every)
    none = F.array().cast("array<int>")
    fa, fb = F.coalesce("folds_a", none), F.coalesce("folds_b", none)
    test = F.transform(F.array_intersect(fa, fb), lambda f: F.struct(f.alias("fold"), F.lit("test").alias("side")))
    train = F.transform(F.array_except("all_folds", F.array_union(fa, fb)), lambda f: F.struct(f.alias("fold"), F.lit("train").alias("side")))
    return rows.select(*pairs.columns, F.explode(F.concat(test, train)).alias("m")).select(*pairs.columns, "m.fold", "m.side")


def kept_folds(members: DataFrame) -> DataFrame:
    """fold of the candidates with enough same-source pairs on both sides."""
    km = lambda side: F.sum(F.when((F.col("side") == side), F.col("label") * times(members)).otherwise(0))
    return members.groupBy("fold").agg(km("train").alias("train_km"), km("test").alias("test_km")).where((F.col("train_km") >= LEAST_TRAIN_KM) & (F.col("test_km") >= LEAST_TEST_KM)).select("fold")


def frozen(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Memberships in kept folds."""
    members = memberships(pairs, folds)
    return members.join(F.broadcast(kept_folds(members)), "fold", "left_semi")


def fold_metrics(rows: DataFrame) -> DataFrame:
    """cllr, cllr_min and auc of rows(fold, lr, label[, n]) for each fold that has both classes; the score is log10 lr."""
    counts = reused(rows.groupBy("fold", "lr", "label").agg(F.sum(times(rows)).alias("n")).withColumn("score", F.log10("lr")))
    both = counts.groupBy("fold").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n_pairs")).where("lo = 0 and hi = 1").select("fold", "n_pairs")
    scored = counts.join(F.broadcast(both.select("fold")), "fold", "left_semi")
    out = both
    for part in (metrics.cllr, metrics.cllr_min, metrics.auc):
        out = out.join(part(scored, ("fold",)), "fold")
    return out


def summarize(per_fold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means and population deviations over folds, and the calibration loss."""
    cols = [f(c).alias(f"{c}{tail}") for c in ("cllr", "cllr_min", "auc") for f, tail in ((F.avg, ""), (F.stddev_pop, "_std"))]
    out = per_fold.groupBy(*by).agg(F.count("*").alias("n_folds"), *cols)
    return out.withColumn("calibration_loss", F.col("cllr") - F.col("cllr_min"))


def score_submission(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Summary over frozen folds, and pooled metrics, of pairs with an lr, or of their counts."""
    counts = pairs if "n" in pairs.columns else pair_counts(pairs, "lr")
    tests = frozen(counts, folds).where("side = 'test'")
    pooled = reused(counts.groupBy("lr", "label").agg(F.sum("n").alias("n")).withColumn("score", F.log10("lr")))
    out = summarize(fold_metrics(tests))
    for part in (metrics.cllr, metrics.cllr_min, metrics.auc, metrics.ece):
        one = part(pooled)
        out = out.join(F.broadcast(one.toDF(*[f"pooled_{c}" for c in one.columns])))
    return out


def disjoint_validation(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold: fit on the train sources, score the held-out ones; of pairs with a score, or of their counts."""
    pairs = pairs if "n" in pairs.columns else pair_counts(pairs, "score")
    counts = reused(frozen(pairs, folds).groupBy("fold", "side", "score", "label").agg(F.sum("n").alias("n")))
    models = calibration.fit_counts(counts.where("side = 'train'").drop("side"), ("fold",))
    tested = reused(calibration.apply_logistic(counts.where("side = 'test'"), models, ("fold",)))
    out = tested.groupBy("fold").agg(F.sum("n").alias("n_pairs"))
    for part in (metrics.cllr, metrics.cllr_min, metrics.auc):
        out = out.join(part(tested, ("fold",)), "fold")
    return out


def stratum_summaries(chosen: DataFrame, folds_of: Callable[[DataFrame], DataFrame] = held_out) -> DataFrame:
    """One row for each of the two strata of chosen(within, source_a, source_b, label, score): counts, auc, cllr_min, and folds where both
    classes and at least LEAST_SOURCES sources are there: how many, and the mean cllr of sources that the fit never saw. One class alone gives nulls."""
    chosen = reused(chosen.groupBy("within", "source_a", "source_b", "score", "label").agg(F.count("*").alias("n")))
    n = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    found = chosen.groupBy("within").agg(F.sum("n").alias("n_pairs"), n(1).alias("n_km"), n(0).alias("n_knm"))
    for part in (metrics.auc, metrics.cllr_min):
        found = found.join(part(chosen, ("within",)), "within", "left")
    several = [r[0] for r in chosen.select("within", F.explode(F.array("source_a", "source_b")).alias("s")).groupBy("within").agg(F.count_distinct("s").alias("n")).where(F.col("n") >= LEAST_SOURCES).collect()]
    per = None
    for within in several:  # two strata at most
        own = chosen.where(F.col("within") == within).drop("within")
        one = disjoint_validation(own, folds_of(own)).select(F.lit(within).alias("within"), "cllr")
        per = one if per is None else per.union(one)
    if per is None:
        return found.select("*", F.lit(0).cast("long").alias("n_folds"), F.lit(None).cast("double").alias("fold_cllr"))
    per = per.groupBy("within").agg(F.count("*").alias("n_folds"), F.avg("cllr").alias("fold_cllr"))
    return found.join(per, "within", "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)))


def lever_table(pairs: DataFrame, folds: DataFrame, levers: tuple[str, ...]) -> DataFrame:
    """Metrics of every lever and fold from pairs, or their counts in a column n, with a column for each lever, in one plan, on counts of each lever's scores."""
    stack = F.explode(F.array(*[F.struct(F.lit(x).alias("lever"), F.col(x).cast("double").alias("score")) for x in levers]))
    rows = pairs.select("source_a", "source_b", "label", times(pairs).alias("n"), stack.alias("x")).select("source_a", "source_b", "label", "n", "x.*")
    counts = reused(rows.groupBy("source_a", "source_b", "lever", "score", "label").agg(F.sum("n").alias("n")))
    by = ("lever", "fold")
    counts = reused(frozen(counts, folds).groupBy(*by, "side", "score", "label").agg(F.sum("n").alias("n")))
    models = calibration.fit_counts(counts.where("side = 'train'").drop("side"), by)
    tested = reused(calibration.apply_logistic(counts.where("side = 'test'"), models, by))
    out = metrics.margin(tested, by)
    for part in (metrics.cllr, metrics.cllr_min, metrics.auc):
        out = out.join(part(tested, by), list(by))
    return out


def beside(table: DataFrame, baseline: str, metrics_of: tuple[str, ...] = ("cllr", "cllr_min", "auc")) -> DataFrame:
    """lever_table's rows of the other levers next to those of the baseline lever, on the folds that both have, with the gain of each metric (what is lower is better for all but auc)."""
    own = table.where(F.col("lever") != baseline).select("lever", "fold", *metrics_of)
    base = table.where(F.col("lever") == baseline).select("fold", *[F.col(m).alias(f"baseline_{m}") for m in metrics_of])
    gain = {f"{m}_gain": (F.col(m) - F.col(f"baseline_{m}")) * (1 if m == "auc" else -1) for m in metrics_of}
    return own.join(base, "fold").withColumns(gain)


def coverage(submission: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id and problem: 'missing' or 'unknown', of a submission against the frozen pairs."""
    missing = pairs.select("pair_id").join(submission.select("pair_id"), "pair_id", "left_anti").withColumn("problem", F.lit("missing"))
    unknown = submission.select("pair_id").join(pairs.select("pair_id"), "pair_id", "left_anti").withColumn("problem", F.lit("unknown"))
    return missing.union(unknown)


def junk_counts(submission: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of LRs that are not finite, or not positive."""
    missing, negative = bad_lr(F.col("lr"))
    return submission.groupBy(*by).agg(F.sum(missing.cast("long")).alias("n_not_finite"), F.sum(negative.cast("long")).alias("n_not_positive"), F.count("*").alias("n"))


def leaderboard(entries: DataFrame, most: int = 100) -> DataFrame:
    """Entries of each split by ascending cllr, ties by time and submitter, with their rank."""
    rank = F.row_number().over(Window.partitionBy("split").orderBy("cllr", "created_at", "submitter"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= most)


def split_hash(pairs: DataFrame, tests: DataFrame) -> str:
    """Digest of a split: one line a pair with the folds that test it, sorted and joined.

    A digest of a text is one chain, so a single task reads the sorted lines; they come
    to it batch by batch, and only the digest comes to the driver.
    """
    of = tests.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("fold")), ";").alias("tested"))
    line = F.concat_ws(",", "pair_id", "hash_a", "hash_b", F.col("label").cast("string"), F.coalesce("tested", F.lit("")))
    lines = pairs.join(of, "pair_id", "left").select(line.alias("line"))

    def run(batches):
        digest, first = hashlib.sha256(), True
        for batch in batches:
            for text in batch.column(0).to_pylist():
                digest.update((text if first else "\n" + text).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["digest"])

    found = lines.repartition(1).sortWithinPartitions("line").mapInArrow(run, "digest string").first()
    return found[0] if found else hashlib.sha256().hexdigest()


def lock_mismatches(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of counts that must all be 0 before scores of a reference stand for frozen pairs: ids on one side only, labels and clusters that differ."""
    a, b = (df.select("pair_id", F.col("label").alias(f"label_{s}"), F.col("cluster_id").alias(f"cluster_{s}"), F.lit(True).alias(f"in_{s}")) for df, s in ((pairs, "a"), (reference, "b")))
    rows = a.join(b, "pair_id", "full_outer")
    both = F.col("in_a") & F.col("in_b")
    n = lambda test: F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("long")), F.lit(0))
    return rows.agg(
        n(F.col("in_b").isNull()).alias("n_missing"), n(F.col("in_a").isNull()).alias("n_unknown"),
        n(both & ~F.col("label_a").eqNullSafe(F.col("label_b"))).alias("n_label"), n(both & ~F.col("cluster_a").eqNullSafe(F.col("cluster_b"))).alias("n_cluster"),
    )


def disjoint_fusion(pairs: DataFrame, folds: DataFrame, features: tuple[str, ...], ridge: float = 1.0) -> DataFrame:
    """Per fold: several features fused on the train sources, cllr and auc of the held-out pairs; of pairs with the features, or of their counts."""
    rows = frozen(pairs if "n" in pairs.columns else pair_counts(pairs, *features), folds)
    rows = reused(rows.groupBy("fold", "side", *features, "label").agg(F.sum("n").alias("n")))
    models = reused(calibration.fit_fusion(rows.where("side = 'train'"), features, ("fold",), ridge))
    tested = reused(calibration.apply_fusion(rows.where("side = 'test'"), models, features, ("fold",)).withColumn("score", F.col("fused")))
    out = tested.groupBy("fold").agg(F.sum("n").alias("n_pairs"))
    for part in (metrics.cllr, metrics.auc):
        out = out.join(part(tested, ("fold",)), "fold")
    return out


class Split(NamedTuple):
    """A frozen benchmark: its pairs, the pairs each fold tests, a leave-sources-out baseline and one row of counts."""

    pairs: DataFrame
    tests: DataFrame
    baseline: DataFrame
    counts: DataFrame


def build_split(first: DataFrame, second: DataFrame, marks: DataFrame, rng: str = "numpy", seed: int = SEED) -> Split:
    """The pairs that both scorers (mark_a, mark_b, score) have a number for, once for each pair of contents, with folds and a baseline from the first scorer.

    marks(mark, source, content_hash). Of pairs with equal contents the one of the least marks stays.
    """
    both = aligned(first, second)
    for s in "ab":
        both = both.join(marks.select(F.col("mark").alias(f"mark_{s}"), F.col("source").alias(f"source_{s}"), F.col("content_hash").alias(f"hash_{s}")), f"mark_{s}")
    both = both.where("source_a is not null and source_b is not null and hash_a is not null and hash_b is not null")
    swap = F.col("hash_b") < F.col("hash_a")  # the lesser content comes first, with its source
    both = both.withColumns({f"{c}_{s}": F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")) for c in ("source", "hash") for s, o in ("ab", "ba")})
    both = both.withColumns({"pair_id": pair_id(F.col("hash_a"), F.col("hash_b")), "label": (F.col("source_a") == F.col("source_b")).cast("int")})
    kept = reused(first_of(both, ("pair_id",), ("mark_a", "mark_b")).withColumn("score", F.col("score_1")))
    members = frozen(kept, held_out(kept, seed=seed, rng=rng))
    tests = members.where("side = 'test'").select("pair_id", "fold")
    baseline = calibration.leave_sources_out_lrs(kept).where("lr is not null").select("pair_id", "lr")
    n = kept.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_km"))
    n_sources = sources_of(kept).agg(F.count("*").alias("n_sources"))
    n_folds = tests.agg(F.count_distinct("fold").alias("n_folds"))
    counts = both.agg(F.count("*").alias("n_aligned"))
    for part in (n, n_sources, n_folds):
        counts = counts.join(F.broadcast(part))
    counts = counts.withColumn("n_duplicates", F.col("n_aligned") - F.col("n_pairs"))
    return Split(kept.select("pair_id", "hash_a", "hash_b", "label", "source_a", "source_b"), tests, baseline, counts)
