"""Pairs counted where they are scored, against the same pairs listed."""

import itertools
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfmatch.operators import bootstrap, metrics, pairs, reports, tallies
from surfmatch.plans import browsing, comparisons, queries  # noqa: F401
from surfmatch.plans import views as V
from surfmatch.sources import readers

rng = np.random.default_rng(5)


def marks(spark, n=90):
    """Marks of five sources, some without a source, some without a signature, some twice and with another source; products hit halves of the last digit."""
    rows = [(i, None if i % 17 == 3 else int(i % 5), None if i % 19 == 4 else (rng.integers(-8, 9, 4) / 8).tolist()) for i in range(n)]
    rows += [(7, 1, rows[7][2]), (11, 4, [0.5, 0.25, 0.125, 1.0])]
    return spark.createDataFrame(rows, "mark long, source int, signature array<double>").cache()


def listed(m, shift=0.3, digits=3):
    return pairs.labelled(pairs.score_blocks(m.select("mark", "signature"), pairs.dot_product, 30), m).withColumn("score", F.round(F.col("score") + shift * F.col("label"), digits))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_rounding_is_that_of_spark(spark):
    values = np.concatenate([rng.normal(size=3000), rng.integers(-4000, 4000, 3000) / 16, rng.integers(-9999, 9999, 3000) / 2000, [0.0, -0.0, 1e-12]])
    own = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (2, 3, 9):
        got = tallies.half_up(values, digits)
        assert (got / 10.0**digits == [r[0] for r in own.select(F.round("v", digits)).collect()]).all()
    large = np.array([0.0005, 2.0**50 + 0.25])
    assert tallies.half_up(large, 3).tolist() == [int(Decimal(repr(v)).scaleb(3).to_integral_value(ROUND_HALF_UP)) for v in large.tolist()]


@pytest.mark.parametrize("block, dense", [(25, 4_000_000), (4000, 4_000_000), (25, 10)])
def test_counts_are_those_of_the_pairs(spark, monkeypatch, block, dense):
    monkeypatch.setattr(tallies, "DENSE", dense)
    m = marks(spark)
    every = listed(m).withColumn("gap", (F.col("mark_b") - F.col("mark_a")).cast("int") % 7)
    for by in ((), ("source_a",), ("source_b",), ("source_a", "source_b")):
        got = tallies.score_counts(m, pairs.dot_product, by, 0.3, 3, ("gap", lambda a, b: np.abs(a - b) % 7, 7), block)
        columns = [*by, "gap", "label", "score", "n"]
        assert rows_of(got, *columns) == rows_of(every.groupBy(*columns[:-1]).agg(F.count("*").alias("n")), *columns)
    plain = tallies.score_counts(m, pairs.dot_product, (), 0.3, 3, None, block)
    assert rows_of(plain, "label", "score", "n") == rows_of(every.groupBy("label", "score").agg(F.count("*").alias("n")), "label", "score", "n")


@pytest.mark.parametrize("block", [25, 4000])
def test_hardest_of_blocks_hold_the_hardest(spark, block):
    m = marks(spark)
    named = ["study", "label", "mark_a", "mark_b", "score", "rank"]
    study = F.col("source_a") % 3
    for wanted, test in ((None, "true"), (lambda a, b: b % 5 != 1, "mark_b % 5 <> 1")):
        few = tallies.hardest_in_blocks(m, pairs.dot_product, 4, 0.3, 3, wanted, block)
        got = pairs.hardest(few.withColumn("study", study), ("study",), 4)
        assert rows_of(got, *named) == rows_of(pairs.hardest(listed(m).where(test).withColumn("study", study), ("study",), 4), *named)


def test_pairs_bring_their_sources_along(spark):
    m = marks(spark)
    named = ["mark_a", "mark_b", "source_a", "source_b", "label", "score"]
    want = pairs.labelled(pairs.score_blocks(m, pairs.dot_product, 30), m).withColumn("score", F.round("score", 6))
    for block, tile in ((25, 1 << 20), (4000, 50)):
        found = pairs.labelled(pairs.score_blocks(tallies.sourced(m), pairs.dot_product, block, along=("source",), tile=tile), m)
        assert rows_of(found.withColumn("score", F.round("score", 6)), *named) == rows_of(want, *named)
    finish = lambda v, a, b: tallies.rounded_scores(v, a, b, 0.3, 3)
    found = pairs.labelled(pairs.score_blocks(tallies.sourced(m), pairs.dot_product, 25, along=("source",), finish=finish), m)
    assert rows_of(found, *named) == rows_of(listed(m), *named)
    plan = pairs.labelled(pairs.score_blocks(m, pairs.dot_product, along=("source",)), m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0]


def test_operators_on_counts_equal_those_on_pairs(spark):
    every = [(f"s{i % 4}", f"s{j % 4}", int(i % 4 == j % 4), round(float(rng.normal() + (i % 4 == j % 4)), 1)) for i, j in itertools.combinations(range(40), 2)]
    rows = spark.createDataFrame(every, "source_a string, source_b string, label int, score double").withColumn("lr", F.exp("score"))
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))

    def alike(f):
        a, b = ([[round(x, 9) if isinstance(x, float) else x for x in r] for r in sorted(map(tuple, f(df).collect()), key=repr)] for df in (rows, counts))
        assert a == b and a

    alike(bootstrap.source_sums)
    alike(lambda df: readers.provenance(df.withColumn("ref_id", F.lit(1)).withColumn("cluster_id", F.concat("source_a", "source_b"))))
    alike(lambda df: reports.head_to_head(df.withColumn("plain", -F.col("score")), "source_a", ("score", "plain")))
    alike(lambda df: metrics.margin(df))
    alike(lambda df: bootstrap.calibration_ensemble(df.withColumn("cluster_id", F.concat("source_a", "source_b")), 3))


COUNTED = """comparison_reports bootstrap_cllr calibration_intervals cross_modality_table fit_logistic flagship hardest_pairs head_to_head
lever_margins merged_hardest_pairs metric_auc metric_calibration_bins metric_cllr metric_ece metric_eer metric_margin
disjoint_fusion submission_summary reference_provenance metric_lr_separation disjoint_validation metric_cllr_min submission_folds metric_tippett
external_protocol fold_sources metric_misleading_rates""".split()


@pytest.mark.parametrize("name", COUNTED)
def test_queries_of_counts_list_no_pairs(spark, monkeypatch, tmp_path, name):
    def refuse(*_, **__):
        raise AssertionError("all pairs are listed")

    def reached(*_, **__):
        raise LookupError

    monkeypatch.setattr(V, "scored_pairs", refuse)
    monkeypatch.setattr(V, "scored_counts", reached)
    monkeypatch.setattr(V, "hard_pairs", reached)
    spark.createDataFrame([(i, [1.0, 0.5], i % 3) for i in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(LookupError):
        queries.QUERIES[name](spark, f"file://{tmp_path}")
