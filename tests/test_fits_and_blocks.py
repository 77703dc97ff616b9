"""Fits by grouped sums, pairs in counted blocks, sampling before scoring, and pairs that fail."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfmatch.functions.helpers import balanced_logistic
from surfmatch.operators import bullets, calibration, folds, newton, pairs, signals

rng = np.random.default_rng(11)


def plain(rows):
    x, y = (np.array([r[k] for r in rows], float) for k in (0, 1))
    return balanced_logistic(x, y, np.ones(len(rows)))


def drawn(n, share, shift, spread, centre=0.0):
    y = (rng.random(n) < share).astype(int)
    y[:3], y[3:6] = 1, 0
    return [(float(centre + rng.normal() * spread + shift * k), int(k)) for k in y]


def test_grouped_fits_equal_plain_ones(spark):
    groups = {"near": drawn(700, 0.2, 0.3, 0.12), "far": drawn(300, 0.5, 40.0, 25.0, 1e3), "apart": drawn(200, 0.3, 1.0, 0.15), "alike": drawn(400, 0.5, 0.0, 1.0), "tied": [(round(s, 1), y) for s, y in drawn(500, 0.1, 0.5, 0.4)]}
    rows = [(g, s, y) for g, part in groups.items() for s, y in part] + [("flat", 2.0, 1), ("flat", 2.0, 0), ("flat", 2.0, 0), ("few", 0.5, 1), ("few", 0.1, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r.g: r for r in calibration.fit_logistic(df, ("g",)).collect()}
    assert set(got) == {*groups, "flat"}
    for g, part in groups.items():
        coef, intercept = plain(part)
        assert (got[g].coef, got[g].intercept) == pytest.approx((coef, intercept), rel=1e-6, abs=1e-7)
        assert (got[g].n_km, got[g].n_knm) == (sum(y for _, y in part), sum(1 - y for _, y in part))
    assert abs(got["flat"].coef * 2.0 + got["flat"].intercept) < 1e-6
    one = calibration.fit_logistic(df.where("g = 'near'")).first()
    assert one.coef == pytest.approx(got["near"].coef, rel=1e-9)
    assert calibration.fit_logistic(df.limit(0)).count() == 0


@pytest.mark.parametrize("anchors", [3, 512])
def test_leave_sources_out_equals_plain_fits(spark, monkeypatch, anchors):
    monkeypatch.setattr(newton, "ANCHORS", anchors)
    source = {m: f"s{m % 5}" for m in range(45)}
    source[45] = "lone"
    rows = []
    for a, b in itertools.combinations(source, 2):
        label = int(source[a] == source[b])
        rows.append((source[a], source[b], float(rng.normal() * 0.2 + 0.3 * label + 0.1 * (source[a] == "s1")), label))
    got = {(r.a, r.b): r for r in calibration.leave_sources_out(spark.createDataFrame(rows, "source_a string, source_b string, score double, label int")).collect()}
    sets = {tuple(sorted(r[:2])) for r in rows}
    assert set(got) == sets
    for s in sets:
        left = [(x, y) for a, b, x, y in rows if not {a, b} & set(s)]
        assert (got[s].coef, got[s].intercept) == pytest.approx(tuple(plain(left)), rel=1e-6, abs=1e-7)
        assert (got[s].n_km, got[s].n_knm) == (sum(y for _, y in left), sum(1 - y for _, y in left))


def test_sets_with_too_little_left_have_no_model(spark):
    rows = [("a", "a", 0.9, 1), ("a", "b", 0.1, 0), ("b", "c", 0.2, 0), ("c", "c", 0.8, 1), ("b", "b", 0.7, 1)]
    df = spark.createDataFrame(rows, "source_a string, source_b string, score double, label int")
    assert calibration.leave_sources_out(df).count() == 0
    assert all(r.lr is None for r in calibration.leave_sources_out_lrs(df).collect())


def test_a_hot_study_spreads_over_blocks(spark):
    marks = spark.createDataFrame([(i, "hot" if i < 900 else f"t{i % 7}", [float(i), 1.0]) for i in range(1000)] + [(2000, None, [0.0, 0.0])], "mark long, study string, signature array<double>")
    placed = pairs.block_pairs(marks, 50, "study")
    tasks = {r.study: r.n for r in placed.groupBy("study").agg(F.count_distinct("bi", "bj").alias("n")).collect()}
    assert tasks["hot"] >= 100 and all(n <= 3 for s, n in tasks.items() if s != "hot")
    assert placed.groupBy("study", "bi", "bj").count().agg(F.max("count")).first()[0] <= 200
    want = {(a, b) for a, b in itertools.combinations(range(1000), 2) if (a < 900) == (b < 900) and (a < 900 or a % 7 == b % 7)}
    scored = pairs.score_blocks(marks, pairs.dot_product, 50, "study").select("mark_a", "mark_b", "score").collect()
    assert len(scored) == len(want) and {(r.mark_a, r.mark_b) for r in scored} == want and all(r.score == r.mark_a * r.mark_b + 1 for r in scored)
    listed = pairs.paired(marks.drop("signature").withColumn("x", F.col("mark") * 2), "study", 50)
    rows = listed.collect()
    assert len(rows) == len(want) and {(r.mark_a, r.mark_b) for r in rows} == want and all((r.x_a, r.x_b) == (2 * r.mark_a, 2 * r.mark_b) for r in rows[:500])
    assert {(r.mark_a, r.mark_b) for r in pairs.paired(marks.where("mark < 30").select("mark"), None, 7).collect()} == set(itertools.combinations(range(30), 2))


@pytest.mark.parametrize("block", [5, 2000])
def test_sampling_before_scoring_takes_the_same_pairs(spark, block):
    source, kind = (lambda i: f"s{i // 4}"), (lambda i: None if i % 9 == 0 else i % 3)
    marks = spark.createDataFrame([(i, source(i), kind(i)) for i in range(48)], "mark long, source string, kind int")
    every = [(i, j, int(source(i) == source(j)), kind(i) == kind(j)) for i, j in itertools.combinations(range(48), 2)]
    want = pairs.stratified(spark.createDataFrame(every, "mark_a long, mark_b long, label int, within boolean"), ("within",), 60)
    got = pairs.sampled_pairs(marks, "kind", 60, block_rows=block)
    assert sorted(map(tuple, got.select("mark_a", "mark_b", "label", "within").collect())) == sorted(map(tuple, want.collect()))
    assert all(r.source_a == source(r.mark_a) and r.source_b == source(r.mark_b) for r in got.collect())


def test_a_pair_that_fails_is_a_row_of_its_own(spark):
    marks = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.5] * 8), (2, [0.0, 0.0, 1.0, 0.2] * 8), (3, None), (4, [1.0])], "mark long, signature array<double>")
    ask = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (1, 77)], "mark_a long, mark_b long")
    for block in (1, 2000):
        scored = pairs.score_pairs(ask.union(spark.createDataFrame([(1, 4)], ask.schema)), marks, signals.plain_product, "score double", block)
        got = {(r.mark_a, r.mark_b): r for r in scored.collect()}
        assert len(got) == 5 and got[1, 2].error is None and got[1, 2].score == pytest.approx(0.8)
        assert all(got[k].score is None for k in got if k != (1, 2))
        assert {(r.mark_a, r.mark_b): r.kind for r in pairs.failures(scored).collect()} == {(1, 3): "ValueError", (3, 2): "ValueError", (1, 77): "LookupError", (1, 4): "ValueError"}
    assert {r.mark_b: r.error is None for r in signals.align_pairs(ask, marks).collect() if r.mark_a == 1} == {2: True, 3: False, 77: False}
    votes = signals.vote_pairs(ask, marks, 8, 4)
    assert votes.where("error is null").select("mark_a", "mark_b").distinct().count() == 1
    assert votes.where("error is not null").count() == 3 and votes.where("error is not null and region_id is null").count() == 3
    maps = spark.createDataFrame([(1, 4, rng.normal(size=(4, 4)).tobytes()), (2, 4, None), (3, 9, b"short")], "mark long, side int, heights binary")
    cells = signals.cell_vote_pairs(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], ask.schema), maps, 2)
    assert {r.mark_b for r in cells.where("error is not null").collect()} == {2, 3} and cells.where("mark_b = 1 and error is not null").count() == 0
    lands = spark.createDataFrame([("x", 0, [0.0, 1.0, 0.5]), ("x", 1, None), ("y", 0, [1.0, 0.0, 0.2])], "bullet string, land int, signature array<double>")
    found = bullets.land_matrix(spark.createDataFrame([("p", "x", "y"), ("q", "x", "gone")], "pair_id string, bullet_a string, bullet_b string"), lands).collect()
    assert sorted((r.pair_id, r.i, r.j, r.ccf is None, r.error is None) for r in found if r.pair_id == "p") == [("p", 0, 0, False, True), ("p", 1, 0, True, True)]
    assert [(r.i, r.error is None) for r in found if r.pair_id == "q"] == [(None, False)]


def test_strata_of_one_class_or_few_sources_have_no_folds(spark):
    rows = [(True, f"s{i}", f"s{i}", 0.5, 1) for i in range(3)] + [(False, "s0", "s1", 0.1, 0), (False, "s0", "s0", 0.4, 1)]
    got = {r.within: r for r in folds.stratum_summaries(spark.createDataFrame(rows, "within boolean, source_a string, source_b string, score double, label int")).collect()}
    assert (got[True].n_pairs, got[True].n_km, got[True].auc, got[True].cllr_min, got[True].n_folds) == (3, 3, None, None, 0)
    assert (got[False].auc, got[False].n_folds, got[False].fold_cllr) == (1.0, 0, None)
