"""Bullets, ensembles, reports, registration, samples, splits and manifests on planted inputs, against direct formulas."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfmatch.functions import columns as C
from surfmatch.functions.helpers import best_lag, lag_matrix, phase_shift
from surfmatch.operators import bootstrap, bullets, calibration, folds, metrics, pairs, reports, signals
from surfmatch.sources import readers


def planted(spark, lands=6, offset=2, n=120):
    """Bullet 2 is bullet 1 turned by offset lands, with noise; bullet 3 is another one; bullet 4 has no signatures."""
    rng = np.random.default_rng(3)
    own = rng.normal(size=(lands, n))
    sets = {1: own, 2: np.roll(own, offset, axis=0) + 0.1 * rng.normal(size=own.shape), 3: rng.normal(size=(lands, n))}
    rows = [(b, i, x.tolist()) for b, s in sets.items() for i, x in enumerate(s)] + [(4, 0, None)]
    found = spark.createDataFrame(rows, "bullet long, land int, signature array<double>")
    return found, spark.createDataFrame([("same", 1, 2), ("other", 1, 3), ("none", 1, 4)], "pair_id string, bullet_a long, bullet_b long"), sets


def test_bullets_find_the_planted_offset(spark):
    lands, asked, sets = planted(spark)
    out = {r["pair_id"]: r for r in bullets.compare(asked, lands).collect()}
    same, other = out["same"], out["other"]
    assert (same["offset"], same["n_lands_a"], same["n_lands_b"]) == (2, 6, 6)
    every = np.array([[best_lag(x, y)[1] for y in sets[2]] for x in sets[1]])
    on = (np.arange(6)[None, :] - np.arange(6)[:, None]) % 6 == 2
    assert same["score"] == pytest.approx(every[on].mean() - every[~on].mean()) and same["score"] > 0.5 > other["score"]
    ccf = [best_lag(sets[1][i], sets[2][(i + 2) % 6])[1] for i in range(6)]
    assert same["best_land_a"] == int(np.argmax(ccf)) and same["best_land_b"] == (same["best_land_a"] + 2) % 6
    assert same["best_land_ccf"] == pytest.approx(max(ccf))
    assert out["none"]["score"] is None and out["none"]["best_land_a"] is None
    bands = bullets.attribution(bullets.compare(asked.where("pair_id = 'same'"), lands), lands, 0.5, 5.0, 30, 15).collect()
    assert len(bands) > 3 and all(abs(b["x_a"] - b["x_b"]) <= 5 for b in bands)


def test_lag_matrix_equals_single_alignments():
    rng = np.random.default_rng(5)
    a = [rng.normal(size=n) for n in (1, 9, 40)] + [np.ones(7), np.array([1.0, np.nan, 3.0, 2.0])]
    b = [rng.normal(size=n) for n in (30, 2)] + [None, np.zeros(0)]
    lag, ccf = lag_matrix(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if y is None or not len(y):
                assert np.isnan(ccf[i, j])
            else:
                assert (lag[i, j], ccf[i, j]) == pytest.approx(best_lag(x, y))


def test_lands_take_their_pairs_label_and_add_up(spark):
    lands, asked, _ = planted(spark)
    cells = bullets.land_matrix(asked.where("pair_id <> 'none'"), lands)
    train = bullets.labelled_lands(cells, asked.withColumn("label", (F.col("pair_id") == "same").cast("int")))
    assert {(r["label"], r["n"]) for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()} == {(1, 6), (0, 6)}
    for method in ("logistic", "isotonic"):
        one = bullets.land_evidence(cells, train, method).groupBy("pair_id").agg(F.sum(F.log10("lr")).alias("v"))
        fused = bullets.fused_lands(cells, train, method).join(one, "pair_id").collect()
        assert all(r["fused"] == pytest.approx(r["v"]) and r["n_lands"] == 6 for r in fused)
        value = {r["pair_id"]: r["fused"] for r in fused}
        assert value["same"] > 0 > value["other"]


def reference(spark, km=80, knm=320):
    rng = np.random.default_rng(1)
    rows = [(float(s), 1, f"k{i // 8}") for i, s in enumerate(rng.normal(3, 1, km))] + [(float(s), 0, f"n{i // 8}") for i, s in enumerate(rng.normal(-1, 1, knm))]
    return spark.createDataFrame(rows, "score double, label int, cluster_id string")


def test_row_stratified_ensemble_keeps_class_sizes(spark):
    ref = reference(spark)
    first = bootstrap.stratified_ensemble(ref, 30, 4)
    models = first.orderBy("replicate").collect()
    assert len(models) == 30 and all((m["n_km"], m["n_knm"]) == (80, 320) for m in models)
    again = bootstrap.stratified_ensemble(ref.repartition(7), 30, 4).orderBy("replicate").collect()
    assert [m["coef"] for m in models] == pytest.approx([m["coef"] for m in again])
    point = calibration.fit_logistic(ref).first()
    assert min(m["coef"] for m in models) < point["coef"] < max(m["coef"] for m in models)
    assert bootstrap.stratified_ensemble(ref.where("label = 0"), 3).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "row-stratified"])
def test_reports_hold_interval_figures_and_wording(spark, kind):
    ref = reference(spark)
    ref = ref if kind == "clustered" else ref.drop("cluster_id")
    crossing = calibration.fit_logistic(ref).first()
    asked = spark.createDataFrame([("same", 3.0), ("even", -crossing["intercept"] / crossing["coef"]), ("far", -9.0), ("none", None)], "query_id string, score double")
    out = {r["query_id"]: r for r in reports.comparison_report(asked, ref, "test", "striated", 40).collect()}
    assert all(r["resample"] == kind and r["reference_n_km"] == 80 for r in out.values())
    assert out["same"]["ci_lo"] <= out["same"]["log10_lr"] <= out["same"]["ci_hi"] and out["same"]["direction"] == "same source"
    assert out["even"]["verbal"].endswith(reports.UNRESOLVED) and not out["same"]["verbal"].endswith(reports.UNRESOLVED)
    assert out["far"]["bound_hit"] and "bound" in out["far"]["scope_note"] and out["none"]["lr"] is None
    assert out["same"]["reference_auc"] == pytest.approx(metrics.auc(ref).first()[0])


def test_correlation_at_a_shift(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=20), rng.normal(size=20)
    b[4] = np.nan
    rows = [(a.tolist(), b.tolist(), s) for s in (-21, -3, 0, 7, 20)] + [([1.0, 1.0], [2.0, 3.0], 1), ([], [], 0)]
    for r in spark.createDataFrame(rows, "a array<double>, b array<double>, s int").select("*", C.ncc_at_shift(F.col("a"), F.col("b"), F.col("s")).alias("v")).collect():
        if len(r["a"]) < 20:
            assert r["v"] == 0.0
            continue
        y = np.roll(b, r["s"])
        y = np.nan_to_num(y - np.nanmean(y))
        x = a - a.mean()
        assert r["v"] == pytest.approx((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))


def test_maps_are_registered(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(16, 16))
    maps = spark.createDataFrame([(i, 16, x.astype("<f8").tobytes()) for i, x in enumerate((a, np.roll(a, (-3, 5), (0, 1)), np.ones((16, 16))))] + [(9, 2, np.zeros(4).tobytes())], "mark long, side int, heights binary")
    out = {r["mark_b"]: r for r in signals.register_pairs(spark.createDataFrame([(0, 1), (0, 2), (0, 9), (0, 77)], "mark_a long, mark_b long"), maps).collect()}
    assert (out[1]["dy"], out[1]["dx"]) == (3, -5) and out[1]["corr"] == pytest.approx(1.0)
    assert out[2]["corr"] == 0.0 and out[9]["dy"] is None and out[77]["corr"] is None
    assert phase_shift(np.full((3, 3), np.nan), np.ones((3, 3))) == (0, 0, 0.0)


def test_balanced_samples(spark):
    # one source holds most marks of its study
    rows = [(i, 0 if i < 300 else 1 + i % 5, 0) for i in range(330)] + [(1000 + i, 10 + i % 2, 1) for i in range(8)] + [(2000, 20, 2)]
    marks = spark.createDataFrame(rows, "mark long, source long, study long")
    of = {m: (s, t) for m, s, t in rows}
    for same in (True, False):
        out = [tuple(r) for r in pairs.balanced_sample(marks, 40, same, 1).collect()]
        assert len(out) == len(set(out)) == 40 and all(a < b for a, b in out)
        assert all((of[a][0] == of[b][0]) == same and of[a][1] == of[b][1] for a, b in out)
        assert sorted(out) == sorted(tuple(r) for r in pairs.balanced_sample(marks.repartition(9), 40, same, 1).collect())
        assert sum(of[a][1] == 1 for a, _ in out) >= 5
    # all there is, where less than wanted can be had
    few = marks.where("study = 1")
    assert pairs.balanced_sample(few, 50, True).count() == 12 and pairs.balanced_sample(few, 50, False).count() == 16
    assert pairs.balanced_sample(marks.where("study = 2"), 5, True).count() == pairs.balanced_sample(marks.limit(0), 5, False).count() == 0


def test_splits_keep_one_pair_of_contents(spark):
    rng = np.random.default_rng(6)
    marks = [(i, f"s{i % 8}", f"h{i - (i == 9) * 8}") for i in range(40)]
    scores = [(i, j, float(round(rng.normal(3.0 * (i % 8 == j % 8), 1), 2))) for i in range(40) for j in range(i + 1, 40)]
    first = spark.createDataFrame(scores, "mark_a long, mark_b long, score double")
    second = first.withColumn("score", F.when(F.col("mark_b") != 39, F.col("score")))
    split = folds.build_split(first, second, spark.createDataFrame(marks, "mark long, source string, content_hash string"), rng="hash")
    got = split.counts.first()
    # marks 1 and 9 hold the same: pairs of 9 repeat those of 1, except that the pair of both stands for itself
    assert (got["n_aligned"], got["n_pairs"], got["n_duplicates"]) == (741, 704, 37)
    ids = {r[0] for r in split.pairs.select("pair_id").collect()}
    assert len(ids) == 704 and {r[0] for r in split.tests.select("pair_id").collect()} <= ids and {r[0] for r in split.baseline.select("pair_id").collect()} <= ids


def test_fusion_on_counts_equals_rows_and_folds_are_scored(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{a}", f"s{b}", int(a == b), float(rng.integers(0, 4) + 2 * (a == b)), float(rng.integers(0, 3))) for a in range(9) for b in range(a, 9) for _ in range(6)]
    df = spark.createDataFrame(rows, "source_a string, source_b string, label int, x double, y double")
    counts = df.groupBy("x", "y", "label").agg(F.count("*").alias("n"))
    one, other = (calibration.fit_fusion(d, ("x", "y")).first() for d in (df, counts))
    assert one["coef"] == pytest.approx(other["coef"]) and one["sd_x"] == pytest.approx(other["sd_x"]) and one["log_bound"] == other["log_bound"]
    out = folds.disjoint_fusion(df, folds.held_out(df, 4, rng="hash"), ("x", "y")).collect()
    assert out and all(r["auc"] > 0.8 and r["cllr"] < 1 for r in out)


def test_manifests_and_sources(spark, tmp_path):
    (tmp_path / "m1.json").write_text(json.dumps({"name": "m1", "study": {"source": "x", "external_id": "1"}, "firearm_defaults": {"n_lands": 6}, "files": [{"name": "a/b.x3p", "url": "u1"}, {"name": "a/b.x3p", "url": "u2"}, {"name": "c.x3p", "url": "u3"}]}, indent=1))
    (tmp_path / "m2.json").write_text(json.dumps({"name": "m2", "entity": "cartridge", "study": {"source": "x", "external_id": "2"}, "files": []}))
    rows = {r["file_name"]: r for r in readers.manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/b.x3p", "c.x3p"} and rows["a/b.x3p"]["url"] == "u1"
    assert rows["c.x3p"]["entity"] == "bullet" and rows["c.x3p"]["firearm_defaults"]["n_lands"] == 6 and rows["c.x3p"]["study"]["source"] == "x"
    scans = spark.createDataFrame([("file:///d/T1/x.x3p",), ("T2/y.x3p",), ("z.x3p",), (None,)], "path string")
    assert sorted(r["source"] for r in readers.with_sources(scans, C.folder_source).collect()) == ["T1", "T2"]
    (tmp_path / "m3.json").write_text(json.dumps({"name": "m3", "entity": "toolmark", "files": [{"name": "q", "url": "u"}]}))
    with pytest.raises(Exception, match="unknown entity"):
        readers.manifest(spark, str(tmp_path)).collect()


def test_land_ccf_matrix_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from surfmatch.plans import comparisons  # noqa: F401 (it registers the query)
    from surfmatch.plans.queries import QUERIES, SQL

    rng = np.random.default_rng(11)
    rows = [(i, i % 3, rng.normal(size=64).tolist()) for i in range(13)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(path)
    own = QUERIES["land_ccf_matrix"](spark, f"file://{tmp_path}")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
        asked = db.execute(SQL["land_ccf_matrix"])
        names, want = [c[0] for c in asked.description], asked.fetchall()
    assert own.columns == names
    assert sorted(map(tuple, own.collect())) == sorted(want) and len(want) == 5 * 5 + 5 * 3
