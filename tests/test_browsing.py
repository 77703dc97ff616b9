"""Browse filters, facets of parents, first scans, owners, completeness, merges, exact samples by digest, tables of references."""

import hashlib

import pytest
from pyspark.sql import functions as F

from surfmatch.operators import browsing, folds, matrices, metrics, pairs, reports

SCANS = "id long, file_name string, land_id long, case_id long, instrument_id long, dpi double"
ROWS = [
    (1, "Barrel1.X3P", 10, None, 1, 1.0), (2, "barrel_2.x3p", 10, None, 2, 2.0), (3, "case 1.x3p", None, 5, 1, 3.0), (4, "100%.x3p", None, None, None, 4.0),
    (5, None, 11, 6, 9, None), (5, None, 11, 6, 9, None),
]
PARENTS = {"land": "land_id", "case": "case_id"}


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame(ROWS, SCANS)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_browse(spark, scans):
    devices = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "instrument_id long, instrument string")
    assert ids(browsing.browse(scans, PARENTS)) == [1, 2, 3, 4, 5, 5]
    assert ids(browsing.browse(scans, PARENTS, name="BARREL")) == [1, 2]
    assert ids(browsing.browse(scans, PARENTS, name="0%")) == [4] and ids(browsing.browse(scans, PARENTS, name="%")) == [4]
    assert ids(browsing.browse(scans, PARENTS, kind="case")) == [3]  # 5 is a land first
    assert ids(browsing.browse(scans, PARENTS, instruments=devices)) == [1, 2, 3, 4, 5, 5]
    assert ids(browsing.browse(scans, PARENTS, instruments=devices, instrument="A", kind="land")) == [1]
    assert {r.id: r.mark_class for r in browsing.browse(scans, PARENTS).collect()} == {1: "land", 2: "land", 3: "case", 4: None, 5: "land"}
    assert sorted(r[0] for r in browsing.used_instruments(scans, devices).collect()) == ["A", "B"]
    assert browsing.browse(scans.limit(0), PARENTS, name="x").count() == 0


def test_facets_of_what_stands_above(spark, scans):
    lands = spark.createDataFrame([(10, 100, 6), (11, 101, 5), (12, None, 6)], "land long, barrel long, n_lands int")
    barrels = spark.createDataFrame([(100, 7), (101, 8), (101, 8)], "barrel_id long, firearm long")
    firearms = spark.createDataFrame([(7, "9mm"), (8, ".45")], "firearm_id long, caliber string")
    above = [("land_id", lands, "land"), ("barrel", barrels, "barrel_id"), ("firearm", firearms, "firearm_id")]
    assert ids(browsing.faceted(scans, {"caliber": "9mm"}, above)) == [1, 2]
    assert ids(browsing.faceted(scans, {"caliber": ".45"}, above)) == [5, 5]  # repeated rows stay, repeated parents add none
    assert ids(browsing.faceted(scans, {"n_lands": 6, "caliber": ".45"}, above)) == []
    assert ids(browsing.faceted(scans, {"n_lands": 6, "instrument_id": 2}, above)) == [2]
    assert ids(browsing.faceted(scans, {"caliber": None}, above)) == [1, 2, 3, 4, 5, 5]
    assert ids(browsing.faceted(scans, {}, above, {"dpi": (2, 3), "n_lands": (None, 6)})) == [2]
    with pytest.raises(ValueError):
        browsing.faceted(scans, {"colour": "red"}, above)


def test_first_owned_complete_and_merged(spark, scans):
    first = browsing.first_of_parent(scans, "land_id", "file_name", "id")
    assert first.columns == scans.columns and ids(first) == [1, 5]
    assert ids(browsing.first_of_parent(scans, "land_id", "dpi", "id")) == [1, 5]  # nulls first
    lands = spark.createDataFrame([(10,), (11,), (12,)], "land long")
    assert sorted(r[0] for r in browsing.owners(lands, "land", scans, "land_id").collect()) == [10, 11]
    declared = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0), ("d", None)], "split string, n_pairs long")
    loaded = spark.createDataFrame([("a",), ("a",), ("x",)], "split string")
    assert {r.split: (r.n_loaded, r.published) for r in browsing.complete(loaded, declared).collect()} == {"a": (2, True), "b": (0, False), "c": (0, True), "d": (0, False)}
    old = spark.createDataFrame([(1, None, "o"), (1, 2, "o"), (3, 4, "o")], "a long, b long, v string")
    new = old.where("a = 1 and b is null").withColumn("v", F.lit("n")).union(spark.createDataFrame([(9, 9, "n")], old.schema))
    assert sorted(map(tuple, browsing.merged(old, new, ("a", "b")).collect()), key=str) == sorted([(1, None, "n"), (1, 2, "o"), (3, 4, "o"), (9, 9, "n")], key=str)
    assert sorted(tuple(r) for r in browsing.merged(old, new.select("b", "a"), ("a", "b")).where("v is null").select("a").collect()) == [(1,), (9,)]


@pytest.mark.parametrize("most", [0, 1, 7, 500, 900, 2000])
def test_first_by_digest_is_exact(spark, most):
    rows = spark.range(900)
    got = {r.id for r in browsing.first_by_digest(rows, pairs.sampling_order(3, F.col("id")), most).collect()}
    assert got == set(sorted(range(900), key=lambda i: hashlib.sha256(f"3|{i}".encode()).hexdigest())[:most])


def test_training_pairs(spark):
    cells = [(p, i, j, 0.9 if (j - i) % 3 == p % 3 else 0.1 * i, 0.0) for p in range(12) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(cells, "pair_id long, i int, j int, ccf double, lag double")
    known = spark.createDataFrame([(p, int(p < 4)) for p in range(11)], "pair_id long, label int")
    got = matrices.training_pairs(df, known, 1.5, 2).collect()
    good = {(r.pair_id, r.i, r.j) for r in got if r.label == 1}
    other = {(r.pair_id, r.i, r.j) for r in got if r.label == 0}
    assert good == {(p, i, j) for p, i, j, _, _ in cells if p < 4 and (j - i) % 3 == p % 3}
    rest = [(p, i, j) for p, i, j, _, _ in cells if 4 <= p < 11]
    assert other == set(sorted(rest, key=lambda x: hashlib.sha256("2|{}|{}|{}".format(*x).encode()).hexdigest())[: int(1.5 * len(good))])


def test_modality_table(spark):
    rows = [(ref, f, 10.0 ** (y * 2 - 1) * (1 + k / 10), y) for ref in ("cartridge", "land") for f in ("1", "2") for y in (0, 1) for k in range(4)]
    held = spark.createDataFrame(rows, "ref_id string, fold string, lr double, label int")
    same = spark.createDataFrame([("cartridge", "h"), ("land", "h")], "ref_id string, config_hash string")
    got = {r.ref_id: r for r in reports.modality_table(same, held).collect()}
    assert set(got) == {"cartridge", "land"} and all(r.one_config and r.n_folds == 2 and r.auc == 1.0 for r in got.values())
    one = held.where("ref_id = 'land' and fold = '1'").withColumn("score", F.log10("lr"))
    assert got["land"].cllr == pytest.approx(metrics.cllr(one).first()["cllr"])  # folds are alike
    mixed = reports.modality_table(same.withColumn("config_hash", F.col("ref_id")), held)
    assert not any(r.one_config for r in mixed.collect())


def test_markers_and_scorers_beside_a_baseline(spark):
    scores = spark.createDataFrame([(0.0, 0), (24.0, 1), (12.0, 1)], "score double, label int")
    asked = spark.createDataFrame([(1, 0.0), (2, 24.0), (3, 23.9), (4, 1.0), (5, -3.0), (6, 99.0), (7, None)], "query_id long, score double")
    got = {r.query_id: (r.bin, r.inside) for r in metrics.histogram_markers(scores, asked).collect()}
    assert got == {1: (0, True), 2: (23, True), 3: (23, True), 4: (1, True), 5: (0, False), 6: (23, False), 7: (None, None)}
    assert {r.bin for r in metrics.histogram_markers(scores.where("label = 0"), asked.where("score = 0")).collect()} == {0}
    assert {r.bin for r in metrics.histogram_markers(scores.limit(0), asked).collect()} == {None}
    table = spark.createDataFrame([("base", 0, 0.5, 0.9), ("base", 1, 0.4, 0.8), ("new", 0, 0.3, 0.95), ("new", 2, 0.1, 1.0)], "lever string, fold int, cllr double, auc double")
    rows = folds.beside(table, "base", ("cllr", "auc")).collect()
    assert [(r.lever, r.fold, round(r.cllr_gain, 9), round(r.auc_gain, 9)) for r in rows] == [("new", 0, 0.2, 0.05)]
