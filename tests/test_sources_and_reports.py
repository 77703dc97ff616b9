"""Harvest of linked pages, boxes, nested handles, orientations from slopes, measures on counts."""

import hashlib
import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfmatch.functions import kernels
from surfmatch.operators import catalog, consensus, metrics, reports, signals
from surfmatch.sources import readers


def guid(text):
    return str(uuid.uuid5(uuid.NAMESPACE_URL, text))


def test_three_levels_of_links(spark):
    def source(name, label, more="Bullet / CC"):
        return f'<a class="x" href="/Studies/Firearm/Details/{guid(name)}"><b>{label}</b></a> <a href="/Studies/Firearm/Details/{guid(name)}?t=1">{more}</a>'

    def link(kind, name):
        return f'<a href="/Studies/{kind}/Details/{guid(name)}">x</a>'

    pages = [
        ("study", source("f1", "Brl01") + source("u1", " Unk ") + source("q1", "Q3") + source("f2", "Questionable?") + source("f3", "G1A9", "Unknown") + source("f1", "Unknown again")),
        (guid("f1"), link("Bullet", "b2") + link("Bullet", "b1") + link("Bullet", "b2")),
        (guid("f3"), link("Bullet", "b3") + link("BulletMeasurement", "stray")),
        (guid("u1"), link("Bullet", "b9")),
        (guid("b2"), "".join(link("BulletMeasurement", m) for m in ("m1", "m2", "m1"))),
        (guid("b1"), link("BulletMeasurement", "m3")),
        (guid("b3"), "no links here"),
        (guid("b9"), link("BulletMeasurement", "m9")),
        ("bare", None),
    ]
    df = spark.createDataFrame(pages, "page string, html string")
    roots = spark.createDataFrame([("s", "study"), ("t", "bare"), ("v", "unsaved")], "root string, page string")
    got = {(r.root, r.name, r.id) for r in readers.harvested(df, roots).collect()}
    # u1, q1 and f2 have labels of sources that nobody knows, so f3 is the second source; its bullet has no scans
    assert got == {("s", "Barrel1_Bullet1_Land1.x3p", guid("m1")), ("s", "Barrel1_Bullet1_Land2.x3p", guid("m2")), ("s", "Barrel1_Bullet2_Land1.x3p", guid("m3"))}
    second = readers.crawl(df, roots, readers.SCAN_LEVELS[:2]).collect()
    assert {(tuple(r.places), r.id) for r in second} == {((1, 1), guid("b2")), ((1, 2), guid("b1")), ((2, 1), guid("b3"))}
    assert readers.harvested(df.limit(0), roots).count() == 0


def test_boxes_stay_on_the_map(spark):
    rows = [("p", 0, 10, 20, 8, 6, -30.0, 2.5, 0.9, 50, 40), ("p", 1, 45, 38, 8, 6, 9.0, 9.0, 0.8, 50, 40), ("p", 2, 3, 3, 60, 6, 1.0, 0.5, 0.7, 50, 40)]
    df = spark.createDataFrame(rows, "pair_id string, region_id int, y int, x int, h int, w int, dy double, dx double, corr double, ny int, nx int")
    a = {r.region_id: r for r in consensus.boxes(df).collect()}
    b = {r.region_id: r for r in consensus.boxes(df, True).collect()}
    assert (a[0].y, a[0].x, a[0].y_frac, a[0].w_frac) == (10, 20, 0.2, 0.15)
    assert (b[0].y, b[0].x, b[0].x_frac) == (0, 22, 22.5 / 40)  # below the map's edge; 22.5 goes to the even number
    assert (b[1].y, b[1].x) == (42, 34) and b[2].y == 0  # a box larger than the map begins at its edge


def test_nested_handles_are_those_of_plain_json(spark):
    rows = [(1, ([(1, 0.1234567), (2, float("nan"))], {"b": 1.00000049, "a": None}), "é", b"\x00\xff"), (2, None, None, None), (1, ([(1, 0.12345674), (2, None)], {"a": None, "b": 1.0}), "é", b"\x00\xff")]
    df = spark.createDataFrame(rows, "k int, v struct<items:array<struct<n:int,x:double>>,m:map<string,double>>, s string, raw binary")
    got = [r.handle for r in reports.content_handles(df.coalesce(1), ["v", "k", "s", "raw"]).collect()]
    plain = [{"k": 1, "v": {"items": [{"n": 1, "x": 0.123457}, {"n": 2, "x": None}], "m": {"a": None, "b": 1.0}}, "s": "é", "raw": "00ff"}, {"k": 2, "v": None, "s": None, "raw": None}]
    want = [hashlib.sha256(json.dumps(p, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for p in plain]
    assert got == [want[0], want[1], want[0]]
    assert reports.content_handles(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("degrees", [0, 20, 45, 90, 135, 170])
def test_slopes_and_spectrum_find_planted_striae(degrees):
    t = math.radians(degrees)
    yy, xx = np.mgrid[0:96, 0:96].astype(float)
    z = np.sin((xx * math.sin(t) - yy * math.cos(t)) / 2.0) * 1e-6  # constant along the direction (cos t, sin t)
    z[5:9, 40:44] = np.nan
    angle, agreement = kernels.gradient_flow(z)
    away = lambda found: abs((found - degrees + 90) % 180 - 90)
    assert away(angle) < 2 and agreement > 0.9 and 0 <= angle < 180
    found, coherence = kernels.texture(z)
    assert away(found) < 2 and coherence > 0.9


def test_smoothing_weights_are_those_of_a_reflecting_filter():
    rng = np.random.default_rng(4)
    for n, sigma in ((7, 3.0), (40, 3.0), (1, 2.0), (5, 0.0), (3, 5.0)):
        v = rng.normal(size=n)
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if sigma else np.ones(1)
        padded = np.pad(v, reach, mode="symmetric") if n > 1 else np.full(n + 2 * reach, v[0])
        smooth = [padded[i : i + 2 * reach + 1] @ kernel / kernel.sum() for i in range(n)]
        assert kernels.reflected_weights(n, sigma) @ v == pytest.approx(sum(smooth), abs=1e-12)


def test_orientations_of_flat_and_broken_surfaces(spark):
    z = np.tile(np.sin(np.arange(32) / 2.0), (32, 1))
    rows = [(1, 32, 32, z.tobytes()), (2, 32, 32, np.zeros((32, 32)).tobytes()), (3, 32, 32, b"short"), (4, 4, 4, np.full((4, 4), np.nan).tobytes())]
    got = {r.scan_id: r for r in signals.orientations(spark.createDataFrame(rows, "scan_id long, ny int, nx int, heights binary")).collect()}
    assert got[1].angle == pytest.approx(90, abs=1) and got[1].error is None
    assert (got[2].angle, got[2].agreement) == (None, 0.0) and got[3].error and (got[4].angle, got[4].agreement) == (None, 0.0)


def test_measures_of_counts_equal_those_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("xy"[k % 2], round(float(rng.normal() + y), 1), int(y), bool(rng.random() < 0.2)) for k, y in enumerate(rng.random(400) < 0.4)]
    df = spark.createDataFrame(rows, "g string, score double, label int, bound_hit boolean").withColumn("lr", F.exp("score"))
    counts = df.groupBy("g", "score", "label", "bound_hit", "lr").agg(F.count("*").alias("n"))
    for part in (metrics.margin, metrics.lr_separation, metrics.misleading_rates, metrics.km_knm_summary):
        for by in (("g",), ()):
            a, b = ({r[0] if by else 0: [x for x in r if not isinstance(x, str)] for r in part(x, by).collect()} for x in (df, counts))
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
    assert sorted(map(tuple, metrics.score_histogram(df).collect())) == sorted(map(tuple, metrics.score_histogram(counts).collect()))


def test_upserted_ids_are_dense_and_stable(spark):
    old = spark.createDataFrame([(5, "a"), (7, "b")], "id long, name string")
    got = catalog.upsert_keys(old, spark.createDataFrame([(f"n{i % 50:02}",) for i in range(200)] + [("a",)], "name string").repartition(6), ("name",))
    rows = {r.name: r.id for r in got.collect()}
    assert got.count() == 52 and rows["a"] == 5 and sorted(v for k, v in rows.items() if k[0] == "n") == list(range(8, 58))
