"""Names, identities, pairs, consensus, screening, readers, kernels and intake."""

import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfmatch.functions import columns as C
from surfmatch.functions import kernels
from surfmatch.functions.helpers import best_lag
from surfmatch.operators import catalog, consensus, matrices, pairs, signals
from surfmatch.sources import readers
from surfmatch.streaming import intake


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, function, want",
    [
        ("Barrel1_Bullet2_Land3.x3p", C.land_name, (1, 2, 3)), ("barrel 10 - bullet_4 land-06", C.land_name, (10, 4, 6)), ("Case 1-1.x3p", C.land_name, None),
        ("Case 1-2.x3p", C.cartridge_source, ("Slide1", "Slide1-Case2")), ("Case A.x3p", C.cartridge_source, None), ("TW01/TW01-01.x3p", C.cartridge_source, ("TW01", "TW01-01")),
        ("a/b/c.x3p", C.cartridge_source, None), ("/c.x3p", C.cartridge_source, None),
        ("VBU1-S4-Qu-Enh_fixed.x3p", C.kit_name, ("VBU1", "S4", "Qu", None, True, "full_headstamp")), ("VCC1-S2-K1_fixed-bf.x3p", C.kit_name, ("VCC1", "S2", "K1", "BF", False, "breech_face")),
        ("VCC1-S2.x3p", C.kit_name, None), ("VCC1-S2-Z9.x3p", C.kit_name, None), ("T01LA-F60-01", C.tool_name, ("T01", "T01LA", "A")), ("X1LA-F60", C.tool_name, None),
    ],
)
def test_names(spark, name, function, want):
    got = one(spark, name, function)
    assert (tuple(got) if got is not None else None) == want


def test_identities(spark):
    h = [hashlib.sha256(x).hexdigest() for x in (b"a", b"b")]
    df = spark.createDataFrame([([h[1], h[0]],), ([h[0]],)], "hashes array<string>").select(C.mark_hash(F.col("hashes")))
    want = [hashlib.sha256("\n".join(sorted(h)).encode()).hexdigest(), h[0]]
    assert [r[0] for r in df.collect()] == want
    ids = spark.createDataFrame([(h[0], h[1]), (h[1], h[0])], "a string, b string").select(C.pair_id(F.col("a"), F.col("b"))).distinct()
    assert [r[0] for r in ids.collect()] == [want[0]]


def test_pairs_in_blocks_are_all_pairs_once(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(24, 5))
    rows = [(i, f"f{i // 4}", m[i].tolist()) for i in range(24)]
    marks = spark.createDataFrame(rows, "mark long, source string, signature array<double>")
    for block in (100, 7, 1):
        got = pairs.labelled(pairs.score_blocks(marks, pairs.dot_product, block), marks).collect()
        assert len(got) == 24 * 23 // 2 and sum(r.label for r in got) == 36
        assert all(r.mark_a < r.mark_b and abs(r.score - m[r.mark_a] @ m[r.mark_b]) < 1e-12 for r in got)


def test_stratified_cap_keeps_same_source_whole(spark):
    rows = [(i, j, int(i // 4 == j // 4), (i % 4 < 2) == (j % 4 < 2)) for i in range(24) for j in range(i + 1, 24)]
    df = spark.createDataFrame(rows, "mark_a long, mark_b long, label int, within boolean")
    got = pairs.stratified(df, ("within",), 50).groupBy("within", "label").count().collect()
    assert {(r.within, r.label): r["count"] for r in got} == {(True, 1): 12, (False, 1): 24, (True, 0): 50, (False, 0): 50}
    again = pairs.stratified(df.repartition(9), ("within",), 50)
    assert pairs.stratified(df, ("within",), 50).exceptAll(again).count() == 0


def test_consensus_takes_the_largest_cluster_and_first_anchor(spark):
    t = [3.0, 3.1, 2.9, 3.05, 40.0, -20.0, 3.0]
    votes = spark.createDataFrame([("p", i, x, 0.2 if i == 6 else 0.9) for i, x in enumerate(t)] + [("q", 0, 0.0, 0.1)], "pair_id string, region_id int, t1 double, corr double")
    pairs_ = spark.createDataFrame([("p",), ("q",), ("r",)], "pair_id string")
    assert {r.pair_id: r.cmr for r in consensus.cmr_scores(pairs_, votes, 0.5, {"t1": 0.5}).collect()} == {"p": 4, "q": 0, "r": 0}
    assert sorted(r.region_id for r in consensus.members(votes, 0.5, {"t1": 0.5}).collect()) == [0, 1, 2, 3]


def test_land_matrix_with_planted_offset(spark):
    rng = np.random.default_rng(1)
    for n, mm in ((6, 6), (7, 4), (3, 5)):
        ccf, lag = rng.random((n, mm)) * 0.2, rng.integers(-9, 9, (n, mm)).astype(float)
        for i in range(n):
            ccf[i, (i + 2) % mm] += 0.6
        cells = spark.createDataFrame([("p", i, j, float(ccf[i, j]), float(lag[i, j])) for i in range(n) for j in range(mm)], "pair_id string, i int, j int, ccf double, lag double")
        got = matrices.features(cells).first()
        diag = [ccf[i, (i + 2) % mm] for i in range(n)]
        means = sorted((np.mean([ccf[i, (i + k) % mm] for i in range(n)]) for k in range(mm)), reverse=True)
        off = np.mean([ccf[i, j] for i in range(n) for j in range(mm) if j != (i + 2) % mm])
        want = (2, np.mean(diag), min(diag), np.mean(diag) - off, means[0] - means[1], 1 / (1 + np.std([lag[i, (i + 2) % mm] for i in range(n)])))
        assert tuple(got)[1:] == pytest.approx(want)
        assert matrices.best_diagonal(cells).count() == n


def test_exclusion_rules_in_order(spark):
    rows = [
        (0, "a", "A", "h1", True, True, True), (1, "b", "A", "h1", True, True, True), (2, "c", "A", "h2", False, True, True), (3, "d", None, "h3", True, True, True),
        (4, "e", "A", "h4", True, True, True), (5, "f", "B", "h4", False, True, True), (6, "g", "A", "h5", True, False, True), (7, "h", "A", "h5", True, True, True), (8, "i", "A", "h6", True, True, False),
    ]
    df = spark.createDataFrame(rows, "seq int, name string, source string, content_hash string, parse_ok boolean, scope_ok boolean, signature_ok boolean")
    got = {r.seq: r.rule for r in catalog.screened(df).collect()}
    assert got == {0: None, 1: "duplicate", 2: "unparseable", 3: "unattributable", 4: "unattributable", 5: "unparseable", 6: "scope_refusal", 7: "duplicate", 8: "unparseable"}


def test_upsert_numbers_new_keys_once(spark):
    have = spark.createDataFrame([(5, "k1")], "id long, name string")
    new = spark.createDataFrame([(f"k{i % 40}",) for i in range(200)], "name string")
    got = catalog.upsert_keys(have, new, ("name",)).collect()
    assert len(got) == 40 and sorted(r.id for r in got) == list(range(5, 45))
    assert catalog.upsert_keys(catalog.upsert_keys(have, new, ("name",)), new, ("name",)).count() == 40


def scan_file(z, checksum=None):
    data = z.astype("<f8").tobytes()
    xml = (
        '<p:ISO5436_2 xmlns:p="x"><Record1><Axes><CX><DataType>D</DataType><Increment>1e-6</Increment></CX><CY><DataType>D</DataType><Increment>2e-6</Increment></CY><CZ><DataType>D</DataType></CZ></Axes></Record1>'
        f"<Record3><MatrixDimension><SizeX>{z.shape[1]}</SizeX><SizeY>{z.shape[0]}</SizeY><SizeZ>1</SizeZ></MatrixDimension><DataLink><PointDataLink>bindata/data.bin</PointDataLink>"
        f"<MD5ChecksumPointData>{checksum or hashlib.md5(data).hexdigest()}</MD5ChecksumPointData></DataLink></Record3></p:ISO5436_2>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("main.xml", xml)
        f.writestr("bindata/data.bin", data)
    return out.getvalue()


def test_scan_files_are_read_or_counted(spark, tmp_path):
    z = np.arange(12.0).reshape(3, 4)
    z[1, 2] = np.nan
    for name, content in (("a.x3p", scan_file(z)), ("b.x3p", b"no zip"), ("c.x3p", scan_file(z, "0" * 32))):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: r for r in readers.read_surfaces(spark, f"file://{tmp_path}").collect()}
    a = got["a.x3p"]
    assert np.array_equal(np.frombuffer(a.heights).reshape(a.ny, a.nx), z, equal_nan=True) and (a.dx, a.dy, a.error) == (1e-6, 2e-6, None)
    assert got["b.x3p"].error and "checksum" in got["c.x3p"].error and got["c.x3p"].heights is None


def test_measures_and_scope(spark):
    y, x = np.mgrid[0:120, 0:150].astype(float)
    striae = 1e-6 * np.sin(x / 2.5) + 1e-9 * y * y
    rows = [(1, 120, 150, 2e-6, 2e-6, striae.tobytes()), (2, 120, 150, 5e-6, 5e-6, striae.tobytes()), (3, 5, 5, 1e-6, 1e-6, b"short")]
    df = spark.createDataFrame(rows, "scan_id long, ny int, nx int, dx double, dy double, heights binary")
    got = {r.scan_id: r for r in signals.scope(signals.measure(df), "toolmark").collect()}
    assert got[1].admissible and got[1].detected == "striated" and abs((got[1].angle - 90) % 180) < 2
    assert got[2].blocking == ["resolution"] and not got[3].admissible and got[3].error
    sig = {r.scan_id: r for r in signals.striation_signatures(df).collect()}
    assert sig[3].signature is None and len(sig[1].signature) == sig[1].hi - sig[1].lo


def test_kernels_against_direct_formulas():
    rng = np.random.default_rng(5)
    v = rng.normal(size=200)
    taps = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
    want = np.convolve(np.pad(v, 12, mode="edge"), taps / taps.sum(), "valid")
    assert np.allclose(kernels.smooth(v, 3.0), want)
    yy, xx = np.mgrid[0:20, 0:30] / 10.0
    assert np.abs(kernels.polynomial_residual(1 + 2 * xx - yy + xx * yy + 0.5 * xx**2)).max() < 1e-9
    a = rng.normal(size=60)
    b = np.concatenate([rng.normal(size=5), a, rng.normal(size=9)])
    lag, c = best_lag(a, b)
    a0, b0 = a - a.mean(), b - b.mean()
    full = np.correlate(a0, b0, "full") / np.sqrt((a0 @ a0) * (b0 @ b0))
    assert lag == int(np.argmax(full)) - (len(b) - 1) == -5 and c == pytest.approx(full.max())
    assert best_lag(np.ones(5), a) == (0, 0.0)
    votes = kernels.window_votes(a, b, 20, 10)
    assert [x[2] for x in votes] == [5.0] * 5 and all(x[3] == pytest.approx(1) for x in votes)
    z = rng.normal(size=(9, 9))
    assert np.allclose(kernels.rotated(z, 90, False), np.rot90(z)) or np.allclose(kernels.rotated(z, 90, False), np.rot90(z, -1))
    assert kernels.normalized([np.nan, 1, np.nan]).tolist() == [0.0] * 512 and abs(kernels.normalized(v).std() - 1) < 1e-9
    m = kernels.areal_map(rng.normal(size=(300, 300)) * 1e-6, 2e-6, 2e-6, size=32)
    assert np.linalg.norm(m) == pytest.approx(1) and kernels.areal_peak(m, m, (0, 90)) == pytest.approx(1)


def test_bootstrap_and_lag_alignment_of_pairs(spark):
    marks = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 1.0, 0.0]), (3, None)], "mark long, signature array<double>")
    ask = spark.createDataFrame([(1, 2), (1, 3)], "mark_a long, mark_b long")
    got = {r.mark_b: (r.lag, r.ccf) for r in signals.align_pairs(ask, marks).collect()}
    assert got[2][0] == -2 and got[3] == (None, None)


def test_intake_stream_is_idempotent(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "source_ref string, v int"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], schema).write.parquet(source)
    for k in range(2):
        intake.start_intake(spark.readStream.schema(schema).parquet(source), target, ("source_ref",), f"{tmp_path}/cp{k}").awaitTermination()
    assert sorted(r.source_ref for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_template_peak_equals_direct_search():
    rng = np.random.default_rng(8)
    target = rng.normal(size=(17, 21))
    cell = target[5:10, 8:14] + 0.01 * rng.normal(size=(5, 6))
    corr, y, x = kernels.template_peak(target, cell)
    padded, best = np.pad(target, ((5, 5), (6, 6))), (-2.0, 0, 0)
    for i in range(17):
        for j in range(21):
            window = padded[i + 5 - 2 : i + 5 + 3, j + 6 - 2 : j + 6 + 4]
            c = np.corrcoef(window.ravel(), cell.ravel())[0, 1] if window.std() > 0 else 0.0
            best = max(best, (c, i, j))
    assert (y, x) == best[1:] == (7, 10) and corr == pytest.approx(best[0])


def test_cells_of_a_shifted_map_agree(spark):
    rng = np.random.default_rng(9)
    big = kernels.smooth(kernels.smooth(rng.normal(size=(90, 90)), 2, 0), 2, 1)
    a, b = big[10:80, 10:80], big[6:76, 13:83]
    maps = spark.createDataFrame([(1, 70, a.tobytes()), (2, 70, np.ascontiguousarray(b).tobytes())], "mark long, side int, heights binary")
    votes = signals.cell_vote_pairs(spark.createDataFrame([(1, 2)], "mark_a long, mark_b long"), maps, grid=5)
    votes = votes.withColumn("pair_id", F.lit("p"))
    best = consensus.cmr_scores(spark.createDataFrame([("p",)], "pair_id string"), votes, 0.3, {"dy": 3.0, "dx": 3.0, "theta": 6.0}).first()
    assert best["cmr"] >= 18
    member = consensus.members(votes, 0.3, {"dy": 3.0, "dx": 3.0, "theta": 6.0}).agg(F.percentile("dy", F.lit(0.5)), F.percentile("dx", F.lit(0.5))).first()
    assert abs(member[0] - 4) <= 1 and abs(member[1] + 3) <= 1


def test_previews_and_images():
    z = np.arange(100.0).reshape(10, 10)
    z[:2] = np.nan
    p = kernels.preview(z, 5)
    assert p.shape == (5, 5) and np.isnan(p[0]).all() and np.nanmin(p) == 0 and np.nanmax(p) == 1
    image = kernels.land_image(z, 8)
    assert image.shape == (2, 8, 8) and image[1].all() and abs(image[0].mean()) < 1e-9
    assert not kernels.land_image(np.full((3, 3), np.nan)).any()


def test_profile_hash_is_of_float_bytes(spark):
    v = [0.1, -2.0, 3.5]
    df = spark.createDataFrame([(v,), ([],)], "p array<double>").select(C.profile_hash(F.col("p")).alias("h"))
    assert [r.h for r in df.collect()] == [hashlib.sha256(np.array(x, "<f8").tobytes()).hexdigest() for x in (v, [])]


def test_ensembles_are_fitted_once(spark, tmp_path):
    from surfmatch.operators import bootstrap

    rng = np.random.default_rng(3)
    rows = [(f"c{i % 16}", float(round(rng.normal(3 * (i % 4 == 0)), 1)), int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "cluster_id string, score double, label int")
    first = bootstrap.cached_ensemble(df, f"file://{tmp_path}", 6)
    again = bootstrap.cached_ensemble(df.repartition(5), f"file://{tmp_path}", 6)
    assert first.inputFiles() == again.inputFiles() and 1 <= first.count() <= 6
    asked = spark.createDataFrame([("q", 2.0)], "query_id string, score double")
    got = bootstrap.lr_intervals(asked, first).first()
    assert got["lo"] <= got["hi"]


def test_children_pages_and_applicability(spark):
    from surfmatch.operators import catalog, signals

    rows = spark.createDataFrame([(1, 5, 2), (1, 4, 1), (2, 9, 7), (None, 3, 1)], "parent int, id int, position int")
    got = {(r.parent, r.id): r.place for r in catalog.children_in_order(rows, "parent", "position", "id").collect()}
    assert got == {(1, 4): 1, (1, 5): 2, (2, 9): 1}
    assert [r.id for r in catalog.page_after(rows, "id", 4, 1).collect()] == [5] and [r.id for r in catalog.page_after(rows, "id", None, 2).collect()] == [3, 4]
    m = spark.createDataFrame([(float(i), i / 100, i * 1e-9) for i in range(101)] + [(50.0, 0.5, float("nan"))], "pitch_um double, coverage double, sq double")
    r = signals.applicability(m).first()
    assert (r.pitch_lo, r.pitch_hi, r.n_reference) == (0.0, 100.0, 102) and abs(r.coverage_floor - 0.0202) < 1e-9 and abs(r.signal_floor_nm - 1.02) < 1e-6


def test_source_keys(spark):
    from surfmatch.functions import columns as C

    row = spark.createDataFrame([("T07AB-3", "a|b")], "tid string, key string").select(
        C.source_key(F.col("tid")).alias("edge"), C.source_key(F.col("tid"), "tool").alias("tool"), C.cluster_sources(F.col("key")).alias("s")
    ).first()
    assert (row.edge, row.tool, tuple(row.s)) == ("T07AB", "T07", ("a", "b"))
