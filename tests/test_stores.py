"""Catalog copies and content stores: order, repetition, orphans, figures, digests."""

import hashlib

import pytest

from surfmatch.sources import stores

LINKS = {"scan": {"mark_id": "mark"}, "mark": {"gun_id": "gun", "study_id": "study"}, "gun": {"study_id": "study"}, "study": {"parent": "study"}}
KEYS = {"scan": "id", "mark": "id", "gun": "id", "study": "id"}


def test_parents_come_before_children():
    assert stores.copy_order(LINKS) == ["study", "gun", "mark", "scan"]
    assert stores.copy_order({"b": {}, "a": {}, "c": {"x": "b"}}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        stores.copy_order({"a": {"x": "b"}, "b": {"y": "a"}})


def test_copies_may_be_repeated(spark, tmp_path):
    tables = {
        "study": spark.createDataFrame([(1, None), (2, 1), (2, 1)], "id long, parent long"),
        "gun": spark.createDataFrame([(1, 1), (2, 2), (3, 99), (4, None)], "id long, study_id long"),
        "mark": spark.createDataFrame([(i, 1 + i % 4, 1) for i in range(20)], "id long, gun_id long, study_id long"),
        "scan": spark.createDataFrame([(i, i % 25) for i in range(50)] + [(None, 1)], "id long, mark_id long"),
    }
    base = f"file://{tmp_path}"
    got = {r["table"]: r for r in stores.copy_catalog(tables, LINKS, KEYS, base).collect()}
    assert [r["table"] for r in sorted(got.values(), key=lambda r: r.seq)] == ["study", "gun", "mark", "scan"]
    assert (got["study"].n_source, got["study"].n_inserted, got["gun"].n_inserted, got["gun"].n_orphans) == (2, 2, 3, 1)
    marks = [i for i in range(20) if 1 + i % 4 != 3]
    scans = [i for i in range(50) if i % 25 in marks]
    assert (got["mark"].n_inserted, got["mark"].n_orphans) == (len(marks), 20 - len(marks))
    assert (got["scan"].n_inserted, got["scan"].n_orphans) == (len(scans), 50 - len(scans))
    assert {r.id for r in spark.read.parquet(f"{base}/scan").collect()} == set(scans)
    again = {r["table"]: r for r in stores.copy_catalog(tables, LINKS, KEYS, base).collect()}
    assert all(r.n_inserted == 0 and r.n_present == got[t].n_inserted and r.n_orphans == got[t].n_orphans for t, r in again.items())
    tables["gun"] = spark.createDataFrame([(3, 2)], "id long, study_id long")
    third = {r["table"]: r for r in stores.copy_catalog(tables, LINKS, KEYS, base).collect()}
    assert third["gun"].n_inserted == 1 and third["mark"].n_inserted == 20 - len(marks) and third["scan"].n_orphans == len([i for i in range(50) if i % 25 >= 20])


def test_blobs_are_verified_and_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/blobs"
    blob = lambda b: (hashlib.sha256(b).hexdigest(), b)
    first = spark.createDataFrame([blob(b"a"), blob(b"b"), blob(b"b"), blob(b"")], "key string, content binary")
    assert stores.sync_blobs(first, path) == {"total": 3, "already_present": 0, "uploaded": 3, "verified": 3}
    more = first.union(spark.createDataFrame([blob(b"c" * 1000)], first.schema))
    assert stores.sync_blobs(more, path) == {"total": 4, "already_present": 3, "uploaded": 1, "verified": 1}
    assert stores.sync_blobs(more, path) == {"total": 4, "already_present": 4, "uploaded": 0, "verified": 0}
    false = spark.createDataFrame([blob(b"d"), ("0" * 64, b"e")], first.schema)
    with pytest.raises(ValueError, match="another digest"):
        stores.sync_blobs(false, path)
    assert spark.read.parquet(path).count() == 4
