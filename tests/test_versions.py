"""Upserts by version."""

import uuid

from galeframe.operators.common import listed, shared_folder
from galeframe.sources.versions import Versioned

SCHEMA = "id long, name string"


def table(spark, buckets=8):
    return Versioned(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", SCHEMA, ("id",), buckets)


def held(df):
    return sorted(((r["id"], r["name"]) for r in df.collect()), key=repr)


def test_every_version_is_read_back(spark):
    t = table(spark)
    assert t.version() == 0 and held(t.read()) == []
    rows = [(k, f"n{k}") for k in range(100)]
    assert t.upsert(spark.createDataFrame(rows, SCHEMA)) == 1
    first = t.read(1)
    changes = [(5, "new", 1, False), (5, "newer", 2, False), (200, "added", 1, False), (7, None, 1, True), (None, "null key", 1, False)]
    assert t.upsert(spark.createDataFrame(changes, f"{SCHEMA}, at int, gone boolean"), "at", "gone") == 2
    want = sorted([r for r in rows if r[0] not in (5, 7)] + [(5, "newer"), (200, "added"), (None, "null key")], key=repr)
    assert held(t.read()) == want and held(t.read(1)) == held(first) == sorted(rows, key=repr)
    assert t.upsert(spark.createDataFrame([(None, "again")], SCHEMA)) == 3
    assert [r for r in held(t.read()) if r[0] is None] == [(None, "again")]


def test_only_touched_buckets_are_written(spark):
    t = table(spark)
    t.upsert(spark.createDataFrame([(k, "a") for k in range(200)], SCHEMA))
    t.upsert(spark.createDataFrame([(3, "b")], SCHEMA))
    one, two = t._manifest(1), t._manifest(2)
    assert len(one) == 8 and sum(one[b] != two[b] for b in one) == 1
    assert len([n for n in listed(spark, f"{t.root}/data/{next(w for b, w in two.items() if one[b] != w)}") if n.startswith("_bucket")]) == 1


def test_the_slower_of_two_writers_goes_on_from_the_faster(spark):
    t = table(spark)
    t.upsert(spark.createDataFrame([(1, "a")], SCHEMA))
    real, calls = Versioned.version, []

    def late(self):
        calls.append(1)
        if len(calls) == 1:
            seen = real(self)
            Versioned.version = real
            self.upsert(spark.createDataFrame([(2, "other")], SCHEMA))
            Versioned.version = late
            return seen
        return real(self)

    Versioned.version = late
    try:
        assert t.upsert(spark.createDataFrame([(1, "mine")], SCHEMA)) == 3
    finally:
        Versioned.version = real
    assert held(t.read()) == [(1, "mine"), (2, "other")]


def test_a_bucket_that_empties_and_an_empty_upsert(spark):
    t = table(spark, 1)
    t.upsert(spark.createDataFrame([(1, "a")], SCHEMA))
    t.upsert(spark.createDataFrame([(1, None, True)], f"{SCHEMA}, gone boolean"), deleted="gone")
    assert held(t.read()) == [] and t.upsert(spark.createDataFrame([], SCHEMA)) == 3 and held(t.read()) == []
