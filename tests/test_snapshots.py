"""Versions of several tables at once."""

from __future__ import annotations

import pytest

from quern.operators.snapshots import Conflict, Snapshots

TABLES = {"vectors": "id long, x double", "marks": "id long, list int"}


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    one, other = (Snapshots(spark, f"file://{tmp_path}/set", TABLES) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, float(i)) for i in ids], TABLES["vectors"])
    marks = lambda *ids: spark.createDataFrame([(i, i % 2) for i in ids], TABLES["marks"])
    assert one.version() == 0 and one.read("vectors").count() == one.read("marks").count() == 0
    base = one.version()
    # two writers from one version: data of both is put, one publishes
    mine = {"vectors": [one.put("vectors", rows(1, 2))], "marks": [one.put("marks", marks(1, 2), ("list",), writer="one")]}
    theirs = {"vectors": [other.put("vectors", rows(9))], "marks": [other.put("marks", marks(9), ("list",))]}
    assert one.version() == 0
    assert one.commit(base, mine) == 1
    with pytest.raises(Conflict):
        other.commit(base, theirs)
    assert {r.id for r in other.read("vectors").collect()} == {r.id for r in other.read("marks").collect()} == {1, 2}
    assert other.parts()["marks"][0]["writer"] == "one"
    # the loser starts again from what is there: nothing is lost
    now = other.parts(1)
    assert other.commit(1, {name: now[name] + theirs[name] for name in TABLES}) == 2
    assert {r.id for r in one.read("vectors").collect()} == {1, 2, 9}
    assert {(r.id, r.list) for r in one.read("marks").where("list = 1").collect()} == {(1, 1), (9, 1)}
    # a version can be read on after others were published
    assert {r.id for r in one.read("vectors", 1).collect()} == {1, 2}
    only = one.put("vectors", rows(4))
    assert one.commit(2, {"vectors": [only]}) == 3 and one.read("marks").count() == 3
    lost = one.put("vectors", rows(5, 6, 7))
    assert one.vacuum() == 3 and lost["folder"] not in str(one.parts())
    assert {r.id for r in one.read("vectors").collect()} == {4} and one.read("marks").count() == 3


def test_writes_say_what_they_did(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/set", TABLES)
    rows = lambda *ids: spark.createDataFrame([(i, float(i)) for i in ids], TABLES["vectors"])
    assert table.insert("vectors", rows(1, 2, 2, 3), ["id"]) == {"version": 1, "inserted": 3, "skipped": 1}
    assert table.insert("vectors", rows(3, 4), ["id"]) == {"version": 2, "inserted": 1, "skipped": 1}
    assert table.insert("vectors", rows(), ["id"]) == {"version": 3, "inserted": 0, "skipped": 0}
    before = table.parts()["vectors"]
    assert table.delete("vectors", rows(4, 99), ["id"]) == {"version": 4, "deleted": 1}
    # parts without such rows stay as they are
    assert table.parts()["vectors"][0] == before[0]
    assert table.delete("vectors", rows(77), ["id"]) == {"version": 5, "deleted": 0}
    assert {r.id for r in table.read("vectors").collect()} == {1, 2, 3}
