"""Catalog files, their faults, selections and runs."""

import pytest

from keyloom.session import work_path
from keyloom.sources import catalog_file

ROWS = [("a", True, [], [], "f"), ("b", True, [], ["a", "a", "b"], "f"), ("c", False, ["why"], [], None), ("d", True, ["odd"], ["c", "gone"], "f"), ("e", False, [], ["gone"], None), ("f", True, None, None, None), ("f", False, ["x"], [], None), (None, True, [], [], None)]


def test_catalogs(spark):
    path = work_path(spark, "catalog")
    df = spark.createDataFrame(ROWS, catalog_file.SCHEMA)
    catalog_file.write_catalog(df, path)
    back = catalog_file.read_catalog(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(ROWS, key=str)
    with pytest.raises(Exception, match="already exists"):
        catalog_file.write_catalog(df, path)
    want = {("f", "listed_twice"), ("d", "reason_on_syncable"), ("e", "no_reason"), ("d", "parent_not_syncable"), ("d", "unknown_parent"), ("e", "unknown_parent"), (None, "unnamed")}
    assert {tuple(r) for r in catalog_file.faults(back).collect()} == want
    chosen = spark.createDataFrame([(x,) for x in ("b", "b", "c", "f", "z")], "table_name string")
    assert {tuple(r) for r in catalog_file.selection_faults(back, chosen).collect()} == {("b", "missing_parent"), ("c", "not_syncable"), ("f", "not_syncable"), ("z", "unknown")}
    runs = {r["table_name"]: r["round"] for r in catalog_file.run_tables(df.where("table_name in ('a', 'b', 'c')")).collect()}
    assert runs == {"a": 0, "b": 1}
    cycle = spark.createDataFrame([("a", True, [], ["b"], "f"), ("b", True, [], ["a"], "f")], catalog_file.SCHEMA)
    with pytest.raises(ValueError, match="cyclic"):
        catalog_file.run_tables(cycle)
    assert catalog_file.faults(df.limit(0)).count() == 0 and catalog_file.run_tables(df.limit(0)).count() == 0


def test_a_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "part.json").write_text('{"table_name": "a", "syncable": true}\nnot json\n')
    with pytest.raises(Exception):
        catalog_file.read_catalog(spark, f"file://{tmp_path}").collect()
