from __future__ import annotations

import pytest
from quarryline.catalog import Catalog, Table
from quarryline.errors import ConnectionError_, ReadOnlyError, ValidationError
from quarryline.operators import write
from quarryline.plans.engine import Engine
from quarryline.sources.tables import jdbc, seed, to_csv


def test_csv_and_seed(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, name string")
    engine = Engine(spark, catalog=Catalog([Table("tags", ("id",))]), frames={"tags": empty})
    seed(engine, {"tags": [{"id": 1, "name": "a,b"}, {"id": 2, "name": None}]})
    to_csv(engine.table("tags").find_many(), str(tmp_path / "out"))
    got = spark.read.option("header", True).schema("id long, name string").csv(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a,b"), (2, None)]
    with pytest.raises(ValidationError):
        seed(engine, {"tags": [{"id": 3, "name": "c"}], "nope": []})
    assert engine.table("tags").count().first()[0] == 2


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(k, f"n{k}", float(k)) for k in range(100)], "id long, name string, value double")
    try:
        rows.write.format("jdbc").options(url=url, dbtable="things", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    except Exception as error:  # the driver's jar is not everywhere
        pytest.skip(str(error)[:80])
    table = jdbc(spark, url, "things", partition=("id", 0, 100, 4))
    assert table.rdd.getNumPartitions() == 4
    things = Engine(spark, catalog=Catalog([Table("things", ("id",))]), frames={"things": table}).table("things")
    found = things.find_many(where={"value": {"gte": 90}}, orderBy={"id": "desc"}, limit=3)
    assert [r["id"] for r in found.collect()] == [99, 98, 97]
    assert any("PushedFilters" in line and "value" in line.lower() for line in things.explain(where={"value": {"gte": 90}}))
    with pytest.raises(ConnectionError_):
        jdbc(spark, url, "missing")
    with pytest.raises(ValidationError):
        jdbc(spark, "odbc:derby:x", "things")


def test_views_cannot_be_written(spark):
    engine = Engine(spark, catalog=Catalog([Table("tags", ("id",))]), frames={"tags": spark.createDataFrame([(1, "a")], "id long, name string")})
    view = engine.view("named", "SELECT id FROM tags WHERE name IS NOT NULL")
    assert [r["id"] for r in view.find_many().collect()] == [1]
    for change in (lambda: write.create_many(view, [{"id": 2}]), lambda: write.delete_many(view, {"id": 1}), lambda: write.update_many(view, {"id": 1}, {"id": 2}), lambda: write.upsert(view, view.find_many(), ["id"], [])):
        with pytest.raises(ReadOnlyError):
            change()
