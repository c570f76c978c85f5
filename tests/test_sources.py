"""Reading feeds of several formats, and what is written."""

import json
from pathlib import Path

import pytest

from tidemark.sources import stored, tables

SCHEMA = tables.string_schema("ID", "Name")


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_read_feed(spark, tmp_path, kind):
    rows = spark.createDataFrame([("1", "a", "x"), ("2", None, "y")], "ID string, Name string, OTHER string")
    (rows.write.option("header", "true") if kind == "csv" else rows.write).format(kind).save(f"{tmp_path}/feed")
    options = {"header": "true", "enforceSchema": "false"} if kind == "csv" else {}
    schema = tables.string_schema("ID", "Name", "OTHER") if kind == "csv" else SCHEMA
    found = tables.read_feed(spark, f"{tmp_path}/feed", schema, kind, **options)
    assert found.columns == [c.lower() for c in schema.names]
    assert sorted((r.id, r.name) for r in found.collect()) == [("1", "a"), ("2", None)]


def test_actions_are_added(spark, tmp_path):
    for action in ("ALERT", "BACKUP"):
        tables.append_rows(spark.createDataFrame([(action, 1)], "action string, supplier_id int"), f"{tmp_path}/actions")
    assert sorted(r.action for r in spark.read.parquet(f"{tmp_path}/actions").collect()) == ["ALERT", "BACKUP"]


def test_reports_are_lines_of_json(spark, tmp_path):
    for n in (1, 2):
        tables.write_report(spark.createDataFrame([(n, {"f": 0.5})], "max_psi int, by_feature map<string,double>"), f"{tmp_path}/report", "2024-01-01")
    lines = [json.loads(x) for p in Path(f"{tmp_path}/report").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["max_psi"] for x in lines) == [1, 2] and all(x["by_feature"] == {"f": 0.5} and x["_reported_at"].startswith("2024-01-01") for x in lines)


def test_stored_tables_can_be_discarded(spark):
    df = stored.store(spark.range(5), "numbers")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 5 and folder.exists()
    stored.discard(df)
    assert not folder.exists()
