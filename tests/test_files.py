"""Readers and writers, there and back."""

import json
from pathlib import Path

import pytest

from veredas.functions import domain
from veredas.operators import generate
from veredas.sources import files


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(generate.generate_final_profiles(spark.range(12).withColumnRenamed("id", "row_id")).collect()).drop("row_id")


@pytest.mark.parametrize("name", ["p.parquet", "p.csv", "p.jsonl", "p.json"])
def test_there_and_back(spark, profiles, tmp_path, name):
    path = f"{tmp_path}/{name}"
    files.write_table(profiles, path, single=name == "p.json")
    back = files.read_table(spark, path, None if name.endswith("parquet") else files.profile_schema())
    want = sorted(map(str, profiles.select(sorted(profiles.columns)).selectExpr(*(f"CAST({c} AS STRING) AS {c}" for c in sorted(profiles.columns))).collect()))
    assert sorted(map(str, back.select(sorted(back.columns)).selectExpr(*(f"CAST({c} AS STRING) AS {c}" for c in sorted(back.columns))).collect())) == want


def test_csv_has_a_mark_and_semicolons(spark, profiles, tmp_path):
    files.write_csv(profiles.select("Nome", "Renda"), f"{tmp_path}/a.csv", single=True)
    (part,) = Path(f"{tmp_path}/a.csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfNome;Renda\n")
    assert files.read_table(spark, f"{tmp_path}/a.csv").columns == ["Nome", "Renda"]
    Path(f"{tmp_path}/b.csv").write_text("a,b\n1,2\n")
    assert [r.asDict() for r in files.read_table(spark, f"{tmp_path}/b.csv").collect()] == [{"a": 1, "b": 2}]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xlsx")


def test_json_array(spark, tmp_path):
    files.write_json(spark.createDataFrame([("São", None), ("b", 1)], "a string, n int"), f"{tmp_path}/a.json", single=True)
    (part,) = Path(f"{tmp_path}/a.json").glob("part-*.txt")
    text = part.read_text()
    assert "São" in text and sorted(json.loads(text), key=str) == sorted([{"a": "São", "n": None}, {"a": "b", "n": 1}], key=str) and "\n  {" in text


def test_json_has_no_nan(spark, tmp_path):
    files.write_json(spark.createDataFrame([(float("nan"), 1.0), (2.0, float("inf"))], "a double, b double"), f"{tmp_path}/n.json", single=True)
    (part,) = Path(f"{tmp_path}/n.json").glob("part-*.txt")
    assert sorted(map(str, json.loads(part.read_text()))) == sorted(map(str, [{"a": None, "b": 1.0}, {"a": 2.0, "b": None}]))


def test_export_chooses_last(spark, profiles, tmp_path):
    assert files.export_profiles(profiles, f"{tmp_path}/m.parquet", preset="minimo") == list(domain.PRESETS["minimo"])
    assert spark.read.parquet(f"{tmp_path}/m.parquet").columns == list(domain.PRESETS["minimo"])
    with pytest.raises(ValueError):
        files.export_profiles(profiles.drop("CPF"), f"{tmp_path}/n.parquet", preset="minimo")


def test_splits_and_records(spark, tmp_path):
    table = spark.createDataFrame([(i, "holdout" if i % 4 == 0 else "train") for i in range(8)], "row_id long, side string")
    files.save_splits(table, f"{tmp_path}/s", {"seed": 41})
    assert [spark.read.parquet(f"{tmp_path}/s/{k}").count() for k in ("calibration", "train", "holdout")] == [8, 6, 2]
    assert files.read_record(spark, f"{tmp_path}/s/metadata") == {"columns": ["row_id"], "seed": 41}


def test_metric_outputs(spark, tmp_path):
    long = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "metric_group string, metric_name string, value double")
    files.write_metric_outputs(long, f"{tmp_path}/m", ("parquet", "csv", "json"))
    assert spark.read.parquet(f"{tmp_path}/m/parquet").where("metric_group = 'b'").select("value").collect()[0][0] == 2.0
    assert len(list(Path(f"{tmp_path}/m/csv").glob("metric_group=*"))) == 2
    with pytest.raises(ValueError):
        files.write_metric_outputs(long, f"{tmp_path}/n", ("xlsx",))


def test_manifests_with_their_evaluations(spark, tmp_path):
    for name, text in (("a", '{"run_id": "a", "seed": 1}'), ("b/c", '{"run_id": "c", "seed": 2}'), ("d", "{broken")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "manifest.json").write_text(text)
    (tmp_path / "a" / "evaluation.json").write_text('{"tvd": 0.5}')
    found = files.read_manifests(spark, str(tmp_path), "run_id string, seed int")
    assert sorted(r.run_id for r in found.collect()) == ["a", "c"]
    both = files.with_evaluations(found, files.read_manifests(spark, str(tmp_path), "tvd double", "evaluation.json"))
    assert {(r.run_id, r.tvd) for r in both.collect()} == {("a", 0.5), ("c", None)}


def test_events(spark, tmp_path):
    schema = "timestamp_utc string, event string"
    for k in range(3):
        files.append_events(spark.createDataFrame([(f"2026-01-0{k + 1}", f"e{k}")], schema), f"{tmp_path}/e")
    (tmp_path / "e" / "odd.json").write_text("not json\n")
    assert [r.event for r in files.read_events(spark, f"{tmp_path}/e", schema, limit=2).collect()] == ["e2", "e1"]
