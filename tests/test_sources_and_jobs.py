import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tablecheck import Rule
from tablecheck.operators import clean
from tablecheck.operators.autoencoder import classify
from tablecheck.operators.model import Model
from tablecheck.operators.session import use_checkpoints
from tablecheck.plans import jobs
from tablecheck.sources import readers, writers
from tablecheck.sources.folders import alternatives, list_files, name_pattern


@pytest.fixture
def people(spark):
    rows = [(1, " Ann@X.org", 30.0), (2, None, 200.0), (3, "bob@y.org", -1.0), (4, "c", None)]
    return spark.createDataFrame(rows, "id int, email string, age double")


def test_dispatch_by_suffix(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p.parquet"))
    people.write.option("header", True).csv(str(tmp_path / "p.PARQUET"))
    assert dict(readers.read_dataset(spark, str(tmp_path / "p.parquet")).dtypes)["age"] == "double"
    upper = readers.read_dataset(spark, str(tmp_path / "p.PARQUET"))  # the suffix is case-sensitive: CSV
    assert dict(upper.dtypes)["age"] == "double" and upper.count() == 4
    text = readers.read_dataset(spark, str(tmp_path / "p.PARQUET"), "id string, email string, age string")
    assert dict(text.dtypes)["id"] == "string"


def test_training_dir_reads_every_file(spark, people, tmp_path):
    folder = str(tmp_path / "train")
    os.makedirs(folder)
    pdf = people.toPandas()
    pdf.head(2).to_parquet(f"{folder}/a.parquet")
    pdf.tail(2).to_csv(f"{folder}/b.csv", index=False)
    (tmp_path / "train" / "notes.txt").write_text("x")
    got = readers.read_training_dir(spark, folder)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        readers.read_training_dir(spark, str(tmp_path))


RULES = [
    {"id": "r1", "name": "has mail", "scope": "table", "targetFields": ["email"]},
    {"id": "r2", "type": "statistical_outlier", "targetFields": ["age"], "parameters": {"lo": "0", "hi": "150"},
     "conditions": [{"field": "age", "operator": "less_than", "value": "100"}]},
]


def test_rules_from_json(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    with open(path, "w") as f:
        json.dump(RULES, f, indent=1)
    rules = {r.id: r for r in readers.to_rules(readers.read_rules(spark, path))}
    assert (rules["r1"].category, rules["r1"].name, rules["r1"].target_fields) == ("simple", "has mail", ("email",))
    assert rules["r2"].conditions[0]["operator"] == "less_than" and rules["r2"].name == "unnamed"
    held = spark.createDataFrame([(json.dumps(RULES),)], "j string").select(F.explode(readers.parse_rules(F.col("j"))).alias("r"))
    assert {r.id for r in readers.to_rules(held.select("r.*"))} == {"r1", "r2"}
    many = spark.range(10_001).select(F.col("id").cast("string").alias("n")).crossJoin(held.limit(1)).select("r.*")
    assert len(readers.to_rules(many)) == 10_001


def test_file_admission(spark, tmp_path):
    for name, size in (("a.csv", 5), ("b.PARQUET", 5), ("c.txt", 5), ("d.csv", 0), ("e.csv", 50), ("f", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = readers.admit_files(spark, str(tmp_path / "*"), max_bytes=20)
    got = {os.path.basename(r["path"]): (r["is_valid"], r["reason"], r["content_type"]) for r in files.collect()}
    binary = "application/octet-stream"
    assert got == {
        "a.csv": (True, "", "text/csv"), "b.PARQUET": (True, "", binary), "c.txt": (False, "file type not allowed", binary),
        "d.csv": (False, "file is empty", "text/csv"), "e.csv": (False, "file too large", "text/csv"), "f": (False, "file type not allowed", binary),
    }


def test_listing_of_folders(spark, tmp_path):
    tree = {"2024/01/a.csv": 3, "2024/01/b c%20.csv": 0, "2024/02/deep/x/c.parquet": 7, "2024/02/_hidden": 1, "2023/01/d.csv": 1, "top.csv": 2}
    for name, size in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)

    def found(glob):
        return sorted((r["path"].removeprefix(f"file:{tmp_path}/"), r["length"]) for r in list_files(spark, f"{tmp_path}/{glob}").collect())

    shown = sorted((k, v) for k, v in tree.items() if "_hidden" not in k)
    assert found("*") == found("") == found("{*,top.csv}") == shown
    assert found("2024") == found("2024/") == found("202[4-9]/*") == [x for x in shown if x[0].startswith("2024")]
    assert found("20??/01/*.csv") == [("2023/01/d.csv", 1), ("2024/01/a.csv", 3), ("2024/01/b c%20.csv", 0)]
    assert found("{2023,2024}/0[^1]") == [("2024/02/deep/x/c.parquet", 7)]
    assert found("top.csv") == [("top.csv", 2)] and found("none/*") == found("*/01/z*") == []


def test_names_of_globs():
    assert set(alternatives("a{b,c{d,}}e")) == {"abe", "acde", "ace"}
    assert re.fullmatch(name_pattern("a.*[0-9]?"), "a.x7z") and not re.fullmatch(name_pattern("a.*"), "ab")


@pytest.mark.parametrize("name", ["d.parquet", "d.csv"])
def test_snapshot_and_restore(spark, people, tmp_path, name):
    source, backup = str(tmp_path / name), str(tmp_path / "backup")
    writers.write_like(people, source, source)
    before = sorted(map(str, readers.read_dataset(spark, source).collect()))
    writers.snapshot(spark, source, backup)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.snapshot(spark, source, backup)
    writers.write_like(people.limit(1), source, source)
    writers.restore(spark, backup, source)
    spark.catalog.refreshByPath(source)
    assert sorted(map(str, readers.read_dataset(spark, source).collect())) == before


def test_anomaly_export(spark, tmp_path):
    rows = [(1, 2.0, {"b": "x", "a": "1"}), (2, 0.1, {"z": "no"}), (3, 0.9, {"c": "q,\"r\""})]
    scored = classify(spark.createDataFrame(rows, "record_id int, reconstruction_error double, field_values map<string,string>"))
    out = str(tmp_path / "out")
    assert writers.export_anomalies(scored, out) == ["a", "b", "c"]
    back = spark.read.csv(out, header=True, escape='"').orderBy("record_id").collect()
    assert [r.asDict() for r in back] == [
        {"record_id": "1", "reconstruction_error": "2.0", "severity": "critical", "a": "1", "b": "x", "c": None},
        {"record_id": "3", "reconstruction_error": "0.9", "severity": "medium", "a": None, "b": None, "c": 'q,"r"'},
    ]
    nothing = str(tmp_path / "none")
    assert writers.export_anomalies(scored.where("record_id = 2"), nothing) is None and not os.path.exists(nothing)
    assert writers.export_anomalies(scored, out, fields=["b"]) == ["b"]
    # more fields than an export may have columns
    more = scored.unionByName(classify(spark.createDataFrame([(4, 9.0, {})], "record_id int, reconstruction_error double, field_values map<string,string>")))
    assert writers.export_anomalies(more, out, widest=2) == ["field", "value"]
    back = spark.read.csv(out, header=True, escape='"').collect()
    assert {(r["record_id"], r["field"], r["value"]) for r in back} == {("1", "a", "1"), ("1", "b", "x"), ("3", "c", 'q,"r"'), ("4", None, None)}
    assert writers.anomaly_fields(more, 3) is None and writers.anomaly_fields(more, 4) == ["a", "b", "c", "z"]


# ---- jobs ---------------------------------------------------------------------------


def test_validation_job(spark, people, tmp_path):
    data, results, ledger = (str(tmp_path / n) for n in ("d.parquet", "results", "runs"))
    people.write.parquet(data)

    def positive(record):
        return record["age"] > 0

    rules = [
        Rule("mail", "has mail", "simple", ("email",)),
        Rule("age", "age", conditions=({"field": "age", "operator": "between", "value": "0,150"},)),
        Rule("py", "python", target_fields=("age",), function=positive),
    ]
    for _ in range(2):  # a rerun replaces its own rows
        outcome = jobs.validation_job(spark, "run1", data, rules, "id", results, ledger, dataset_id="ds")
    jobs.validation_job(spark, "run2", data, rules[:1], "id", results, ledger)
    s = outcome["summary"]
    assert (s["total_records"], s["total_evaluations"], s["passed"], s["failed"], s["errors"]) == (4, 12, 6, 5, 1)
    assert s["passed"] + s["failed"] + s["errors"] == s["total_evaluations"]
    assert (outcome["score"], s["rules_submitted"], s["rules_executed"]) == (50.0, 3, 3)
    written = spark.read.parquet(results)
    assert {r["run_id"]: r["count"] for r in written.groupBy("run_id").count().collect()} == {"run1": 12, "run2": 4}
    now = {r["id"]: r for r in jobs.current_state(spark.read.parquet(ledger)).collect()}
    assert (now["run1"]["status"], now["run1"]["score"], now["run2"]["status"]) == ("completed", 50.0, "completed")
    with pytest.raises(Exception):
        jobs.validation_job(spark, "run3", str(tmp_path / "gone.parquet"), rules, "id", results, ledger)
    failed = jobs.job_status(spark.read.parquet(ledger), "run3").first()
    assert failed["status"] == "failed" and failed["error_message"]
    with pytest.raises(ValueError):
        jobs.validation_job(spark, "run4", data, [], "id", results, ledger)


@pytest.mark.parametrize("name", ["d.parquet", "d.csv"])
def test_clean_job(spark, people, tmp_path, name):
    source, ledger, root = str(tmp_path / name), str(tmp_path / "ledger"), str(tmp_path)
    writers.write_like(people, source, source)
    steps = clean.compile_steps([("normalize_text", {"column": "email"}), ("drop_out_of_range", {"column": "age", "lo": 0, "hi": 150})])
    s = jobs.clean_job(spark, "j1", source, steps, ["id"], f"{root}/b1", root, ledger)["summary"]
    assert s == dict(total_records=4, modified_records=1, unchanged_records=0, error_records=0, output_records=1,
                     output_path=f"{root}/cleaned/j1/{name}")
    assert readers.read_dataset(spark, s["output_path"]).first()["email"] == "ann@x.org"
    assert readers.read_dataset(spark, source).count() == 4 and os.path.exists(f"{root}/b1")
    assert glob.glob(f"{s['output_path']}/*.{'csv' if name.endswith('csv') else 'parquet'}")

    def broken(df):
        return df.select("no_such_column")

    with pytest.raises(Exception):
        jobs.clean_job(spark, "j2", source, [broken], ["id"], f"{root}/b2", root, ledger)
    with pytest.raises(ValueError, match="not unique"):
        jobs.clean_job(spark, "j3", source, lambda d: d.where("id < 3").withColumn("age", F.lit(1.0)).union(d), ["id"], f"{root}/b3", root, ledger)
    states = {r["id"]: r["status"] for r in jobs.current_state(spark.read.parquet(ledger)).collect()}
    assert states == {"j1": "completed", "j2": "failed", "j3": "failed"}
    assert readers.read_dataset(spark, source).count() == 4
    with pytest.raises(ValueError):
        jobs.clean_job(spark, "j4", source, steps, ["id"], f"{root}/b4", root, ledger, state="completed")


def test_score_job(spark, people, tmp_path):
    # a one-component linear model over one feature reconstructs nothing away: error 0 everywhere
    model = Model("pca", ["age"], [0.0], [1.0], None, None, 1, [0.0])
    models = spark.createDataFrame([("m1", "completed"), ("m2", "running")], "model_id string, status string")
    args = dict(key="id", results_path=str(tmp_path / "scores"), ledger_path=str(tmp_path / "ledger"), threshold=100.0)
    s = jobs.score_job(spark, "s1", "m1", models, model, people, **args)["summary"]
    assert (s["total_records"], s["anomaly_count"], s["anomaly_percentage"]) == (4, 2, 50.0)
    assert s["severity_counts"] == {"critical": 2, "normal": 2} and sum(s["severity_counts"].values()) == 4
    rows = {r["record_id"]: r["severity"] for r in spark.read.parquet(args["results_path"]).collect()}
    assert rows == {"1": "critical", "2": "critical", "3": "normal", "4": "normal"}
    for bad in ("m2", "m3"):
        with pytest.raises(ValueError):
            jobs.score_job(spark, "s2", bad, models, model, people, **args)


def test_checkpoints_use_the_folder_the_session_names(spark):
    use_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()
