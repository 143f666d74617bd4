import json
import math
from pathlib import Path

import pytest

from twinlens import cli
from twinlens.sources import folders, tables


def write(path, rows, header="age,income,sex,등급"):
    path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n", encoding="utf-8-sig")


@pytest.fixture
def folder(tmp_path):
    import random

    r = random.Random(3)
    one = lambda: (r.randint(20, 24), r.choice([100, 150.5, 200]), r.choice("MF"), r.choice("abcd"))
    write(tmp_path / "x_origin.csv", [one() for _ in range(40)])
    write(tmp_path / "x_synth.csv", [one() for _ in range(60)])
    return tmp_path


def test_csv_reading(spark, tmp_path):
    write(tmp_path / "a.csv", [(1, "NA", " x", "007"), (2, 2.5, '"a,""b"""', "")])
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [(1, None, " x", 7), (2, 2.5, 'a,"b"', None)]
    text = tables.read_table_as_strings(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in text.collect()] == [("1", "NA", " x", "007"), ("2", "2.5", 'a,"b"', "")]
    assert tables.read_table_as_strings(spark, str(tmp_path / "a.csv"), ["", "NA"]).first().income is None
    (tmp_path / "k.csv").write_bytes("이름,v\n가,1\n".encode("cp949"))
    assert tables.read_table(spark, str(tmp_path / "k.csv")).first()["이름"] == "가"
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.bin").write_bytes(b"")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "a.bin"))


def test_large_csv_is_read_alike(spark, tmp_path, monkeypatch):
    """With and without line breaks within quotes, in both encodings: splitting changes nothing."""
    rows = [(k, k / 4, f" v{k % 7}", f"가{k}") for k in range(300)]
    write(tmp_path / "a.csv", rows)
    write(tmp_path / "b.csv", [*rows, (1, 2, '"x\ny"', "z")])
    (tmp_path / "k.csv").write_bytes("이름,v\n가,1\n나,2\n".encode("cp949"))
    small = [sorted(map(tuple, tables.read_table(spark, str(tmp_path / f"{n}.csv")).collect())) for n in "abk"]
    assert [len(x) for x in small] == [300, 301, 2]
    monkeypatch.setattr(tables, "SPLIT_BYTES", 0)
    assert [sorted(map(tuple, tables.read_table(spark, str(tmp_path / f"{n}.csv")).collect())) for n in "abk"] == small
    assert tables._csv_facts(spark, str(tmp_path / "a.csv")) == (False, False)
    assert tables._csv_facts(spark, str(tmp_path / "b.csv")) == (True, False)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, " b ", ""), (1, 'a"q', "x,y")], "k int, s string, t string")
    tables.write_csv(df, str(tmp_path / "o.csv"), "k")
    back = tables.read_table_as_strings(spark, str(tmp_path / "o.csv"))
    assert [tuple(r) for r in back.collect()] == [('a"q', "x,y"), (" b ", "")]


def test_json(tmp_path):
    tables.save_json({"a": math.nan, "b": [math.inf, 1.5], "c": tmp_path}, tmp_path / "x.json")
    assert tables.load_json(tmp_path / "x.json") == {"a": None, "b": [None, 1.5], "c": tmp_path.as_posix()}


def test_folder_discovery(folder):
    pair = folders.find_data_pair(folder)
    assert pair.prefix == "x" and pair.output_dir.name == "x_results"
    (folder / "~$x_origin.csv").write_text("")
    (folder / "y_ORIGIN.csv").write_text("a\n")
    assert folders.find_data_pair(folder).prefix == "x"
    assert folders.find_data_pair(folder, "y", need_synthetic=False).synthetic is None
    with pytest.raises(folders.DataDirError):
        folders.find_data_pair(folder, "z")
    (folder / "x_synth.parquet").write_text("")
    with pytest.raises(folders.DataDirError):
        folders.find_data_pair(folder)


def test_stages_end_to_end(spark, folder):
    at = ["--data_dir", str(folder)]
    assert cli.main(["threshold", "--metric", "inference_risk", "--method", "distribution", *at], spark) == 0
    assert cli.main(["threshold", "--metric", "single_out_risk", "--n_simulations", "5", *at], spark) == 0
    assert cli.main(["preprocess", "--reduction_method", "inference_distance", *at], spark) == 0
    out = folder / "x_results"
    record = json.loads((out / "preprocess/reduction.json").read_text())
    assert record["n_synthetic_after"] == 40 and record["n_deleted_total"] == 20
    processed = (out / "preprocess/synthetic_processed.csv").read_text(encoding="utf-8-sig").splitlines()
    source = (folder / "x_synth.csv").read_text(encoding="utf-8-sig").splitlines()
    assert processed == [source[0], *(x for k, x in enumerate(source[1:]) if k not in record["deleted_row_indices"])]
    assert len(processed) == 41 and set(processed) <= set((folder / "x_synth.csv").read_text(encoding="utf-8-sig").splitlines())
    assert (folder / "x_synth_processed.csv").exists()
    assert cli.main(["privacy", "--quasi_identifiers", "sex", "--sensitive_attributes", "등급", "income", "--evaluation_mode", "combined", *at], spark) == 0
    risk = json.loads((out / "metrics/inference_risk.json").read_text())
    # Preprocessing has kept the distances of the rows that stay.
    assert risk["passed"] in (True, False) and risk["cache_hit"] and risk["cache_key"] == record["processed_cache_key"]
    assert risk["value"] == pytest.approx(record["processed_inference_risk"]) and risk["details"]["n_evaluated"] == 40 - risk["details"]["n_ties"]
    assert cli.main(["metric", "--name", "inference_risk", *at], spark) == 0
    again = json.loads((out / "metrics/inference_risk.json").read_text())
    assert again["cache_hit"] and again["value"] == risk["value"]
    cap = json.loads((out / "metrics/linkage_risk.json").read_text())
    first = cap["details"]["evaluations"][0]
    assert first["original_count"] == 40 and first["synthetic_count"] == first["synthetic_valid_count"] == 40 and first["evaluation_status"] == "evaluated"
    assert json.loads(first["key_columns"]) == ["sex"] and first["matched_count"] + first["unmatched_count"] == first["evaluated_count"]
    listed = json.loads(Path(cap["details"]["records_file"]).read_text())["records"]
    assert len(listed) == 3 * 40 and sum(r["exceeds_threshold"] for r in listed) == cap["exceed_count"]
    assert [e["evaluation"] for e in cap["details"]["evaluations"]] == ["income", "등급", "등급+income"]
    assert cli.main(["utility", *at], spark) == 0
    figures = json.loads((out / "metrics/univariate_similarity.json").read_text())["details"]["figures"]
    assert set(figures) == {"age", "income", "sex", "등급", "summary"} and all(Path(p).is_file() for p in figures.values())


def test_report(spark, folder, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text(f"data_dir: {folder}\nn_simulations: 3\nskip_metrics: [pmse]\nreduction_method: random\n")
    assert cli.main(["report", "--config", str(config), "--n_simulations", "4"], spark) == 0
    report = json.loads((folder / "x_results/report.json").read_text())
    assert report["overall_passed"] in (True, False) and "pmse" not in report["metrics"] and "linkage_risk" not in report["metrics"]
    assert report["thresholds"]["bivariate_similarity"]["simulation"]["n_simulations"] == 4


def test_on_off_and_files(spark, folder, tmp_path):
    files = ["--original", str(folder / "x_origin.csv"), "--synthetic", str(folder / "x_synth.csv"), "--output_dir", str(tmp_path / "r")]
    values = cli.parse_args(["report", *files, "--plots", "off", "--duplicate_adjustment", "off", "--size_correction", "off", "--drop_constant_columns", "on", "--remove_exact_matches", "on", "--linkage_missing_policy", "error", "--linkage_evaluation_mode", "combined"])
    assert [values[k] for k in ("plots", "duplicate_adjustment", "size_correction", "drop_constant_columns", "remove_exact_matches")] == [False, False, False, True, True]
    assert (values["linkage_missing_policy"], values["linkage_evaluation_mode"]) == ("error", "combined")
    config = tmp_path / "c.yaml"
    config.write_text(f'original: {folder / "x_origin.csv"}\nsynthetic: {folder / "x_synth.csv"}\noutput_dir: {tmp_path / "wrong"}\nplots: "off"\nmodel_params: \'{{"maxIter": 5}}\'\nskip_metrics: [bivariate_similarity, pmse]\n')
    values = cli.parse_args(["utility", "--config", str(config), "--output_dir", str(tmp_path / "u")])
    assert values["plots"] is False and values["model_params"] == {"maxIter": 5}
    assert cli.main(["utility", "--config", str(config), "--output_dir", str(tmp_path / "u")], spark) == 0
    assert not (tmp_path / "u/figures").exists() and not (tmp_path / "wrong").exists() and not (tmp_path / "u/metrics/pmse.json").exists()
    assert cli.parse_args(["metric", "--name", "pmse", "--config", str(config), *files][:3] + files)["original"].endswith("x_origin.csv")
    for bad in (["report", "--prefix", "x", *files], ["report", "--original", "a.csv"], ["threshold", "--metric", "pmse"], ["report", *files, "--plots", "no"]):
        with pytest.raises(SystemExit):
            cli.parse_args(bad)
    with pytest.raises(SystemExit) as e:
        cli.parse_args(["--version"])
    assert e.value.code == 0


def test_threshold_file(spark, folder, tmp_path):
    files = ["--original", str(folder / "x_origin.csv"), "--synthetic", str(folder / "x_synth.csv")]
    assert cli.main(["threshold", "--metric", "single_out_risk", "--manual_threshold", "0.25", "--original", files[1], "--output_dir", str(tmp_path / "t")], spark) == 0
    record = tmp_path / "t/threshold/single_out_risk.json"
    assert cli.main(["metric", "--name", "single_out_risk", *files, "--output_dir", str(tmp_path / "m"), "--threshold_file", str(record)], spark) == 0
    out = json.loads((tmp_path / "m/metrics/single_out_risk.json").read_text())
    assert out["threshold"] == 0.25 and out["threshold_file"] == record.as_posix() and out["pass_rule"] == "value <= threshold" and Path(out["result_file"]).is_file()
    assert cli.main(["metric", "--name", "pmse", *files, "--output_dir", str(tmp_path / "m"), "--threshold_file", str(record)], spark) == 2
    assert cli.main(["metric", "--name", "pmse", *files, "--output_dir", str(tmp_path / "m"), "--threshold_file", str(tmp_path / "none.json")], spark) == 2


def test_column_order_and_exclusion(spark, folder, tmp_path):
    """The processed file has the original's column order; names are compared before columns are excluded."""
    rows = (folder / "x_synth.csv").read_text(encoding="utf-8-sig").splitlines()
    turned = tmp_path / "turned.csv"
    turned.write_text("\n".join(",".join(reversed(r.split(","))) for r in rows) + "\n", encoding="utf-8")
    args = ["preprocess", "--original", str(folder / "x_origin.csv"), "--synthetic", str(turned), "--output_dir", str(tmp_path / "r"), "--reduction_method", "random", "--exclude_columns", "sex"]
    assert cli.main(args, spark) == 0
    got = (tmp_path / "r/preprocess/synthetic_processed.csv").read_text(encoding="utf-8-sig").splitlines()
    assert got[0] == rows[0] and set(got) <= set(rows) and len(got) == 41
    report = json.loads((tmp_path / "r/preprocess/reduction.json").read_text())
    assert len(report["deleted_row_indices"]) == report["n_deleted"] == 20
    lacking = tmp_path / "lacking.csv"
    lacking.write_text("\n".join(",".join(r.split(",")[:2] + r.split(",")[3:]) for r in rows) + "\n", encoding="utf-8")
    assert cli.main([*args[:4], str(lacking), *args[5:]], spark) == 2


def test_any_metric_can_be_simulated(spark):
    from twinlens.operators.thresholds import derive_seeds, simulate, split_in_a

    table = spark.createDataFrame([(k, float(k * k)) for k in range(30)], "row_id long, x double")
    seeds = derive_seeds(5, 3)
    got = simulate(table, 30, seeds, lambda a, b, seed: b.agg({"x": "sum"}).first()[0] - a.agg({"x": "sum"}).first()[0])
    want = [sum(-k * k if side else k * k for k, side in enumerate(split_in_a(30, s))) for s in seeds]
    assert got == list(enumerate(want))


def test_errors(spark, folder, tmp_path):
    files = ["--original", str(folder / "x_origin.csv"), "--synthetic", str(folder / "x_synth.csv"), "--output_dir", str(tmp_path / "r")]
    assert cli.main(["threshold", "--metric", "pmse", "--method", "distribution", *files], spark) == 2
    assert cli.main(["metric", "--name", "linkage_risk", *files], spark) == 2
    assert cli.main(["preprocess", "--original", "none.csv", "--synthetic", "none.csv"], spark) == 2
    assert cli.main(["threshold", "--metric", "single_out_risk", "--strict", "--original", "none.csv", "--output_dir", str(tmp_path / "r")], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["privacy", "--data_dir", str(folder), *files], spark)
    bad = tmp_path / "b.yaml"
    bad.write_text("zz: 1\n")
    with pytest.raises(ValueError):
        cli.main(["report", "--config", str(bad), *files], spark)
