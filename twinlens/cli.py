"""Command line: preprocess, threshold, metric, utility, privacy, report."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from . import __version__
from .functions.schema import DataValidationError
from .operators.reduction import STRATEGIES
from .operators.thresholds import METHODS, METRICS
from .plans import evaluate
from .sources.folders import DataDirError, find_data_pair

log = logging.getLogger("twinlens")
GROUPS = {"utility": ["univariate_similarity", "bivariate_similarity", "pmse"], "privacy": ["single_out_risk", "inference_risk", "linkage_risk"]}
CONFIGURED = ("utility", "privacy", "report")


def _json(text: str) -> dict:
    value = json.loads(text)
    if not isinstance(value, dict):
        raise argparse.ArgumentTypeError("a JSON object is expected")
    return value


def _share(text: str) -> float:
    value = float(text)
    if not 0 < value < 1:
        raise argparse.ArgumentTypeError("a number between 0 and 1 is expected")
    return value


def _switch(text: str) -> bool:
    """on or off."""
    if text not in ("on", "off"):
        raise argparse.ArgumentTypeError("on or off is expected")
    return text == "on"


def _shared(p: argparse.ArgumentParser) -> None:
    a = p.add_argument
    a("--original")
    a("--synthetic")
    a("--data_dir")
    a("--prefix")
    a("--output_dir")
    a("--categorical_columns", nargs="+", default=[])
    a("--exclude_columns", nargs="+", default=[])
    a("--random_seed", type=int, default=42)
    a("--n_jobs", type=int, default=-1, help="accepted; the cluster decides")
    a("--threshold_file", help="threshold record to judge by, instead of that in the output folder")
    a("--verbose", action="store_true")
    a("--distance_metric", choices=("gower", "cosine"), default="gower")
    a("--use_gpu", action="store_true")
    a("--duplicate_adjustment", type=_switch, default=True, metavar="{on,off}")
    a("--model", default="logistic_regression")
    a("--model_params", type=_json, default={})
    a("--drop_constant_columns", type=_switch, default=True, metavar="{on,off}")
    a("--quasi_identifiers", nargs="+", default=[])
    a("--sensitive_attributes", nargs="+", default=[])
    a("--linkage_threshold", type=float, default=0.7)
    a("--linkage_missing_policy", "--missing_policy", choices=("exclude", "error"), default="exclude")
    a("--linkage_evaluation_mode", "--evaluation_mode", choices=("individual", "combined"), default="individual")
    a("--alpha", type=_share, default=0.05)
    a("--plots", type=_switch, default=True, metavar="{on,off}")


def _threshold(p: argparse.ArgumentParser) -> None:
    a = p.add_argument
    a("--method", choices=METHODS[:2], default="simulation")
    a("--n_simulations", type=int, default=100)
    a("--quantile", type=_share, default=0.95)
    a("--size_correction", type=_switch, default=True, metavar="{on,off}")
    a("--strict", action="store_true")
    a("--manual_threshold", type=float)


def _preprocess(p: argparse.ArgumentParser) -> None:
    a = p.add_argument
    a("--reduction_method", choices=sorted(STRATEGIES))
    a("--remove_exact_matches", type=_switch, default=False, metavar="{on,off}")
    a("--inference_threshold", type=float)
    a("--target_margin", type=float, default=0.95)


def build_parser() -> tuple[argparse.ArgumentParser, dict[str, argparse.ArgumentParser]]:
    """The parser, and those of its commands."""
    top = argparse.ArgumentParser(prog="twinlens", description=__doc__)
    top.add_argument("--version", action="version", version=f"twinlens {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    parsers = {}
    for name in ("preprocess", "threshold", "metric", "utility", "privacy", "report"):
        p = parsers[name] = sub.add_parser(name)
        _shared(p)
        if name in ("threshold", "report"):
            _threshold(p)
        if name in ("preprocess", "report"):
            _preprocess(p)
        if name == "threshold":
            p.add_argument("--metric", choices=METRICS, required=True)
        if name == "metric":
            p.add_argument("--name", choices=METRICS, required=True)
        if name in CONFIGURED:
            p.add_argument("--config")
            p.add_argument("--metrics", nargs="+", choices=METRICS)
            p.add_argument("--skip_metrics", nargs="+", choices=METRICS)
    return top, parsers


def load_config(path: str, known: set[str]) -> dict:
    import yaml

    values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path} does not map argument names to values")
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown keys in {path}: {unknown}")
    return values


def parse_args(argv: list[str]) -> dict:
    """Settings of a run: command line over configuration file over defaults."""
    parser, parsers = build_parser()
    path = argparse.ArgumentParser(add_help=False)
    path.add_argument("--config")
    command = next((x for x in argv if x in parsers), None)
    if (config := path.parse_known_args(argv)[0].config) and command in CONFIGURED:
        known = {a.dest for a in parsers[command]._actions} - {"help", "config"}  # noqa: SLF001
        # Texts among defaults go through the same conversions as arguments do.
        parsers[command].set_defaults(**load_config(config, known))
    values = vars(parser.parse_args(argv))
    given = {x.removeprefix("--").split("=")[0] for x in argv if x.startswith("--")}
    fail = parsers[values["command"]].error
    if values["data_dir"] and (values["original"] or values["synthetic"]):
        if "data_dir" in given and not given & {"original", "synthetic"}:
            values |= {"original": None, "synthetic": None}
        elif "data_dir" not in given and given & {"original", "synthetic"}:
            values |= {"data_dir": None, "prefix": None}
        else:
            fail("--data_dir and --original/--synthetic exclude each other")
    if values["prefix"] and not values["data_dir"]:
        fail("--prefix needs --data_dir")
    wanted = [] if values["data_dir"] else [n for n in ("original", "synthetic") if not values[n] and (n == "original" or values["command"] != "threshold")]
    if wanted:
        fail(f"needed: {', '.join('--' + n for n in wanted)}, or a folder with --data_dir")
    return values


def resolve_folder(values: dict) -> dict:
    """File paths from --data_dir; later stages take the processed synthetic file where it is not older than the raw one."""
    if not values.get("data_dir"):
        return values | {"output_dir": values.get("output_dir") or "results"}
    pair = find_data_pair(values["data_dir"], values.get("prefix"), values["command"] != "threshold")
    out = values | {"original": str(pair.original), "synthetic": str(pair.synthetic) if pair.synthetic else None, "output_dir": values.get("output_dir") or str(pair.output_dir)}
    if values["command"] in ("metric", "utility", "privacy"):
        done = Path(out["output_dir"]) / "preprocess" / "synthetic_processed.csv"
        if done.exists() and done.stat().st_mtime >= pair.synthetic.stat().st_mtime:
            out["synthetic"] = str(done)
        else:
            log.warning("no up-to-date processed file; the raw synthetic file is used")
    return out


def dispatch(spark, values: dict):
    o = evaluate.Options.of(values)
    command = values["command"]
    if command == "threshold":
        return evaluate.run_threshold(spark, values["metric"], values["method"], o)
    if command == "preprocess":
        return evaluate.run_preprocess(spark, o)
    if command == "metric":
        return evaluate.run_metrics(spark, [values["name"]], o)
    if command in GROUPS:
        o.threshold_file = None  # a record is for one metric
    if command == "report":
        return evaluate.run_report(spark, o, values["method"], values.get("metrics"), values.get("skip_metrics"))
    names = evaluate.select_metrics(o, values.get("metrics") or GROUPS[command], values.get("skip_metrics"))
    return evaluate.run_metrics(spark, [m for m in names if m in GROUPS[command]], o)


def main(argv: list[str] | None = None, spark=None) -> int:
    values = parse_args(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(stream=sys.stdout, level=logging.DEBUG if values["verbose"] else logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        values = resolve_folder(values)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("twinlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        dispatch(spark, values)
    except (DataValidationError, DataDirError, FileNotFoundError, ValueError) as e:
        log.error("%s", e)
        return 2
    except Exception:
        log.exception("unexpected error")
        return 1
    return 0


def run() -> None:
    """The console script."""
    sys.exit(main())
