"""Reading and writing tables and documents of the evaluation."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import json
import math
import os
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import q

#: Texts that a CSV reader takes for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CAP_NA_TOKENS = ["", "null", "NULL", "NaN", "nan"]
ENCODINGS = ("utf-8-sig", "cp949")
#: Local CSV files up to this size are read by one task.
SPLIT_BYTES = 32 << 20
FORMATS = (".csv", ".txt", ".parquet", ".xlsx", ".xls")


def _checked(path: str) -> str:
    """The lower-cased suffix of a readable format."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    suffix = Path(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type {suffix!r}: {path}")
    return suffix


def detect_encoding(path: str, block: int = 1 << 20) -> str:
    """The first encoding that decodes the whole local file, read block by block."""
    for encoding in ENCODINGS:
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            with open(path, "rb") as f:
                while data := f.read(block):
                    decoder.decode(data)
                decoder.decode(b"", True)
            return encoding
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path} is encoded as none of {ENCODINGS}")


def _csv_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(whether some line ends within quotes, whether it is no UTF-8) of a file of any size, by executors."""
    line = F.col("value")
    open_ = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    row = spark.read.text(path).agg(F.bool_or(open_), F.bool_or(~F.is_valid_utf8(line))).first()
    return bool(row[0]), bool(row[1])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts; an empty unquoted field is NULL.

    A file with line breaks within quotes, or a small one, is read by one task; a large
    one without them is split.
    """
    if "://" not in path and os.path.getsize(path) <= SPLIT_BYTES:
        whole, cp949 = True, detect_encoding(path) == "cp949"
    else:
        whole, cp949 = _csv_facts(spark, path)
    reader = spark.read.option("header", True).option("multiLine", whole).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if cp949:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("encoding", "MS949")
    return reader.csv(path)


def _excel(spark: SparkSession, path: str, as_text: bool) -> DataFrame:
    """Spark has no Excel source: one sheet is read on the driver, where an engine for it is installed."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str if as_text else None)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose known values are all integers, numbers or booleans become that; one job over all columns."""
    kinds = ("bigint", "double", "boolean")
    checks = [F.bool_and(q(c).isNull() | q(c).try_cast(k).isNotNull()).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in kinds]
    checks += [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    found = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        if not found[f"n{i}"]:
            out.append(q(c).cast("double").alias(c))
            continue
        kind = next((k for k in kinds if found[f"{k}{i}"]), None)
        out.append(q(c).try_cast(kind).alias(c) if kind else q(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Typed read by suffix: Parquet as it is; CSV and text with NA texts as NULL and inferred types; Excel."""
    suffix = _checked(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".xlsx", ".xls"):
        return _excel(spark, path, False)
    df = _csv(spark, path)
    return infer_types(df.select(*(F.when(~q(c).isin(NA_TOKENS), q(c)).alias(c) for c in df.columns)))


def read_table_as_strings(spark: SparkSession, path: str, na_values: list[str] | None = None) -> DataFrame:
    """Verbatim texts; with ``na_values`` those become NULL, without it an empty field is the empty text."""
    suffix = _checked(path)
    if suffix in (".csv", ".txt"):
        df = _csv(spark, path)
        empty = [F.coalesce(q(c), F.lit("")) for c in df.columns]
    else:
        df = _excel(spark, path, True) if suffix != ".parquet" else spark.read.parquet(path)
        empty = [q(c).cast("string") for c in df.columns]
    if na_values is None:
        return df.select(*(x.alias(c) for x, c in zip(empty, df.columns)))
    return df.select(*(F.when(~x.isin(na_values), x).alias(c) for x, c in zip(empty, df.columns)))


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """One CSV file with a byte-order mark: parts in order are written by executors, then joined block by block."""
    out = df.orderBy(q(order)).drop(order) if order else df
    tmp = f"{path}.parts"
    out.write.mode("overwrite").option("header", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("escape", '"').csv(tmp)
    with open(path, "wb") as f:
        f.write(codecs.BOM_UTF8)
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(out.columns)
        f.write(head.getvalue().encode("utf-8"))
        for part in sorted(Path(tmp).glob("part-*.csv")):
            with open(part, "rb") as g:
                while block := g.read(1 << 20):
                    f.write(block)
    shutil.rmtree(tmp)


def to_jsonable(x):
    """NaN, infinities and missing values become null; paths, rows, arrays and times become plain values."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, Path):
        return x.as_posix()
    if isinstance(x, T.Row):
        return to_jsonable(x.asDict(recursive=True))
    if isinstance(x, dict):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [to_jsonable(v) for v in x]
    if hasattr(x, "tolist"):
        return to_jsonable(x.tolist())
    return str(x)


def save_json(data, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(to_jsonable(data), f, ensure_ascii=False, indent=2, allow_nan=False)


def save_records(df: DataFrame, order: list[str], base: str | Path, facts: dict, most: int) -> Path:
    """Rows as one JSON document ``base``.json, or, beyond ``most`` rows, as a folder of JSON lines written by executors."""
    rows = df.orderBy(*(q(c) for c in order)) if order else df
    if df.count() > most:
        rows.write.mode("overwrite").json(str(base))
        return Path(base)
    path = Path(f"{base}.json")
    save_json(facts | {"records": rows.collect()}, path)
    return path


def load_json(path: str | Path):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def stage_dir(output_dir: str | Path, stage: str) -> Path:
    out = Path(output_dir) / stage
    out.mkdir(parents=True, exist_ok=True)
    return out


def now() -> str:
    return datetime.now().astimezone().isoformat(timespec="seconds")


def cache_key(paths: list[str], metric: str, parameters: dict, version: int = 1) -> str:
    """24 hex digits over paths, their modification times, the metric and its parameters."""
    stamp = [(str(Path(p).resolve()), os.stat(p).st_mtime_ns if os.path.exists(p) else None) for p in paths]
    return hashlib.sha256(json.dumps([stamp, metric, parameters, version], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:24]


def save_cache(df: DataFrame, output_dir: str, key: str, facts: dict) -> None:
    """Parquet keeps infinities; the facts lie beside it as JSON."""
    base = stage_dir(output_dir, "cache")
    df.write.mode("overwrite").parquet(str(base / f"{key}.parquet"))
    save_json({"cache_key": key, "created_at": now()} | facts, base / f"{key}.json")


def load_cache(spark: SparkSession, output_dir: str, key: str) -> tuple[DataFrame, dict] | None:
    base = Path(output_dir) / "cache"
    if not (base / f"{key}.json").exists() or not (base / f"{key}.parquet").exists():
        return None
    try:
        return spark.read.parquet(str(base / f"{key}.parquet")), load_json(base / f"{key}.json")
    except Exception:  # noqa: BLE001  an unreadable cache is no cache
        return None
