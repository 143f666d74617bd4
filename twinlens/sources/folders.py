"""Finding an original and a synthetic file in a folder by their names."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

SUFFIXES = ("_origin", "_synth")
FORMATS = (".csv", ".parquet", ".xlsx")


class DataDirError(ValueError):
    """The folder doesn't hold exactly one usable pair."""


@dataclass(frozen=True)
class DataPair:
    prefix: str
    original: Path
    synthetic: Path | None
    output_dir: Path


def results_dir(data_dir: Path, prefix: str) -> Path:
    return data_dir / (f"{prefix}_results" if prefix else "results")


def find_data_pair(data_dir: str | Path, prefix: str | None = None, need_synthetic: bool = True) -> DataPair:
    """``<prefix>_origin`` and ``<prefix>_synth`` (any case of the suffix) with a known format; lock files (~$) are ignored."""
    folder = Path(data_dir)
    if not folder.is_dir():
        raise DataDirError(f"no such folder: {folder}")
    found: dict[str, dict[str, list[Path]]] = {}
    for p in sorted(folder.iterdir()):
        if not p.is_file() or p.name.startswith("~$") or p.suffix.lower() not in FORMATS:
            continue
        for end in SUFFIXES:
            if p.stem.lower().endswith(end):
                found.setdefault(p.stem[: -len(end)], {}).setdefault(end, []).append(p)
    names = [prefix] if prefix is not None else sorted(n for n, kinds in found.items() if "_origin" in kinds and (not need_synthetic or "_synth" in kinds))
    if len(names) != 1 or names[0] not in found:
        raise DataDirError(f"{folder}: {'several pairs, name a prefix' if len(names) > 1 else 'no pair'}; prefixes found: {sorted(found)}")
    kinds = found[names[0]]
    for end in SUFFIXES:
        if len(kinds.get(end, [])) > 1:
            raise DataDirError(f"{folder}: several files for {names[0]}{end}: {[p.name for p in kinds[end]]}")
        if not kinds.get(end) and (end == "_origin" or need_synthetic):
            raise DataDirError(f"{folder}: no file for {names[0]}{end}")
    return DataPair(names[0], kinds["_origin"][0], kinds["_synth"][0] if kinds.get("_synth") else None, results_dir(folder, names[0]))
