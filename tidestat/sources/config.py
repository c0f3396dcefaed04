"""YAML run configuration: which statistics to compute, and their options."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# The statistics of a run without a configuration file.
DEFAULT_STATS = (
    "ChromStat",
    "ReadLengthCounter",
    "ModHist",
    "ModMetaHist",
    "ModRate",
    "NucMSPRate",
    "NucMSPLenHist",
    "ModCrossCor",
)


@dataclass(frozen=True)
class StatConfig:
    stats: tuple[str, ...] = DEFAULT_STATS
    configs: dict[str, Any] = field(default_factory=dict)


def parse(tree: Any) -> StatConfig:
    """A StatConfig from parsed YAML; `stats` is a list of names, `configs` a mapping by name (both required)."""
    if not isinstance(tree, dict) or "stats" not in tree or "configs" not in tree:
        raise ValueError("a configuration has the keys `stats` and `configs`")
    names, configs = tree["stats"], tree["configs"] or {}
    if not isinstance(names, list) or not all(isinstance(x, str) for x in names):
        raise ValueError("`stats` is a list of names")
    if not isinstance(configs, dict) or not all(isinstance(v, (dict, list)) for v in configs.values()):
        raise ValueError("`configs` maps each name to options or to a list of them")
    return StatConfig(tuple(names), configs)


def load(file: str | Path) -> StatConfig:
    import yaml

    return parse(yaml.safe_load(Path(file).read_text()))
