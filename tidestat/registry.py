"""The extension point: a statistic is a named plan over the shared relations."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidestat.functions.tally import Reads
from tidestat.schema import READS
from tidestat.sources.relations import Relations

REGISTRY: dict[str, type["Stat"]] = {}


def cell(s: str = "''", a: str = "0", b: str = "0", c: str = "0", n: str = "1", m: str = "0", x: str = "0") -> str:
    """SQL of one cell of a shared pass: a key (the statistic's tag, s, a, b, c) and what is added up under it (n, m whole, x not)."""
    whole = ", ".join(f"'{k}', bigint({v})" for k, v in (("a", a), ("b", b), ("c", c), ("n", n), ("m", m)))
    return f"named_struct('tag', int({{tag}}), 's', string({s}), {whole}, 'x', double({x}))"


class Stat(ABC):
    """One statistic.

    ``schema`` is the result's, for reading it back (where columns vary, see schema_of). ``grain`` names the relation that it reads ("read", "mod" or "per-read mod"); ``file`` is its output
    name (gzip iff it ends in .gz); ``title`` is the heading in the report.
    """

    name = ""
    title = ""
    file = ""
    grain = "read"
    #: What it reads of a read, in schema.READS; sources that can leave out the rest.
    columns: tuple[str, ...] = tuple(READS.names)
    schema: StructType | str | None = None

    def __init__(self, **options: Any):
        self.options = options

    @classmethod
    def schema_of(cls, header: list[str]) -> StructType | str | None:
        """The schema of a saved table with these columns; None: types are inferred."""
        return cls.schema

    @abstractmethod
    def compute(self, rel: Relations) -> DataFrame:
        """The statistic's result table, lazily."""

    def prepare(self) -> dict[str, str]:
        """Columns, as SQL over a read, that cells() and later ones of them name as {column}. `calls` are the read's calls."""
        return {}

    def cells(self) -> str | None:
        """SQL of the array of cells that a read gives to the shared pass (see plans.fused), if any."""
        return None

    def call_cell(self) -> str | None:
        """SQL of the cell (or null) that a call gives to the shared pass, if any: over pos, mod, prob, gpos and its read's tid and qlen."""
        return None

    def counter(self) -> Callable[[Reads], Iterator[dict]] | None:
        """Where it is given, the same cells from a batch of reads at once, equal ones added up (see functions.tally); runs in tasks."""
        return None

    def place(self, cells: DataFrame, tag: int, rel: Relations) -> DataFrame:
        """All cells of the pass before they are added up; a statistic may turn those with its tag into others."""
        return cells

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        """The result of compute() from this statistic's added cells."""
        raise NotImplementedError

    def plot_data(self, result: DataFrame) -> DataFrame:
        """What the report draws; by default the result itself."""
        return result

    def plot(self, result: DataFrame) -> str:
        """An inline SVG of plot_data (small)."""
        return ""


def register(cls: type[Stat]) -> type[Stat]:
    """Class decorator: make a Stat available by its name."""
    REGISTRY[cls.name] = cls
    return cls


def stats(names: Iterable[str], configs: Mapping[str, Any] | None = None) -> list[Stat]:
    """Instances for registered names, in order; an unknown name is an error that lists the known ones."""
    configs = configs or {}
    out = []
    for name in names:
        if name not in REGISTRY:
            raise KeyError(f"unknown statistic {name!r}; known: {sorted(REGISTRY)}")
        given = configs.get(name) or {}
        out.append(REGISTRY[name](**(given if isinstance(given, Mapping) else {"config": given})))
    return out


def stat_title(name: str) -> str:
    """The heading of a statistic, or a marked fallback for an unknown name."""
    return REGISTRY[name].title if name in REGISTRY else f"Unk: {name}"
