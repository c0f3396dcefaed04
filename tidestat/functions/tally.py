"""Batches of reads as flat numpy arrays, and equal rows of whole numbers added up: what statistics count with in the shared pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bins for each row up to which rows are counted in a table of all keys between the least and the largest; beyond it they are sorted.
SPARSE = 4


def whole(values: pa.Array, null: int) -> np.ndarray:
    """Whole numbers as int64, `null` where there is none."""
    return values.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The size of each list (0: none there), and all values behind one another."""
    return whole(pc.list_value_length(lists), 0), lists.flatten()


def tally(columns: Sequence[np.ndarray], *weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Equal rows of whole numbers as one: their columns, how many rows each stands for, and the sums of their weights."""
    if not len(columns[0]):
        return [np.empty(0, np.int64) for _ in columns], np.empty(0, np.int64), [np.empty(0) for _ in weights]
    lows, values = [int(c.min()) for c in columns], [None] * len(columns)
    sizes = [int(c.max()) - lo + 1 for c, lo in zip(columns, lows, strict=True)]
    if np.prod(sizes, dtype=float) >= 2.0**62:  # numbered first, so that a row fits into a word
        found = [np.unique(c, return_inverse=True) for c in columns]
        values, columns = [v for v, _ in found], [i for _, i in found]
        lows, sizes = [0] * len(columns), [len(v) for v in values]
    key = np.zeros(len(columns[0]), np.int64)
    for c, lo, size in zip(columns, lows, sizes, strict=True):
        key = key * size + (c - lo)
    if np.prod(sizes, dtype=float) <= SPARSE * len(key) + (1 << 16):
        n = np.bincount(key)
        keys = np.flatnonzero(n)
        n, sums = n[keys], [np.bincount(key, w)[keys] for w in weights]
    else:
        keys, where, n = np.unique(key, return_inverse=True, return_counts=True)
        sums = [np.bincount(where, w, len(keys)) for w in weights]
    out = []
    for lo, size, v in zip(lows[::-1], sizes[::-1], values[::-1], strict=True):
        keys, i = np.divmod(keys, size)
        out.append(i + lo if v is None else v[i])
    return out[::-1], n, sums


class Reads:
    """A batch of reads: a value for each read in tid (null stays), qlen (null: 0); for each call the number of its read and its fields."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.n = batch, batch.num_rows

    @cached_property
    def qlen(self) -> np.ndarray:
        return whole(self.batch["qlen"], 0)

    @cached_property
    def _calls(self) -> tuple[np.ndarray, dict[str, pa.Array]]:
        sizes, calls = flat(self.batch["mods"])
        return np.repeat(np.arange(self.n), sizes), dict(zip((f.name for f in calls.type), calls.flatten(), strict=True))

    @property
    def row(self) -> np.ndarray:
        return self._calls[0]

    @property
    def calls(self) -> dict[str, pa.Array]:
        return self._calls[1]

    @cached_property
    def pos(self) -> np.ndarray:
        """0: none."""
        return whole(self.calls["pos"], 0)

    @cached_property
    def prob(self) -> np.ndarray:
        """-1: none."""
        return whole(self.calls["prob"], -1)

    @cached_property
    def _mods(self) -> tuple[np.ndarray, list[str | None]]:
        coded = self.calls["mod"].dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        return whole(coded.indices, len(names) - 1), names

    @property
    def mod(self) -> np.ndarray:
        """The number of each call's modification in mods."""
        return self._mods[0]

    @property
    def mods(self) -> list[str | None]:
        return self._mods[1]

    def number(self, mod: str) -> int:
        """The number of a modification, -1 where no call has it."""
        return self.mods.index(mod) if mod in self.mods else -1


def cells(n: np.ndarray | Sequence[int], s: str | Sequence[str | None] | pa.Array = "", a=0, b=0, c=0, m=0, x=0.0) -> Iterator[dict]:
    """The cells of some rows, as columns: numbers that are the same for all may be given once."""
    if len(n):
        yield {"s": s, "a": a, "b": b, "c": c, "n": n, "m": m, "x": x}


def table(tag: int, columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Cells as a batch of the shared pass."""
    size = len(columns["n"])

    def column(name: str) -> pa.Array:
        v, t = tag if name == "tag" else columns[name], schema.field(name).type
        if isinstance(v, pa.Array):
            return v.cast(t)
        if isinstance(v, np.ndarray):
            return pa.array(v.astype(np.float64 if pa.types.is_floating(t) else np.int64)).cast(t)
        return pa.array(v, t) if isinstance(v, list) else pa.repeat(pa.scalar(v, t), size)

    return pa.RecordBatch.from_arrays([column(f.name) for f in schema], schema=schema)
