"""Records of a BAM file decoded a batch at a time: rank and select over all bases of the batch.

The bases of all records lie one after the other, each read in the direction in which it was sequenced. A modification list says how many
bases of its kind to skip between calls; the running sum of skips is a rank, and the places of that base in the batch, in order, are
what a rank selects. Python steps are a few for each record and tag, none for a base or a call.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from tidestat.schema import READS

# Fixed values of the format: 4-bit codes of bases and of their complements, modification codes, sizes and kinds of tag values.
CODE = {b: i for i, b in enumerate("=ACMGRSVTWYHKDBN")}
OTHER = np.arange(16, dtype=np.uint8)
for _a, _b in ("AT", "CG"):
    OTHER[CODE[_a]], OTHER[CODE[_b]] = CODE[_b], CODE[_a]
MODS = {"m": "mod_5mC", "h": "mod_5hmC", "a": "mod_6mA"}
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
KINDS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
_ORDER = sorted(MODS.values())
_HEAD = re.compile(rb"([ACGTUN])([+-])([a-z]+|\d+)[.?]?")
_READ, _GENOME, _ALIGNED = (np.array([op in s for op in "MIDNSHP=X"] + [False] * 7) for s in ("MIS=X", "MDN=X", "M=X"))


def tags(data: bytes, wanted: frozenset[bytes]) -> dict[bytes, object]:
    """The wanted tags among the bytes of a record's tags: strings as bytes, arrays as numpy arrays; others are stepped over."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2], chr(data[at + 2]), at + 3
        if kind in SIZES:
            at += SIZES[kind]
        elif kind in "ZH":
            end = data.index(b"\0", at)
            if name in wanted:
                out[name] = data[at:end]
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            if name in wanted:
                out[name] = np.frombuffer(data, KINDS[sub], n, at + 5)
            at += 5 + n * SIZES[sub]
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of each size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _lists(values: pa.Array, sizes: Sequence[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def decode(data: bytes, starts: np.ndarray, first_id: int, columns: Sequence[str] = tuple(READS.names)) -> pa.RecordBatch:
    """The records that begin (after their sizes) at `starts` of data, as these columns of schema.READS."""
    raw, n = np.frombuffer(data, np.uint8), len(starts)
    head = raw[starts[:, None] + np.arange(32)].copy().view("<i4")
    tid, left = head[:, 0], head[:, 1].astype(np.int64)
    name = (head[:, 2] & 0xFF).astype(np.int64)
    cigars, flag = (head[:, 3] & 0xFFFF).astype(np.int64), head[:, 3].view("<u4") >> 16
    bases = head[:, 4].astype(np.int64)
    made: dict[str, pa.Array] = {}
    cigar_at = starts + 32 + name
    if {"right1", "mods"} & set(columns):
        ops = raw[(_spread(cigar_at, 4 * cigars))].copy().view("<u4") if cigars.sum() else np.zeros(0, np.uint32)
        of = np.repeat(np.arange(n), cigars)
        size, op = (ops >> 4).astype(np.int64), ops & 15
        span = np.bincount(of, size * _GENOME[op], n).astype(np.int64)
        made["right1"] = pa.array(left + span)
    made |= {"read_id": pa.array(np.arange(first_id, first_id + n)), "tid": pa.array(tid), "qlen": pa.array(bases), "left0": pa.array(left)}
    wanted = {"nuc_len": {b"nl"}, "msp_len": {b"al"}, "mods": {b"MM", b"Mm", b"ML", b"Ml"}}
    names = frozenset().union(*[wanted.get(c, set()) for c in columns])
    if names:
        packed = (bases + 1) // 2
        tags_at = cigar_at + 4 * cigars + packed + bases
        ends = starts + raw[(starts - 4)[:, None] + np.arange(4)].copy().view("<i4")[:, 0]
        found = [tags(data[a:b], names) for a, b in zip(tags_at.tolist(), ends.tolist(), strict=True)]
        for column, tag in (("nuc_len", b"nl"), ("msp_len", b"al")):
            if column in columns:
                parts = [f.get(tag, ()) for f in found]
                flat = np.concatenate([*[np.asarray(p, np.int64) for p in parts], np.zeros(0, np.int64)])
                made[column] = _lists(pa.array(flat, pa.int32()), [len(p) for p in parts])
        if "mods" in columns:
            nibbles = raw[_spread(cigar_at + 4 * cigars, packed)]
            codes = np.stack([nibbles >> 4, nibbles & 15], 1).ravel()
            codes = codes[_spread(2 * (np.cumsum(packed) - packed), bases)]  # without the last half of an odd count
            runs = _runs(of, size, op, left, bases, n)
            made["mods"] = _calls(found, codes, bases, (flag & 16) > 0, tid, runs)
    return pa.RecordBatch.from_arrays([made[c] for c in columns], names=list(columns))


def _runs(of: np.ndarray, size: np.ndarray, op: np.ndarray, left: np.ndarray, bases: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Aligned runs: their first base (counted through the whole batch), first genome position from 1, and length."""

    def before(step: np.ndarray) -> np.ndarray:
        """The sum of earlier steps of the same record."""
        total = np.cumsum(step) - step
        first = np.searchsorted(of, np.arange(n))
        return total - np.append(total, 0)[first][of]

    start = np.cumsum(bases) - bases
    read, genome = before(size * _READ[op]), before(size * _GENOME[op])
    some = _ALIGNED[op] & (size > 0)
    return (start[of] + read)[some], (left[of] + 1 + genome)[some], size[some]


def _calls(found: list[dict], codes: np.ndarray, bases: np.ndarray, reverse: np.ndarray, tid: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The calls of each record, sorted by position, modification and probability."""
    n, start = len(bases), np.cumsum(bases) - bases
    stored = _spread(start, bases)
    ahead = np.repeat(reverse, bases)
    turned = np.where(ahead, np.repeat(2 * start + bases - 1, bases) - stored, stored)  # as sequenced
    strand = np.where(ahead, OTHER[codes[turned]], codes[turned])
    groups: dict[int, list[tuple[int, np.ndarray, str, np.ndarray, int]]] = {}  # by base code (-1: any): record, skips, codes, ML, its place
    for r, f in enumerate(found):
        ml, k = f.get(b"ML", f.get(b"Ml", np.zeros(0, np.uint8))), 0
        for group in f.get(b"MM", f.get(b"Mm", b"")).split(b";"):
            top, *rest = group.split(b",", 1)
            m = _HEAD.fullmatch(top)
            if not m:
                continue
            skips = np.array(rest[0].split(b","), np.int64) if rest else np.zeros(0, np.int64)
            kinds = [m[3].decode()] if m[3].isdigit() else list(m[3].decode())
            code = -1 if m[1] == b"N" else CODE[m[1].decode().replace("U", "T")]
            groups.setdefault(code if code < 0 or m[2] == b"+" else int(OTHER[code]), []).append((r, skips, kinds, ml, k))
            k += len(skips) * len(kinds)
    at_all, of_all, mod_all, prob_all = [], [], [], []
    for code, some in groups.items():
        record = np.repeat([g[0] for g in some], [len(g[1]) for g in some])
        if not len(record):
            continue
        rank = np.concatenate([np.cumsum(g[1] + 1) for g in some])  # from 1, inside the record
        if code < 0:
            at, last = rank - 1, bases[record]
        else:
            places = np.flatnonzero(strand == code)
            first = np.searchsorted(places, start)  # the bases of this kind before each record
            last = np.append(first[1:], len(places))[record] - first[record]
            at = places[np.minimum(first[record] + rank - 1, len(places) - 1)] - start[record] if len(places) else rank
        if (rank > last).any():
            raise ValueError("an MM tag points beyond the read")
        lo = 0
        for r, skips, kinds, ml, k in some:
            mine = at[lo : lo + len(skips)]
            lo += len(skips)
            for c, kind in enumerate(kinds):
                if kind in MODS:
                    here = k + c + len(kinds) * np.arange(len(skips))
                    at_all.append(mine)
                    of_all.append(np.full(len(skips), r))
                    mod_all.append(np.full(len(skips), _ORDER.index(MODS[kind]), np.int32))
                    prob_all.append(np.where(here < len(ml), np.append(ml, 0)[np.minimum(here, len(ml))], 255))
    at, of, mod, prob = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (at_all, of_all, mod_all, prob_all))
    pos = np.where(reverse[of], bases[of] - at, at + 1)
    order = np.lexsort((prob, mod, pos, of))
    of, pos, mod, prob = of[order], pos[order], mod[order], prob[order]
    gpos, aligned = np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    if len(runs[0]):
        g = start[of] + pos - 1
        i = np.searchsorted(runs[0], g, "right") - 1
        j = np.maximum(i, 0)
        aligned = (i >= 0) & (g < runs[0][j] + runs[2][j]) & (tid[of] >= 0)
        gpos = runs[1][j] + g - runs[0][j]
    names = pa.DictionaryArray.from_arrays(pa.array(mod.astype(np.int32)), pa.array(_ORDER)).cast(pa.string())
    fields = [pa.array(pos, pa.int32()), names, pa.array(prob, pa.int32()), pa.array(gpos, pa.int64(), mask=~aligned)]
    return _lists(pa.StructArray.from_arrays(fields, names=["pos", "mod", "prob", "gpos"]), np.bincount(of, minlength=n))
