"""Secret scans: patterns of known shapes, and windows of high Shannon entropy inside candidate strings.

A candidate is a longest run of a character class. A window slides over it; its entropy is kept up to date by the counts of
the byte that leaves and of the one that enters, so a run costs one step a byte. Windows above the limit of the class are
joined to spans; an allow-list takes back what is known to be harmless.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidestat.llm.common import map_rows, strings

# The base shapes, and how long they must be.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex")

_NAMES = re.compile(rb"pass(?:word|wd)|secret|token|api_?key")
_DIGIT = bytes(48 <= b <= 57 for b in range(256))
_LETTER = bytes(65 <= b <= 90 or 97 <= b <= 122 for b in range(256))
#: Entropies are added up as whole numbers of this share of a bit, so that nothing drifts along a run.
_SCALE = 1 << 24


@dataclass(frozen=True)
class EntropyClass:
    """Runs of `alphabet` whose windows of `width` bytes hold at least `bits` of entropy a byte, a digit and a letter."""

    kind: str
    alphabet: bytes
    width: int
    bits: float

    def limit(self) -> int:
        """The largest sum of c * log2(c) over a window's counts c that still has `bits` of entropy."""
        return math.floor(self.width * (math.log2(self.width) - self.bits) * _SCALE)


#: Random hex digits have 3.4 bits a byte on average over 20, random base64 4.1, words of prose 3.5.
CLASSES = (EntropyClass("entropy_hex", rb"0-9A-Fa-f", 20, 3.0), EntropyClass("entropy_base64", rb"A-Za-z0-9+/_-", 20, 3.85))


@dataclass(frozen=True)
class AllowList:
    """What is no secret: `inside` is looked for in a candidate and takes all of it back, `around` is looked for in the whole text and
    takes back the spans that it overlaps."""

    inside: tuple[bytes, ...] = (rb"(?i)example|placeholder|changeme|x{6}", rb"0123456789|9876543210", rb"(?i)abcdefgh|qwertyui")
    around: tuple[bytes, ...] = (
        rb"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
        rb"\bsha(?:1|256|384|512)[-:=][A-Za-z0-9+/=]+",
        rb"\bhttps?://[^\s\"'<>]+",
    )


ALLOWED = AllowList()


def steps(width: int) -> list[int]:
    """What the sum of c * log2(c) gains when a count goes from c to c + 1."""
    f = [0, *(round(c * math.log2(c) * _SCALE) for c in range(1, width + 1))]
    return [b - a for a, b in zip(f, f[1:], strict=False)]


def hot_spans(run: bytes, width: int, limit: int) -> Iterator[tuple[int, int]]:
    """The joined windows of a run whose sum is at most limit and that hold a digit and a letter; counts are kept incrementally."""
    gain, counts = steps(width), [0] * 256
    total = digits = letters = 0
    lo = hi = -1
    for i, new in enumerate(run):
        if i >= width:
            b = run[i - width]
            c = counts[b] - 1
            total -= gain[c]
            counts[b] = c
            digits -= _DIGIT[b]
            letters -= _LETTER[b]
        c = counts[new]
        total += gain[c]
        counts[new] = c + 1
        digits += _DIGIT[new]
        letters += _LETTER[new]
        if total <= limit and i >= width - 1 and digits and letters:
            if i - width + 1 > hi:
                if hi >= 0:
                    yield lo, hi
                lo = i - width + 1
            hi = i + 1
    if hi >= 0:
        yield lo, hi


class _Cover:
    """Spans to look things up in."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        spans = sorted(spans)
        self.starts, self.ends = [s[0] for s in spans], list(accumulate((s[1] for s in spans), max))

    def end(self, place: int) -> int:
        """The furthest end of the spans that start at a place or before it; -1 if there are none."""
        i = bisect_right(self.starts, place)
        return self.ends[i - 1] if i else -1


class Scanner:
    """Finds (start, end, kind) in UTF-8 bytes; places count bytes."""

    def __init__(self, classes: tuple[EntropyClass, ...] = CLASSES, allowed: AllowList = ALLOWED):
        self.classes = [(c.kind, re.compile(rb"[%s]{%d,}" % (c.alphabet, c.width)), c.width, c.limit()) for c in classes]
        self.order = {k: i for i, k in enumerate((*KINDS, *(c.kind for c in classes)))}
        self.inside = [re.compile(p) for p in allowed.inside]
        self.around = [re.compile(p) for p in allowed.around]

    def base(self, text: bytes) -> list[tuple[int, int, str]]:
        """The spans of the base shapes, by start and then by kind as listed."""
        out, low, at = [], text.lower(), 0  # ASCII letters only: bytes
        while name := _NAMES.search(low, at):  # a name may begin inside another
            at = name.start() + 1
            if m := ASSIGN.match(text, name.start()):
                at = m.end()  # a match that fails takes its place too
                if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                    out.append((m.start(), m.end(), "assign"))
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return sorted(out, key=lambda s: (s[0], self.order[s[2]]))

    def entropy(self, text: bytes) -> list[tuple[int, int, str]]:
        """The spans of high entropy that the allow-list leaves; one of an earlier class hides what it covers of a later one."""
        out: list[tuple[int, int, str]] = []
        for kind, runs, width, limit in self.classes:
            new: list[tuple[int, int, str]] = []
            for m in runs.finditer(text):
                found = [(m.start() + a, m.start() + b, kind) for a, b in hot_spans(m[0], width, limit)]
                if found and not any(p.search(m[0]) for p in self.inside):
                    new += found
            hidden = _Cover(out)
            out += [s for s in new if hidden.end(s[0]) < s[1]]
        if out:
            known = _Cover([(*m.span(), "") for p in self.around for m in p.finditer(text)])
            out = [s for s in out if known.end(s[1] - 1) <= s[0]]
        return out

    def spans(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base spans, and all spans: those of high entropy are added, inside base spans too (they tell random values from others)."""
        base = self.base(text)
        return base, sorted(base + self.entropy(text), key=lambda s: (s[0], self.order[s[2]]))


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with places counted in code points. Every border stands beside an ASCII byte."""
    if not spans or text.isascii():
        return spans
    at, done, n = {}, 0, 0
    for p in sorted({p for a, b, _ in spans for p in (a, b)}):
        n += len(text[done:p].decode())
        at[p], done = n, p
    return [(at[a], at[b], k) for a, b, k in spans]


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())])


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allowed: AllowList = ALLOWED, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex (matches of the base shapes), base_sha256 and spans (kind:start:end, comma-joined, by start and
    then by kind: assign, access, hex, then the classes in order), and secrets, the same spans as an array of (start, end, kind).

    Places are code points, ends exclusive. Cases: a null text counts as empty, an empty one has no spans; texts of any length are scanned
    whole; repeated rows each get their own result; columns of docs with one of these names, in any case, are replaced.
    """

    def make() -> Callable[[pa.RecordBatch, list[bytes | None]], dict[str, pa.Array]]:
        scanner = Scanner(classes, allowed)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

        def each(batch: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            counts, digests, written, found = {k: [] for k in KINDS}, [], [], []
            for t in texts:
                base, every = (in_code_points(t or b"", s) for s in scanner.spans(t or b""))
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(every))
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in every])
            return {
                **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS},
                "base_sha256": pa.array(digests, pa.string()),
                "spans": pa.array(written, pa.string()),
                "secrets": pa.array(found, kind),
            }

        return each

    fields = [StructField(f"n_{k}", LongType()) for k in KINDS]
    fields += [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("secrets", ArrayType(SPAN))]
    return map_rows(docs, text, fields, make)


def redact(docs: DataFrame, mark: str = "[{kind}]", classes: tuple[EntropyClass, ...] = CLASSES, allowed: AllowList = ALLOWED, text: str = "text") -> DataFrame:
    """docs with every span replaced by its mark; spans that overlap are joined under the kind of the first. Null texts stay null."""

    def make() -> Callable[[pa.RecordBatch, list[bytes | None]], dict[str, pa.Array]]:
        scanner = Scanner(classes, allowed)

        def clean(t: bytes) -> bytes:
            out, done = [], 0
            for a, b, k in scanner.spans(t)[1]:
                if a >= done:
                    out += [t[done:a], mark.format(kind=k).encode()]
                done = max(done, b)
            return b"".join([*out, t[done:]])

        return lambda batch, texts: {text: strings([None if t is None else clean(t) for t in texts])}

    return map_rows(docs, text, [StructField(text, StringType())], make)
