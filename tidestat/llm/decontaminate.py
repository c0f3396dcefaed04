"""Benchmark decontamination: a generalised suffix automaton of normalised test items over training tokens.

The automaton of all items' words is built once and sent to every executor behind a check of its size (beyond
MAX_WORDS the items go in groups, one pass over the documents each). Each document streams through it, tracking the
longest suffix that some item contains; a length of `window` words marks a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidestat.llm.common import WORD_ONLY, map_rows, materialise, n_chars_of, strings

WINDOW = 10
#: Words of items in one automaton (about 300 bytes each in a worker).
MAX_WORDS = 500_000
#: A document with this share of hit words or more goes as a whole in decontaminate().
MAX_COVERAGE = 0.8

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text: A-Z lowered, runs of digits, letters and non-ASCII."""
    return text.translate(WORD_ONLY).split() if text else []


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of words, with the windows that end in its states."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        ids = self.vocabulary
        coded = []
        for item, words in items:
            if not words:
                continue
            seq = [ids.setdefault(w, len(ids)) for w in words]
            coded.append((item, seq))
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: State -> (length, items) of the windows whose words end in it; at most one length of `window` and shorter ones.
        ends: dict[int, dict[int, set]] = {}
        for item, seq in coded:
            n = min(window, len(seq))
            state, size = 0, 0
            for c in seq:
                state, size = self.next[state][c], size + 1
                if size >= n:
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                    size = n
                    ends.setdefault(state, {}).setdefault(n, set()).add(item)
        self.ends = ends
        #: State -> the nearest state on its chain of links, itself included, that ends a window; -1 if none.
        self.nearest = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[s] = s if s in ends else self.nearest[self.link[s]] if self.link[s] > 0 else -1

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q that holds what p reaches by c, for q's shorter contexts."""
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint hit spans [start, stop) of words, in order, and the items whose windows occur."""
        nxt, link, length, nearest = self.next, self.link, self.length, self.nearest
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = size = 0
        get = self.vocabulary.get
        for i, c in enumerate(map(get, words)):
            if c is None:
                state = size = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            s = nearest[state]
            while s > 0:  # all windows that are suffixes of what matched
                for n, found in self.ends[s].items():
                    if n <= size:
                        items |= found
                        start = i + 1 - n
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
                up = link[s]
                s = nearest[up] if up > 0 else -1
        return spans, items


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
HIT_FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("spans", _SPANS),
    StructField("items", ArrayType(StringType())),
]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _groups(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in groups of MAX_WORDS words, read partition by partition."""
    group, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        words = words_of((r[1] or "").encode())
        if group and size + len(words) > MAX_WORDS:
            yield group
            group, size = [], 0
        group.append((r[0], words))
        size += len(words)
    yield group


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs with n_words, n_hit, spans (of words, [start, stop), disjoint) and items (ids with an occurring window, sorted).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Cases: null text has no words; items without words have no windows; repeated items count once by id; an item without an id
    hits but is not listed; empty tables on either side work; those four columns replace any of the same name.
    """
    spark = docs.sparkSession
    out = docs.drop(*[f.name for f in HIT_FIELDS])
    for k, group in enumerate(_groups(benchmark, item_id, "text")):
        if k:
            out = materialise(out, "decontaminate")
        out = _one_pass(out, spark.sparkContext.broadcast(SuffixAutomaton(group, window)), text, first=not k)
    return out


def _one_pass(docs: DataFrame, shared, text: str, first: bool) -> DataFrame:
    def make():
        automaton = shared.value

        def each(b: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            n_words, n_hit, all_spans, all_items = [], [], [], []
            if not first:
                old_spans = b.column(b.schema.get_field_index("spans")).to_pylist()
                old_items = b.column(b.schema.get_field_index("items")).to_pylist()
            for i, t in enumerate(texts):
                words = words_of(t)
                spans, items = automaton.scan(words)
                items.discard(None)
                if not first:
                    spans = _merge(spans + [(s["start"], s["stop"]) for s in old_spans[i]])
                    items |= set(old_items[i])
                n_words.append(len(words))
                n_hit.append(sum(y - x for x, y in spans))
                all_spans.append([{"start": x, "stop": y} for x, y in spans])
                all_items.append(sorted(items))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            return {
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "spans": pa.array(all_spans, kind),
                "items": pa.array(all_items, pa.list_(pa.string())),
            }

        return each

    return map_rows(docs, text, HIT_FIELDS, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text: str = "text") -> DataFrame:
    """docs without benchmark passages: hit spans go from the text (one blank stays in their place), documents whose share of
    hit words is max_coverage or more go as a whole. Documents without a hit stay as they are (null text included)."""
    own = {f.name for f in HIT_FIELDS}
    clash = {c: f"__kept_{c}" for c in docs.columns if c.lower() in own}
    hits = find_hits(docs.withColumnsRenamed(clash), benchmark, window, text)
    kept = hits.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.lit(max_coverage) * F.col("n_words")))

    def make():
        def each(b: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            out = []
            for t, spans in zip(texts, b.column(b.schema.get_field_index("spans")).to_pylist(), strict=True):
                if spans:
                    at = [m.span() for m in _WORD.finditer(t.translate(WORD_ONLY))]
                    parts, last = [], 0
                    for s in spans:
                        parts.append(t[last : at[s["start"]][0]].rstrip(b" "))
                        last = at[s["stop"] - 1][1]
                    parts.append(t[last:].lstrip(b" "))
                    t = b" ".join(parts)
                out.append(t)
            return {text: strings(out)}

        return each

    done = map_rows(kept, text, [], make, drop=tuple(f.name for f in HIT_FIELDS))
    return n_chars_of(done.withColumnsRenamed({v: k for k, v in clash.items()}), text).select(*docs.columns)
