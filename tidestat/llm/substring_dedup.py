"""Substring dedup by recompression: rounds name token runs, then pairs, by content, so that equal substrings get equal
interior symbols in every document; symbols that several documents share reveal and verify long repeats.

A name is a hash of what it spells, so the same run or pair has the same name in every task: the rounds need no shuffle and no
table of names.
Round 0 names runs of one token; each pair round deals symbols to two classes by a bit of their names and names every
adjacent (left class, right class) pair. Each symbol carries the context that its parse depends on; if the context lies
inside a window, every occurrence of that window has that symbol at that place.

Every window picks one such symbol (of the highest round that has one, least by hash, leftmost): its anchor. Consecutive
windows mostly pick the same, so an anchor row stands for several windows.

1. A Bloom pair over anchor keys finds those seen twice; other anchors never shuffle.
2. Suspected anchors carry the hashes of their windows. Grouped by (key, all their windows), every document but the
   smallest is repeated as a whole there; hot groups combine before the shuffle.
3. Where one key has different surroundings, one row for each of them goes to the level of windows.
4. Runs of repeated windows go to where texts are read (module placed; documents without places are joined with them), and each
   document finds repeats inside itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidestat.llm import bloom, placed
from tidestat.llm.common import BLANK, fresh, join_hot, map_rows, materialise, n_chars_of, raw, spread, strings, tidy

WINDOW = 20
PAIR_ROUNDS = 2
#: Words parsed at a time in a task; a longer document is parsed whole.
SLICE_WORDS = 400_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a text: maximal runs of bytes other than white space."""
    return text.translate(BLANK).split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.concatenate([[_U(1)], np.full(n - 1, _U(_BASE))]).cumprod(dtype=_U)
            self.down = np.concatenate([[_U(1)], np.full(n - 1, _U(_INVERSE))]).cumprod(dtype=_U)
        return self.up[:n], self.down[:n]


def range_hashes(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of token ranges, independent of where they lie."""
    return spread((prefix[stop] - prefix[start]) * down[start])


def _levels(tokens: np.ndarray, doc: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, context start, context stop) of each round's symbols, the raw tokens first."""
    n = len(tokens)
    at = np.arange(n)
    yield tokens, at, at + 1
    head = np.ones(n, bool)
    head[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(head)
    stop = np.append(start[1:], n)
    size = (stop - start).astype(_U)
    name = np.where(size > 1, spread(tokens[start] + size * _U(0xD6E8FEB86659FD93), 1), tokens[start])
    owner = doc[start]
    lo, hi = start - 1, stop + 1  # that a run ends there depends on its neighbours
    yield name, lo, hi
    for r in range(rounds):
        left = (spread(name, 11 + r) >> _U(63)) == 0
        same = np.zeros(len(name), bool)
        same[:-1] = owner[1:] == owner[:-1]
        joined = np.zeros(len(name), bool)
        joined[:-1] = left[:-1] & ~left[1:] & same[:-1]
        second = np.zeros(len(name), bool)
        second[1:] = joined[:-1]
        # An unpaired symbol depends on the neighbour that it could have paired with.
        alone_left = left & ~joined & same
        after = same.nonzero()[0]
        grown_hi, grown_lo = hi.copy(), lo.copy()
        grown_hi[alone_left] = hi[np.flatnonzero(alone_left) + 1]
        before = np.zeros(len(name), bool)
        before[after + 1] = True
        alone_right = ~left & ~second & before
        grown_lo[alone_right] = lo[np.flatnonzero(alone_right) - 1]
        first = np.flatnonzero(joined)
        made = name.copy()
        made[first] = spread(name[first] + spread(name[first + 1], 21 + r), 31 + r)
        grown_hi[first] = hi[first + 1]
        grown_lo[first] = lo[first]
        keep = ~second
        name, lo, hi, owner = made[keep], grown_lo[keep], grown_hi[keep], owner[keep]
        yield name, lo, hi


def _least(weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The index of the least weight in each [lo, hi), leftmost on ties."""
    out = np.empty(len(lo), np.int64)
    size = hi - lo
    table, step = np.arange(len(weight)), 1
    while True:
        fits = (size >= step) & (size < 2 * step)
        if fits.any():
            a, b = table[lo[fits]], table[hi[fits] - step]
            out[fits] = np.where(weight[b] < weight[a], b, a)
        if not (size >= 2 * step).any():
            return out
        a, b = table[:-step], table[step:]
        table, step = np.where(weight[b] < weight[a], b, a), 2 * step


def parse(tokens: np.ndarray, sizes: np.ndarray, powers: Powers, window: int = WINDOW, rounds: int = PAIR_ROUNDS):
    """Anchors of the windows of concatenated documents.

    Returns (document index, first window, windows, key) of each anchor row, and the hash of every window in
    the rows' order. Documents of fewer than `window` words have none.
    """
    n = len(tokens)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    base = np.concatenate([[0], np.cumsum(sizes)])
    up, down = powers.get(n + 1)
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(tokens * up[:n], dtype=_U)])
    starts = np.flatnonzero(np.arange(n) + window <= base[doc + 1])
    hashes = range_hashes(prefix, down, starts, starts + window)
    chosen_lo, chosen_hi = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    level = np.full(len(starts), -1)
    for k, (name, lo, hi) in reversed(list(enumerate(_levels(tokens, doc, rounds)))):
        open_ = np.flatnonzero(level < 0)
        if not len(open_):
            break
        s = starts[open_]
        # symbols whose context starts at s or later, and ends by s + window
        first = np.cumsum(np.bincount(lo + 1, minlength=n + 2))[s]
        last = np.cumsum(np.bincount(hi, minlength=n + window + 2))[s + window]
        has = last > first
        pick = _least(spread(name, 3), first[has], last[has])
        where = open_[has]
        level[where] = k
        chosen_lo[where], chosen_hi[where] = lo[pick], hi[pick]
    key = spread(range_hashes(prefix, down, chosen_lo, chosen_hi) + level.astype(_U), 5)
    new = np.ones(len(starts), bool)
    owner = doc[starts]
    new[1:] = (chosen_lo[1:] != chosen_lo[:-1]) | (level[1:] != level[:-1]) | (owner[1:] != owner[:-1])
    row = np.flatnonzero(new)
    count = np.diff(np.append(row, len(starts)))
    return owner[row], starts[row] - base[owner[row]], count, key[row], hashes


def _slices(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Documents in slices of about SLICE_WORDS words: their places, and their words."""
    at, words, n = [], [], 0
    for i, t in enumerate(texts):
        w = split_words(t)
        at.append(i)
        words.append(w)
        n += len(w)
        if n >= SLICE_WORDS:
            yield at, words
            at, words, n = [], [], 0
    if at:
        yield at, words


def _parsed(texts: list[bytes | None], powers: Powers, window: int, rounds: int):
    for at, words in _slices(texts):
        long = [(i, w) for i, w in zip(at, words, strict=True) if len(w) >= window]
        if long:
            sizes = np.array([len(w) for _, w in long])
            tokens = hash_words([x for _, w in long for x in w])
            yield [i for i, _ in long], parse(tokens, sizes, powers, window, rounds)


def anchor_rows(docs: DataFrame, estimate: int, window: int, rounds: int, doc_id: str, text: str) -> DataFrame:
    """key, doc, start, hashes: the suspected anchors with the hashes of their windows."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        powers = Powers()
        for b in batches:
            for _, (owner, _, _, key, _) in _parsed(raw(b.column(1)), powers, window, rounds):
                yield _distinct(owner, key)

    suspected = bloom.repeated(rows, keys, estimate)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, (owner, start, count, key, hashes) in _parsed(raw(b.column(1)), powers, window, rounds):
                hold = suspected(key)
                kept = np.repeat(hold, count)
                offsets = np.concatenate([[0], np.cumsum(count[hold])]).astype(np.int32)
                values = pa.array(hashes[kept].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[hold].view(np.int64)),
                        pa.array(ids[np.array(at)][owner[hold]].astype(np.int64)),
                        pa.array(start[hold].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                    ],
                    names=["key", "doc", "start", "hashes"],
                )

    return rows.mapInArrow(tidy(emit), "key long, doc long, start int, hashes array<long>")


def _distinct(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each document's distinct keys."""
    return key[np.unique(spread(key + spread(owner.astype(_U), 15), 17), return_index=True)[1]]


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = PAIR_ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start, n: runs of windows that also occur in a document of a smaller id."""
    estimate = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    anchors = anchor_rows(docs, estimate // 30 + 1, window, rounds, doc_id, text)
    anchors = materialise(anchors.withColumn("around", F.xxhash64("hashes")), "anchors")
    total = anchors.count()
    groups = anchors.groupBy("key", "around").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("rows"))
    groups = materialise(groups, "anchor-groups")
    places = anchors.select("key", "around", "doc", "start", F.size("hashes").alias("n"))
    whole = (
        join_hot(places, groups.where("first < last").drop("last"), ["key", "around"], "rows", total)
        .where("doc > first")
        .select("doc", "start", "n")
    )
    # Keys with several surroundings: the windows of each one's first document against those of the others. Only
    # these anchors' window hashes shuffle.
    several = groups.groupBy("key").agg(F.min("around").alias("a"), F.max("around").alias("b")).where("a < b").select("key")
    firsts = materialise(groups.join(several, "key", "left_semi").drop("last"), "anchor-firsts")
    mixed = join_hot(anchors, firsts, ["key", "around"], "rows", total).where("doc = first").select("key", "doc", "start", "hashes")
    mixed = materialise(mixed, "anchor-mixed")
    earliest = mixed.select("key", "doc", F.explode("hashes").alias("h")).groupBy("key", "h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    earliest = materialise(earliest.where("lo < hi").drop("hi"), "windows")
    part = (
        mixed.select("key", "doc", "start", F.posexplode("hashes").alias("i", "h"))
        .join(earliest, ["key", "h"])
        .where("doc > lo")
        .select("doc", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"))
    )
    return whole.unionByName(part)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = PAIR_ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated words removed (the kept words joined by one blank), and n_words, n_removed (these replace
    columns of the same name).

    A window is `window` consecutive words of one document. A word goes if a window that covers it also starts
    earlier: in a document of a smaller id, or earlier in the same one. Windows are judged on the input.
    Cases: null text has no words (text becomes empty); a document of fewer words than a window stays; rows that share a
    doc_id do not remove each other's words; a row without doc_id only loses its own repeats and removes nothing elsewhere;
    empty tables work; other columns pass through; n_chars, if present, follows the new text.
    """
    docs = docs.drop("n_words", "n_removed")
    runs = repeated_windows(docs, window, rounds, doc_id, text).select("doc", F.expr("shiftleft(cast(start as bigint), 32) + n").alias("run"))
    found, facts = placed.with_places(docs), None
    if found:
        # Ids and places (24 bytes a row) meet the runs, and these go to where texts are read: texts stay.
        located, c_file, c_row = found
        ids = located.select(F.col(doc_id).cast("long").alias("doc"), F.col(c_file).alias("file"), F.col(c_row).alias("row"))
        facts = placed.write(runs.join(ids, "doc").select("file", "row", "doc", F.col("run").alias("value")), "window-runs")
    if facts:
        c_doc = fresh(located, "__doc")[0]
        given = [c_file, c_row, c_doc]
        joined = located.withColumn(c_doc, F.col(doc_id).cast("long"))
    else:
        c_doc, c_runs = fresh(docs, "__doc", "__runs")
        lists = runs.groupBy(F.col("doc").alias(c_doc)).agg(F.collect_list("run").alias(c_runs))
        joined = docs.join(lists, F.col(doc_id).cast("long") == F.col(c_doc), "left").drop(c_doc)
        given = [c_runs]
    chunk = placed.CHUNK

    def make():
        powers = Powers()
        reader = placed.Reader(facts, chunk) if facts else None

        def runs_of(columns: list[pa.Array], i: int) -> np.ndarray:
            if reader is None:
                return columns[0][i].values.to_numpy() if columns[0][i].is_valid else np.empty(0, np.int64)
            file, row, doc = (c[i].as_py() for c in columns)
            return np.empty(0, np.int64) if doc is None else reader.values(file, row, doc)

        def each(b: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            out, n_words, n_removed = [b""] * len(texts), [0] * len(texts), [0] * len(texts)
            columns = [b.column(b.schema.get_field_index(c)) for c in given]
            for at, words in _slices(texts):
                sizes = np.array([len(w) for w in words])
                base = np.concatenate([[0], np.cumsum(sizes)])
                flagged = np.zeros(base[-1] + 1, np.int64)
                inside = _own_repeats(words, sizes, base, powers, window)
                np.add.at(flagged, inside, 1)
                np.add.at(flagged, inside + window, -1)
                for k, i in enumerate(at):
                    mine = runs_of(columns, i)
                    if len(mine):
                        s = (mine >> 32) + base[k]
                        np.add.at(flagged, s, 1)
                        np.add.at(flagged, s + (mine & 0xFFFFFFFF) - 1 + window, -1)
                gone = np.cumsum(flagged)[:-1] > 0
                for k, i in enumerate(at):
                    g = gone[base[k] : base[k + 1]]
                    n_words[i], n_removed[i] = len(words[k]), int(g.sum())
                    out[i] = b" ".join(words[k]) if not n_removed[i] else b" ".join([w for w, x in zip(words[k], g.tolist(), strict=True) if not x])
            return {text: strings(out), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}

        return each

    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType())]
    return n_chars_of(map_rows(joined, text, fields, make, drop=tuple(given)), text)


def _own_repeats(words: list[list[bytes]], sizes: np.ndarray, base: np.ndarray, powers: Powers, window: int) -> np.ndarray:
    """Places (in the slice) of windows that start earlier in the same document too."""
    n = int(base[-1])
    if n < window:
        return np.empty(0, np.int64)
    tokens = hash_words([x for w in words for x in w])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    up, down = powers.get(n + 1)
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(tokens * up[:n], dtype=_U)])
    starts = np.flatnonzero(np.arange(n) + window <= base[doc + 1])
    mixed = spread(range_hashes(prefix, down, starts, starts + window) + spread(doc[starts].astype(_U), 9), 13)
    first = np.unique(mixed, return_index=True)[1]
    again = np.ones(len(starts), bool)
    again[first] = False
    return starts[again]
