"""Media columns: chroma audio fingerprints.

A recording becomes pitch-class frames; filters over the integral image of the frames, each coded in two bits, give a packed
32-bit integer for every place. Recordings are aligned by a histogram of offsets of equal word parts, and compared by the bit
errors at all offsets with two votes or more. How many bits may differ follows from the overlap: an alignment has to be
far from chance.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from tidestat.llm.common import map_rows, materialise, tidy

RATE = 4000
FRAME, HOP = 1024, 256
LOW, HIGH = 110.0, 1760.0
SPAN = 16
#: Words of overlap that a match has at least, and the greatest share of bits that may differ. Whole copies match at any length.
MIN_OVERLAP, MAX_ERROR = 16, 0.30
#: Unrelated words differ in half of their bits, with a deviation SPREAD times that of independent bits (neighbouring words
#: share most of their frames); a match differs in fewer by SIGMAS deviations.
SIGMAS, SPREAD = 5, 4
#: The parts of a word that vote: first bits, and bits each.
PARTS, PART_BITS = (0, 11, 22), 10
TOP = 10
#: Words compared at once, and matches in an output batch at least.
CELLS, ROWS = 1 << 20, 50_000
#: Words compared of an alignment before its errors are looked at: at first, and at most (both even).
STEP, MAX_STEP = 16, 1 << 12
#: Votes are counted in a table of all offsets of up to so many times as many cells, or sorted.
DENSE = 8
#: Query recordings in a block, and their words (one recording more): an index takes about 30 bytes a word.
BLOCK, BLOCK_WORDS = 2048, 1 << 17
#: Postings that a recording meets at once; a long one meets them a slice at a time.
POSTINGS = 1 << 22


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of sixteen filters, by a rule that spreads all four."""
    out = []
    for i in range(16):
        height = (12, 6, 4, 3)[i % 4]
        out.append((i % 6, (5 * i) % (12 - height + 1), height, 4 + 4 * ((i // 4) % 4)))
    return out


FILTERS = _filters()
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) energies by pitch class, each frame scaled to length one (silence stays zero)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    keep = (f >= LOW) & (f <= HIGH)
    pitch = np.round(12 * np.log2(f[keep] / 440.0)).astype(int) % 12
    out = np.zeros((len(x), 12))
    np.add.at(out.T, pitch, power[:, keep].T)
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers of a mono signal at RATE; none if it is shorter than SPAN frames."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(x0: np.ndarray, x1: np.ndarray, y0: int, y1: int) -> np.ndarray:
        return image[x1, y1] - image[x0, y1] - image[x1, y0] + image[x0, y0]

    words = np.zeros(n, np.uint32)
    for i, (kind, y, h, w) in enumerate(FILTERS):
        y1, ym, xm = y + h, y + h // 2, t + w // 2
        total = area(t, t + w, y, y1)
        third_x, third_y = w // 3, max(1, h // 3)
        part = (
            lambda: area(t, t + w, ym, y1),  # high against low pitch classes
            lambda: area(xm, t + w, y, y1),  # late against early
            lambda: area(t, xm, y, ym) + area(xm, t + w, ym, y1),  # diagonal
            lambda: area(t, t + w, y + third_y, y1 - third_y),  # middle classes
            lambda: area(t + third_x, t + w - third_x, y, y1),  # middle frames
            lambda: area(t, xm, ym, y1) + area(xm, t + w, y, ym),  # other diagonal
        )[kind]()
        ratio = np.log((part + 0.01) / (total - part + 0.01))
        words |= _GRAY[np.digitize(ratio, (-0.6, 0.0, 0.6))] << np.uint32(2 * i)
    return words


def samples_of(data: bytes | None) -> np.ndarray:
    """A mono signal at RATE of WAV bytes (16-bit PCM; channels averaged, resampled linearly); empty for null or unreadable data."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            if f.getsampwidth() != 2:
                return np.empty(0)
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(1) / 32768
            rate = f.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0)
    at = np.arange(int(len(x) * RATE / rate)) * (rate / RATE)
    return x if rate == RATE else np.interp(at, np.arange(len(x)), x) if len(x) else x


def fingerprints(media: DataFrame, column: str, samples: Callable[[object], np.ndarray] = samples_of) -> DataFrame:
    """media with fingerprint (array<int>, the packed words as signed integers); it replaces a column of that name.

    ``samples`` turns a value of the column into a signal (by default WAV bytes). Null, unreadable and short recordings have
    an empty fingerprint.
    """

    def make():
        def each(b: pa.RecordBatch, _: list) -> dict[str, pa.Array]:
            found = [fingerprint(samples(x)).view(np.int32) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            return {"fingerprint": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

        return each

    return map_rows(media, None, [StructField("fingerprint", ArrayType(IntegerType()))], make)


def limit(overlap: np.ndarray) -> np.ndarray:
    """The share of bits that may differ over so many words of overlap."""
    return np.minimum(MAX_ERROR, 0.5 - SIGMAS * SPREAD * 0.5 / np.sqrt(32 * np.maximum(overlap, 1)))


def _parts(words: np.ndarray) -> np.ndarray:
    mask = np.uint32((1 << PART_BITS) - 1)
    return np.concatenate([((words >> np.uint32(s)) & mask).astype(np.int64) + (k << PART_BITS) for k, s in enumerate(PARTS)])


class Index:
    """Word parts of some recordings -> where they stand."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.size = np.array(ids, np.int64), np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([*words, np.zeros(MAX_STEP, np.uint32)])
        self.base = np.cumsum(self.size) - self.size
        self.longest = int(self.size.max(initial=0))
        self.stride = 1 << (2 * self.longest).bit_length()
        codes = [_parts(w) for w in words]
        cells = [np.tile(np.arange(len(w)), len(PARTS)) + i * self.stride for i, w in enumerate(words)]
        codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        #: Recording times stride plus place, by code.
        self.cells = np.concatenate(cells)[order] if cells else np.empty(0, np.int64)
        self.start = np.searchsorted(codes[order], np.arange((len(PARTS) << PART_BITS) + 1))

    def match(self, words: np.ndarray, but: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recordings, offsets, bit errors and votes of all indexed recordings that align, each at its offset of least error among all
        with two votes or more; an offset is its place less that in `words`."""
        if not len(words) or not len(self.cells):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        i, off, votes = self._voted(words)
        a, b = np.maximum(0, -off), np.minimum(len(words), self.size[i] - off)
        long = b - a >= MIN_OVERLAP
        keep = long | (off == 0) & (b == len(words)) & (b == self.size[i])
        if but is not None:
            keep &= self.ids[i] != but
        keep = np.flatnonzero(keep)
        i, off, a, b, votes, long = (x[keep] for x in (i, off, a, b, votes, long))
        error = self._errors(words, i, off, a, b - a, np.where(long, limit(np.arange(len(words) + 1))[b - a], 0))
        keep = error <= 1
        i, off, votes, error = (x[keep] for x in (i, off, votes, error))
        order = np.lexsort((off, -votes, error, i))
        i, off, votes, error = (x[order] for x in (i, off, votes, error))
        first = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
        return self.ids[i[first]], off[first], error[first], votes[first]

    def _voted(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recordings, offsets and votes, of two votes or more."""
        last = len(words) - 1
        if self.longest + last > self.stride:  # offsets of two recordings would meet
            i, place = np.divmod(self.cells, self.stride)
            self.stride = 1 << (self.longest + last).bit_length()
            self.cells = i * self.stride + place
        code = _parts(words)
        lo, hi = self.start[code], self.start[code + 1]
        shift = np.tile(last - np.arange(len(words)), len(PARTS))
        met = np.cumsum(hi - lo)
        dense = len(self.ids) * self.stride <= DENSE * int(met[-1])  # counting takes less than sorting
        key, votes = np.empty(0, np.int64), np.zeros(len(self.ids) * self.stride if dense else 0, np.int32)
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + POSTINGS, "right")))
            some = np.concatenate([self.cells[x:y] for x, y in zip(lo[at:to].tolist(), hi[at:to].tolist(), strict=True)])
            some = some + np.repeat(shift[at:to], hi[at:to] - lo[at:to])
            if dense:
                count = np.bincount(some)
                votes[: len(count)] += count.astype(np.int32)
            else:
                key, place = np.unique(np.concatenate([key, some]), return_inverse=True)
                votes = np.bincount(place, np.concatenate([votes, np.ones(len(some), np.int32)]), len(key)).astype(np.int32)
            at = to
        several = np.flatnonzero(votes > 1)
        key, votes = several if dense else key[several], votes[several].astype(np.int64)
        i, place = np.divmod(key, self.stride)
        return i, place - last, votes

    def _errors(self, words: np.ndarray, i: np.ndarray, off: np.ndarray, a: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Share of differing bits over n words from place a of `words`, for each recording i and offset; 2 where it is over `most`,
        for which a part of the words is compared: what differs in too many bits already differs in no fewer later."""
        out, here = np.full(len(i), 2.0), np.concatenate([words, np.zeros(MAX_STEP, np.uint32)])
        for at in range(0, len(i), CELLS // STEP):
            k = np.arange(at, min(at + CELLS // STEP, len(i)))
            mine, left, bits = a[k], n[k], np.zeros(len(k))
            other = self.base[i[k]] + off[k] + mine
            while len(k):
                step = max(STEP, min(int(n[k[0]] - left[0]), MAX_STEP, CELLS // len(k)) // STEP * STEP)
                differ = _windows(self.words, step, other) ^ _windows(here, step, mine)
                if left.min() < step:
                    differ.view(np.uint32)[:] *= np.arange(step) < left[:, None]
                bits = bits + np.bitwise_count(differ).astype(np.float32) @ np.ones(step // 2, np.float32)
                share = bits / (32 * n[k])
                keep = share <= most[k]
                ended = np.flatnonzero(keep & (left <= step))
                out[k[ended]] = share[ended]
                keep = np.flatnonzero(keep & (left > step))
                k, bits, mine, other, left = k[keep], bits[keep], mine[keep] + step, other[keep] + step, left[keep] - step
        return out


def _windows(words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """A row of n words from each place, as pairs of words: n is even."""
    rows = np.ndarray((len(words) - n + 1,), f"V{4 * n}", words, 0, (4,))[at]  # copied row by row: a third of the time of single words
    return rows.view(np.uint64).reshape(len(at), n // 2)


_MATCH = pa.struct([("query_id", pa.int64()), ("offset", pa.int32()), ("bit_error", pa.float64()), ("votes", pa.int32())])


def align(recordings: DataFrame, queries: DataFrame, id_column: str, block: int = BLOCK, words: int = BLOCK_WORDS) -> DataFrame:
    """id, block, matches (query_id, offset, bit_error, votes; by query_id): for each recording all queries that it aligns with,
    itself left out. offset is the place of a common passage in the query less that in the recording.

    Both have id_column and fingerprint. Queries go in blocks of `block` recordings or `words` words, each an index that every task holds,
    and all recordings stream past; a long one is held against the index a slice at a time. A row's list is one block's, so that it is bounded too: every recording has a row for block 0, with an empty list
    where nothing aligns, and one for each further block in which something does.
    Cases: no fingerprint matches nothing; rows without an id are left out; a row that repeats an id is a match of its own.
    """
    spark = recordings.sparkSession
    out, held = None, []
    schema = "id long, block int, matches array<struct<query_id:long,offset:int,bit_error:double,votes:int>>"

    def one(rows: list[tuple[int, list[int]]], number: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [np.array(r[1], np.int32).view(np.uint32) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for b in batches:
                ids, lists, n = [], [], 0
                for i, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    w = words.values.to_numpy().astype(np.int32).view(np.uint32) if words.is_valid else np.empty(0, np.uint32)
                    q, off, error, votes = (x.tolist() for x in index.match(w, i))
                    if q or not number:
                        ids.append(i)
                        lists.append(sorted(zip(q, off, error, votes, strict=True)))
                        n += len(q)
                    if n >= ROWS:
                        yield batch(ids, lists)
                        ids, lists, n = [], [], 0
                yield batch(ids, lists)

        def batch(ids: list[int], lists: list[list[tuple]]) -> pa.RecordBatch:
            flat = [dict(zip(("query_id", "offset", "bit_error", "votes"), m, strict=True)) for x in lists for m in x]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            columns = [pa.array(ids, pa.int64()), pa.array([number] * len(ids), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat, _MATCH))]
            return pa.RecordBatch.from_arrays(columns, names=["id", "block", "matches"])

        rows_in = recordings.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), "fingerprint")
        return rows_in.mapInArrow(tidy(run), schema)

    number = size = 0
    for r in queries.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), "fingerprint").toLocalIterator():
        held.append((r[0], r[1] or []))
        size += len(r[1] or [])
        if len(held) == block or size >= words:
            found = materialise(one(held, number), "matches")
            out, held, number, size = found if out is None else out.unionByName(found), [], number + 1, 0
    if held or out is None:
        found = one(held, number)
        out = found if out is None else out.unionByName(found)
    return out


def search(recordings: DataFrame, queries: DataFrame, id_column: str, block: int = BLOCK) -> DataFrame:
    """query_id, id, offset, bit_error, votes: align() as a row for each match."""
    rows = align(recordings, queries, id_column, block).select("id", F.inline("matches"))
    return rows.select("query_id", "id", "offset", "bit_error", "votes")


def best(matches: DataFrame, top: int = TOP) -> DataFrame:
    """A report of matches: for each query the `top` of least bit error (ties by id), with their rank."""
    order = Window.partitionBy("query_id").orderBy("bit_error", "id", "offset")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def render(vector: list[float] | None) -> np.ndarray:
    """A stand-in recording of a vector: one note for each number, its pitch among 24 semitones by the number's size."""
    if not vector:
        return np.empty(0)
    v = np.nan_to_num(np.array(vector, float))
    note = np.clip(np.round(12 + v / (v.std() + 1e-9) * 4), 0, 24)
    f = np.repeat(220.0 * 2 ** (note / 12), HOP)
    phase = 2 * np.pi * np.cumsum(f) / RATE
    return np.sin(phase) + 0.4 * np.sin(2 * phase)
