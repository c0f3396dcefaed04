"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text, compared over word windows.

Each dictionary is trained (zstandard's own dictionary trainer) on texts of its class alone: the ordinary one on whole
ordinary texts, the toxic one on what toxic texts do not share with ordinary ones, their stretches of byte 8-grams that the
class has several times as often. A text is cut in windows of whole words; the margin of a window is by how many bytes the
toxic dictionary shortens it more than the ordinary one does, and more than none does. Thresholds on margins are
calibrated on folds that their dictionaries have not seen, with a logistic link.

Training takes a bounded sample of labelled rows (MAX_ROWS rows, MAX_BYTES of text) to one task, and only the model, a few KB,
to the driver; scoring reads whole texts on the executors.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from tidestat.llm.common import map_rows, small_batches, spread, tidy

#: The sample of labelled rows: the first MAX_ROWS by hash, and of these all that still fit in MAX_BYTES of text, in that order.
MAX_ROWS = 8_000
MAX_BYTES = 48 << 20
#: Bytes of a window of whole words (a longer word is a window). In longer windows the compressor codes what no dictionary
#: holds by Huffman trees of their own, and lengths tell less: on held-out rows 24 bytes are the best of 24, 30, 36, 62 and 140.
WINDOW_BYTES = 24
#: Bytes of each dictionary's content.
CONTENT_BYTES = 2 << 10
#: Bytes of text that a dictionary is trained on: whole texts at even steps through the sample (the trainer takes some 20 times as much memory).
TRAIN_BYTES = 6 << 20
#: Bytes that the trainer puts before a content (coding tables, not used here: they would tell the classes apart by letters).
_TABLES = 300
#: Stands after each window and at the end of each dictionary, so that even a short window is coded by matches (the
#: compressor looks for none in the last eight bytes).
LEAD = bytes(33 + (i * i * 7 + i * 13) % 94 for i in range(40))
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
PREDICT_AT = 0.7
FOLDS = 5
#: Rows whose word pairs have this Jaccard similarity are near copies; BANDS pairs of least hashes miss one in 20,000 of them.
NEAR, BANDS = 0.8, 10
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[bytes]:
    return " ".join(_WORD.findall(text.lower())).encode().split(b" ") if text else []


def plain(text: str) -> bytes:
    """The words of a text between single blanks, with one before and after."""
    return b" " + b" ".join(words_of(text)) + b" "


def windows(words: list[bytes], size: int = WINDOW_BYTES) -> list[bytes]:
    """Whole words between blanks, as many as fit in `size` bytes (one at least)."""
    out, now, n = [], [], 1
    for w in words:
        if n + len(w) >= size and now:
            out.append(b" %b " % b" ".join(now))
            now, n = [], 1
        now.append(w)
        n += len(w) + 1
    if now and now != [b""]:
        out.append(b" %b " % b" ".join(now))
    return out


class Compressor:
    """Compressed lengths under one dictionary, without headers. Lengths of repeated windows are remembered, up to a bound."""

    def __init__(self, content: bytes):
        params = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=16, hash_log=14, chain_log=14, search_log=6, min_match=6,
            strategy=zstd.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        data = zstd.ZstdCompressionDict(content + LEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        self.compress, self.known = zstd.ZstdCompressor(compression_params=params, dict_data=data).compress, {}

    def length(self, piece: bytes) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > 20_000:
                self.known.clear()
            n = self.known[piece] = len(self.compress(piece + LEAD))
        return n


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the calibration: weights over features, and the intercept."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    bias: float
    center: tuple[float, ...]
    scale: tuple[float, ...]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.toxic, self.ordinary, self.none = Compressor(model.toxic), Compressor(model.ordinary), Compressor(b"")

    def margins(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one and over none, whichever saves more; 0 at least."""
        out = np.zeros(len(pieces), np.int32)
        toxic, ordinary, none = self.toxic.length, self.ordinary.length, self.none.length
        for i, p in enumerate(pieces):
            n = toxic(p)
            saved = none(p) - n
            if saved > 0:
                out[i] = max(0, min(saved, ordinary(p) - n))
        return out

    def features(self, texts: Iterable[str]) -> np.ndarray:
        return np.array([features(self.margins(windows(words_of(t)))) for t in texts]).reshape(-1, N_FEATURES)

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        m = self.model
        z = (self.features(texts) - np.array(m.center)) / np.array(m.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(m.weights) + m.bias, -30, 30)))


N_FEATURES = 3 * len(THRESHOLDS) + 2


def features(margins: np.ndarray) -> list[float]:
    """For each threshold the log count and the share of windows at or beyond it, and whether there is one; the greatest margin;
    the log of windows."""
    n = len(margins)
    over = [int((margins >= t).sum()) for t in THRESHOLDS]
    return [*(np.log1p(k) for k in over), *(k / max(1, n) for k in over), *(float(k > 0) for k in over), float(min(12, margins.max(initial=0))), float(np.log1p(n))]


def _grams(text: bytes) -> np.ndarray:
    """The 8-grams of a text, each as one number, by place."""
    if len(text) < 8:
        return np.empty(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)).view("<u8").ravel()


def own_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Of each toxic text, its stretches of 8-grams that toxic texts hold far more often than ordinary ones, joined; texts
    without any are left out."""
    if not toxic:
        return []
    gram, of_toxic = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic]), return_counts=True)
    often = of_toxic >= max(4, 0.015 * len(toxic))
    gram, of_toxic = gram[often], of_toxic[often]
    of_ordinary = np.zeros(len(gram), np.int64)
    for t in ordinary:
        of_ordinary += np.isin(gram, _grams(t))
    chance = (of_ordinary + 0.5) / max(1, len(ordinary)) * len(toxic)
    telling = gram[(of_toxic >= 8 * chance) & (of_toxic - chance >= 5 * np.sqrt(chance + 0.5))]
    out = []
    for t in toxic:
        at = np.flatnonzero(np.isin(_grams(t), telling))
        if len(at):
            cover = np.zeros(len(t) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 8, -1)
            out.append(np.frombuffer(t, np.uint8)[np.cumsum(cover)[:-1] > 0].tobytes())
    return out


def _some(samples: list[bytes], most: int) -> list[bytes]:
    """Samples at even steps, as many as fit in `most` bytes; a longer one is passed over."""
    step = max(1, -(-sum(map(len, samples)) // most))
    out, size = [], 0
    for s in (s for k in range(step) for s in samples[k::step]):
        if size + len(s) <= most:
            out.append(s)
            size += len(s)
    return out


def dictionary(samples: list[bytes], size: int = CONTENT_BYTES, segment: int = 16) -> bytes:
    """The content of a dictionary trained on samples, `size` bytes at most, made of segments of so many bytes; all of the samples where they are too few to train on."""
    samples = _some(samples, TRAIN_BYTES)
    whole = b"".join(samples)
    if len(samples) < 8 or len(whole) < 4 * size:
        return whole[-size:]
    try:
        return zstd.train_dictionary(size + _TABLES, samples, k=segment, d=8).as_bytes()[-size:]
    except zstd.ZstdError:  # samples too alike to train on
        return whole[-size:]


def _marks(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct word pairs, sorted; of the words where there is no pair."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(spread(h[:-1] + spread(h[1:], 3), 4) if len(h) > 1 else h)


def _distinct(rows: Iterable[tuple[str, int]]) -> list[tuple[bytes, int]]:
    """Plain texts and labels of the rows, without near copies: a row goes only if a kept row of the same label has a Jaccard
    similarity of word pairs of NEAR at least. Bands of least hashes propose kept rows, whole sets of pairs decide."""
    bands: dict[tuple[int, int, int, int], list[int]] = {}
    sets: list[np.ndarray] = []
    out = []
    for t, y in rows:
        h = _marks(words_of(t))
        least = [int(spread(h, seed).min()) if len(h) else 0 for seed in range(2 * BANDS)]
        keys = [(y, i, least[2 * i], least[2 * i + 1]) for i in range(BANDS)]
        for other in {o for k in keys for o in bands.get(k, ())}:
            both = len(np.intersect1d(h, sets[other], assume_unique=True))
            if both >= NEAR * (len(h) + len(sets[other]) - both):
                break
        else:
            for k in keys:
                bands.setdefault(k, []).append(len(out))
            sets.append(h)
            out.append((plain(t), y))
    return out


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """A model from (text, label) rows. In turn each FOLDS-th part calibrates on dictionaries of the others, and the calibrations
    join; the final dictionaries come from all rows. One class only: a constant score of that class's side."""
    kept = _distinct(rows)  # copies count once

    def dictionaries(part: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
        toxic, ordinary = [t for t, y in part if y], [t for t, y in part if not y]
        return dictionary(own_stretches(toxic, ordinary)), dictionary(ordinary)

    def raw_features(part: list[tuple[bytes, int]], pair: tuple[bytes, bytes]) -> np.ndarray:
        s = Scorer(Model(*pair, (), 0.0, (), ()))
        return np.array([features(s.margins(windows(t.split()))) for t, _ in part]).reshape(-1, N_FEATURES)

    labels = {y for _, y in kept}
    if len(labels) < 2:
        return Model(b"", b"", (0.0,) * N_FEATURES, {1: 6.0, 0: -6.0}.get(next(iter(labels), -1), 0.0), (0.0,) * N_FEATURES, (1.0,) * N_FEATURES)
    x, y = [], []
    for fold in range(FOLDS):
        x.append(raw_features(kept[fold::FOLDS], dictionaries([r for i, r in enumerate(kept) if i % FOLDS != fold])))
        y += [r[1] for r in kept[fold::FOLDS]]
    x, y = np.concatenate(x), np.array(y, float)
    center, scale = x.mean(0), x.std(0) + 1e-6
    w, b = _logistic((x - center) / scale, y)
    return Model(*dictionaries(kept), tuple(w.tolist()), float(b), tuple(center.tolist()), tuple(scale.tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, held_out: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from labelled documents that `held_out` (SQL over doc_id) does not keep back.

    The sample is the max_rows least by a hash of doc_id; in that order, a row whose text no longer fits in max_bytes is
    passed over and later ones go on. Labelled texts of which none fits are an error. Rows with a null label or doc_id are left out; a document labelled twice counts twice.
    """
    known = labels.where(f"toxic is not null and doc_id is not null and not ({held_out})")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"))
    chosen = known.select("doc_id", F.col("toxic").cast("int").alias("y")).orderBy(*order).limit(max_rows).collect()
    if not chosen:
        return fit([])
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int"))  # at most max_rows
    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = {r.doc_id: r.n for r in found.join(ids.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    keep, size = [], 0
    for r in chosen:
        n = sizes.get(r.doc_id, 0)
        if size + n <= max_bytes:
            size += n
            keep.append((r.doc_id, r.y))
    if not any(i in sizes for i, _ in keep) and sizes:
        raise ValueError(f"none of the {len(sizes)} labelled texts fits in {max_bytes} bytes")
    small_batches(spark)
    kept = F.broadcast(spark.createDataFrame(keep, "doc_id long, y int"))
    sample = found.join(kept, "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))  # at most max_bytes
        model = fit((t, y) for _, t, y in rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(tidy(run), "model binary").first()[0])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int, 1 if score >= PREDICT_AT); both replace columns of that name.

    Null and empty texts have no windows and get the score of a text without any margin; long texts are read whole; an empty
    table gives an empty table; other columns pass through and are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def each(_: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            s = scorer.scores((t or b"").decode() for t in texts)
            return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= PREDICT_AT).astype(np.int32))}

        return each

    return map_rows(docs.drop("score", "predicted"), text, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], make)


__all__ = ["Model", "Scorer", "fit", "score", "train"]
