"""Line dedup: two Bloom filters find suspected repeats; only those shuffle, for exact confirmation.

1. Every task folds the key hashes of its lines into bit positions, seen once and seen twice (a position is the
   sparse form of a filter's set bit). Merging by segment: a bit is in the second filter if any task saw it twice
   or two tasks saw it once. A key in two documents has all its bits in the second filter: no repeat is missed.
2. A second scan emits (key digest, doc_id) only for keys that the second filter suspects. A grouped min / max
   (combined before the shuffle, so a hot line is one row a task) confirms keys in two documents and picks the first.
3. Suspects meet the confirmed keys (hot ones are broadcast). The drops go to where texts are read: they are written by chunks of
   rows of a file, and the last scan looks them up by place (module placed). Whole texts never shuffle. Of a table without
   places, that is one not read from Parquet, documents are joined with their drops.

The filters are sized from a count of all lines, up to bloom.MAX_FILTER_BYTES. Of more lines than these have bits for, more
are suspects: 24 bytes shuffled for each, which is what the exact steps take without any filter.
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
from tidestat.llm.common import LOWER, SPACE, code_points, fresh, join_hot, map_rows, materialise, n_chars_of, raw, short_reads, strings, tidy

MIN_LENGTH = 10


def keys_of(text: bytes | None, min_length: int = MIN_LENGTH) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text (null or empty: one empty line), and each one's key or None where it is too short."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip(SPACE) for x in (text or b"").translate(LOWER).split(b"\n")]
    return lines, [
        k if len(k) >= 4 * min_length or (len(k) >= min_length and code_points(k) >= min_length) else None for k in keys
    ]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _digests(keys) -> np.ndarray:
    """An (n, 2) array of 128-bit digests."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


def _suspects(docs: DataFrame, lines: int, min_length: int, doc_id: str, text: str, place: list[str]) -> DataFrame:
    """h1, h2, doc: distinct suspected keys of each row, with its file and row where `place` names their columns."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield _hashes([k for t in raw(b.column(0)) for k in {k for k in keys_of(t, min_length)[1] if k is not None}])

    suspected = bloom.repeated(docs.select(text), hashes, lines)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owner = [], []
            for i, t in enumerate(raw(b.column(0))):
                own = {k for k in keys_of(t, min_length)[1] if k is not None}
                keys += own
                owner += [i] * len(own)
            if not keys:
                continue
            at = np.flatnonzero(suspected(_hashes(keys)))
            d = _digests([keys[i] for i in at]).view(np.int64)
            of = pa.array([owner[i] for i in at], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *(b.column(i).take(of) for i in range(1, b.num_columns))],
                names=["h1", "h2", "doc", "file", "row"][: 1 + b.num_columns],
            )

    rows = docs.where(F.col(doc_id).isNotNull()).select(text, F.col(doc_id).cast("long"), *place)
    return rows.mapInArrow(tidy(probe), "h1 long, h2 long, doc long" + (", file long, row long" if place else ""))


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated lines removed, and n_lines, n_dropped (these replace columns of the same name).

    A line's key is the line stripped of white space with A-Z in lower case. A key of at least min_length code
    points that is found in two documents or more loses all its lines but those in the document of the smallest id.
    Cases: null or empty text is one empty line (text becomes empty); a key twice in one document only is kept;
    rows that share a doc_id are one document; a row without doc_id keeps its lines and holds none;
    an empty table gives an empty table; other columns pass through; n_chars, if present, follows the new text.
    """
    docs = docs.drop("n_lines", "n_dropped")
    short_reads(docs.sparkSession)
    newlines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.sum(newlines)).first()[0] or 0
    found = placed.with_places(docs)
    located, *place = found or (docs,)
    suspects = materialise(_suspects(located, lines, min_length, doc_id, text, place), "line-suspects")
    confirmed = suspects.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    confirmed = materialise(confirmed.where("first < last").drop("last"), "line-keys")
    drops = join_hot(suspects, confirmed, ["h1", "h2"], "n", suspects.count()).where("doc != first")
    facts = placed.write(drops.select("file", "row", "doc", F.col("h1").alias("value")), "line-drops") if place else None
    c_doc, c_drop = fresh(located, "__doc", "__drop")
    if facts:
        given = [*place, c_doc]
        joined = located.withColumn(c_doc, F.col(doc_id).cast("long"))
    else:
        lists = drops.groupBy(F.col("doc").alias(c_doc)).agg(F.collect_set("h1").alias(c_drop))
        # Drops are the smaller side in any partition (8 bytes a line dropped, of MIN_LENGTH or more): hashed, texts need no sort.
        joined = docs.join(lists.hint("shuffle_hash"), F.col(doc_id).cast("long") == F.col(c_doc), "left").drop(c_doc)
        given = [c_drop]

    chunk = placed.CHUNK

    def make():
        reader = placed.Reader(facts, chunk) if facts else None

        def dropped(b: pa.RecordBatch) -> list:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in given]
            return columns[0] if reader is None else [() if d is None else reader.values(f, r, d).tolist() for f, r, d in zip(*columns, strict=True)]

        def each(b: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            out, n_lines, n_dropped = [], [], []
            for t, drop in zip(texts, dropped(b), strict=True):
                if not drop:
                    out.append(t or b"")
                    n_lines.append((t or b"").count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {x & 0xFFFFFFFFFFFFFFFF for x in drop}
                parts, keys = keys_of(t, min_length)
                kept = [x for x, k in zip(parts, keys, strict=True) if k is None or xxhash.xxh3_128_intdigest(k) >> 64 not in gone]
                out.append(b"\n".join(kept))
                n_lines.append(len(parts))
                n_dropped.append(len(parts) - len(kept))
            return {text: strings(out), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}

        return each

    fields = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    done = map_rows(joined, text, [*fields], make, drop=tuple(given))
    return n_chars_of(done, text)
