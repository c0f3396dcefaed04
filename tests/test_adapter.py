"""The stand-in decoder: calls of whole batches against a loop over letters, and its working memory."""

import tracemalloc

import pyarrow as pa
import pytest

from tidestat.sources import adapter


def plain(texts, read_id, left0):
    names = {v: k for k, v in adapter.LETTERS.items()}
    return [
        [dict(pos=p, mod=names[c], prob=(p * p * 31 + p * 17 + i * 11) % 256, gpos=x + p if p % 10 else None) for p, c in enumerate(t, 1) if c in names]
        for t, i, x in zip(texts, read_id, left0, strict=True)
    ]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_calls_of_any_slices(monkeypatch, size):
    monkeypatch.setattr(adapter, "SLICE", size)
    texts = ["", "aoi", "éa 中o𝄞i", "x" * 40, "", "a" * 30 + "é" + "o" * 5]
    ids, left = [5, 6, 7, 8, 9, 10], [0, 97, 194, 3, 4, 5]
    for kind in (pa.string(), pa.large_string()):
        got = adapter._calls(pa.array(["io", *texts], kind).slice(1), pa.array(ids), pa.array(left))
        assert got.to_pylist() == plain(texts, ids, left)
    assert adapter._calls(pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())).to_pylist() == []


def test_working_memory_of_a_batch():
    def peak(rows):
        batch = pa.array(["the oak is a tree " * 250] * rows), pa.array(range(rows)), pa.array(range(rows))
        tracemalloc.start()
        try:
            adapter._calls(*batch)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(10)
    assert peak(4000) < 4 * 18_000_000  # the size of the texts: places of all calls, and the rest of one slice


def test_batches_are_bounded_while_decoding_only(spark, small):
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(batch)
    seen = []
    kept, adapter.stored = adapter.stored, lambda df, name: seen.append(spark.conf.get(batch)) or f"{small}/none"
    try:
        adapter.decoded(spark, f"{small}/.")
    finally:
        adapter.stored = kept
        adapter._DECODED.pop((spark.sparkContext.applicationId, f"{small}/."), None)
    assert seen == [str(adapter.BATCH)] and spark.conf.get(batch) == before


def test_a_file_of_reads_has_many_row_groups(spark, tmp_path):
    """A stream takes two files a batch: their row groups are what its tasks share."""
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(12_000).selectExpr("id", "transform(sequence(1, 200), i -> xxhash64(id, i)) v").coalesce(1)
    found = glob.glob(adapter.stored(rows, "groups").replace("file://", "") + "/*.parquet")
    assert len(found) == 1 and pq.ParquetFile(found[0]).num_row_groups > 1
