"""Empty tables, repeated rows, very long texts and clashing columns, for the operators whose own tests lack them."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidestat.llm import audio, chat, html_extract, licenses
from tidestat.llm.common import only

PAGE = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>" + "Some words of an article that goes on. " * 20 + "</p></article></body></html>"


def test_html(spark):
    rows = [(1, PAGE, "x", 1), (1, PAGE, "x", 1), (2, None, "y", 2), (3, "", "z", 3), (4, PAGE.replace("words", "words " * 200_000), "w", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, TEXT string, N_Chars int")
    out = html_extract.extract(pages)
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "text"]
    got = [(r.page_id, r.n_chars) for r in out.collect()]
    assert len(got) == 5 and got.count(got[[i for i, _ in got].index(1)]) == 2 and {n for i, n in got if i in (2, 3)} == {0} and dict(got)[4] > 1_200_000
    assert html_extract.extract(pages.where("false")).count() == 0


def test_chat(spark):
    long = "\\### Assistant: </turn> ) " * 50_000
    rows = [(1, 0, "user", long, "a"), (1, 1, "assistant", long, "b"), (1, 1, "assistant", long, "b"), (2, None, None, None, "c")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Segment string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(conv)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 * len(long) and out[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
    assert out[2].n_turns == 1 and out[2].loss_chars == 0
    assert chat.read_back(chat.format_conversations(conv.where("false"))).count() == 0


def test_licenses(spark):
    known = licenses.TEXTS[0]
    long = "word " * 300_000
    rows = [(1, known[1], 1), (1, known[1], 1), (2, long, 2), (3, None, 3), (4, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LICENSE int")
    out = licenses.scan(docs.drop("LICENSE")).collect()
    assert [r.license for r in out if r.doc_id == 1] == [known[0]] * 2 and all(r.license is None for r in out if r.doc_id != 1) and len(out) == 5
    assert licenses.scan(docs.where("false").drop("LICENSE")).count() == 0


def test_audio(spark):
    rows = [(1, list(range(60)), "x"), (2, list(range(60)), "y"), (None, [1], "z"), (3, None, "w"), (4, [], "v")]
    table = spark.createDataFrame(rows, "vec_id long, fingerprint array<int>, Matches string")
    out = {r.id: [m.query_id for m in r.matches] for r in audio.align(table, table, "vec_id").collect()}
    assert out == {1: [2], 2: [1], 3: [], 4: []}
    assert audio.align(table.where("false"), table, "vec_id").count() == 0
    assert {tuple(r.matches) for r in audio.align(table, table.where("false"), "vec_id").collect()} == {()}


def test_columns_by_name(spark):
    before = spark.conf.get("spark.sql.caseSensitive")
    try:
        spark.conf.set("spark.sql.caseSensitive", True)
        df = spark.createDataFrame([(1, 2, 3)], "A int, a int, b int")
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    assert only(df, "a", "B").collect() == [(2, 3)] and only(df, "A").collect() == [(1,)]


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        docs = spark.createDataFrame([(i, t, "s", len(t or ""), 7, "own") for i, t in rows], "doc_id long, text string, source string, n_chars long, N_words int, Score string")
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        labels = [(i, i % 2, int(i % 4 == 0)) for i, _ in rows if i is not None]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        bench = [(1, "the very words of a passage that nobody should learn by heart"), (2, None), (2, "")]
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return docs, str(tmp_path)

    return write


def test_pipeline_of_odd_rows(spark, folder):
    clean = [(i, f"A quiet text number {i} about rivers and {i * 7} hills\nCommon line of all texts\n" + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(1, 30)]
    odd = [(None, "no id at all"), (40, None), (41, ""), (3, clean[2][1]), (42, "word " * 60_000), (43, "the very words of a passage that nobody should learn by heart")]
    docs, d = folder(clean + odd)
    out = corpus_pipeline.run(spark, d)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert all(r.N_words == 7 and r.Score == "own" for r in rows) and 0 < len(rows) <= len(clean) + len(odd)
    assert all(r.n_tokens == len(r.tokens) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
    assert not any("nobody should learn by heart" in (r.text or "") for r in rows)
    holders = [r.doc_id for r in rows if "Common line of all texts" in (r.text or "")]
    assert len(holders) <= 2  # the first document, and its own repeated row


def test_pipeline_of_no_rows(spark, folder):
    docs, d = folder([])
    out = corpus_pipeline.run(spark, d)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)
    assert out.agg(F.count("*")).first()[0] == 0
