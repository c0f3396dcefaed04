"""Five stages that turn documents into training tokens. Each reads what the one before it kept, written as Parquet.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidestat.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tidestat.llm.common import materialise
from tidestat.llm.queries import HELD_OUT, tokenizer


def _shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs, those that work has no business with under other names meanwhile: whatever they are
    called, in any case, they meet none of its own."""
    names = {c: f"__{i}_kept" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    done = work(docs.withColumnsRenamed(names)).select(*[names.get(c, c) for c in docs.columns])
    return done.withColumnsRenamed({v: k for k, v in names.items()})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (predicted 1). The model learns from labelled rows of docs."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), HELD_OUT)
    return _shielded(docs, lambda d: toxicity.score(d, model).where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds go; documents stay, even those of repeated lines only (with an empty text)."""
    return _shielded(docs, line_dedup.dedup_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: word 5-grams, Jaccard 0.8 or more, linked transitively."""
    return _shielded(docs, lambda d: jaccard_join.dedup_documents(d, shingle=5, percent=80))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from texts, and documents that consist of them."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _shielded(docs, lambda d: decontaminate.decontaminate(d, benchmark))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with tokens (the byte-level BPE ids of each text), n_tokens, ids_sha256, and decoded_sha256, the
    digest of what the ids decode to (that of the text). Columns of those names are replaced."""
    return bpe.encode(docs, tokenizer(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", to_tokens),
]

#: Not expressible: the toxicity model, the tokens. The tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
