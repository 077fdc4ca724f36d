"""From documents to token records: classify, drop near copies, decontaminate, mix, write.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents. The mixture is an order of rows, which the files of its
stage keep; the last stage writes records in the order of file and row in which it finds its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, minhash, mixing, quality, tokens
from tidemark.llm._shared import forget_since, materialise, written
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays; rows of one id count as one document."""
    found = minhash.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is little else goes. n_chars counts what is left."""
    clean = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.in_mixed_order(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in the order of the files read, or of ids if ``docs`` is not read from files."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")  # beyond five digits names do not sort as numbers do
    order = [number, name, F.col("_metadata.row_index")] if docs.inputFiles() else None
    return tokens.token_records(docs, tokenizer_path(), order=order)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmarks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A trained model and a tokenizer are not SQL; tests/llm holds the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; once a stage's result is stored, what was stored before it and within it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
        forget_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
