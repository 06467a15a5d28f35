"""Corpus pipeline: documents in, packed sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; every result is written as
Parquet to the shared folder and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.

Defined cases, of every stage: null text counts as empty text and is judged like it; texts of any
length are read whole; extra columns are dropped, whatever their names; an empty table gives no
rows. Rows that repeat (with their ids) are judged alike by the classifier, are documents of their
own for the line counts, are one group for the near copies (one row stays) and draw alike when
sources are mixed; packing places every row, and ``row_id`` tells the copies of a document apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotry.llm import jaccard, lines, mixing, packing, quality
from depotry.llm.queries import MIX_SEED, MIX_WEIGHTS, TOKENIZER
from depotry.llm.shared import Workspace, crc_of_id

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages learn from labels, so SQL cannot express the whole.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, the length brought up to date."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels that are not held out."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_of_id("doc_id") % 4 != 2))
    return quality.score(docs, model, keep_text=True).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold."""
    kept = lines.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return _documents(kept.withColumnRenamed("kept", "text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return jaccard.representatives(docs.select(*COLUMNS), n=5, num=80, den=100).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the sources' weights, in shuffled order."""
    return mixing.mix(docs.select(*COLUMNS), MIX_WEIGHTS, MIX_SEED).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences, with their tokens; ``row_id`` is a copy's own."""
    return packing.pack(docs, TOKENIZER, max_tokens=2048, end_id=0, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``: each piece with its place and its tokens."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed`` without the tokens: places and digests."""
    return packed(spark, sf_dir).drop("ids")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence; at most ``max_tokens`` of them in a row."""
    pieces = packed(spark, sf_dir).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return pieces.select("sequence_id", F.flatten("pieces.ids").alias("ids"))
