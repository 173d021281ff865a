"""Five stages from raw documents to a mixed training sample.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all that its predecessor
kept; all but the last return these columns. Each stage's result is written and read again before the next one.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.llm import decontaminate, langid, line_dedup, mixing, near_copies
from trustfold.llm.common import bound_batches, ensure_checkpoint_dir


def stage(function):
    """A stage in a session whose Arrow batches are bounded by bytes."""

    @functools.wraps(function)
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return function(spark, docs, sf_dir)

    return of


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language model, trained on the labelled ones, rejects; the others go on with the predicted language as ``lang``.

    Null, empty and letterless texts are rejected, repeated rows are judged alike, very long texts are read whole, and columns of any other name pass through.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    asked = langid.identify(docs.select(F.struct("*").alias("doc"), "text"), model)
    return asked.where("not rejected").select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"doc.`{c}`") for c in docs.columns])


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat an earlier line; a document goes if that leaves nothing but white space of it.

    Null and empty texts stay as they are, repeated rows are treated alike, rows without an id come last in order, very long texts are read whole, and
    columns of any other name pass through.
    """
    kept = line_dedup.dedup_lines(docs.select(F.struct("*").alias("doc"), "doc_id", "text"))
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the least id: texts whose SimHash fingerprints differ in three bits or fewer, and texts
    that these miss but whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Null and empty texts are one group, rows without an id stay, of rows that repeat an id the one with the least text stays; see simhash and near_copies.
    """
    return near_copies.keep_first(docs)


@stage
def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none, repeated rows go or stay together; see decontaminate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample to tempered source, language and topic weights; adds the sampling probability and topic. Null values are a value of their own, and texts without a word are kept; see mixing."""
    mixed = mixing.mix(docs).where("mix_keep")
    return mixed.select(*docs.columns, F.col("mix_topic").alias("topic"), "n_tokens", F.round("mix_prob", 6).alias("prob"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]

#: Language ID, edit joins and fingerprints are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES):
        function(spark, docs, sf_dir).write.parquet(f"{base}/{number}-{name}")
        docs = spark.read.parquet(f"{base}/{number}-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
