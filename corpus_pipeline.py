"""A training corpus from `documents`: identified languages, one of each group of near copies, no personal
data, sources mixed to their weights, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of docs. A stage works on all rows that its
predecessor kept, at any size. Nulls in any column, empty and very long texts, ties, repeated rows, an empty
table and further columns of any names are as the stage's operator says: identification drops texts that are
null, empty or without a letter; of the others each stage keeps every row that it has no reason to drop.

As an application the pipeline sets the session's Arrow batches to ARROW_ROWS rows and leaves them so, since a stage's
frame runs after its function has returned: stages that follow each other in the same executors leave little memory
behind. Results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import jaccard_join, langid, mixing, packing, pii
from tallyforge.llm.common import checkpointed
from tallyforge.llm.registry import PIECES_FILE, TOKENIZER_FILE, tokenizer_path

ARROW_ROWS = 2000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is undetermined (null, empty and letterless texts) or unsure; repeated rows are decided each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return langid.keep_identified(docs, langid.read_pieces(tokenizer_path(PIECES_FILE)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of five-word shingles at 0.8 or more connect, that of the smallest id.

    Texts without words link with nothing; rows of one id are decided by their own texts.
    """
    return jaccard_join.keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by its kind; null and empty texts stay as they are, repeated rows are redacted each."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as their source's target asks for; texts without words count nothing, a null source is a source."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of at most 4096; a null or empty text has its end alone, repeated rows are packed each."""
    with open(tokenizer_path(TOKENIZER_FILE), encoding="utf-8") as f:
        return packing.pack(docs.select("doc_id", "text"), f.read())


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the models of languages, the sampling and the packing; tests hold run() against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each stage's result written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
