"""The training-data pipeline: STAGES over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; other columns that docs has don't go on.

Nulls and empty tables: a stage takes an empty table and gives one. A null or empty text goes in the first stage, as it has no letters; later stages keep
such rows as their operators define it (line_dedup keeps a null text, near_dedup has null and wordless texts in one class, of which one stays, mix
takes no words of them, encode gives no ids). Null languages teach nothing, null sources are a source, null ids are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, line_dedup, mixing, sentencepiece_codec, shingle_dedup, simhash
from quern.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of so many characters can be judged; a lower score than this says it is in no learned language. A text of a few words has few n-grams, and may
#: have none that the sample to learn from holds: on sf0.1 the limit spares 3 of 10,000 documents, all below 20 characters, and no longer one scores below 0.1.
JUDGED_CHARS, LEAST_SCORE = 100, 0.1


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, judged_chars: int = JUDGED_CHARS, least_score: float = LEAST_SCORE) -> DataFrame:
    """Drops documents without a letter, and those of at least judged_chars whose n-grams no language contains.

    The languages are learned from the documents whose crc32(doc_id) mod 4 is not 2.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.in_fold(F.col("doc_id"), 4, 2)))
    found = langid.predict(docs, model)
    unknown = (F.col("lang_pred") == "und") | ((F.length("text") >= judged_chars) & (F.col("score") < least_score))
    return found.where(~unknown).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stand on over 5 % of their source's distinct texts; documents of such lines alone go.

    Copies count once: near_dedup comes later, and leaves one of them.
    """
    out = line_dedup.drop_site_lines(docs.select(*COLUMNS), copies=False)
    whole = (F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\r\n\f\x0b")) != "")
    return out.where(whole).withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class: under links of SimHash fingerprints of five-word shingles, and of shingle sets
    with a similarity of 0.8, which no radius of 64 bits finds without comparing all tiles."""
    return simhash.keep_one(docs.select(*COLUMNS), classify=shingle_dedup.with_fingerprints).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share of words; a document stands as often as it is taken."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each document, how many they are, and whether they decode to its text."""
    both = sentencepiece_codec.round_trip(docs.select(*COLUMNS), sentencepiece_codec.vocabulary())
    return both.select(*COLUMNS, "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("same"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL can't express language ID, SimHash or the encoding; tests/llm/test_pipeline.py compares every stage with plain loops on a whole table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the table documents; each stage before it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
