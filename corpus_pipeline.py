"""The corpus pipeline: stages over documents, each fed with what the one before kept.

Every stage takes and returns the columns of documents; the last adds the token ids. Whole texts are read, however
long; empty tables give empty tables; other columns travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import language, mixing, ngram_join, sentence_pieces, substrings
from marlspike.llm._shared import drop_written, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents found to be in a language of the model, by text, declared language and source.

    A null or empty text without a declared language stays if the prior of its source favours one language.
    Repeated rows are judged alike.
    """
    found = language.identify(docs, language.fit(docs), "text", F.col("lang"), F.col("source"))
    return found.where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by the Jaccard similarity of their 2-word shingles.

    The smallest id stays, null ids last; of rows that repeat id and text one does. Documents without words stay.
    """
    return ngram_join.one_of_each(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that begin earlier; a document of which nothing is left goes.

    Documents without words have nothing removed and stay, a null text as an empty one. n_chars is counted anew.
    """
    out = substrings.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a row for each lap over a document that the mix takes.

    Documents without words are not taken. A null source is a source. The order of the mix is the operator's
    mix_slot, which a table with the columns of documents has no place for.
    """
    out = mixing.mix_sources(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and round_trip; a null text has no ids. Repeated rows are encoded each."""
    return sentence_pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixture", mixture),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i:
            before, docs = docs, written(out, name)
            if i > 1:
                drop_written(before)
        out = stage(spark, docs, sf_dir)
    return out
