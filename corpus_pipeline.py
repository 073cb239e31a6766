"""A corpus pipeline of five operators over ``documents``; each stage is written as Parquet and reread.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns the next stage's
documents (the columns of ``documents``), the last one the encoded documents.

Columns that ``documents`` has beside doc_id, text, lang and source are carried along, whatever their names.  An empty
table passes all stages empty; what becomes of nulls, empty texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillet.llm.common import table
from rillet.llm.exact_dedup import keep_first
from rillet.llm.minhash_dedup import keep_one_of_each
from rillet.llm.quality_rules import keep_good
from rillet.llm.sentencepiece_codec import encode_decode_digests
from rillet.llm.source_mix import keep_drawn
from rillet.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules or their host's failure rate reject go.

    Null and empty texts have no words and go; a null source is a host of its own.  An id on several rows goes with all
    of them if one is rejected; rows without an id have no verdict to join and stay.
    """
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the smallest doc_id stays; null counts as the empty text.

    Of repeats of the row that stays one is left.  Rows without an id come after all others, and stay only where no
    other row has their text.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8).

    It is the one with the smallest id.  Texts without words are near to nothing and stay, as do rows without an id;
    rows that share an id are one document.
    """
    return keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that tokens meet the target shares of sources, languages and topics.

    Null sources and languages are a class of their own; texts without tokens are drawn like their cell's others;
    equal ids are drawn alike.
    """
    return keep_drawn(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, bytes, tokens, a digest of the ids and whether decoding gave back the text.

    A null text has no bytes and no ids; repeated rows each get a row.
    """
    return encode_decode_digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mix", mixed),
    ("sentencepiece", encoded),
]

#: SentencePiece ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
