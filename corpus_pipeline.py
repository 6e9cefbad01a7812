"""A training corpus from raw documents: four stages, each of which calls one operator.

1. toxicity: documents with a predicted severity grade of 1 or more go.
2. language: documents go in which there is no letter; or for which none of the languages that the
   model has learned has a calibrated probability of at least 0.35, or fewer than half of whose n-grams
   occur in its training documents (texts under 40 letters stay, since they say too little). Where
   nothing was learned, documents with letters stay.
3. near_duplicates: of each group of documents linked by a Jaccard index of 0.8 or more on
   five-word shingles, the one with the smallest doc_id stays.
4. packing: the rest is packed into sequences of at most 4096 tokens; one row per piece.

Stages 1 to 3 return the columns of documents. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import langid, lsh_forest, packing, toxicity
from tidewell.llm.common import materialize, table
from tidewell.llm.registry import tokenizer_path

#: The packed sequences can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.without_unknown(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.without_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
