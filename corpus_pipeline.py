"""A training-data pipeline over ``documents``: language ID, near-duplicate removal, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; the result is written as Parquet
and read again as the next stage's ``docs``. All stages but the last return the columns of documents. Stages that hand
texts to Python write their result themselves, for only while ``materialise`` writes are the batches of texts kept small.

Nulls, ties and odd rows: documents whose text is null, empty or without letters go in the first stage. Rows that repeat a
doc_id stay or go together, equal texts under different doc_ids leave the smallest; a null doc_id is never a copy. A null
source is a source of its own; ties of keys in mixing go by size, then doc_id. Texts of any length are worked on whole. An
empty table gives an empty table. Further columns of a table are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywork.llm._spark import materialise, remove_tables, written_tables
from quaywork.llm.bpe import bpe_encode
from quaywork.llm.language_id import identify, train
from quaywork.llm.mixing import mix, repeated, words_of
from quaywork.llm.ngram_join import one_of_each
from quaywork.llm.queries import LABEL_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Word n-grams and percent of likeness of near copies.
WIDTH, PERCENT = 5, 80
#: Weights of the sources in code point order, repeating, and the share of all words that the mix has.
SOURCE_WEIGHTS, SHARE = [5, 2, 1], 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language's character model accepts, and those without letters."""
    return materialise(identify(docs, train(docs), tuple(COLUMNS)).where("not rejected").select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return one_of_each(docs.select(COLUMNS), WIDTH, PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources stand at their weights, those of better quality labels first."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    quality = F.when(F.col("label") == 0, LABEL_WEIGHTS[0]).when(F.col("label") == 1, LABEL_WEIGHTS[1]).otherwise(1.0)
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"))  # so that the join moves no texts
    weighted = sized.join(labels, "doc_id", "left").withColumn("quality", quality)
    return repeated(docs.select(COLUMNS), mix(weighted, SOURCE_WEIGHTS, SHARE, quality="quality", size="size"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids, the BPE encoding of each whole text."""
    coded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("doc_id", "lang", "source"))
    return materialise(coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]
#: Stages whose result is a scratch table already.
WRITTEN = (language_id, bpe)

#: Character models and BPE can't be said in SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents, as a scratch table; what else they wrote goes when a result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written_tables()
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage not in WRITTEN:
            docs = materialise(docs)
        remove_tables(spark, [t for t in written_tables()[:-1] if t not in before])
    return docs
