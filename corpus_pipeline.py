"""A corpus pipeline of five stages over `documents`: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, cuckoo, language, mixing, simhash
from veilspark.llm.common import col, ensure_checkpoint_dir, fresh, table
from veilspark.llm.queries import RANKS, WEIGHTS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (null texts, texts without a letter); the others take the one predicted.

    Where no row tells its language there is nothing to predict: texts with a letter stay as they are.  Each row is
    judged by itself, repeated rows and null ids too; an empty table stays empty; other columns keep their names.
    """
    model = language.fit_language(docs, F.lit(True))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang_pred", "lang_score")
    found = language.identify(docs, model, lang_col=lang, score_col=score).where(F.col(lang) != language.UNDETERMINED)
    return found.withColumn("lang", F.col(lang)).select(*[col(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the document with the largest id stays (null ids last), and one
    row of it where rows repeat; null counts as empty.  An empty table stays empty; columns are as they were."""
    return cuckoo.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike by shingles of five words (Jaccard similarity 0.8 or more), the smallest id stays (null ids
    last), and one row of it where rows repeat; texts without a word are alike.  An empty table stays empty; columns are
    as they were."""
    return simhash.drop_near_duplicates(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, taken or repeated, so that sources come near their target weights.

    Rows are drawn each by itself, also where ids repeat or are null; null is a source, the last one; a null text has no
    words.  An empty table stays empty; columns are as they were.
    """
    return mixing.take(docs, WEIGHTS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, `ids` and `n_tokens` (under other names, an underscore before, if the table
    has these); each row's ids are decoded again and held against its text.

    Null and empty texts have no ids; repeated rows are rows each; an empty table stays empty.
    """
    ids, n_tokens = fresh(docs, "ids", "n_tokens")
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids_col=ids, verified=True)
    return coded.withColumn(n_tokens, F.size(ids).cast("long"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

#: SQL can express neither the language model nor the cube method's draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each returns is written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
